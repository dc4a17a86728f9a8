"""Column expressions and frame helpers that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed and carriage return: the white space of all operators here.
WHITE = " \t\n\x0b\x0c\r"
#: A word: a run of anything else.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(text, F.lit(""))


def without_white(text: Column) -> Column:
    out = text
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def id_text(doc_id: Column) -> Column:
    """A row key as text; null keys share the empty one."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def hex_bits(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of a digest, from the 1-based ``start``, as a bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def slices(batch: pa.RecordBatch, column: str, size_limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``size_limit`` bytes of text, or one longer row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > size_limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)

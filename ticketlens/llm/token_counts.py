"""Token counts through a digest cache.

A count belongs to (tokenizer digest, content digest). The job digests every text, keeps the
distinct ones, joins them to the stored counts, encodes only those that have none and appends
them to the cache; then every document takes its count from stored and new ones. A text that
occurs a million times is encoded once, and a second run over the same corpus encodes nothing.

The cache is a folder of Parquet files, one sub-folder per tokenizer digest. Appending the same
text twice (two jobs at once) is harmless: counts are read back as one per digest.

Encoding is the library's own. Pieces of this vocabulary never run across the start of a word
mark, so merges in one space-separated unit do not see the next one and a text's count is the
sum over its units; a task therefore asks the library once per distinct unit and batch. The
property is read from the vocabulary, and texts with other spacing (runs of spaces, a space at
an end, a literal word mark) are encoded whole, as are all texts where the property fails.

Defined results: null counts as the empty text, with no token; equal texts have equal counts; an
empty table gives no rows and leaves the cache as it is. Texts of any length are encoded whole.
Rows that repeat id and text (null ids included) are one miss: the cache takes one row per text.
Only the id and text columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ticketlens.llm.common import id_text, slices, text_of
from ticketlens.operators.staging import stage

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: Units remembered by one task, to bound its memory.
UNITS = 600_000

_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    """Names the tokenizer's version: a digest of its file."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    by_unit = not any(
        crossing.search(model.id_to_piece(i)) for i in range(model.vocab_size())
    ) and model.encode("a b", out_type=str) == model.encode("a", out_type=str) + model.encode(
        "b", out_type=str
    )
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        split = [
            t.split(" ") if by_unit and MARK not in t and "  " not in t and t.strip(" ") == t else None
            for t in texts
        ]
        fresh = list({u for units in split if units for u in units} - known.keys())
        if len(known) + len(fresh) > UNITS:
            known.clear()
            fresh = list({u for units in split if units for u in units})
        known.update(zip(fresh, map(len, model.encode(fresh, num_threads=1)), strict=True))
        whole = [t for t, units in zip(texts, split, strict=True) if units is None]
        rest = iter(map(len, model.encode(whole, num_threads=1)))
        get = known.__getitem__
        return [next(rest) if units is None else sum(map(get, units)) for units in split]

    return count


def _json_counter(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """Token counts of a list of texts; the model is loaded once per Python worker."""
    if name not in _COUNTERS:
        path = tokenizer_path(name)
        _COUNTERS[name] = (_json_counter if path.endswith(".json") else _piece_counter)(path)
    return _COUNTERS[name]


def _encode_misses(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
                )

    return run


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema("digest binary, n_tokens bigint").parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def count_tokens(
    docs: DataFrame,
    cache: str,
    tokenizer: str = TOKENIZER,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``cache`` is a folder all executors see."""
    spark = docs.sparkSession
    folder = f"{cache.rstrip('/')}/{tokenizer_digest(tokenizer)}"
    text = text_of(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
    )
    keys = stage(rows.select("doc_id", "n_bytes", "digest"), "token_keys")
    # One document stands for all with its digest. Its id is part of the join key, so that the
    # texts of a much-copied document do not meet in one task before all but one are dropped.
    wanted = keys.groupBy("digest").agg(F.min(id_text(F.col("doc_id"))).alias("_at"))
    stored = _stored(spark, folder)
    if stored is not None:
        wanted = wanted.join(stored.select("digest"), "digest", "left_anti")
    # Rows that repeat id and text are dropped where they are read, before the shuffle that the
    # join uses as well.
    texts = rows.select("digest", id_text(F.col("doc_id")).alias("_at"), "text").dropDuplicates(["digest", "_at"])
    misses = texts.join(wanted.hint("merge"), ["digest", "_at"]).select("digest", "text")
    counted = misses.mapInArrow(_encode_misses(tokenizer), "digest binary, n_tokens bigint")
    counted.write.mode("append").parquet(folder)
    # Of a cache of many corpora only this one's digests are grouped.
    known = spark.read.schema("digest binary, n_tokens bigint").parquet(folder)
    known = known.join(keys.select("digest").distinct(), "digest", "left_semi")
    # Written, so that a digest with very many documents can be split in the join.
    counts = stage(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token_counts")
    return keys.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def delete_cache(spark: SparkSession, cache: str) -> None:
    """Remove a cache folder; results of ``count_tokens`` do not read it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

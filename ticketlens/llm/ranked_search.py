"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks of bounded size: one row per (term, block) holds the block's documents with
the term, their occurrences and their lengths. Terms are owned by successive stages, rarest first
(``SHARES``). Items travel in bundles of ``BUNDLE``: a bundle and a block carry a sparse set of accumulators,
(item, document) -> score, from stage to stage. At each stage a cogroup brings the bundle to the owner of the
stage's terms in that block; the owner adds its integer contributions and sends the bundle on. The last
stage adds its own and selects the k best of each item in the block; a ranking over the blocks' best follows.
Nothing is pruned: every document with a term of the item is scored.

What a task holds is bounded by a block (``BLOCK_BYTES`` of text or one longer document, ``BLOCK_DOCS``
documents) and ``BUNDLE`` times ``BLOCK_DOCS`` accumulators, however frequent a term or large the corpus. Terms
of no item are left out while the index is built if the items' terms fit in ``VOCABULARY_BYTES`` (measured);
beyond that all terms are indexed and the join with the items' terms leaves them out. Both ways give the same rows.

Scores: a term weighs floor(1000 * ln((2N + 2) / (2 df + 1))); a document's m is 50 + (50 n N) div L; a term
adds its weight times (10^9 tf) div (1000 tf + 20 m), in 64-bit integers.

Defined results: null and empty texts have no term, so such documents are never found and do not count in N,
and such items have no rows. Every document row is a document of its own, also with a null or repeated id;
equal scores go by ascending id, null ids last. Item rows with one id are ranked each on its own. A document
beyond ``BLOCK_BYTES`` is a block of its own. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import slices, text_of
from ticketlens.operators.ordering import row_numbers
from ticketlens.operators.staging import discard, stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a block, and items in a bundle.
BLOCK_BYTES, BLOCK_DOCS, BUNDLE = 16_000_000, 16_384, 256
VOCABULARY_BYTES = 16_000_000
#: A stage owns the terms that at most this share of all documents holds, and no earlier stage owns.
SHARES = [1 / 1024, 1 / 32, 1 / 4, 1.0]

#: Bytes of terms to themselves, A-Z in lower case, all others to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_CELLS = "bundle long, block long, ids array<{0}>, cells binary, scores binary"
_INDEX = (
    "block long, term binary, n_docs long, n_terms long, docs binary, tfs binary, lengths binary, ids array<{0}>"
)


def terms_of(text) -> F.Column:
    """The distinct terms of a text, as UTF-8."""
    folded = F.translate(text_of(text), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))


def _block(number: int, ids: pa.Array, texts: list[bytes], vocabulary: frozenset[bytes] | None) -> pa.RecordBatch:
    """Index rows of one block, and one row without a term for the block itself."""
    postings: dict[bytes, tuple[list[int], list[int]]] = {}
    lengths = np.zeros(len(texts), np.uint32)
    for doc, text in enumerate(texts):
        found = Counter(text.translate(_FOLD).split())
        lengths[doc] = found.total()
        for term in found.keys() if vocabulary is None else found.keys() & vocabulary:
            lists = postings.get(term)
            if lists is None:
                lists = postings[term] = ([], [])
            lists[0].append(doc)
            lists[1].append(found[term])
    docs = [np.array(d, np.uint16) for d, _ in postings.values()]
    one = len(postings)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number] * (one + 1), pa.int64()),
            pa.array([*postings, None], pa.binary()),
            pa.array([*map(len, docs), int((lengths > 0).sum())], pa.int64()),
            pa.array([0] * one + [int(lengths.sum(dtype=np.int64))], pa.int64()),
            pa.array([*(d.tobytes() for d in docs), None], pa.binary()),
            pa.array([*(np.array(t, np.uint32).tobytes() for _, t in postings.values()), None], pa.binary()),
            pa.array([*(lengths[d].tobytes() for d in docs), None], pa.binary()),
            pa.array([None] * one + [ids.to_pylist()], pa.list_(ids.type)),
        ],
        ["block", "term", "n_docs", "n_terms", "docs", "tfs", "lengths", "ids"],
    )


def _indexer(vocabulary: frozenset[bytes] | None):
    def closed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        # In the order of the ids, so that of equal scores the first document is the one to take.
        order = pc.sort_indices(rows.column("id"), null_placement="at_end")
        rows = rows.take(order)
        ids = rows.column("id").combine_chunks()
        texts = [t or b"" for t in rows.column("text").to_pylist()]
        return _block(number, ids if isinstance(ids, pa.Array) else ids.chunk(0), texts, vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = docs = 0
        for batch in batches:
            for cut in slices(batch, "text", BLOCK_BYTES):
                for start in range(0, cut.num_rows, BLOCK_DOCS):
                    part = cut.slice(start, BLOCK_DOCS)
                    add = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                    if held and (size + add > BLOCK_BYTES or docs + part.num_rows > BLOCK_DOCS):
                        yield closed(number, held)
                        number, held, size, docs = number + 1, [], 0, 0
                    held.append(part)
                    size, docs = size + add, docs + part.num_rows
        if held:
            yield closed(number, held)

    return index


def _owner(n_all: int, l_all: int, k: int | None):
    """The work of a stage: add the terms' contributions to a bundle's accumulators; with k, select."""

    def visit(key: tuple, bundle: pa.Table, terms: pa.Table) -> pa.Table:
        number, block = key[0].as_py(), key[1].as_py()
        rows = bundle.to_pylist()
        # One row of ids per bundle and block goes through all stages.
        ids = bundle.column("ids").combine_chunks()
        ids = (ids if isinstance(ids, pa.Array) else ids.chunk(0)).flatten()
        board = np.zeros((BUNDLE, max(1, len(ids))), np.int64)
        cells = np.frombuffer(rows[0]["cells"], np.uint32)
        board[cells >> 16, cells & 0xFFFF] = np.frombuffer(rows[0]["scores"], np.int64)
        for row in terms.select(["weight", "slots", "docs", "tfs", "lengths"]).to_pylist():
            docs = np.frombuffer(row["docs"], np.uint16)
            tf = np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
            m = 50 + (50 * np.frombuffer(row["lengths"], np.uint32).astype(np.int64) * n_all) // l_all
            add = row["weight"] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            for slot in row["slots"]:
                board[slot, docs] += add
        if k is None:
            item, doc = np.nonzero(board)
            packed = (item.astype(np.uint32) << np.uint32(16)) | doc.astype(np.uint32)
            return pa.table(
                {
                    "bundle": pa.array([number], pa.int64()),
                    "block": pa.array([block], pa.int64()),
                    "ids": pa.array([ids.to_pylist()], pa.list_(ids.type)),
                    "cells": pa.array([packed.tobytes()], pa.binary()),
                    "scores": pa.array([board[item, doc].tobytes()], pa.binary()),
                }
            )
        items, docs = [], []
        for slot in np.flatnonzero(board.any(axis=1)):
            scores = board[slot]
            found = np.flatnonzero(scores)
            if len(found) > k:
                least = np.partition(scores[found], -k)[-k]
                above = found[scores[found] > least]
                found = np.concatenate([above, found[scores[found] == least][: k - len(above)]])
            items.append(np.full(len(found), slot))
            docs.append(found)
        item = np.concatenate(items) if items else np.zeros(0, np.int64)
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        return pa.table(
            {
                "item": pa.array(number * BUNDLE + item, pa.int64()),
                "id": ids.take(pa.array(doc)),
                "score": pa.array(board[item, doc], pa.int64()),
            }
        )

    return visit


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    vocabulary_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """item id, rank, document id and score of each item's k best documents."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    asked = items.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(item_col).alias("item_id"),
        terms_of(F.col(item_text_col)).alias("terms"),
    )
    numbered = stage(
        row_numbers(stage(asked, "search_asked"), ["row"], name="item").withColumn("item", F.col("item") - 1),
        "search_items",
    )
    wanted = stage(
        numbered.select("item", F.explode("terms").alias("term"))
        .groupBy(F.col("term").cast("binary").alias("term"), F.floor(F.col("item") / BUNDLE).alias("bundle"))
        .agg(F.sort_array(F.collect_list((F.col("item") % BUNDLE).cast("int"))).alias("slots")),
        "search_wanted",
    )
    words = wanted.select("term").distinct()
    size = words.agg(F.sum(F.octet_length("term") + 60)).first()[0] or 0
    vocabulary = frozenset(bytes(r[0]) for r in words.collect()) if size <= vocabulary_bytes else None

    index = stage(
        docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).cast("binary").alias("text")).mapInArrow(
            _indexer(vocabulary), _INDEX.format(id_type)
        ),
        "search_index",
    )
    blocks, postings = index.filter("term is null"), index.filter("term is not null")
    n_all, l_all = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_bundles = (numbered.count() + BUNDLE - 1) // BUNDLE
    schema = T.StructType(
        [
            T.StructField("item_id", items.schema[item_col].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("score", T.LongType()),
        ]
    )
    if not n_all or not n_bundles:
        return spark.createDataFrame([], schema)

    df = F.sum("n_docs")
    weights = postings.groupBy("term").agg(
        F.floor(1000 * F.log(F.lit(2.0 * n_all + 2) / (2 * df + 1).cast("double"))).cast("bigint").alias("weight"),
        F.array_position(F.transform(F.array(*map(F.lit, SHARES)), lambda s: df <= s * n_all), True).alias("stage"),
    )
    weighted = stage(wanted.join(weights, "term"), "search_weights")

    # Every bundle visits every block: the items are the stated query set, the blocks the corpus.
    empty = F.lit(b"")
    bundles = blocks.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bundles - 1).cast("bigint"))).alias("bundle"),
        "block",
        "ids",
        empty.alias("cells"),
        empty.alias("scores"),
    )
    last = len(SHARES)
    for turn in range(1, last + 1):
        owned = postings.join(weighted.filter(F.col("stage") == turn).drop("stage"), "term").select(
            F.col("bundle").alias("to"), F.col("block").alias("at"), "weight", "slots", "docs", "tfs", "lengths"
        )
        out = _CELLS.format(id_type) if turn < last else f"item long, id {id_type}, score long"
        bundles = (
            bundles.groupBy("bundle", "block")
            .cogroup(owned.groupBy("to", "at"))
            .applyInArrow(_owner(n_all, l_all, k if turn == last else None), out)
        )
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = bundles.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = stage(
        ranked.join(numbered.select("item", "item_id"), "item").select(
            "item_id", "rank", F.col("id").alias("doc_id"), "score"
        ),
        "search_ranked",
    )
    discard(index, wanted, weighted, numbered)
    return out

"""Exact dedup, mixing, quality rules and sharding against plain Python."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import edge  # noqa: E402

from ticketlens.llm import exact_dedup, mixing, quality_rules, sharding  # noqa: E402
from ticketlens.llm.queries import QUERIES  # noqa: E402
from ticketlens.llm.queries_sql import sql  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(sql()))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    want = con.execute(sql()[name]).df()
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    a = got[key].sort_values("doc_id").reset_index(drop=True)
    b = want[key].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


# --- exact duplicates --------------------------------------------------------------------


def test_exact_dedup_on_edge_rows(spark):
    got = exact_dedup.deduplicate(edge.frame(spark)).collect()
    assert len(got) == len(edge.rows())
    groups = defaultdict(list)
    for i, text, *_ in edge.rows():
        groups["".join(WORD.findall(text or ""))].append((-len(text or ""), i is None, i or 0, i))
    want = Counter()
    for plain, members in groups.items():
        keep = min(members)[3]
        sha = hashlib.sha256(plain.encode()).hexdigest()
        for _, _, _, i in members:
            want[(i, keep, len(members), sha)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_radix_rounds_beyond_the_first(spark):
    common = "p" * 700
    texts = [common + "a" * 3000, common + "a" * 3000, common + "a" * 2999 + "b", common, common[:-1], common]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(df).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (3, 2)}


def test_kept_documents_keep_their_columns(spark):
    docs = edge.frame(spark)
    kept = exact_dedup.kept_documents(docs)
    assert kept.schema == docs.schema
    plain = ["".join(WORD.findall(r.text or "")) for r in kept.collect()]
    assert len(plain) == len(set(plain)) == len({"".join(WORD.findall(t or "")) for _, t, *_ in edge.rows()})


# --- mixing ------------------------------------------------------------------------------


def water_fill(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing_on_edge_rows(spark):
    got = mixing.mix(edge.frame(spark)).collect()
    sizes = defaultdict(int)
    for _, text, _, source, *_ in edge.rows():
        sizes[source] += len(WORD.findall(text or ""))
    assert len(got) == len(edge.rows())
    want = Counter()
    target = water_fill(sizes)
    for i, text, _, source, *_ in edge.rows():
        want[(i, len(WORD.findall(text or "")), sizes[source], round(target[source], 6))] += 1
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == want
    assert all(r.taken == r.repeats * r.size and 0 <= r.repeats <= 3 for r in got)
    assert Counter(got) == Counter(mixing.mix(edge.frame(spark).repartition(3)).collect())


def test_each_source_comes_near_its_target(spark):
    rows = [(i, "w " * (1 + i % 37), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 37).all()
    mixed = mixing.mixed_documents(df)
    assert mixed.schema == df.schema and mixed.count() == got.repeats.sum()


# --- quality rules -----------------------------------------------------------------------


def measures(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), failed,
    )


def test_quality_measures_on_edge_rows(spark):
    extra = [(100, "a b c d e f g h i " * 9), (101, "same line\n" * 9 + "same line"), (102, "# * $ % & | < > " * 4)]
    df = edge.frame(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = quality_rules.judge(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((i, *measures(t)) for i, t in [(r[0], r[1]) for r in edge.rows()] + extra)
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_rules_separate_good_from_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.judge(docs).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.2


# --- sharding ----------------------------------------------------------------------------


def test_shards_on_edge_rows(spark):
    df = edge.frame(spark)
    got = sharding.assign_shards(df, [1.0] * 8, [1.0] * 9).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge.rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())


def test_weighted_shards(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    got = sharding.assign_shards(df, [1.0, 1.0, 2.0], [1.0, 1.0, 2.0, 4.0]).toPandas()
    share = got.shard.value_counts(normalize=True)
    assert abs(share[2] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {3} and abs(len(moved) / len(got) - 0.5) < 0.02


@pytest.mark.parametrize(
    "run",
    [
        exact_dedup.deduplicate,
        exact_dedup.kept_documents,
        mixing.mix,
        mixing.mixed_documents,
        quality_rules.judge,
        lambda d: sharding.assign_shards(d, [1.0], [1.0, 1.0]),
    ],
)
def test_empty_tables(spark, run):
    assert run(edge.empty(spark)).collect() == []

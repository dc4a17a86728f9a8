"""Prefix trie, ranked search and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import edge  # noqa: E402

from ticketlens.llm import nearest, prefix_trie, ranked_search  # noqa: E402

# --- prefix trie -------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, conv long, pos long, `a.b` string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "x") for r in rows], TURNS)


def trie(df, container):
    turns = prefix_trie.turns_of(df)
    conv = F.col("conv")
    convs, rebuilt = prefix_trie.rebuilt(turns, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5)
    return Counter(tuple(r) for r in prefix_trie.nodes(convs, rebuilt, container).collect())


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        chars = len(p[-1][1]) if p else 0
        saved[p] = (len(members[p]) - 1) * chars + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p))
        out[
            (
                members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]),
                leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest(),
            )
        ] += 1
    return out


def made_conversations(seed):
    rng, rows = random.Random(seed), []
    for c in [*rng.sample(range(-30, 330), 70), 100, 200]:
        for turn in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, turn, rng.choice(["user", "user", "assistant"]), rng.choice(["a", "a", "a", "é😀"])))
    # Long common paths, copies and a hot first turn.
    for c in range(1000, 1040):
        rows += [(c, t, "user", f"step {t}") for t in range(12 + c % 3)]
    rows += [(5000, t, None, None) for t in range(300)]
    rows += [(7, None, "user", "first"), (7, None, None, ""), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "container"), [(1, 20_000), (1, 25), (2, 1)])
def test_trie_equals_brute_force(spark, seed, container):
    rows = made_conversations(seed)
    df = conversations(spark, rows).repartition(3)
    assert trie(df, container) == brute_trie(rows)


def test_trie_of_little(spark):
    assert trie(conversations(spark, []), 10) == Counter()
    assert trie(conversations(spark, [(None, 1, "user", "a")]), 10) == Counter()
    # A conversation that the rule leaves no turn still ends in the root.
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(turnless, 0, "user", "a")]
    assert trie(conversations(spark, rows), 10) == brute_trie(rows)
    rows = [(turnless, 0, "user", "x" * 300_000), (3, 0, "user", "x" * 300_000)]
    assert trie(conversations(spark, rows), 1) == brute_trie(rows)


def test_sweep_counts_a_container():
    rows = prefix_trie.sweep(1, 2, [([b"a", b"b"], 5, [3, 4]), ([b"a"], 9, [3]), ([b"c"], 4, [1]), ([b"a", b"b"], 8, [3, 4])])
    assert sorted(r[:7] for r in rows) == [
        (1, 2, None, 0, 2, 2, 10),
        (4, 3, 1, 1, 0, 1, 0),
        (5, 3, 1, 3, 1, 1, 10),
        (5, 4, 5, 2, 0, 1, 4),
    ]


# --- ranked search -----------------------------------------------------------------------

TERM = re.compile(ranked_search.TERM)
FOLD = str.maketrans(ranked_search.UPPER, ranked_search.LOWER)
ITEMS = "item_id long, text string, doc_id long, score string, `rank` int"


def brute_search(docs, items, k):
    counts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_all, l_all = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = Counter()
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(FOLD)))
        scored = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_all) // l_all
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[(item, rank, i, -score)] += 1
    return out


@pytest.mark.parametrize("vocabulary_bytes", [ranked_search.VOCABULARY_BYTES, 0])
def test_search_equals_brute_force(spark, vocabulary_bytes):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "ünder", "日本", "THE", "the"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for i in range(300)]
    docs += [(r[0], r[1]) for r in edge.rows()] + [(900 + i, "tie, tie!") for i in range(9)] + [(900, "tie tie")]
    texts = [" ".join(rng.choices(vocabulary, k=8)) for _ in range(300)]
    items = list(enumerate(texts)) + [(1, texts[0]), (None, "tie fox"), (2000, None), (2001, ""), (2002, "absent"), (2003, edge.LONG)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, block int")
    asked = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in items], ITEMS)
    got = ranked_search.search(frame.repartition(5), asked, k=7, vocabulary_bytes=vocabulary_bytes)
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items, 7)


def test_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "a", 1, "s", 2)], ITEMS)
    assert ranked_search.search(edge.empty(spark), asked).collect() == []
    assert ranked_search.search(edge.frame(spark), asked.limit(0)).collect() == []
    nulls = edge.frame(spark).withColumn("text", F.lit(None).cast("string"))
    assert ranked_search.search(nulls, asked).collect() == []


# --- nearest neighbours --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, `class` string, score double, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 0.5, 1) for i, v in rows], VECTORS)


def brute_nearest(rows, k):
    """query id -> [(score, id)] of its own dimension, best first."""
    seen = {(i, tuple(v)) for i, v in rows}
    out = {}
    for q, v in seen:
        if q % 20 == 0:
            others = [(i, w) for i, w in seen if (i, w) != (q, v) and len(w) == len(v)]
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in others)
            out[(q, v)] = [(-s, i) for s, i in scored[:k]]
    return out


def test_recall_of_hard_vectors_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 24)) * np.exp(rng.standard_normal((6000, 1)))
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got = defaultdict(list)
    for r in nearest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    data = np.array([v for _, v in rows])
    hits = 0
    for q in range(0, 6000, 20):
        score = data @ data[q]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in mine) and q not in [i for _, i, _ in mine]
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        score[q] = -np.inf
        hits += len({i for _, i, _ in mine} & set(np.argsort(-score)[:20]))
    assert hits >= 0.93 * 20 * 300


def test_copies_ties_and_odd_rows(spark):
    rng = random.Random(8)
    few = [[float(a) for a in (1, 0, 0)], [0.0, 2.0, 0.0], [0.5, 0.5, -1.0], [-1.0, 0.0, 0.25]]
    rows = [(i, few[0] if i % 3 else rng.choice(few)) for i in range(400)]
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (1020, [3.0]), (0, [0.0, 2.0, 0.0]), (20, rows[20][1])]
    odd = [(40, None), (41, []), (60, [0.0, 0.0, 0.0]), (61, [1.0, None, 0.0]), (80, [math.nan, 1.0, 1.0]), (81, [math.inf, 0.0, 1.0]), (None, few[0])]
    got = defaultdict(list)
    df = vectors(spark, [r for r in rows] + odd)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    want = defaultdict(list)
    for (q, _), best in brute_nearest(rows, 5).items():
        want[q] += [(n, s, i) for n, (s, i) in enumerate(best, 1)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}


def test_no_vectors(spark):
    assert nearest.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest.nearest(vectors(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []


def test_codes_are_the_nearest_signed_axis():
    x = np.random.default_rng(1).standard_normal((50, 16))
    for bits in (0, 1, 3, 5, 9):
        code, found = nearest.codes(x, 2, bits), nearest.probes(x, 2, bits, 4)
        assert (code == found[:, 0]).all() and code.max(initial=0) < 2**bits
        assert all(len(set(r)) == len(r) for r in found.tolist())
    dense = np.array([[nearest._rotated(np.eye(16)[i : i + 1], 0, 0)[0] for i in range(16)]])[0]
    assert np.allclose(dense @ dense.T, np.eye(16))

"""The Jaccard join against all pairs, and the pipeline stage by stage."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import edge  # noqa: E402

import corpus_pipeline  # noqa: E402
from ticketlens.llm import jaccard_join  # noqa: E402
from ticketlens.llm.shingles import shingle_sets  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def all_pairs(rows, width: int, percent: int) -> list[int]:
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        cut = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        sets.append(frozenset(cut or ([tuple(words)] if words else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def corpus() -> list[tuple[int, str]]:
    """A large group of near copies, a second one close to it, a shared passage, tiny texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = draw(150)
    docs = [edge.mutated(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 10]), vocabulary) for _ in range(220)]
    other = edge.mutated(rng, base, 9, vocabulary)
    docs += [edge.mutated(rng, other, rng.choice([0, 1, 2, 3, 5]), vocabulary) for _ in range(80)]
    passage = draw(60)
    docs += [draw(k := rng.choice([3, 5, 10, 40, 200])) + passage + draw(k // 2) for _ in range(120)]
    docs += [[rng.choice(vocabulary[:3]) for _ in range(rng.randrange(8))] for _ in range(120)]
    docs += [edge.mutated(rng, b, rng.choice([0, 1, 4]), vocabulary) for b in (draw(25), draw(300)) for _ in range(10)]
    rng.shuffle(docs)
    rows = [(i, " ".join(d) if i % 7 else " \n ".join(d).upper()) for i, d in enumerate(docs)]
    return [*rows, (len(rows), None), (len(rows) + 1, "")]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.near_duplicates(df, width, percent).collect()}
    want, sizes = all_pairs(rows, width, percent)
    assert got == {i: (want[i], sizes[i]) for i in range(len(rows))}


def lowest_of(edges) -> dict[int, int]:
    """Union-find: the smallest class of the component of every class with an edge."""
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def linked_graphs():
    """Chains and bridged stars, each with random numbers for its classes."""
    rng = random.Random(11)
    yield [(1, 3), (3, 4), (4, 5), (5, 2)]
    for _ in range(4):
        at = rng.sample(range(1000), 42)
        yield [(at[0], x) for x in at[1:21]] + [(at[21], x) for x in at[22:]] + [(at[5], at[30])]
    for k in (5, 8, 30):
        at = rng.sample(range(1000), k)
        yield list(zip(at, at[1:], strict=False))


@pytest.mark.parametrize("edges", list(linked_graphs()))
def test_closure_of_links_is_union_find(spark, edges):
    got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = lowest_of(edges)
    assert sorted((r.cls, r.root) for r in got) == sorted((x, r) for x, r in want.items() if x != r)


@pytest.mark.parametrize("width", [4, 5])
def test_tables_of_one_short_text(width):
    words = "one two three four five six".split()
    for n in range(1, 7):
        text = " ".join(words[:n])
        (alone,) = shingle_sets(pa.array([text]), width)
        beside = shingle_sets(pa.array([text, " ".join(words * 3)]), width)[0]
        assert len(alone) == max(1, n - width + 1) and alone.tolist() == beside.tolist()


def test_rows_of_chains_come_out_once(spark):
    rng = random.Random(3)
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(30)]
    rng.shuffle(rows)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(i, 0) for i in range(30)]


def test_join_on_edge_rows(spark):
    got = jaccard_join.near_duplicates(edge.frame(spark), 4, 85).collect()
    assert len(got) == len(edge.rows())
    found = {r.doc_id: r.component_id for r in got}
    assert found[2] == found[3] == 1 and found[8] == 7 and found[15] == 14
    assert found[4] == 4 and found[5] == 5 and found[6] == 6
    assert jaccard_join.near_duplicates(edge.empty(spark)).collect() == []
    kept = jaccard_join.kept_documents(edge.frame(spark))
    assert kept.schema == edge.frame(spark).schema


def test_null_and_repeated_ids_keep_one_row_of_a_component(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(4)]
    near = [" ".join(edge.mutated(rng, base, 1, vocabulary)) for _ in range(60)]
    rows = [(None, t) for t in near] + [(5, near[0]), (5, clean[0]), (5, clean[0]), (5, near[1])]
    rows += [(None, clean[1])] * 7 + [(8, clean[2]), (9, None), (9, None), (None, ""), (None, clean[3])]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, digest string, n long")
    kept = jaccard_join.kept_documents(docs.repartition(5))
    assert kept.columns == docs.columns
    got = kept.collect()
    texts = [(r.doc_id, r.text) for r in got]
    members = [(i, t) for i, t in texts if t in near]
    assert len(members) == 1 and members[0][0] == 5 and members[0][1] in near[:2]
    rest = sorted(map(repr, (x for x in texts if x[1] not in near)))
    assert rest == sorted(map(repr, [(5, clean[0]), (None, clean[1]), (8, clean[2]), (9, None), (9, None), (None, ""), (None, clean[3])]))
    found = jaccard_join.near_duplicates(docs.repartition(3)).collect()
    assert len(found) == len(rows) and sum(r.component_id == 5 for r in found) == 64


def test_all_stages_in_a_chain_on_edge_rows(spark):
    docs = edge.frame(spark)
    kept = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept, SF_DIR)
        assert out.schema.names == docs.schema.names
        kept = spark.createDataFrame(out.collect(), docs.schema)
    texts = [r.text for r in kept.collect()]
    assert set(texts) <= {t for _, t, *_ in edge.rows() if t}
    encoded = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR)
    assert encoded.filter("not round_trip").count() == 0 and encoded.filter("sample = 1").count() == len(texts)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, seen[-1], SF_DIR)
        assert out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    counts = [d.count() for d in seen]
    rows = [d.select("doc_id", "text").orderBy("doc_id").collect() for d in seen]
    # Language: only texts without a letter go.
    assert counts[1] == sum(any(map(str.isalpha, r.text or "")) for r in rows[0])
    plain = {"".join((r.text or "").split()) for r in rows[1]}
    assert counts[2] == len(plain) == len({"".join(r.text.split()) for r in rows[2]})
    groups, _ = all_pairs([(r.doc_id, r.text) for r in rows[2]], 5, 80)
    assert [r.doc_id for r in rows[3]] == [r.doc_id for i, r in enumerate(rows[2]) if groups[i] == i]
    words = [sum(len(r.text.split()) for r in rows[k]) for k in (3, 4)]
    assert abs(words[1] - words[0]) < 0.5 * words[0]
    encoded = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF_DIR)
    assert encoded.filter("not round_trip").count() == 0
    assert encoded.filter("sample = 1").count() == counts[4]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}"
    edge.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []

"""Logistic regression and boosted trees against independent versions in plain numpy."""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import boosting, design, metrics, newton
from ticketlens.operators.ordering import shuffled
from ticketlens.operators.staging import stage

N = 1500


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    group = rng.integers(0, 6, N)
    a, b = rng.normal(3, 2, N), rng.integers(0, 40, N).astype(float)
    z = 0.8 * (a - 3) + np.array([0, 1.5, -1, 0.5, 0, -2])[group] - 0.05 * (b - 20) * (group == 1)
    y = (rng.random(N) < 1 / (1 + np.exp(-z))).astype(float)
    rows = [("abcdef"[g], float(u), float(v) if i % 50 else None, float(t)) for i, (g, u, v, t) in enumerate(zip(group, a, b, y))]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double").repartition(3)
    df = stage(df, "toy")
    features = design.measured(df, [design.category("g", list("abcde")), design.number("a"), design.number("b")])
    data = stage(design.blocks(df, features, "y"), "toy_blocks")
    packed = [design.block_arrays(r.asDict(), 3) for r in data.collect()]
    x, codes, y = (np.concatenate([p[i] for p in packed], axis=-1) for i in range(3))
    return df, features, data, x, codes, y


def test_blocks_hold_the_rows(made):
    df, features, data, x, codes, y = made
    assert sorted(y) == sorted(r.y for r in df.collect()) and x.shape == (3, N)
    # The level that training levels lack is code 0, as is a missing number.
    assert Counter(codes[0] == 0)[True] == df.filter("g = 'f'").count()
    assert ((codes[2] == 0) == np.isnan(x[2])).all()
    edges = np.array(features[1].edges)
    assert (codes[1] == 1 + (x[1][:, None] > edges[None]).sum(axis=1)).all()


def test_newton_solves_the_score_equations(made):
    _, features, data, x, _, y = made
    models = [newton.Logistic((0,), (1, 2), (), c, w) for c in (0.01, 1.0) for w in ((1.0, 1.0), (0.7, 1.9))]
    scans = newton.fit(data, models, features, 4)
    assert scans < 12
    d = newton.expand(x, features, models[0].columns)
    assert d.shape[1] == len(newton.names(features, models[0].columns)) == 1 + 5 + 2
    for m in models:
        w = np.where(y == 1, m.weights[1], m.weights[0])
        p = 1 / (1 + np.exp(-d @ m.beta))
        gradient = m.c * d.T @ (w * (p - y)) + np.r_[0, m.beta[1:]]
        assert np.abs(gradient).max() < 1e-6
    apart = newton.Logistic((0,), (1, 2), (), 1.0, (0.7, 1.9))
    newton.fit(data, [apart], features, 4)
    assert np.allclose(apart.beta, models[3].beta, atol=1e-8)
    # Sums that are added up on executors first.
    assert np.allclose(newton.score_equations(data, models, features, 1000)[0], 0, atol=1e-8)


def test_newton_with_separable_rows_ends(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "a double, y double")
    features = design.measured(df, [design.number("a")])
    data = stage(design.blocks(df, features, "y"), "separable")
    model = newton.Logistic((), (0,), (), 1e6)
    newton.fit(data, [model], features, 1)
    assert model.steps <= newton.MAX_STEPS and np.isfinite(model.beta).all()


def plain_boost(codes, y, model, features):
    """Leaf-wise growth by trying every split of every leaf afresh."""
    margin = np.full(len(y), model.start)
    for _ in range(model.rounds):
        g, h = boosting._slopes(model.loss, model.weights, margin, y)

        def best(rows):
            found = None
            G, H = g[rows].sum(), h[rows].sum()
            for f in model.features:
                c = codes[f, rows]
                bins = [b for b in range(features[f].bins) if features[f].is_category is False or (c == b).any()]
                if features[f].is_category:
                    bins.sort(key=lambda b: g[rows][c == b].sum() / (h[rows][c == b].sum() + model.l2 + boosting.SMOOTH))
                for i in range(1, len(bins)):
                    left = np.isin(c, bins[:i])
                    n = left.sum()
                    if min(n, len(rows) - n) < model.least_rows:
                        continue
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + model.l2) + (G - gl) ** 2 / (H - hl + model.l2) - G**2 / (H + model.l2)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, rows[left], rows[~left])
            return found

        leaves, heap, count = [np.arange(len(y))], [], 0
        first = best(leaves[0])
        if first:
            heap.append((-first[0], 0, first))
        done = {0}
        while heap and len(done) < model.leaves:
            _, i, (_, a, b) = heapq.heappop(heap)
            done.discard(i)
            for part in (a, b):
                leaves.append(part)
                count = len(leaves) - 1
                done.add(count)
                if split := best(part):
                    heapq.heappush(heap, (-split[0], count, split))
        for i in done:
            margin[leaves[i]] -= model.rate * g[leaves[i]].sum() / (h[leaves[i]].sum() + model.l2)
    return margin


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_trees_equal_plain_growth(made, loss):
    _, features, data, x, codes, y = made
    models = [
        boosting.Boosted((0, 1, 2), loss, 3, 0.1, 7, 20, 1.0, start=0.2),
        boosting.Boosted((1, 0), loss, 3, 0.3, 4, 50, 0.0, weights=(0.5, 2.0), start=-0.1),
        boosting.Boosted((2,), loss, 3, 0.3, 9, 5, 0.5),
    ]
    apart = [replace(m) for m in models]
    assert boosting.fit(data, models, features, 4) == 0
    assert boosting.fit(data, apart, features, 4, gathered=0) > 0
    for m, other in zip(models, apart):
        assert all(np.array_equal(a.feature, b.feature) for a, b in zip(m.trees, other.trees))
        assert np.allclose(m.margin(codes), other.margin(codes))
        assert all((t.feature < 0).sum() <= m.leaves for t in m.trees)
        assert np.allclose(m.margin(codes), plain_boost(codes, y, m, features))


def test_many_trees_and_depth_limit(made):
    _, features, data, x, codes, y = made
    deep = boosting.Boosted((0, 1, 2), rounds=12, leaves=31, max_depth=2)
    far = boosting.Boosted((0, 1, 2), rounds=20, leaves=6)
    stump = boosting.Boosted((0, 1, 2), rounds=2, leaves=2)
    boosting.fit(data, [deep, far, stump], features, 4, gathered=0)
    assert max(t.depth for t in deep.trees) == 2 and len(far.trees) == 20
    assert all((t.feature < 0).sum() == 2 for t in stump.trees)
    p = 1 / (1 + np.exp(-far.margin(codes)))
    assert ((p - y) ** 2).mean() < ((y.mean() - y) ** 2).mean() - 0.02
    back = [boosting.Tree.from_lists(t.as_lists(), max(f.bins for f in features)) for t in far.trees]
    assert np.array_equal(replace(far, trees=back).margin(codes), far.margin(codes))


def test_one_class_and_constant_features(spark):
    df = spark.createDataFrame([(1.0, None, 1.0)] * 60, "a double, b double, y double")
    features = design.measured(df, [design.number("a"), design.number("b")])
    data = stage(design.blocks(df, features, "y"), "constant")
    model = boosting.Boosted((0, 1), rounds=2, start=30.0)
    boosting.fit(data, [model], features, 1)
    assert all(t.depth == 0 for t in model.trees)


# --- permutations and bootstrap ----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_shuffled_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(shuffled(F.col("id"), n, "3/1")).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        other = [r[0] for r in spark.range(n).select(shuffled(F.col("id"), n, "3/2")).collect()]
        assert got != other and abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.1
        assert sum(a == b for a, b in enumerate(got)) < 12


def test_bootstrap_spreads_like_resampling(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 800)
    p = np.round(np.clip(0.3 * y + rng.random(800) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)] + [(None, 1)], "p double, y int")
    got = metrics.bootstrap_ranking(df, 400).toPandas()
    assert sorted(got.replicate) == list(range(1, 401))
    again = metrics.bootstrap_ranking(df.repartition(7), 400).toPandas().sort_values("replicate")
    assert np.array_equal(got.sort_values("replicate").roc_auc, again.roc_auc)

    def auc(i):
        pos, neg = p[i][y[i] == 1], p[i][y[i] == 0]
        return ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)

    want = [auc(rng.integers(0, 800, 800)) for _ in range(400)]
    assert got.roc_auc.mean() == pytest.approx(np.mean(want), abs=0.004)
    assert got.roc_auc.std() == pytest.approx(np.std(want), rel=0.15)


def test_bootstrap_of_little(spark):
    empty = spark.createDataFrame([], "p double, y int")
    assert metrics.bootstrap_ranking(empty, 5).collect() == []
    one = spark.createDataFrame([(0.5, 1)] * 30, "p double, y int")
    assert {(r.roc_auc, r.pr_auc) for r in metrics.bootstrap_ranking(one, 5).collect()} == {(None, None)}
    low, table = metrics._poisson_table(100_000)
    draws = low + np.searchsorted(table, (np.arange(1000) + 0.5) / 1000, side="right")
    assert draws.mean() == pytest.approx(100_000, abs=20) and draws.std() == pytest.approx(316, rel=0.05)

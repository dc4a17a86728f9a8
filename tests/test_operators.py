from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketlens.functions.exact import pct, ratio
from ticketlens.functions.labels import humanise, service_label
from ticketlens.operators import metrics
from ticketlens.operators.encoding import cross_fit_encode, fold_of
from ticketlens.operators.dense import every_step
from ticketlens.operators.intervals import flag_inside, interval_join
from ticketlens.operators.openat import MonthGrid, SingleInstant, WeekGrid, explode_open, open_counts
from ticketlens.operators.ordering import equal_count_bin, ordered_prefix, rank_desc, row_numbers
from ticketlens.operators.percentile import MEDIAN, P90, grouped_percentiles, selected_percentiles
from ticketlens.operators.quantiles import position_quantiles
from ticketlens.plans.enrich import add_sla_target, number_changes, open_backlog_at_event, reopen_counts


def skewed(spark, n=4000):
    """One key holds most rows."""
    key = F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11))
    return spark.range(n).select(
        "id", key.alias("key"), ((F.col("id") * 7919) % 1009).alias("v")
    )


def test_ordered_prefix_equals_a_window(spark):
    df = skewed(spark)
    got = ordered_prefix(df, ["v", "id"], {"run": F.col("v")}, ["key"])
    line = Window.partitionBy("key").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("v").over(line))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_row_numbers_over_everything(spark):
    got = row_numbers(skewed(spark), ["v", "id"]).collect()
    want = sorted(got, key=lambda r: (r["v"], r["id"]))
    assert [r["row_number"] for r in want] == list(range(1, len(got) + 1))


def test_rank_desc_with_ties_and_nulls(spark):
    rows = [("a", 5), ("a", 5), ("a", 3), ("a", None), ("b", None), ("b", 1)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = sorted((r["g"], r["v"] or -1, r["rk"]) for r in rank_desc(df, ["g"], "v", "rk").collect())
    assert got == [("a", -1, 4), ("a", 3, 3), ("a", 5, 1), ("a", 5, 1), ("b", -1, 2), ("b", 1, 1)]


def test_percentiles_match_numpy_for_hot_and_small_groups(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 13 > 0, F.col("v")))
    got = grouped_percentiles(
        df, ["key"], "v", {"m": MEDIAN, "p": P90}, {"n": F.lit(1).cast("bigint")}
    )
    data: dict[str, list] = {}
    for r in df.collect():
        data.setdefault(r["key"], []).append(r["v"])
    for r in got.collect():
        values = [v for v in data[r["key"]] if v is not None]
        assert r["n"] == len(data[r["key"]])
        assert r["m"] / 2 == pytest.approx(np.percentile(values, 50))
        assert r["p"] / 10 == pytest.approx(np.percentile(values, 90))


def test_percentile_of_a_group_without_values_is_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 4)], "k string, v int")
    got = {r["k"]: r["m"] for r in grouped_percentiles(df, ["k"], "v", {"m": MEDIAN}).collect()}
    assert got == {"a": None, "b": 8}


@pytest.mark.parametrize("keys", [["key"], ["key", "third"], []])
def test_selected_percentiles_equal_the_grouped_ones(spark, keys):
    """Values over many bins, negative ones, NULL keys and values, weights, a hot key."""
    i = F.col("id")
    df = skewed(spark, 6000).withColumns(
        {
            "key": F.when(i % 17 > 0, F.col("key")),
            "third": i % 3,
            "v": F.when(i % 13 > 0, (i * 7919) % 100_003 * 97 - 50_000),
            "n": (i % 4).cast("bigint"),
        }
    )
    ask = {"m": MEDIAN, "p": P90, "top": (1, 1), "low": (0, 1)}
    sums = {"n_rows": F.lit(1).cast("bigint"), "total": F.col("v")}
    for weight in (None, F.col("n")):
        got = selected_percentiles(df, keys, "v", ask, sums, weight)
        want = grouped_percentiles(df, keys, "v", ask, sums, weight)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_selected_percentiles_without_values_or_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", 4), (None, 7)], "k string, v int")
    got = {r["k"]: r["m"] for r in selected_percentiles(df, ["k"], "v", {"m": MEDIAN}).collect()}
    assert got == {"a": None, "b": 8, None: 14}
    none = df.filter("v > 100")
    ask = ({"m": MEDIAN}, {"n": F.lit(1)})
    assert [tuple(r) for r in selected_percentiles(none, [], "v", *ask).collect()] == [(None, None)]
    assert selected_percentiles(none, ["k"], "v", *ask).count() == 0


def test_selected_percentile_of_many_distinct_values(spark):
    df = spark.range(200_000).select(((F.col("id") * 7919) % 199_999).alias("v"))
    got = selected_percentiles(df, [], "v", {"m": MEDIAN})
    values = sorted((i * 7919) % 199_999 for i in range(200_000))
    assert got.first()["m"] == values[99_999] + values[100_000]


def test_every_step_fills_the_gaps(spark):
    owners = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, info int")
    series = spark.createDataFrame(
        [("a", 1, 10), ("a", 3, None), ("b", 0, 5), ("b", 4, 6), ("x", 2, 9), ("c", 7, 1)],
        "k string, i bigint, m int",
    )
    got = {(r["k"], r["i"]): (r["info"], r["m"]) for r in every_step(owners, series, "k", "i", 5).collect()}
    assert len(got) == 15 == every_step(owners, series, "k", "i", 5).count()
    assert {k: v for k, v in got.items() if v[1] is not None} == {
        ("a", 1): (1, 10), ("b", 0): (2, 5), ("b", 4): (2, 6)
    }
    assert every_step(owners, series, "k", "i", 0).count() == 0
    assert every_step(owners, series.limit(0), "k", "i", 2).count() == 6


@pytest.mark.parametrize("total", [3, 10, 26_267, 26_270])
def test_equal_count_bins_put_larger_bins_first(spark, total):
    rows = spark.range(1, total + 1).select(
        equal_count_bin(F.col("id"), F.lit(total), 10).alias("b")
    )
    sizes = [r[1] for r in rows.groupBy("b").count().orderBy("b").collect()]
    assert sizes == [len(x) for x in np.array_split(np.arange(total), 10) if len(x)]


def test_quantiles_match_numpy(spark):
    df = spark.range(1001).select("id", ((F.col("id") * 37) % 997 / 997.0).alias("p"))
    values = [r["p"] for r in df.collect()]
    fractions = [0.0, 0.05, 0.7, 0.9, 1.0]
    got = position_quantiles(df, "p", "id", fractions)
    assert got == pytest.approx(list(np.quantile(values, fractions)))


def tickets(spark, n=400):
    rng = random.Random(3)
    start = datetime(2000, 1, 3)
    rows = []
    for i in range(n):
        # Some on a grid instant exactly, some open for years, some never closed.
        created = start + timedelta(days=rng.randrange(500)) + timedelta(
            seconds=rng.choice([0, rng.randrange(86400)])
        )
        length = rng.choice([60, 86400, 3 * 86400, 7 * 86400, 40 * 86400, 500 * 86400])
        closed = rng.choice([created + timedelta(seconds=length), None])
        expected = created + timedelta(hours=rng.choice([4, 24, 168, 720]))
        rows.append((i, f"g{i % 3}", created, closed, expected, i % 4 == 0))
    schema = (
        "ticket_id int, grp string, creation_ts timestamp_ntz, closed_ts timestamp_ntz, "
        "expected_resolution_ts timestamp_ntz, high boolean"
    )
    return spark.createDataFrame(rows, schema), rows


GRIDS = {
    "week": WeekGrid.over(datetime(2000, 1, 5, 7), datetime(2001, 6, 1)),
    "month": MonthGrid.over(datetime(2000, 1, 5, 7), datetime(2001, 6, 1)),
    "single": SingleInstant(datetime(2000, 9, 4)),
}


@pytest.mark.parametrize("name", list(GRIDS))
def test_open_at_equals_the_theta_join(spark, name):
    df, rows = tickets(spark)
    grid = GRIDS[name]
    instants = [
        r[0] for r in spark.range(grid.size).select(grid.instant(F.col("id"))).collect()
    ]
    want = {
        (i, t) for i, _, c, e, *_ in rows for t in instants if c <= t and (e is None or e > t)
    }
    pairs = explode_open(df, grid).select("ticket_id", "as_of", "age_bucket", "past_due").collect()
    assert {(r[0], r[1]) for r in pairs} == want and len(pairs) == len(want)
    by_id = {r[0]: r for r in rows}
    for r in pairs:
        assert r["past_due"] == (r["as_of"] > by_id[r["ticket_id"]][4])

    counts: dict = {}
    for r in pairs:
        key = (r["as_of"], by_id[r["ticket_id"]][1], r["age_bucket"])
        n = counts.setdefault(key, [0, 0, 0])
        n[0] += 1
        n[1] += r["past_due"]
        n[2] += by_id[r["ticket_id"]][5]
    got = open_counts(df, grid, ["grp"], {"high": F.col("high")}, banded=True)
    found = {
        (r["as_of"], r["grp"], r["age_bucket"]): [r["open_tickets"], r["past_due_tickets"], r["high"]]
        for r in got.collect()
    }
    assert found == counts


def test_week_grid_ends_a_week_before_a_partial_one():
    grid = WeekGrid.over(datetime(2000, 1, 5), datetime(2000, 1, 23, 23))
    assert (grid.first, grid.size) == (datetime(2000, 1, 10), 2)
    assert WeekGrid.over(datetime(2000, 1, 5), datetime(2000, 1, 24)).size == 3


def test_interval_join_and_flag_against_brute_force(spark):
    rng = random.Random(5)
    base = datetime(2000, 1, 1)
    points = [(i, rng.choice("ab"), base + timedelta(minutes=rng.randrange(30_000))) for i in range(600)]
    spans = []
    for j in range(12):
        s = base + timedelta(minutes=rng.randrange(30_000))
        spans.append((f"o{j}", rng.choice("ab"), s, s + timedelta(minutes=rng.choice([1, 700, 5000]))))
    points.append((600, spans[0][1], spans[0][2]))
    points.append((601, spans[0][1], spans[0][3]))
    p = spark.createDataFrame(points, "i int, k string, ts timestamp_ntz")
    o = spark.createDataFrame(spans, "o string, k string, s timestamp_ntz, e timestamp_ntz")
    want = {(i, o_) for i, k, t in points for o_, k2, s, e in spans if k == k2 and s <= t < e}
    pairs = interval_join(p, "ts", o, "s", "e", ["k"]).select("i", "o").collect()
    assert {tuple(r) for r in pairs} == want and len(pairs) == len(want)
    flags = {r["i"]: r["f"] for r in flag_inside(p, "ts", o, "s", "e", ["k"], "f").collect()}
    assert flags == {i: any(w[0] == i for w in want) for i, *_ in points}


def test_backlog_at_event_against_brute_force(spark):
    rng = random.Random(7)
    base = datetime(2000, 1, 1)
    rows = []
    for i in range(500):
        c = base + timedelta(minutes=rng.randrange(900))
        e = rng.choice([None, c + timedelta(minutes=rng.choice([5, 60, 300]))])
        rows.append(("hot" if i % 3 else "cold", i, c, e))
    df = spark.createDataFrame(rows, "g string, i int, c timestamp_ntz, e timestamp_ntz")
    got = {r["i"]: r["open_backlog_at_creation"] for r in open_backlog_at_event(df, "g", "i", "c", "e").collect()}
    for g, i, c, _ in rows:
        want = sum(
            g2 == g and (c2, i2) < (c, i) and (e2 is None or e2 > c) for g2, i2, c2, e2 in rows
        )
        assert got[i] == want


def test_reopen_counts_follow_the_sequence(spark):
    states = ["acknowledged", "resolved", "in_progress", "resolved", "in_progress", "closed"]
    rows = [("t", s, datetime(2000, 1, 1, i), i) for i, s in enumerate(states)]
    rows += [("u", "in_progress", datetime(2000, 1, 1), 0)]
    df = spark.createDataFrame(rows, "ticket_id string, status string, ts timestamp_ntz, k int")
    numbered = number_changes(df, "ticket_id", "ts", "k")
    assert {tuple(r) for r in reopen_counts(numbered).collect()} == {("t", 2)}


def test_rounding_is_half_away_and_null_on_zero(spark):
    df = spark.createDataFrame([(1, 8), (5, 1000), (1, 0)], "a bigint, b bigint")
    got = [(r[0], r[1]) for r in df.select(ratio("a", "b", 2), pct("a", "b", 1)).collect()]
    assert got == [(0.13, 12.5), (0.01, 0.5), (None, None)]


def test_labels(spark):
    codes = ["financial_services", "sbc_ddos_fault", "o'neil-x2y", "sd_wan", None, "MIDDLE EAST", "in_progress"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(humanise("c")).collect()] == [
        "Financial Services", "SBC DDoS Fault", "O'Neil-X2Y", "SD WAN", None, "Middle East", "In Progress",
    ]
    assert df.filter("c = 'sd_wan'").select(service_label("c")).first()[0] == "SD-WAN"


def test_labels_of_any_length(spark):
    code = "a" * 1_200_000 + "_b"
    got = spark.createDataFrame([(code,)], "c string").select(humanise("c")).first()[0]
    assert got == "A" + "a" * 1_199_999 + " B"


def test_repeated_sla_targets_double_no_ticket(spark):
    targets = spark.createDataFrame(
        [("gold", "major", 8), ("gold", "major", 4), ("gold", "low", 24), ("tin", "low", 1), (None, "low", 2)],
        "tier string, severity string, target_hours int",
    )
    tickets = spark.createDataFrame(
        [(1, "gold", "major"), (2, "gold", "low"), (3, "bronze", "low"), (4, None, "low")],
        "id int, tier string, severity string",
    )
    got = add_sla_target(tickets, targets).orderBy("id").select("id", "sla_target_hours").collect()
    assert [tuple(r) for r in got] == [(1, 4), (2, 24), (3, None), (4, None)]


def test_ranking_metrics_by_hand(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    p = [0.9, 0.8, 0.8, 0.6, 0.6, 0.3, 0.2, 0.0]
    df = spark.createDataFrame(list(zip(range(8), y, p)), "i int, y int, p double")
    row = metrics.ranking_metrics(df).first()
    pairs = [(a, b) for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    ap, seen, hits = 0.0, 0, 0
    for t in sorted(set(p), reverse=True):
        block = [yy for pp, yy in zip(p, y) if pp == t]
        seen, hits = seen + len(block), hits + sum(block)
        ap += sum(block) / sum(y) * hits / seen
    assert row["roc_auc"] == pytest.approx(auc)
    assert row["pr_auc"] == pytest.approx(ap)
    assert row["brier"] == pytest.approx(np.mean((np.array(p) - np.array(y)) ** 2))
    q = np.clip(p, 1e-6, 1 - 1e-6)
    assert row["log_loss"] == pytest.approx(-np.mean(np.where(y, np.log(q), np.log(1 - q))))
    single = metrics.ranking_metrics(df.filter("y = 1")).first()
    assert single["roc_auc"] is None and single["pr_auc"] is None


def test_operating_point_is_zero_when_nothing_is_flagged(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.1)], "y int, p double")
    row = metrics.at_thresholds(df, {"none": 0.9}).first()
    assert (row["flagged"], row["precision"], row["recall"], row["lift_vs_prevalence"]) == (0, 0, 0, 0)


def test_bootstrap_mean_is_near_the_point_estimate(spark):
    df = spark.range(2000).select(
        "id",
        (F.col("id") % 4 == 0).cast("int").alias("y"),
        (F.when(F.col("id") % 4 == 0, 0.3).otherwise(0.1) + (F.col("id") * 7919 % 1000) / 1500).alias("p"),
    )
    point = metrics.ranking_metrics(df).first()["roc_auc"]
    reps = metrics.bootstrap_ranking(df, 40)
    row = metrics.confidence_interval(reps, "roc_auc").first()
    assert row["replicates"] == 40
    assert row["low"] < point < row["high"] and abs(row["mean"] - point) < 0.01
    assert metrics.confidence_interval(reps, "roc_auc").first() == row


def test_cross_fit_leaves_the_own_fold_out(spark):
    df = spark.range(500).select(
        "id", (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 7 == 0).cast("int").alias("y")
    )
    rows = df.withColumn("f", fold_of("id")).collect()
    assert {r["f"] for r in rows} == set(range(5))
    coded = {r["id"]: r["code"] for r in cross_fit_encode(df, "c", "id", "code").collect()}
    for r in rows[:20]:
        rest = [x for x in rows if x["f"] != r["f"]]
        rate = np.mean([x["y"] for x in rest])
        own = [x["y"] for x in rest if x["c"] == r["c"]]
        n, m, v = len(own), np.mean(own), rate * (1 - rate)
        trust = v * n / (v * n + m * (1 - m))
        assert coded[r["id"]] == pytest.approx(trust * m + (1 - trust) * rate)

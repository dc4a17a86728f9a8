"""What a query shuffles and builds: steps that once grew faster than their input."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketlens import catalog
from ticketlens.operators.intervals import last_inside
from ticketlens.operators.staging import stage
from ticketlens.plans import quality
from ticketlens.plans.desk import Desk, _new_desk
from ticketlens.plans.enrich import with_open_backlog
from ticketlens.plans.extracts import export_extracts
from ticketlens.plans.findings import breach_by_backlog_quintile
from ticketlens.session import METHOD_LIMIT
from ticketlens.sources.testdata import LINE_ORDER, TIE_COLUMNS, joined_lines, numbered_lines, table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fresh(spark):
    """A desk of which nothing is built yet."""
    return _new_desk(spark, SF_DIR)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["sequenced_history", "latest_status", "first_end", "reopen_counts", "score_table"]
)
def test_rows_of_a_ticket_are_not_shuffled(fresh, name):
    """A ticket's changes and its score are worked out in its own row."""
    build = catalog.ENRICHMENT.get(name) or catalog.SCORES[name]
    text = plan(build(fresh))
    assert not [x for x in ("SortMergeJoin", "SortAggregate", "Window", "hashpartitioning(ticket_id") if x in text]


@pytest.mark.parametrize(
    "name", ["active_outage", "breach_by_dimension", "risk_band_summary", "sla_outcome_labels", "ever_pending"]
)
def test_queries_without_the_backlog_do_not_build_it(spark, fresh, name):
    """No row is moved for columns that the query does not read."""
    build = {**catalog.ENRICHMENT, **catalog.FINDINGS, **catalog.VIEW_QUERIES}[name]
    assert build(fresh).count() > 0
    assert not {"timed_lines", "tickets", "raw_dir"} & set(fresh._built)


@pytest.mark.parametrize("most", [1, 5, 100])
def test_backlog_over_slices_of_any_width(spark, most):
    rng = random.Random(most)
    base, rows = datetime(2000, 1, 1), []
    for i in range(300):
        c = base + timedelta(seconds=rng.randrange(400) * rng.choice([1, 900]))
        e = rng.choice([None, c, c + timedelta(seconds=rng.choice([5, 60, 90_000]))])
        rows.append((rng.choice(["a", "b", None]), i, c, e, f"x{i}"))
    df = spark.createDataFrame(rows, "g string, i int, c timestamp_ntz, e timestamp_ntz, kept string")
    out = with_open_backlog(df, "g", "i", "c", "e", ["i", "kept"], most)
    assert plan(out).count("rangepartitioning") == 1
    got = {r["i"]: (r["kept"], r["open_backlog_at_creation"]) for r in out.collect()}
    assert len(got) == len(rows)
    for g, i, c, _, kept in rows:
        early = [e2 is None or e2 > c for g2, i2, c2, e2, _ in rows if g2 == g and (c2, i2) < (c, i)]
        # An item that ends as it begins counts off before it counts on.
        own = sum(g2 == g and c2 == e2 == c and i2 >= i for g2, i2, c2, e2, _ in rows)
        assert got[i] == (kept, sum(early) - own)


def test_last_of_the_intervals_around_an_instant(spark):
    day = datetime(2000, 1, 1)
    spans = [("o1", "a", day, day + timedelta(days=3)), ("o2", "a", day + timedelta(days=1), day + timedelta(days=2)),
             ("o0", "a", day, day + timedelta(days=3)), ("o9", "b", day, day)]
    points = [(1, "a", day), (2, "a", day + timedelta(days=1)), (3, "a", day + timedelta(days=2)), (4, "b", day),
              (5, "a", day + timedelta(days=3)), (6, None, day), (7, "a", None)]
    p = spark.createDataFrame(points, "i int, k string, ts timestamp_ntz")
    o = spark.createDataFrame(spans, "o string, k string, s timestamp_ntz, e timestamp_ntz")
    got = {r["i"]: r["last"] for r in last_inside(p, "ts", o, "s", "e", ["k"], "o", "last").collect()}
    assert got == {1: "o1", 2: "o2", 3: "o1", 4: None, 5: None, 6: None, 7: None}


def test_facts_and_tickets_agree(fresh):
    facts = fresh.get("facts").drop("timeline")
    tickets = fresh.tickets.select(*facts.columns)
    assert facts.exceptAll(tickets).count() == 0 and facts.count() == tickets.count()
    assert fresh.tickets.filter(F.col("open_backlog_at_creation").isNull()).count() == 0


def test_wide_raw_rows_are_shuffled_once(fresh):
    """rows of an id meet once, for both kinds of duplicates."""
    text = plan(catalog.CLEANING["trimmed_text"](fresh))
    # One for the rows with an id; two for those without one, which are combined before each.
    assert text.count("hashpartitioning(id") == 3
    assert "REPARTITION_BY_COL" in text and not {"tickets", "raw_dir"} & set(fresh._built)


def test_tickets_meet_no_dimension_in_full_width(fresh):
    """Only keys are joined with the dimensions."""
    checked = fresh.get("cleaned").checked
    text = plan(checked)
    assert "SortMergeJoin" not in text and checked.filter("not known_keys").count() > 0


def test_places_of_lines_that_differ_in_the_flag_only(spark, tmp_path):
    """columns that only break ties stay unread, but where lines tie, they decide."""
    for name in ("orders", "customer", "part"):
        table(spark, SF_DIR, name).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = table(spark, SF_DIR, "lineitem")
    some = lines.filter("l_orderkey % 7 = 0")
    flag = F.when(F.col("l_returnflag") == "A", "R").otherwise("A")
    ties = some.withColumns({"l_returnflag": flag, "l_quantity": F.col("l_quantity") + F.col("l_suppkey") % 3 - 1})
    none = some.withColumns({"l_returnflag": F.lit(None).cast("string"), "l_tax": F.lit(None).cast("double")})
    for added in (None, ties.unionByName(none).unionByName(some)):
        path = f"{tmp_path}/lineitem.parquet"
        whole = lines if added is None else lines.unionByName(added)
        whole.write.mode("overwrite").parquet(path)
        kept = []
        got = joined_lines(spark, str(tmp_path), lambda df: kept.append(stage(df, "lines")) or kept[-1])
        assert len(kept) == (1 if added is None else 2)
        columns = ["l_orderkey", "l_linenumber", "place", "l_partkey", "l_suppkey", "l_returnflag"]
        same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER)
        want = whole.withColumn("place", (F.row_number().over(same) - 1).cast("bigint")).select(*columns)
        assert got.count() == want.count()
        assert got.select(*columns).exceptAll(want).isEmpty()
    assert "l_extendedprice" not in plan(numbered_lines(lines, [*TIE_COLUMNS, "l_returnflag"]))


@pytest.mark.parametrize("name", ["reopen_counts", "sequenced_history", "breach_by_dimension", "resolution_stats"])
def test_queries_without_scores_look_for_no_threshold(spark, name):
    """a threshold orders and writes the labelled tickets."""
    desk = _new_desk(spark, SF_DIR)
    build = {**catalog.ENRICHMENT, **catalog.FINDINGS, **catalog.VIEW_QUERIES}[name]
    assert build(desk).count() > 0
    assert "thresholds" not in desk._built


@pytest.mark.parametrize("rows, top", [(103, 1), (103, 4), (4, 9), (1000, 60)])
def test_backlog_bins_with_many_ties(spark, rows, top):
    """bins are equal counts in the order of (backlog, ticket), also where one backlog spans bins."""
    rng = random.Random(rows + top)
    data = [(i, rng.choice([True, False, None]), rng.randrange(top), rng.random() < 0.9) for i in range(rows)]
    df = spark.createDataFrame(
        data, "ticket_id long, sla_breached boolean, open_backlog_at_creation int, is_resolved boolean"
    )
    got = {r["quintile"]: tuple(r)[1:5] for r in breach_by_backlog_quintile(Desk({"tickets": lambda d: df})).collect()}
    order = sorted((b, i, bad) for i, bad, b, done in data if done)
    want, at = {}, 0
    for q in range(1, 6):
        size = len(order) // 5 + (q <= len(order) % 5)
        part, at = order[at : at + size], at + size
        if part:
            want[q] = (part[0][0], part[-1][0], size, sum(bad is True for *_, bad in part))
    assert got == want


def test_backlog_bins_move_no_whole_lines(spark):
    """whole lines are neither carried through the backlog nor written for it."""
    desk = _new_desk(spark, SF_DIR)
    assert breach_by_backlog_quintile(desk).count() == 5
    assert not {"timed_lines", "tickets", "thresholds"} & set(desk._built)


def test_baseline_builds_no_backlog(spark):
    """the medians by tier and severity need no feature that orders all tickets."""
    desk = _new_desk(spark, SF_DIR)
    got = [tuple(r) for r in catalog.resolve_time_baseline(desk).collect()]
    assert not {"timed_lines", "tickets", "model_rows", "thresholds"} & set(desk._built)
    catalog.model_rows(desk)
    assert got == [tuple(r) for r in catalog.resolve_time_baseline(desk).collect()]


def test_extracts_are_written_compressed(fresh, tmp_path):
    """a ticket's labels are long and repeat; the rows read back are all there."""
    got = export_extracts(fresh, str(tmp_path), ["fact_ticket", "dim_site"]).collect()
    assert [r["rows"] for r in got] == [fresh.facts.count(), fresh.sites.count()]
    assert list(tmp_path.glob("fact_ticket/*.csv.gz")) and not list(tmp_path.glob("*/*.csv"))
    plain = export_extracts(fresh, str(tmp_path), ["fact_ticket"], compression="none").first()
    assert plain["rows"] == got[0]["rows"] and plain["bytes"] > 4 * got[0]["bytes"]


def test_raw_tickets_are_written_without_another_sort(spark):
    """Lines go to the raw files from the backlog, and only who reads the history writes it."""
    desk = _new_desk(spark, SF_DIR)
    assert [r[0] for r in catalog.snapshot_of_extract(desk).collect()] == ["declared", "last_update"]
    assert not {"timed_lines", "tickets", "raw_dir", "thresholds"} & set(desk._built)


def test_clean_tickets_are_not_written_in_full_width(spark):
    """Besides the raw files, only ids, unknown keys and rows of repeated ids are staged."""
    desk = _new_desk(spark, SF_DIR)
    checked = desk.get("cleaned").checked
    assert checked.filter("not known_keys").count() > 0
    read = {f.rsplit("/", 2)[1].rsplit("-", 5)[0] for f in checked.inputFiles()}
    assert "tickets.csv" in read and "checked" not in read


def test_long_methods_are_split_unless_the_session_says_otherwise(spark):
    """The JVM does not compile a method of more than 8,000 bytes."""
    name, limit = METHOD_LIMIT
    _new_desk(spark, SF_DIR)
    assert spark.conf.get(name) == limit
    spark.conf.set(name, "65535")
    _new_desk(spark, SF_DIR)
    assert spark.conf.get(name) == "65535"
    spark.conf.unset(name)
    _new_desk(spark, SF_DIR)
    assert spark.conf.get(name) == limit


def test_audit_rows_are_counted_without_the_backlog(spark):
    """rows are counted, so whole lines are not written once more with their backlog."""
    desk = _new_desk(spark, SF_DIR)
    got = {r["table_name"]: r["rows"] for r in catalog.load_run_latest(desk).collect()}
    assert got["fact_ticket"] == got["ticket_risk_score"] == desk.get("base").count()
    assert not {"timed_lines", "tickets"} & set(desk._built)


def test_processed_tables_need_no_scores_and_are_compressed(spark):
    """no threshold is looked for, and the files take a fraction of the text."""
    desk = _new_desk(spark, SF_DIR)
    back = catalog.processed_roundtrip(desk)
    assert back.count() == desk.get("base").count() and "thresholds" not in desk._built
    assert back.inputFiles() and all(f.endswith(".csv.gz") for f in back.inputFiles())


def test_audit_of_several_rules_in_one_pass(spark, fresh):
    """the combined passes count what the single ones count, NULLs and lost keys included."""
    df = spark.createDataFrame(
        [(1, 10, "x"), (None, 10, "y"), (3, None, None), (4, 99, "x"), (4, 98, "z")], "a int, k int, s string"
    )
    tests = {"row:small": F.col("a") < 4, "domain:s": F.col("s").isin("x", "y")}
    one = quality.rules(df, "t", ["a", "s"], tests)
    two = quality.not_null(df, "t", ["a", "s"]).unionByName(quality.checks(df, "t", tests))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    parent, other = spark.createDataFrame([(10,), (11,)], "id int"), spark.createDataFrame([("x",), ("x",)], "s string")
    one = quality.foreign_keys(df, "t", {"k": (parent, "id"), "s": (other, "s")})
    two = quality.foreign_key(df, "t", "k", parent, "id").unionByName(quality.foreign_key(df, "t", "s", other))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    text = quality.constraint_audit(fresh)._jdf.queryExecution().optimizedPlan().toString()
    # Tickets: rules, unique, foreign keys, and parent of two tables; changes and scores: three passes each.
    assert 0 < text.count("Relation [l_orderkey") <= 11

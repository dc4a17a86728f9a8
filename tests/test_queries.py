"""Every registered query against its SQL twin, and invariants between queries."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import canonical, connect, kinds
from ticketlens import catalog
from ticketlens.plans import views
from ticketlens.plans.desk import load_extract

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    res = duck.execute(SQL[name])
    want = pd.DataFrame(res.fetchall(), columns=[d[0] for d in res.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    a, b = kinds(got), kinds(want)
    assert {c: a[c] for c in a if "-" not in (a[c], b[c])} == {
        c: b[c] for c in b if "-" not in (a[c], b[c])
    }


# --- invariants ------------------------------------------------------------------------

FLOW = ["tickets_opened", "tickets_resolved", "breached_tickets"]


@pytest.mark.parametrize("by", [views.weekly_kpi_by_customer, views.weekly_kpi_by_service])
def test_weekly_parts_sum_to_the_desk_total(desk, by):
    total = views.weekly_kpi(desk).select("week_ending", *FLOW)
    parts = by(desk).groupBy("week_ending").agg(*[F.sum(c).alias(c) for c in FLOW])
    assert total.exceptAll(parts).count() == 0 and parts.exceptAll(total).count() == 0


def test_open_list_agrees_with_ageing_and_weekly_level(desk):
    monthly = {
        r[0]: r[1]
        for r in views.backlog_ageing_monthly(desk).groupBy("as_of").agg(F.sum("open_tickets")).collect()
    }
    by_service = {
        r[0]: r[1]
        for r in views.backlog_monthly_by_service(desk).groupBy("as_of").agg(F.sum("open_tickets")).collect()
    }
    assert monthly == by_service
    assert monthly[catalog.AS_OF] == views.open_tickets(desk, catalog.AS_OF).count()
    week = views.weekly_kpi(desk).filter("open_backlog > 0").orderBy("week_ending").first()
    assert views.open_tickets(desk, week["backlog_as_of"]).count() == week["open_backlog"]


def test_deciles_differ_by_at_most_one_and_rise(desk):
    rows = catalog.extracts.risk_deciles(desk).orderBy("Decile").collect()
    sizes = [r["Tickets"] for r in rows]
    assert [r["Decile"] for r in rows] == list(range(1, 11))
    assert max(sizes) - min(sizes) <= 1
    floors = [r["Probability From"] for r in rows]
    assert floors == sorted(floors)


def test_constraints_hold(desk):
    assert catalog.quality.constraint_audit(desk).filter("violations > 0").count() == 0


def test_constraint_audit_sees_violations(spark, desk):
    t = desk.tickets.limit(50)
    bad = t.unionByName(t.limit(1).withColumn("priority", F.lit(9)))
    checks = catalog.quality.checks(bad, "t", catalog.quality.ticket_checks())
    assert {r[1]: r[2] for r in checks.collect()}["range:priority"] == 1
    assert catalog.quality.unique(bad, "t", ["ticket_id"]).first()["violations"] == 1
    few = desk.customers.filter("customer_id < 0")
    assert catalog.quality.foreign_key(t, "t", "customer_id", few).first()["violations"] == 50


def test_loading_the_dirty_extract_recovers_the_clean_tickets(spark, desk):
    """Cleaning, enrichment and history numbering of the raw files give the staged tables."""
    loaded = load_extract(spark, desk.get("raw_dir"))
    assert loaded.snapshot == desk.snapshot
    rejected = desk.get("cleaned").rejected.select(F.col("id").cast("bigint").alias("ticket_id"))
    cols = [
        "severity", "status", "creation_ts", "resolution_ts", "tier", "region", "service_type",
        "sla_target_hours", "resolution_hours", "sla_breached", "creation_hour_local", "closed_ts",
    ]
    want = desk.tickets.join(rejected, "ticket_id", "left_anti").select("ticket_id", *cols)
    got = loaded.tickets.select(F.col("ticket_id").cast("bigint").alias("ticket_id"), *cols)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert loaded.history.count() == desk.get("cleaned_history").rows().count()
    # Without a scorer every score is NULL, and nothing fails for the lack of one.
    assert loaded.tickets.filter("risk_band is not null").count() == 0
    assert loaded.loads.first()["snapshot_ts"] == loaded.snapshot


def test_results_do_not_depend_on_the_session_zone(spark, desk):
    before = spark.conf.get("spark.sql.session.timeZone")

    def snapshot():
        parts = [
            views.weekly_kpi(desk),
            views.backlog_ageing_monthly(desk),
            views.outage_impact(desk),
            views.customer_risk_trend(desk),
        ]
        return [sorted(map(str, p.collect())) for p in parts]

    utc = snapshot()
    spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")
    try:
        assert snapshot() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

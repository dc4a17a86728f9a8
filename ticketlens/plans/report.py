"""Datasets of the weekly service-desk report for the week ending on a Sunday."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.constants import AGE_BANDS
from ticketlens.functions.exact import big, ratio, units, wide_ratio
from ticketlens.operators.openat import WeekGrid
from ticketlens.operators.percentile import MEDIAN, selected_percentiles
from ticketlens.plans import views
from ticketlens.plans.desk import Desk
from ticketlens.plans.views import flag, one, urgent

TREND_WEEKS = 13
BASELINE_WEEKS = 4
TOP_N = 50

# The ten KPIs (label, source column, which direction is better).
KPIS = [
    ("Tickets opened", "tickets_opened", "-"),
    ("Tickets resolved", "tickets_resolved", "higher"),
    ("SLA compliance", "sla_compliance", "higher"),
    ("SLA breaches", "breached_tickets", "lower"),
    ("MTTR - mean resolution (h)", "mttr_hours", "lower"),
    ("Resolution time p50 (h)", "p50_resolution_hours", "lower"),
    ("Resolution time p90 (h)", "p90_resolution_hours", "lower"),
    ("Open backlog at week end", "open_backlog", "lower"),
    ("Backlog aged over the SLA (past due)", "backlog_past_due", "lower"),
    ("High-risk open tickets (model)", "high_risk_open", "lower"),
]


def available_weeks(desk: Desk) -> DataFrame:
    """Week endings with a full week of data, oldest first."""
    spine = views.week_spine(desk.spark, desk.weeks)
    return spine.select("week_ending").orderBy("week_ending")


def last_week(desk: Desk) -> date:
    grid = desk.weeks
    return (grid.first + timedelta(days=7 * (grid.size - 1) - 1)).date()


def check_week(desk: Desk, week_ending: date | None) -> date:
    """The week to report: default the last full one; must be a Sunday with a prior week."""
    grid = desk.weeks
    if not grid.size:
        raise ValueError("the data holds no complete week")
    first, last = (grid.first - timedelta(days=1)).date(), last_week(desk)
    week = week_ending or last
    if week.weekday() != 6:
        raise ValueError(f"a week is named by its Sunday, which {week} is not")
    if not first <= week <= last:
        raise ValueError(f"{week} lies outside the complete weeks, {first} to {last}")
    if week == first:
        raise ValueError(f"{week} has no earlier week to compare it with")
    return week


def weeks_up_to(desk: Desk, week_ending: date, n: int) -> WeekGrid:
    """The last ``n`` full weeks up to ``week_ending`` (fewer at the start of the data)."""
    end = datetime.combine(week_ending + timedelta(days=1), datetime.min.time())
    available = int((end - desk.weeks.first).days // 7) + 1
    n = min(n, available)
    return WeekGrid(end - timedelta(days=7 * (n - 1)), n)


def week_end_instant(week_ending: date) -> datetime:
    return datetime.combine(week_ending + timedelta(days=1), datetime.min.time())


def kpi_trend(desk: Desk, week_ending: date | None = None, n: int = TREND_WEEKS) -> DataFrame:
    """The last ``n`` weeks of the weekly KPIs up to the report week, oldest first.

    Only those weeks are computed: the time filters reach the scan.
    """
    week = check_week(desk, week_ending)
    return views.weekly_kpi(desk, weeks_up_to(desk, week, n)).orderBy("week_ending")


def kpi_summary(desk: Desk, week_ending: date | None = None) -> DataFrame:
    """Ten KPIs: this week, prior week, mean of the four weeks before, and the changes.

    Compliance is the unrounded ratio; its changes are in percentage points.
    """
    week = check_week(desk, week_ending)
    recent = views.weekly_kpi(desk, weeks_up_to(desk, week, BASELINE_WEEKS + 1))
    done = F.nullif(F.col("tickets_resolved"), F.lit(0).cast("bigint")).cast("double")
    kept = recent.withColumn("sla_compliance", 1 - F.col("breached_tickets") / done)
    entries = [
        F.struct(
            F.lit(i).alias("kpi_order"),
            F.lit(label).alias("kpi"),
            F.col(column).cast("double").alias("value"),
            F.lit(better).alias("better_when"),
            F.lit(100.0 if column == "sla_compliance" else 1.0).alias("scale"),
        )
        for i, (label, column, better) in enumerate(KPIS, start=1)
    ]
    long = kept.select("week_ending", F.inline(F.array(*entries)))
    this = F.col("week_ending") == F.lit(week)
    prior = F.col("week_ending") == F.lit(week - timedelta(days=7))
    agg = long.groupBy("kpi_order", "kpi", "better_when", "scale").agg(
        F.max(F.when(this, F.col("value"))).alias("this_week"),
        F.max(F.when(prior, F.col("value"))).alias("prior_week"),
        F.avg(F.when(~this, F.col("value"))).alias("trailing_mean"),
    )

    def shown(value: Column) -> Column:
        return F.round(value, 4)

    return agg.select(
        "kpi_order",
        "kpi",
        shown(F.col("this_week")).alias("this_week"),
        shown(F.col("prior_week")).alias("prior_week"),
        shown((F.col("this_week") - F.col("prior_week")) * F.col("scale")).alias("change_vs_prior"),
        shown(F.col("trailing_mean")).alias("trailing_mean"),
        shown((F.col("this_week") - F.col("trailing_mean")) * F.col("scale")).alias(
            "change_vs_mean"
        ),
        "better_when",
    ).orderBy("kpi_order")


# --- by customer / by service ----------------------------------------------------------


def open_aggregates(desk: Desk, key: str, as_of: datetime) -> DataFrame:
    """Open, past-due and high-risk tickets per key at one instant."""
    return views.open_tickets(desk, as_of).groupBy(key).agg(
        F.count(F.lit(1)).alias("open_backlog"),
        F.count_if("past_due").alias("backlog_past_due"),
        F.count_if(F.col("risk_band") == "high").alias("high_risk_open"),
    )


def _with_prior(two_weeks: DataFrame, key: str, week: date) -> DataFrame:
    """The report week's rows plus the same key's compliance of the week before."""
    prior = two_weeks.filter(F.col("week_ending") < F.lit(week)).select(
        key, F.col("sla_compliance_pct").alias("prior_week_compliance_pct")
    )
    return two_weeks.filter(F.col("week_ending") == F.lit(week)).join(prior, key, "left")


OPEN_COLUMNS = ["open_backlog", "backlog_past_due", "high_risk_open"]


def _sheet(desk: Desk, week: date, weekly: DataFrame, key: str) -> DataFrame:
    rows = _with_prior(weekly, key, week)
    held = open_aggregates(desk, key, week_end_instant(week))
    return rows.join(held, key, "left").fillna(0, OPEN_COLUMNS)


def customer_week(desk: Desk, week_ending: date | None = None) -> DataFrame:
    week = check_week(desk, week_ending)
    weekly = views.weekly_kpi_by_customer(desk, weeks_up_to(desk, week, 2))
    return _sheet(desk, week, weekly, "customer_id").orderBy(
        F.col("breached_tickets").desc(), F.col("tickets_opened").desc(), "customer_name"
    )


def service_week(desk: Desk, week_ending: date | None = None) -> DataFrame:
    week = check_week(desk, week_ending)
    weekly = views.weekly_kpi_by_service(desk, weeks_up_to(desk, week, 2))
    return _sheet(desk, week, weekly, "service_type").orderBy(
        F.col("breached_tickets").desc(), "service_type"
    )


def totals_row(sheet: DataFrame) -> DataFrame:
    """Column sums of a customer or service sheet; compliance recomputed from the sums."""
    sums = ["tickets_opened", "tickets_resolved", "breached_tickets", *OPEN_COLUMNS]
    total = sheet.agg(*[F.sum(c).alias(c) for c in sums])
    good = F.col("tickets_resolved") - F.col("breached_tickets")
    share = wide_ratio(big(good) * 100, big("tickets_resolved"), 2)
    return total.withColumn("sla_compliance_pct", share)


# --- ageing matrix and at-risk list ----------------------------------------------------


def ageing_matrix(desk: Desk, key: str, week_ending: date | None = None) -> DataFrame:
    """Open tickets by key and age band at the week end, with a total row (key NULL)."""
    week = check_week(desk, week_ending)
    held = views.open_tickets(desk, week_end_instant(week)).withColumn(
        "age_cents", units("age_hours", 100)
    )
    sums = {
        **{band: flag(F.col("age_bucket") == band) for band in AGE_BANDS},
        "total_open": one(),
        "past_due": flag("past_due"),
        "critical_or_major": flag(urgent()),
        "high_risk": flag(F.col("risk_band") == "high"),
    }

    def shaped(keys: list[str]) -> DataFrame:
        agg = selected_percentiles(held, keys, "age_cents", {"p50": MEDIAN}, sums)
        total = F.lit(None).cast("string").alias(key)
        return agg.select(
            *(keys or [total]),
            *[F.col(f"`{c}`") for c in sums],
            ratio("p50", 200, 1).alias("median_age_hours"),
        )

    return shaped([key]).unionByName(shaped([]))


def at_risk_top_n(desk: Desk, week_ending: date | None = None, n: int = TOP_N) -> DataFrame:
    """Open scored tickets with the highest breach probability at the week end."""
    week = check_week(desk, week_ending)
    held = views.open_tickets(desk, week_end_instant(week)).filter("probability is not null")
    order = [F.col("probability").desc(), "creation_ts", "ticket_id"]
    top = held.orderBy(*order).limit(n)
    # At most ``n`` rows reach this window.
    rank = F.row_number().over(Window.orderBy(*order))
    age = (F.unix_timestamp("as_of") - F.unix_timestamp("creation_ts")).cast("bigint")
    return top.select(
        rank.alias("rank"),
        "ticket_id",
        "name",
        "customer_name",
        "tier",
        "service_type",
        "severity",
        "assignment_group",
        "creation_ts",
        ratio(age, 3600, 1).alias("age_hours"),
        "sla_target_hours",
        "expected_resolution_ts",
        F.when(F.col("past_due"), "yes").otherwise("no").alias("past_due"),
        "probability",
        "risk_band",
    ).orderBy("rank")


def provenance(desk: Desk, source: str) -> DataFrame:
    """Snapshot, model version and source of a report, as one row."""
    version = desk.scores.agg(F.min("model_version").alias("model_version"))
    return version.select(
        F.expr(f"timestamp_ntz'{desk.snapshot:%Y-%m-%d %H:%M:%S}'").alias("snapshot_ts"),
        "model_version",
        F.lit(source).alias("source"),
    )


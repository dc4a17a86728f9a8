"""The analytical views: compliance, backlog ageing, resolution, outages, risk, weekly KPIs.

Every view is a scan of the wide ticket table followed by aggregation with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens import constants as C
from ticketlens.functions.exact import (
    big,
    compliance_pct,
    count_where,
    idiv,
    month_of,
    pct,
    pct_units,
    plus_seconds,
    ratio,
    scaled,
    seconds,
    units,
    week_of,
    wide_ratio,
)
from ticketlens.operators.dense import every_step
from ticketlens.operators.intervals import flag_inside, interval_join
from ticketlens.operators.openat import (
    WeekGrid,
    explode_open,
    ntz,
    open_counts,
    open_rows,
)
from ticketlens.operators.ordering import rank_desc
from ticketlens.operators.percentile import (
    MEDIAN,
    P90,
    grouped_percentiles,
    second_hours,
    selected_percentiles,
    tick_hours,
)
from ticketlens.plans.desk import Desk


def one() -> Column:
    return F.lit(1).cast("bigint")


def flag(cond: Column | str) -> Column:
    """1 / 0 as a summable integer; unknown counts as 0."""
    cond = F.expr(cond) if isinstance(cond, str) else cond
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def ticks(hours: str = "resolution_hours") -> Column:
    """A four-decimal hour column in whole ten-thousandths."""
    return units(hours, 10_000)


def urgent() -> Column:
    return F.col("severity").isin("critical", "major")


def not_cancelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") != "cancelled")


def mean_ticks(total: Column | str, n: Column | str, digits: int = 2) -> Column:
    """Mean of ten-thousandths of an hour, as rounded hours."""
    n = F.col(n) if isinstance(n, str) else n
    total = F.col(total) if isinstance(total, str) else total
    return wide_ratio(big(total), big(n) * 10_000, digits)


OUTCOME_SUMS = {
    "tickets": one,
    "resolved_tickets": lambda: flag("is_resolved"),
    "tickets_with_outcome": lambda: flag("sla_breached is not null"),
    "breached_tickets": lambda: flag("sla_breached"),
}


def outcome_sums() -> dict[str, Column]:
    return {name: make() for name, make in OUTCOME_SUMS.items()}


# --- compliance ------------------------------------------------------------------------


def sla_compliance_monthly(desk: Desk) -> DataFrame:
    """Customer x service type x creation month; unknown outcomes leave the denominator."""
    # hours / target per ticket in 1e-9 units, rounded; only resolved tickets contribute.
    target = units("sla_target_hours", 100)
    use = idiv(F.col("ticks") * 20_000_000 + target, target * 2)
    base = not_cancelled(desk.facts).withColumns(
        {"month": month_of("creation_ts"), "ticks": ticks()}
    )
    sums = {
        **outcome_sums(),
        "_use": F.when(F.col("is_resolved"), use).otherwise(F.lit(0).cast("bigint")),
    }
    # Names and tier hang on the customer id, so they join the aggregated rows.
    keys = ["customer_id", "service_type", "month"]
    agg = grouped_percentiles(base, keys, "ticks", {"p50": MEDIAN}, sums)
    people = desk.customers.select("customer_id", "customer_name", "tier", "industry")
    return agg.join(people, "customer_id").select(
        "customer_id",
        "customer_name",
        "tier",
        "industry",
        "service_type",
        "month",
        *OUTCOME_SUMS,
        compliance_pct("breached_tickets", "tickets_with_outcome").alias("sla_compliance_pct"),
        tick_hours("p50").alias("p50_resolution_hours"),
        wide_ratio(big("_use"), big("resolved_tickets") * 1_000_000_000, 3).alias(
            "avg_target_utilisation"
        ),
    )


# --- backlog ---------------------------------------------------------------------------


def _ageing(pairs: DataFrame) -> DataFrame:
    keys = ["as_of", "assignment_group", "age_bucket", "bucket_order"]
    sums = {
        "open_tickets": one(),
        "past_due_tickets": flag("past_due"),
        "critical_or_major": flag(urgent()),
    }
    agg = grouped_percentiles(pairs, keys, "age_seconds", {"p50": MEDIAN}, sums)
    return agg.select(*keys, *sums, second_hours("p50").alias("median_age_hours"))


AGEING_INPUT = ["assignment_group", "severity", "creation_ts", "closed_ts", "expected_resolution_ts"]


def backlog_ageing(desk: Desk, as_of: datetime) -> DataFrame:
    """Open tickets per assignment group and age band at one instant."""
    return _ageing(open_rows(desk.facts.select(*AGEING_INPUT), as_of))


def backlog_ageing_monthly(desk: Desk) -> DataFrame:
    """The same at every month start from the month after the first ticket to the snapshot."""
    return _ageing(explode_open(desk.facts.select(*AGEING_INPUT), desk.months))


def backlog_ageing_current(desk: Desk) -> DataFrame:
    return backlog_ageing(desk, desk.snapshot)


def open_tickets(desk: Desk, as_of: datetime) -> DataFrame:
    """The open tickets themselves with dimensions, age, past-due flag and risk score."""
    rows = open_rows(desk.facts, as_of)
    return rows.select(
        "as_of",
        "ticket_id",
        "name",
        "creation_ts",
        "expected_resolution_ts",
        "customer_id",
        "customer_name",
        "tier",
        "industry",
        "site_id",
        "region",
        "province",
        "service_type",
        "assignment_group",
        "severity",
        "ticket_type",
        "channel",
        F.col("sla_target_hours").cast("double").alias("sla_target_hours"),
        ratio("age_seconds", 3600, 2).alias("age_hours"),
        "past_due",
        "age_bucket",
        "bucket_order",
        "probability",
        "risk_band",
    )


def backlog_monthly_by_service(desk: Desk) -> DataFrame:
    counted = {
        "critical_or_major": urgent(),
        "high_risk_tickets": F.col("risk_band") == "high",
    }
    return open_counts(desk.facts, desk.months, ["service_type"], counted, banded=True)


# --- resolution ------------------------------------------------------------------------


def resolution_stats(desk: Desk) -> DataFrame:
    """MTTR and percentiles by severity and service type with all subtotals.

    Each ticket counts in its four (sub)total rows; only counts and sums are shuffled.
    """
    dims = ["severity", "service_type"]
    target = units("sla_target_hours", 100)
    both = [F.col(d).alias(d) for d in dims]
    every = [F.lit("all").alias(d) for d in dims]
    sets = [F.struct(a, b) for a in (both[0], every[0]) for b in (both[1], every[1])]
    base = desk.unscored.filter("is_resolved").select(
        ticks().alias("ticks"), flag("sla_breached").alias("breached"), target.alias("target"),
        F.explode(F.array(*sets)).alias("_set"),
    )
    named = base.select("_set.*", "ticks", "breached", "target")
    sums = {
        "resolved_tickets": one(),
        "_ticks": F.col("ticks"),
        "_target": F.col("target"),
        "_breached": F.col("breached"),
    }
    agg = selected_percentiles(named, dims, "ticks", {"p50": MEDIAN, "p90": P90}, sums)
    return agg.select(
        *dims,
        "resolved_tickets",
        mean_ticks("_ticks", "resolved_tickets").alias("mttr_hours"),
        tick_hours("p50").alias("p50_hours"),
        tick_hours("p90", P90).alias("p90_hours"),
        wide_ratio(big("_target"), big("resolved_tickets") * 100, 2).alias("avg_target_hours"),
        pct("_breached", "resolved_tickets").alias("breach_rate_pct"),
    )


# --- outages ---------------------------------------------------------------------------

PLACE = ["region", "service_type"]


def outage_impact(desk: Desk) -> DataFrame:
    """Per outage: volume and breach rate during it and in the 28 days before, one pass."""
    base = not_cancelled(desk.facts).select(*PLACE, "creation_ts", "severity", "sla_breached")
    before = F.lit(-C.BASELINE_DAYS * 86400)
    windows = desk.outages.select(
        "outage_id",
        *PLACE,
        F.col("start_ts").alias("o_start"),
        plus_seconds("start_ts", before).alias("o_from"),
        F.col("end_ts").alias("o_end"),
    )
    pairs = interval_join(base, "creation_ts", windows, "o_from", "o_end", PLACE)
    during = F.col("creation_ts") >= F.col("o_start")
    known = F.col("sla_breached").isNotNull()
    counts = pairs.groupBy("outage_id").agg(
        count_where(during).alias("n"),
        count_where(during & F.col("sla_breached")).alias("b"),
        count_where(during & known).alias("k"),
        count_where(during & urgent()).alias("u"),
        count_where(~during).alias("n0"),
        count_where(~during & F.col("sla_breached")).alias("b0"),
        count_where(~during & known).alias("k0"),
    )
    joined = desk.outages.join(counts, "outage_id", "left").withColumns(
        {
            "secs": seconds("end_ts") - seconds("start_ts"),
            "n": F.coalesce(F.col("n"), F.lit(0)),
            "n0": F.coalesce(F.col("n0"), F.lit(0)),
        }
    )
    hours0 = C.BASELINE_DAYS * 24
    # (n / (secs / 3600)) / (n0 / hours0) without intermediate rounding
    multiplier = wide_ratio(
        big("n") * F.lit(3600 * hours0), big("secs") * big("n0"), 1
    )
    return joined.select(
        "outage_id",
        "cause",
        *PLACE,
        "start_ts",
        "end_ts",
        ratio("secs", 3600, 1).alias("duration_hours"),
        F.col("n").alias("tickets_during"),
        ratio(F.col("n") * 3600, "secs", 2).alias("tickets_per_hour_during"),
        ratio("n0", hours0, 3).alias("tickets_per_hour_baseline"),
        multiplier.alias("volume_multiplier"),
        pct("b", "k", 1).alias("breach_rate_during_pct"),
        pct("b0", "k0", 1).alias("breach_rate_baseline_pct"),
        pct("u", "n", 1).alias("critical_major_share_pct"),
    ).orderBy("start_ts")


def during_outage(tickets: DataFrame, outages: DataFrame) -> DataFrame:
    """Adds ``during_outage``: an outage of the region and service was active at creation."""
    return flag_inside(
        tickets, "creation_ts", outages, "start_ts", "end_ts", PLACE, "during_outage"
    )


def outage_vs_normal(desk: Desk) -> DataFrame:
    cols = [
        *PLACE, "creation_ts", "severity", "sla_breached", "resolution_hours",
        "open_backlog_at_creation",
    ]
    base = not_cancelled(desk.tickets).select(*cols).withColumn("ticks", ticks())
    sums = {
        "tickets": one(),
        "_known": flag("sla_breached is not null"),
        "_breached": flag("sla_breached"),
        "_urgent": flag(urgent()),
        "_backlog": F.col("open_backlog_at_creation").cast("bigint"),
    }
    flagged = during_outage(base, desk.outages)
    agg = selected_percentiles(flagged, ["during_outage"], "ticks", {"p50": MEDIAN}, sums)
    return agg.select(
        "during_outage",
        "tickets",
        pct("_breached", "_known").alias("breach_rate_pct"),
        tick_hours("p50").alias("p50_resolution_hours"),
        pct("_urgent", "tickets", 1).alias("critical_major_share_pct"),
        ratio("_backlog", "tickets", 1).alias("avg_backlog_at_creation"),
    )


# --- customer risk ---------------------------------------------------------------------


def _customer_months(desk: Desk, since: date | None = None) -> DataFrame:
    """Customer x month with rolling and previous-month rates in hundredths of a percent."""
    monthly = not_cancelled(desk.facts).groupBy(
        "customer_id", month_of("creation_ts").alias("month")
    ).agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count("sla_breached").alias("tickets_with_outcome"),
        count_where(F.col("sla_breached")).alias("breached_tickets"),
    )
    by_month = Window.partitionBy("customer_id").orderBy("month")
    three = by_month.rowsBetween(-2, Window.currentRow)
    moved = monthly.withColumns(
        {
            "_b3": F.sum("breached_tickets").over(three),
            "_k3": F.sum("tickets_with_outcome").over(three),
            "_b1": F.lag("breached_tickets").over(by_month),
            "_k1": F.lag("tickets_with_outcome").over(by_month),
        }
    )
    if since is not None:
        moved = moved.filter(F.col("month") == F.lit(since))
    people = desk.customers.select("customer_id", "customer_name", "tier", "industry")
    return moved.join(people, "customer_id").select(
        *people.columns,
        "month",
        "tickets",
        "tickets_with_outcome",
        "breached_tickets",
        pct_units("breached_tickets", "tickets_with_outcome").alias("_now"),
        pct_units("_b1", "_k1").alias("_prev"),
        pct_units("_b3", "_k3").alias("_roll"),
        F.col("_k3").alias("rolling_3m_tickets_with_outcome"),
    )


def customer_risk_trend(desk: Desk) -> DataFrame:
    ranked = rank_desc(_customer_months(desk), ["month"], "_roll", "risk_rank_in_month")
    return ranked.select(
        "customer_id",
        "customer_name",
        "tier",
        "industry",
        "month",
        "tickets",
        "tickets_with_outcome",
        "breached_tickets",
        scaled(F.col("_now"), 2).alias("breach_rate_pct"),
        scaled(F.col("_prev"), 2).alias("prev_month_breach_rate_pct"),
        scaled(F.col("_roll"), 2).alias("rolling_3m_breach_rate_pct"),
        "rolling_3m_tickets_with_outcome",
        scaled(F.col("_now") - F.col("_prev"), 2).alias("mom_change_pp"),
        "risk_rank_in_month",
    )


def month_before(snapshot: datetime) -> date:
    first = date(snapshot.year, snapshot.month, 1)
    return (first - timedelta(days=1)).replace(day=1)


def top_customers_at_risk(desk: Desk) -> DataFrame:
    """Up to ten customers with the highest rolling breach rate in the last complete month."""
    month = month_before(desk.snapshot)
    rows = _customer_months(desk, month).filter(
        F.col("rolling_3m_tickets_with_outcome") >= C.AT_RISK_MIN_TICKETS
    )
    # Ties at the cut go to the lower customer id; ranks within the kept rows are final
    # because every row with a higher rate is among them.
    top = rows.orderBy(F.col("_roll").desc(), "customer_id").limit(C.AT_RISK_ROWS)
    change = F.col("_now") - F.col("_prev")
    edge = C.TREND_THRESHOLD_PP * 100
    trend = F.when(change > edge, "worsening").when(change < -edge, "improving").otherwise("flat")
    return top.select(
        "customer_id",
        "customer_name",
        "tier",
        "industry",
        "month",
        scaled(F.col("_roll"), 2).alias("rolling_3m_breach_rate_pct"),
        "rolling_3m_tickets_with_outcome",
        scaled(F.col("_now"), 2).alias("latest_month_breach_rate_pct"),
        scaled(F.col("_prev"), 2).alias("prev_month_breach_rate_pct"),
        scaled(change, 2).alias("mom_change_pp"),
        trend.alias("trend"),
        F.rank().over(Window.orderBy(F.col("_roll").desc())).alias("risk_rank"),
    ).orderBy("risk_rank", "customer_id")


# --- risk scores -----------------------------------------------------------------------


def ticket_risk(desk: Desk) -> DataFrame:
    scored = desk.tickets.filter(F.col("probability").isNotNull())
    return scored.select(
        "ticket_id",
        "creation_ts",
        "creation_month",
        "customer_id",
        "customer_name",
        "tier",
        "industry",
        "region",
        "province",
        "service_type",
        "assignment_group",
        "severity",
        "ticket_type",
        "channel",
        "status",
        F.col("active_outage_id").isNotNull().alias("has_active_outage"),
        "open_backlog_at_creation",
        F.col("sla_target_hours").cast("double").alias("sla_target_hours"),
        "model_version",
        "probability",
        "risk_band",
        "split",
        "sla_breached",
        F.col("resolution_hours").cast("double").alias("resolution_hours"),
    )


def micro(p: str = "probability") -> Column:
    """A six-decimal probability in whole millionths."""
    return units(p, 1_000_000)


def risk_band_summary(desk: Desk) -> DataFrame:
    agg = desk.facts.filter(F.col("probability").isNotNull()).groupBy("split", "risk_band").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count("sla_breached").alias("tickets_with_outcome"),
        count_where(F.col("sla_breached")).alias("breached_tickets"),
        F.sum(micro()).alias("_p"),
    )
    order = F.when(F.col("risk_band") == "high", 0).when(F.col("risk_band") == "medium", 1)
    return agg.select(
        "split",
        "risk_band",
        "tickets",
        "tickets_with_outcome",
        "breached_tickets",
        pct("breached_tickets", "tickets_with_outcome").alias("observed_breach_rate_pct"),
        wide_ratio(big("_p"), big("tickets") * 10_000, 2).alias("mean_predicted_pct"),
    ).orderBy("split", order.otherwise(2))


# --- weekly KPIs -----------------------------------------------------------------------


def week_spine(spark: SparkSession, grid: WeekGrid) -> DataFrame:
    """week_start, week_ending (Sunday) and backlog_as_of of each full week of the grid."""
    rows = spark.range(grid.size).select(grid.instant(F.col("id")).alias("backlog_as_of"))
    day = F.to_date("backlog_as_of")
    return rows.select(
        F.date_sub(day, 7).alias("week_start"), F.date_sub(day, 1).alias("week_ending"),
        "backlog_as_of",
    )


def _weekly_measures(
    desk: Desk, grid: WeekGrid, keys: Sequence[str], fractions: dict, percentiles=selected_percentiles
) -> DataFrame:
    """Opened by creation week and resolved by resolution week.

    ``percentiles`` is ``grouped_percentiles`` where the keys have no bounded number of values.
    """
    first = ntz(grid.first - timedelta(days=7))
    stop = ntz(grid.first + timedelta(days=7 * (grid.size - 1)))
    null = F.lit(None).cast("bigint")
    opened = (F.col("creation_ts") >= first) & (F.col("creation_ts") < stop)
    done = (F.col("resolution_ts") >= first) & (F.col("resolution_ts") < stop)

    def entry(ts: str, opened: int, value: Column) -> Column:
        return F.struct(
            week_of(ts).alias("week_start"),
            F.lit(opened).cast("bigint").alias("opened"),
            value.alias("ticks"),
            (flag("sla_breached") if not opened else F.lit(0).cast("bigint")).alias("breached"),
        )

    entries = F.array(
        F.when(opened, entry("creation_ts", 1, null)),
        F.when(F.col("is_resolved") & done, entry("resolution_ts", 0, ticks())),
    )
    # The same two ranges as a plain filter, so that the scan skips other weeks' row groups.
    events = not_cancelled(desk.facts).filter(opened | done).select(
        *keys, F.explode(F.array_compact(entries)).alias("e")
    )
    flat = events.select(*keys, "e.*")
    sums = {
        "tickets_opened": F.col("opened"),
        "tickets_resolved": 1 - F.col("opened"),
        "breached_tickets": F.col("breached"),
        "_ticks": F.coalesce(F.col("ticks"), F.lit(0).cast("bigint")),
    }
    return percentiles(flat, [*keys, "week_start"], "ticks", fractions, sums)


COUNTS = ["tickets_opened", "tickets_resolved", "breached_tickets"]


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)


def _week_compliance() -> Column:
    return compliance_pct("breached_tickets", "tickets_resolved").alias("sla_compliance_pct")


def weekly_kpi(desk: Desk, grid: WeekGrid | None = None) -> DataFrame:
    """One row per full week; counts are zero-filled, statistics stay NULL."""
    grid = grid or desk.weeks
    spark = desk.spark
    flow = _weekly_measures(desk, grid, [], {"p50": MEDIAN, "p90": P90})
    level = open_counts(desk.facts, grid, [], {"high_risk_open": F.col("risk_band") == "high"})
    backlog = level.select(
        F.col("as_of").alias("backlog_as_of"),
        F.col("open_tickets").alias("open_backlog"),
        F.col("past_due_tickets").alias("backlog_past_due"),
        "high_risk_open",
    )
    # Both sides hold at most one row per week of the grid: a proven bound for the broadcast.
    joined = (
        week_spine(spark, grid)
        .join(F.broadcast(flow), "week_start", "left")
        .join(F.broadcast(backlog), "backlog_as_of", "left")
    )
    return joined.select(
        "week_start",
        "week_ending",
        "backlog_as_of",
        *[_zero(c) for c in COUNTS],
        _week_compliance(),
        mean_ticks("_ticks", "tickets_resolved").alias("mttr_hours"),
        tick_hours("p50").alias("p50_resolution_hours"),
        tick_hours("p90", P90).alias("p90_resolution_hours"),
        *[_zero(c) for c in ("open_backlog", "backlog_past_due", "high_risk_open")],
    )


def _dense(owners: DataFrame, flow: DataFrame, key: str, grid: WeekGrid) -> DataFrame:
    """Every owner on every week of the grid, with its measures of that week."""
    first = F.lit((grid.first - timedelta(days=7)).date())
    step = idiv(F.date_diff("week_start", first), 7)
    filled = every_step(owners, flow.withColumn("_i", step).drop("week_start"), key, "_i", grid.size)
    monday = F.date_add(first, (F.col("_i") * 7).cast("int"))
    return filled.withColumns({"week_start": monday, "week_ending": F.date_add(monday, 6)})


def weekly_kpi_by_customer(desk: Desk, grid: WeekGrid | None = None) -> DataFrame:
    grid = grid or desk.weeks
    flow = _weekly_measures(desk, grid, ["customer_id"], {"p50": MEDIAN}, grouped_percentiles)
    people = desk.customers.select("customer_id", "customer_name", "tier", "industry")
    joined = _dense(people, flow, "customer_id", grid)
    return joined.select(
        "week_start",
        "week_ending",
        *people.columns,
        *[_zero(c) for c in COUNTS],
        _week_compliance(),
        tick_hours("p50").alias("p50_resolution_hours"),
    )


def weekly_kpi_by_service(desk: Desk, grid: WeekGrid | None = None) -> DataFrame:
    grid = grid or desk.weeks
    flow = _weekly_measures(desk, grid, ["service_type"], {"p50": MEDIAN, "p90": P90})
    kinds = desk.services.select("service_type").distinct()
    joined = _dense(kinds, flow, "service_type", grid)
    return joined.select(
        "week_start",
        "week_ending",
        "service_type",
        *[_zero(c) for c in COUNTS],
        _week_compliance(),
        tick_hours("p50").alias("p50_resolution_hours"),
        tick_hours("p90", P90).alias("p90_resolution_hours"),
    )


# --- registry --------------------------------------------------------------------------

VIEWS = {
    "v_sla_compliance_monthly": sla_compliance_monthly,
    "v_backlog_ageing_monthly": backlog_ageing_monthly,
    "v_backlog_ageing_current": backlog_ageing_current,
    "v_backlog_ageing_monthly_by_service": backlog_monthly_by_service,
    "v_resolution_stats": resolution_stats,
    "v_outage_impact": outage_impact,
    "v_outage_vs_normal": outage_vs_normal,
    "v_customer_risk_trend": customer_risk_trend,
    "v_top_customers_at_risk": top_customers_at_risk,
    "v_ticket_risk": ticket_risk,
    "v_risk_band_summary": risk_band_summary,
    "v_weekly_kpi": weekly_kpi,
    "v_weekly_kpi_by_customer": weekly_kpi_by_customer,
    "v_weekly_kpi_by_service": weekly_kpi_by_service,
}


def register_views(desk: Desk, names: Sequence[str] | None = None) -> list[str]:
    """(Re)create the views as temp views, in order, so that plain SQL can query them."""
    chosen = list(VIEWS) if names is None else list(names)
    for name in chosen:
        VIEWS[name](desk).createOrReplaceTempView(name)
    return chosen

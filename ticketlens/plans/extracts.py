"""Labelled extracts for a BI tool, and the aggregates its dashboard shows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import constants as C
from ticketlens.functions import labels as L
from ticketlens.functions.exact import pct, ratio, week_of
from ticketlens.operators.ordering import row_numbers
from ticketlens.operators.percentile import (
    MEDIAN,
    P90,
    grouped_percentiles,
    selected_percentiles,
)
from ticketlens.plans import views
from ticketlens.plans.desk import Desk
from ticketlens.plans.views import flag, micro, one, ticks

STAMP = "yyyy-MM-dd HH:mm:ss"
DAY = "yyyy-MM-dd"


def _stamp(name: str) -> Column:
    """UTC text; NULL -> empty."""
    return F.coalesce(F.date_format(name, STAMP), F.lit(""))


def _day(name: str) -> Column:
    return F.date_format(name, DAY)


def centroids(spark: SparkSession) -> DataFrame:
    """The fixed city list: one row per city, so its broadcast size is fixed too."""
    schema = "city string, province string, latitude double, longitude double"
    return spark.createDataFrame(C.CITY_CENTROIDS, schema)


def locate(df: DataFrame) -> DataFrame:
    """Adds latitude and longitude by (city, province); unknown cities keep NULL."""
    return df.join(F.broadcast(centroids(df.sparkSession)), ["city", "province"], "left")


def unmatched_cities(sites: DataFrame) -> DataFrame:
    """Cities without a centroid and how many sites they have."""
    lost = sites.join(F.broadcast(centroids(sites.sparkSession)), ["city", "province"], "left_anti")
    return lost.groupBy("city", "province").agg(F.count(F.lit(1)).alias("sites"))


# --- extracts --------------------------------------------------------------------------


def fact_extract(desk: Desk) -> DataFrame:
    """One denormalised, labelled row per scored ticket."""
    t = locate(desk.facts.filter("probability is not null"))
    breached = F.col("sla_breached")
    return t.select(
        F.col("ticket_id").alias("Ticket ID"),
        _stamp("creation_ts").alias("Created At (UTC)"),
        F.col("customer_id").alias("Customer ID"),
        F.col("customer_name").alias("Customer"),
        L.humanise("industry").alias("Industry"),
        F.col("site_id").alias("Site ID"),
        F.col("site_name").alias("Site"),
        F.col("city").alias("City"),
        F.col("province").alias("Province"),
        L.province_name("province").alias("Province Name"),
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
        F.col("service_id").alias("Service ID"),
        L.humanise("tier").alias("Tier"),
        L.humanise("region").alias("Region"),
        L.service_label("service_type").alias("Service Type"),
        L.group_label("assignment_group").alias("Assignment Group"),
        L.humanise("severity").alias("Severity"),
        L.humanise("ticket_type").alias("Ticket Type"),
        L.channel_label("channel").alias("Channel"),
        L.humanise("status").alias("Status"),
        F.when(F.col("active_outage_id").isNotNull(), "Yes").otherwise("No").alias("During Outage"),
        F.coalesce(F.col("active_outage_id"), F.lit("")).alias("Outage ID"),
        F.col("sla_target_hours").cast("double").alias("SLA Target Hours"),
        _stamp("resolution_ts").alias("Resolved At (UTC)"),
        ratio(ticks(), 10_000, 2).alias("Resolution Hours"),
        F.col("is_resolved").cast("int").alias("Is Resolved"),
        L.sla_outcome_label("status", "sla_breached").alias("SLA Outcome"),
        breached.isNotNull().cast("int").alias("Has Outcome"),
        F.coalesce(breached, F.lit(False)).cast("int").alias("Is Breached"),
        F.col("probability").alias("Breach Probability"),
        L.risk_label("risk_band").alias("Risk Band"),
        L.split_label("split").alias("Model Split"),
    )


def monthly_compliance_extract(desk: Desk) -> DataFrame:
    v = views.sla_compliance_monthly(desk)
    return v.select(
        _day("month").alias("Month"),
        F.col("customer_id").alias("Customer ID"),
        F.col("customer_name").alias("Customer"),
        L.humanise("tier").alias("Tier"),
        L.humanise("industry").alias("Industry"),
        L.service_label("service_type").alias("Service Type"),
        F.col("tickets").alias("Tickets"),
        F.col("resolved_tickets").alias("Resolved Tickets"),
        F.col("tickets_with_outcome").alias("Tickets With Outcome"),
        F.col("breached_tickets").alias("Breached Tickets"),
        F.col("sla_compliance_pct").alias("SLA Compliance Pct"),
        F.col("p50_resolution_hours").alias("P50 Resolution Hours"),
        F.col("avg_target_utilisation").alias("Avg Target Utilisation"),
    )


def backlog_grid(desk: Desk) -> DataFrame:
    """Snapshot x service x age band, every combination present, zero-filled."""
    counts = views.backlog_monthly_by_service(desk)
    # The counts table has at most months x services x bands rows.
    measures = ["open_tickets", "past_due_tickets", "critical_or_major", "high_risk_tickets"]
    bands = F.array(
        *[F.struct(F.lit(b).alias("age_bucket"), F.lit(i).alias("bucket_order"))
          for i, b in enumerate(C.AGE_BANDS, start=1)]
    )
    # One row with the months and service types that occur (both few), spread back out.
    axes = counts.agg(
        F.collect_set("as_of").alias("as_of"), F.collect_set("service_type").alias("service_type")
    )
    days = axes.select(F.explode("as_of").alias("as_of"), "service_type")
    kinds = days.select("as_of", F.explode("service_type").alias("service_type"))
    grid = kinds.select("as_of", "service_type", F.inline(bands))
    dense = grid.join(
        counts.drop("bucket_order"), ["as_of", "service_type", "age_bucket"], "left"
    ).fillna(0, measures)
    return dense.select("as_of", "service_type", "age_bucket", "bucket_order", *measures)


def backlog_extract(desk: Desk) -> DataFrame:
    return backlog_grid(desk).select(
        _day("as_of").alias("Snapshot Date"),
        L.service_label("service_type").alias("Service Type"),
        F.col("age_bucket").alias("Age Band"),
        F.col("bucket_order").alias("Age Band Order"),
        F.col("open_tickets").alias("Open Tickets"),
        F.col("past_due_tickets").alias("Past Due Tickets"),
        F.col("critical_or_major").alias("Critical Or Major"),
        F.col("high_risk_tickets").alias("High Risk Tickets"),
    )


def decile_stats(scored: DataFrame) -> DataFrame:
    """Rank-based deciles ``floor((rank - 1) / (n / 10)) + 1`` of labelled, scored tickets.

    Ranks come from a range-partitioned order on (probability, ticket), not one task.
    """
    rows = scored.select("ticket_id", micro().alias("p6"), flag("sla_breached").alias("y"))
    ranked = row_numbers(rows, ["p6", "ticket_id"])
    n = ranked.agg(F.max("row_number")).first()[0] or 1
    index = F.call_function("div", (F.col("row_number") - 1) * 10, F.lit(n))
    decile = F.least(index, F.lit(9)).cast("int") + 1
    return ranked.groupBy(decile.alias("decile")).agg(
        F.min("p6").alias("p_min"),
        F.max("p6").alias("p_max"),
        F.sum("p6").alias("p_sum"),
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("breached"),
    )


def risk_deciles(desk: Desk) -> DataFrame:
    test = desk.facts.filter("split = 'test' and sla_breached is not null and probability is not null")
    million = 1_000_000
    return decile_stats(test).select(
        F.col("decile").alias("Decile"),
        ratio("p_min", million, 4).alias("Probability From"),
        ratio("p_max", million, 4).alias("Probability To"),
        ratio("p_sum", F.col("n") * million, 4).alias("Mean Predicted"),
        F.col("n").alias("Tickets"),
        F.col("breached").alias("Breached"),
        ratio("breached", "n", 4).alias("Observed Breach Rate"),
        F.lit("Test").alias("Model Split"),
    )


def calibration_gap(desk: Desk) -> DataFrame:
    """Observed minus predicted per decile, in whole ten-thousandths."""
    d = risk_deciles(desk)
    units = [F.round(F.col(c) * 10_000).cast("bigint") for c in ("Observed Breach Rate", "Mean Predicted")]
    return d.select("Decile", ((units[0] - units[1]) / 10_000.0).alias("Calibration Gap"))


def weekly_extract(desk: Desk) -> DataFrame:
    return views.weekly_kpi(desk).select(
        _day("week_start").alias("Week Start"),
        _day("week_ending").alias("Week Ending"),
        F.col("tickets_opened").alias("Tickets Opened"),
        F.col("tickets_resolved").alias("Tickets Resolved"),
        F.col("breached_tickets").alias("Breached Tickets"),
        F.col("sla_compliance_pct").alias("SLA Compliance Pct"),
        F.col("mttr_hours").alias("MTTR Hours"),
        F.col("p50_resolution_hours").alias("P50 Resolution Hours"),
        F.col("p90_resolution_hours").alias("P90 Resolution Hours"),
        F.col("open_backlog").alias("Open Backlog"),
        F.col("backlog_past_due").alias("Backlog Past Due"),
        F.col("high_risk_open").alias("High Risk Open"),
    )


def customer_extract(desk: Desk) -> DataFrame:
    return desk.customers.select(
        F.col("customer_id").alias("Customer ID"),
        F.col("customer_name").alias("Customer"),
        L.humanise("industry").alias("Industry"),
        L.humanise("tier").alias("Tier"),
        F.col("hq_province").alias("HQ Province"),
        L.province_name("hq_province").alias("HQ Province Name"),
    )


def site_extract(desk: Desk) -> DataFrame:
    return locate(desk.sites).select(
        F.col("site_id").alias("Site ID"),
        F.col("customer_id").alias("Customer ID"),
        F.col("site_name").alias("Site"),
        F.col("city").alias("City"),
        F.col("province").alias("Province"),
        L.province_name("province").alias("Province Name"),
        L.humanise("region").alias("Region"),
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
    )


def service_extract(desk: Desk) -> DataFrame:
    return desk.services.select(
        F.col("service_id").alias("Service ID"),
        F.col("site_id").alias("Site ID"),
        F.col("customer_id").alias("Customer ID"),
        L.service_label("service_type").alias("Service Type"),
        F.col("bandwidth_mbps").alias("Bandwidth Mbps"),
        L.group_label("assignment_group").alias("Assignment Group"),
    )


def outage_extract(desk: Desk) -> DataFrame:
    return views.outage_impact(desk).select(
        F.col("outage_id").alias("Outage ID"),
        L.humanise("cause").alias("Cause"),
        L.humanise("region").alias("Region"),
        L.service_label("service_type").alias("Service Type"),
        _stamp("start_ts").alias("Start (UTC)"),
        _stamp("end_ts").alias("End (UTC)"),
        _day("start_ts").alias("Start Date"),
        F.col("duration_hours").alias("Duration Hours"),
        F.col("tickets_during").alias("Tickets During"),
        F.col("volume_multiplier").alias("Volume Multiplier"),
        F.col("breach_rate_during_pct").alias("Breach Rate During Pct"),
        F.col("breach_rate_baseline_pct").alias("Breach Rate Baseline Pct"),
    )


EXTRACTS: dict[str, Callable[[Desk], DataFrame]] = {
    "fact_ticket": fact_extract,
    "monthly_compliance": monthly_compliance_extract,
    "backlog_ageing": backlog_extract,
    "risk_deciles": risk_deciles,
    "weekly_kpi": weekly_extract,
    "dim_customer": customer_extract,
    "dim_site": site_extract,
    "dim_service": service_extract,
    "dim_outage": outage_extract,
}


def export_extracts(
    desk: Desk, out_dir: str, names: Sequence[str] | None = None, fmt: str = "csv", compression: str = "gzip"
) -> DataFrame:
    """Write the extracts and return their manifest: extract, rows, bytes, snapshot, model.

    Labelled rows repeat a few long texts, so the files are compressed as they are written.
    """
    spark = desk.spark
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    version = desk.scores.agg(F.min("model_version")).first()[0]
    rows = []
    for name in names or EXTRACTS:
        path = f"{out_dir}/{name}"
        out = EXTRACTS[name](desk).write.mode("overwrite").options(header=True, compression=compression)
        out.format(fmt).save(path)
        where = jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(conf).getContentSummary(where).getLength()
        reader = spark.read.option("header", True).format(fmt)
        rows.append((name, reader.load(path).count(), int(size), desk.snapshot, version))
    schema = (
        "extract string, rows bigint, bytes bigint, load_snapshot_ts timestamp_ntz, "
        "model_version string"
    )
    return spark.createDataFrame(rows, schema)


# --- dashboard aggregates --------------------------------------------------------------


def dashboard_tickets(
    desk: Desk,
    tier: str | None = None,
    service_type: str | None = None,
    region: str | None = None,
    created: tuple[date, date] | None = None,
) -> DataFrame:
    """Scored tickets under the dashboard's filters; all of them reach the scan."""
    t = desk.facts.filter("probability is not null")
    for name, value in (("tier", tier), ("service_type", service_type), ("region", region)):
        if value is not None:
            t = t.filter(F.col(name) == value)
    if created is not None:
        day = F.to_date("creation_ts")
        t = t.filter((day >= F.lit(created[0])) & (day <= F.lit(created[1])))
    return t


def measures(tickets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The dashboard's ticket measures, in all or per key (ticket ids are unique, so count = countd)."""
    live = (F.col("status") != "cancelled") & ~F.col("is_resolved")
    sums = {
        "tickets": one(),
        "_known": flag("sla_breached is not null"),
        "breaches": flag("sla_breached"),
        "open_tickets": flag(live),
        "resolved_tickets": flag("is_resolved"),
        "high_risk_tickets": flag(F.col("risk_band") == "high"),
        "outage_tickets": flag(F.col("active_outage_id").isNotNull()),
    }
    # The extract shows hours with two decimals, so the median is taken over those.
    cents = F.call_function("div", ticks() + 50, F.lit(100).cast("bigint"))
    base = tickets.withColumn("_cents", cents)
    percentiles = grouped_percentiles if keys else selected_percentiles
    agg = percentiles(base, keys, "_cents", {"p50": MEDIAN, "p90": P90}, sums)
    return agg.select(
        *keys,
        "tickets",
        pct(F.col("_known") - F.col("breaches"), "_known").alias("compliance_pct"),
        pct("breaches", "_known").alias("breach_rate_pct"),
        "breaches",
        "open_tickets",
        "resolved_tickets",
        ratio("p50", 200, 3).alias("median_resolution_hours"),
        ratio("p90", 1000, 3).alias("p90_resolution_hours"),
        "high_risk_tickets",
        "outage_tickets",
    )


def dashboard_kpis(desk: Desk, **filters) -> DataFrame:
    return measures(dashboard_tickets(desk, **filters), [])


def weekly_volume(desk: Desk, **filters) -> DataFrame:
    """Tickets opened per week and outage flag."""
    t = dashboard_tickets(desk, **filters)
    outage = F.when(F.col("active_outage_id").isNotNull(), "Yes").otherwise("No")
    return t.groupBy(week_of("creation_ts").alias("created_week"), outage.alias("during_outage")).agg(
        F.count(F.lit(1)).alias("tickets")
    )


def compliance_heatmap(desk: Desk, service_types: Sequence[str]) -> DataFrame:
    """Customer rows x service columns of compliance over the period, worst customer first."""
    base = views.not_cancelled(desk.facts)
    counts = base.groupBy("customer_id", "customer_name", "service_type").agg(
        F.count("sla_breached").alias("known"), F.count_if("sla_breached").alias("bad")
    )
    sums = []
    for s in service_types:
        here = F.col("service_type") == s
        sums += [
            F.sum(F.when(here, F.col("known"))).alias(f"_k_{s}"),
            F.sum(F.when(here, F.col("bad"))).alias(f"_b_{s}"),
        ]
    wide = counts.groupBy("customer_id", "customer_name").agg(
        F.sum("known").alias("_k"), F.sum("bad").alias("_b"), *sums
    )
    return wide.select(
        "customer_id",
        "customer_name",
        *[pct(F.col(f"_k_{s}") - F.col(f"_b_{s}"), f"_k_{s}").alias(s.lower()) for s in service_types],
        pct(F.col("_k") - F.col("_b"), "_k").alias("compliance_pct"),
    ).orderBy("compliance_pct", "customer_id")


def backlog_area(desk: Desk) -> DataFrame:
    """Open tickets and past-due share per month snapshot and age band."""
    grid = backlog_grid(desk)
    agg = grid.groupBy("as_of", "age_bucket", "bucket_order").agg(
        F.sum("open_tickets").alias("open_tickets"), F.sum("past_due_tickets").alias("past_due")
    )
    return agg.select(
        F.to_date("as_of").alias("snapshot_date"),
        "age_bucket",
        "bucket_order",
        "open_tickets",
        pct("past_due", "open_tickets").alias("past_due_share_pct"),
    )


def city_map(desk: Desk, **filters) -> DataFrame:
    """Tickets, breach rate and high-risk tickets per city with its centroid."""
    t = dashboard_tickets(desk, **filters)
    agg = t.groupBy("city", "province").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count("sla_breached").alias("_known"),
        F.count_if("sla_breached").alias("_bad"),
        F.count_if(F.col("risk_band") == "high").alias("high_risk_tickets"),
    )
    return locate(agg).select(
        "city",
        L.province_name("province").alias("province_name"),
        "latitude",
        "longitude",
        "tickets",
        pct("_bad", "_known").alias("breach_rate_pct"),
        "high_risk_tickets",
    )


def customer_drilldown(desk: Desk, **filters) -> DataFrame:
    rows = measures(dashboard_tickets(desk, **filters), ["customer_id", "customer_name", "tier"])
    return rows.orderBy(F.col("breaches").desc(), "customer_id")


def probability_bins(desk: Desk) -> DataFrame:
    """Fixed-width bins ``int(p * 10) + 1`` of the predicted probability."""
    t = desk.facts.filter("probability is not null")
    bin_no = (F.call_function("div", micro() * 10, F.lit(1_000_000).cast("bigint")) + 1).cast("int")
    return t.groupBy(bin_no.alias("probability_bin")).agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count("sla_breached").alias("with_outcome"),
        F.count_if("sla_breached").alias("breached"),
    )


def weekly_compliance(desk: Desk) -> DataFrame:
    """1 - breached / resolved per resolution week, as a rounded share."""
    w = views.weekly_kpi(desk)
    good = F.col("tickets_resolved") - F.col("breached_tickets")
    return w.select(
        "week_ending",
        "tickets_resolved",
        "breached_tickets",
        ratio(good, "tickets_resolved", 4).alias("compliance"),
    )

"""Registered queries: name -> function of (spark, folder of source tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions import labels
from ticketlens.operators import encoding, metrics
from ticketlens.operators.openat import open_rows
from ticketlens.operators.ordering import row_numbers
from ticketlens.operators.staging import shared_root, stage
from ticketlens.plans import (
    cleaning,
    enrich,
    extracts,
    findings,
    quality,
    report,
    scoring,
    training,
    views,
)
from ticketlens.plans import features as FT
from ticketlens.plans.desk import Desk, load_extract, testdata_desk
from ticketlens.sources import raw, tables, testdata

Query = Callable[[SparkSession, str], DataFrame]
Build = Callable[[Desk], DataFrame]

AS_OF = datetime(2000, 6, 1)
WEEK = date(2000, 6, 4)
SERVICE_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _spark(desk: Desk) -> SparkSession:
    return desk.spark


def _dbl(name: str):
    return F.col(name).cast("double").alias(name)


# --- sources, sinks, catalog -----------------------------------------------------------


def raw_extract_counts(desk: Desk) -> DataFrame:
    return quality.table_counts(desk.get("raw"))


def source_reconciliation(desk: Desk) -> DataFrame:
    return testdata.source_reconciliation(_spark(desk), desk.get("source_dir"), desk.facts)


def snapshot_of_extract(desk: Desk) -> DataFrame:
    spark = _spark(desk)
    declared = raw.resolve_snapshot(raw.read_metadata(spark, desk.get("raw_tickets_dir")), desk.unscored)
    seen = raw.resolve_snapshot({}, desk.get("cleaned").kept)
    rows = [("declared", declared), ("last_update", seen)]
    return spark.createDataFrame(rows, "source string, snapshot_ts timestamp_ntz")


def processed_roundtrip(desk: Desk) -> DataFrame:
    """Write the processed tables as CSV, read the wide one back with types."""
    out = f"{shared_root(_spark(desk))}/processed"
    wide = desk.unscored_tickets.select(*enrich.FACT_COLUMNS, *enrich.WIDE_EXTRAS)
    rejected = desk.get("cleaned").rejected
    tables.write_processed({"tickets": wide, "history": desk.history, "rejected": rejected}, out, "csv")
    back = tables.read_processed(_spark(desk), f"{out}/tickets", wide.schema, "csv")
    return back.select(
        "ticket_id",
        "creation_ts",
        "resolution_ts",
        "customer_id",
        "active_outage_id",
        _dbl("resolution_hours"),
        "is_weekend",
        "is_resolved",
        "sla_breached",
    )


TABLES = ["dim_customer", "dim_site", "dim_service", "sla_target", "outage_incident"]


def _loaded(desk: Desk, tickets: DataFrame) -> dict[str, DataFrame]:
    return {
        "dim_customer": desk.customers,
        "dim_site": desk.sites,
        "dim_service": desk.services,
        "sla_target": desk.targets,
        "outage_incident": desk.outages,
        "fact_ticket": tickets,
        "fact_ticket_status_history": desk.history,
        "ticket_risk_score": desk.scores,
    }


def load_table_counts(desk: Desk) -> DataFrame:
    root = f"{shared_root(_spark(desk))}/loaded"
    loaded = _loaded(desk, desk.tickets.select(*enrich.FACT_COLUMNS))
    rows = [(n, tables.load_table(df, f"{root}/{n}")) for n, df in loaded.items()]
    return _spark(desk).createDataFrame(rows, "table_name string, rows bigint")


def extract_to_report(desk: Desk) -> DataFrame:
    """The dirty raw extract, loaded, scored and audited: tickets by band, split and outcome.

    Scores are the stand-in's, looked up by ticket id, so that SQL can follow.
    """

    def scorer(tickets: DataFrame) -> DataFrame:
        known = desk.get("predictions").withColumn("ticket_id", F.col("ticket_id").cast("string"))
        return scoring.score_table(tickets, known, desk.get("thresholds"), testdata.MODEL_VERSION)

    loaded = load_extract(_spark(desk), desk.get("raw_dir"), scorer)
    audited = tables.latest_snapshot(loaded.loads)
    return loaded.facts.groupBy("risk_band", "split", "sla_breached").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.lit(audited).cast("timestamp_ntz").alias("snapshot_ts"),
    )


def load_run_latest(desk: Desk) -> DataFrame:
    """Append two audit rows, then read the latest snapshot and its counts."""
    spark = _spark(desk)
    # A path of its own per call, so that no earlier call's rows are read.
    path = f"{shared_root(spark)}/load_run-{uuid.uuid4().hex}"
    # Rows are counted, not loaded, so that the backlog is not worked out for them.
    counts = {r[0]: r[1] for r in quality.table_counts(_loaded(desk, desk.facts)).collect()}
    cleaned = desk.get("cleaned").report().filter("detail = ''")
    summary = {r[0]: r[2] for r in cleaned.collect()}
    for snapshot in (datetime(2001, 6, 1), desk.snapshot):
        record = tables.load_run(spark, snapshot, "testdata", counts, summary)
        tables.append_load_run(record, path)
    loads = spark.read.schema(tables.TABLES["load_run"]).parquet(path)
    latest = F.lit(tables.latest_snapshot(loads))
    return (
        loads.filter(F.col("snapshot_ts") == latest)
        .select("snapshot_ts", "source_dir", "synthetic", F.explode("row_counts"))
        .select(
            "snapshot_ts",
            "source_dir",
            "synthetic",
            F.col("key").alias("table_name"),
            F.col("value").alias("rows"),
        )
    )


def overwritten_scores(desk: Desk) -> DataFrame:
    path = f"{shared_root(_spark(desk))}/ticket_risk_score"
    for _ in range(2):
        tables.overwrite_scores(desk.scores, path)
    back = tables.read_published(_spark(desk), path, desk.scores.schema)
    return back.groupBy("model_version", "risk_band", "split").agg(
        F.count(F.lit(1)).alias("tickets")
    )


def extract_manifest(desk: Desk) -> DataFrame:
    out = f"{shared_root(_spark(desk))}/extracts"
    return extracts.export_extracts(desk, out).drop("bytes")


def view_registry(desk: Desk) -> DataFrame:
    """Register views and answer a question about them in SQL."""
    names = ["v_sla_compliance_monthly", "v_risk_band_summary", "v_outage_vs_normal"]
    views.register_views(desk, names)
    return _spark(desk).sql(
        """
        SELECT 'compliance' AS source, service_type AS item, sum(tickets) AS tickets
        FROM v_sla_compliance_monthly GROUP BY service_type
        UNION ALL SELECT 'risk', risk_band, sum(tickets) FROM v_risk_band_summary GROUP BY risk_band
        UNION ALL SELECT 'outage', CAST(during_outage AS STRING), tickets FROM v_outage_vs_normal
        """
    )


# --- cleaning --------------------------------------------------------------------------


def _unique(desk: Desk) -> DataFrame:
    return cleaning.unique_tickets(desk.get("raw_tickets"))


def _bigint_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("bigint"))


CLEANING: dict[str, Build] = {
    "trimmed_text": lambda d: _unique(d).select("id", *cleaning.C.TEXT_COLUMNS[1:]),
    "normalised_codes": lambda d: cleaning.normalise_tickets(_unique(d)).select(
        "id", *cleaning.NORMALISED
    ),
    "normalised_cell_counts": lambda d: d.get("cleaned")
    .report()
    .filter("metric = 'categorical_cells_normalised'"),
    "duplicate_rows": lambda d: _unique(d)
    .filter("copies > 1")
    .select("id", "copies", "variants", "status"),
    "parsed_timestamps": lambda d: cleaning.normalise_tickets(_unique(d)).select(
        "id", *cleaning.C.TICKET_TIMESTAMPS
    ),
    "imputed_priority": lambda d: cleaning.normalise_tickets(_unique(d)).select(
        "id", "priority", "imputed"
    ),
    "numeric_defaults": lambda d: cleaning.normalise_tickets(_unique(d)).select(
        "id", *cleaning.COUNTERS
    ),
    "rejected_tickets": lambda d: d.get("cleaned").rejected.select("id", "reject_reason"),
    "domain_violations": lambda d: cleaning.normalise_tickets(_unique(d))
    .select(
        *[
            F.count_if(cleaning.outside_domain(c, v)).alias(c)
            for c, v in cleaning.C.TICKET_DOMAINS.items()
        ]
    ),
    "unknown_dimension_keys": lambda d: d.get("cleaned")
    .checked.filter("not known_keys")
    .select("id", "customer_id", "site_id", "service_id"),
    "clean_tickets": lambda d: d.get("cleaned").kept,
    "clean_status_history": lambda d: d.get("cleaned_history").rows(),
    "status_history_report": lambda d: d.get("cleaned_history").report(),
    "cleaning_report": lambda d: d.get("cleaned").report(),
    "constraint_audit": quality.constraint_audit,
    "reconcile_counts": lambda d: quality.reconcile_counts(
        d.get("cleaned").report(), d.get("cleaned").kept
    ),
}


# --- enrichment ------------------------------------------------------------------------


def local_time(desk: Desk) -> DataFrame:
    return desk.facts.select(
        "ticket_id",
        "creation_hour_local",
        "creation_dow_local",
        "is_weekend",
        "is_after_hours",
        "has_requested_resolution_date",
        "creation_month",
    )


def sla_outcomes(desk: Desk) -> DataFrame:
    return desk.facts.select(
        "ticket_id", _dbl("sla_target_hours"), _dbl("resolution_hours"), "is_resolved",
        "sla_breached",
    )


def code_labels(desk: Desk) -> DataFrame:
    """Distinct codes with their labels."""
    t = desk.facts
    label_of = {
        "service_type": labels.service_label("code"),
        "channel": labels.channel_label("code"),
        "assignment_group": labels.group_label("code"),
        "split": labels.split_label("code"),
    }
    kinds = ["service_type", "channel", "assignment_group", "industry", "ticket_type", "region", "split"]
    pairs = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("code")) for c in kinds]
    # One scan; the labels are worked out on the few distinct codes.
    codes = t.select(F.inline(F.array(*pairs))).distinct()
    causes = desk.outages.select(F.lit("cause").alias("kind"), F.col("cause").alias("code")).distinct()
    label = labels.humanise("code")
    for kind, own in label_of.items():
        label = F.when(F.col("kind") == kind, own).otherwise(label)
    return codes.unionByName(causes).select("kind", "code", label.alias("label"))


ENRICHMENT: dict[str, Build] = {
    "joined_dimensions": lambda d: d.facts.select(
        "ticket_id", "customer_name", "tier", "industry", "city", "province", "region",
        "service_type",
    ),
    "local_time_features": local_time,
    "sla_outcomes": sla_outcomes,
    "active_outage": lambda d: d.facts.select(
        "ticket_id", "active_outage_id", enrich.has_active_outage().alias("has_active_outage")
    ),
    "open_backlog_at_creation": lambda d: d.tickets.select("ticket_id", "open_backlog_at_creation"),
    "first_end": lambda d: enrich.first_end(d.unscored),
    "sequenced_history": lambda d: d.history.select("ticket_id", "sequence_no", "status", "change_ts"),
    "latest_status": lambda d: enrich.latest_status(d.unscored),
    "reopen_counts": lambda d: enrich.reopened(d.unscored),
    "ever_pending": findings.pending_split,
    "code_labels": code_labels,
    "site_locations": lambda d: extracts.locate(d.sites).select(
        "site_id", "city", "province", labels.province_name("province").alias("province_name"),
        "latitude", "longitude",
    ),
    "unmatched_cities": lambda d: extracts.unmatched_cities(d.sites),
    "sla_outcome_labels": lambda d: d.facts.groupBy(
        labels.sla_outcome_label("status", "sla_breached").alias("sla_outcome")
    ).agg(F.count(F.lit(1)).alias("tickets")),
    "age_bands": lambda d: open_rows(d.facts, AS_OF).select(
        "ticket_id", "age_seconds", "age_bucket", "bucket_order"
    ),
    "time_split": lambda d: d.facts.groupBy("split", "creation_month").agg(
        F.count(F.lit(1)).alias("tickets")
    ),
}


# --- views -----------------------------------------------------------------------------

VIEW_QUERIES: dict[str, Build] = {
    "sla_compliance_monthly": views.sla_compliance_monthly,
    "backlog_ageing_at": lambda d: views.backlog_ageing(d, AS_OF),
    "backlog_ageing_monthly": views.backlog_ageing_monthly,
    "backlog_ageing_current": views.backlog_ageing_current,
    "open_tickets_at": lambda d: views.open_tickets(d, AS_OF),
    "backlog_monthly_by_service": views.backlog_monthly_by_service,
    "resolution_stats": views.resolution_stats,
    "outage_impact": views.outage_impact,
    "outage_vs_normal": views.outage_vs_normal,
    "customer_risk_trend": views.customer_risk_trend,
    "top_customers_at_risk": views.top_customers_at_risk,
    "ticket_risk": views.ticket_risk,
    "risk_band_summary": views.risk_band_summary,
    "weekly_kpi": views.weekly_kpi,
    "weekly_kpi_by_customer": views.weekly_kpi_by_customer,
    "weekly_kpi_by_service": views.weekly_kpi_by_service,
}


# --- weekly report ---------------------------------------------------------------------

REPORT: dict[str, Build] = {
    "available_weeks": report.available_weeks,
    "kpi_trend": lambda d: report.kpi_trend(d, WEEK),
    "kpi_summary": lambda d: report.kpi_summary(d, WEEK),
    "customer_week": lambda d: report.customer_week(d, WEEK),
    "service_week": lambda d: report.service_week(d, WEEK),
    "open_by_customer": lambda d: report.open_aggregates(
        d, "customer_id", report.week_end_instant(WEEK)
    ),
    "customer_week_totals": lambda d: report.totals_row(report.customer_week(d, WEEK)),
    "ageing_matrix_by_group": lambda d: report.ageing_matrix(d, "assignment_group", WEEK),
    "ageing_matrix_by_service": lambda d: report.ageing_matrix(d, "service_type", WEEK),
    "at_risk_top_n": lambda d: report.at_risk_top_n(d, WEEK),
    "report_provenance": lambda d: report.provenance(d, "testdata"),
}


# --- extracts and dashboard ------------------------------------------------------------

EXTRACTS: dict[str, Build] = {
    "extract_fact_ticket": extracts.fact_extract,
    "extract_monthly_compliance": extracts.monthly_compliance_extract,
    "extract_backlog_ageing": extracts.backlog_extract,
    "extract_risk_deciles": extracts.risk_deciles,
    "extract_weekly_kpi": extracts.weekly_extract,
    "extract_dim_customer": extracts.customer_extract,
    "extract_dim_site": extracts.site_extract,
    "extract_dim_service": extracts.service_extract,
    "extract_dim_outage": extracts.outage_extract,
    "dashboard_kpis": extracts.dashboard_kpis,
    "dashboard_kpis_filtered": lambda d: extracts.dashboard_kpis(
        d, tier="gold", region="ASIA", created=(date(1998, 1, 1), date(2000, 6, 30))
    ),
    "weekly_volume": extracts.weekly_volume,
    "compliance_heatmap": lambda d: extracts.compliance_heatmap(d, SERVICE_TYPES),
    "backlog_area": extracts.backlog_area,
    "calibration_gap": extracts.calibration_gap,
    "city_map": extracts.city_map,
    "customer_drilldown": extracts.customer_drilldown,
    "probability_bins": extracts.probability_bins,
    "weekly_compliance": extracts.weekly_compliance,
}


# --- scores and metrics ----------------------------------------------------------------


def labelled_rows(desk: Desk, split: str) -> DataFrame:
    """Scored tickets of a split with ``y`` and ``p`` (the stored probability)."""
    rows = desk.facts.filter(F.col("split") == split)
    return rows.select(
        "ticket_id",
        "tier",
        "service_type",
        F.col("sla_breached").cast("int").alias("y"),
        F.col("probability").alias("p"),
    )


def score_thresholds(desk: Desk) -> DataFrame:
    cuts = desk.get("thresholds")
    rows = [("medium", round(cuts.medium, 6)), ("high", round(cuts.high, 6))]
    return _spark(desk).createDataFrame(rows, "band string, threshold double")


def review_flags(desk: Desk) -> DataFrame:
    cut = round(desk.get("thresholds").high, 6)
    return desk.scores.groupBy(
        "split", scoring.flag_for_review("probability", cut).alias("flag_for_review")
    ).agg(F.count(F.lit(1)).alias("tickets"))


def threshold_metrics(desk: Desk) -> DataFrame:
    cuts = {"review": round(desk.get("thresholds").high, 6), "half": 0.5}
    return metrics.rounded(metrics.at_thresholds(labelled_rows(desk, "test"), cuts))


def constant_baseline(desk: Desk) -> DataFrame:
    """Test metrics of a constant prediction, the training breach rate."""
    rate = labelled_rows(desk, "train").agg(F.avg(F.col("y").cast("double"))).first()[0]
    test = labelled_rows(desk, "test").withColumn("p", F.lit(rate))
    out = metrics.ranking_metrics(test)
    # A constant ranks nothing: its average precision is the prevalence.
    return metrics.rounded(out)


SCORES: dict[str, Build] = {
    "training_rows": lambda d: enrich_training(d),
    "split_summary": lambda d: split_summary(d),
    "score_thresholds": score_thresholds,
    "score_table": lambda d: d.scores,
    "review_flags": review_flags,
    "ranking_metrics": lambda d: metrics.rounded(metrics.ranking_metrics(labelled_rows(d, "test"))),
    "threshold_metrics": threshold_metrics,
    "top_share_table": lambda d: metrics.rounded(
        metrics.top_share_table(labelled_rows(d, "test"), "ticket_id")
    ),
    "reliability_table": lambda d: metrics.rounded(
        metrics.reliability_table(labelled_rows(d, "test"), "ticket_id")
    ),
    "calibration_error": lambda d: metrics.rounded(
        metrics.expected_calibration_error(
            metrics.reliability_table(labelled_rows(d, "test"), "ticket_id")
        )
    ),
    "segment_metrics_tier": lambda d: metrics.rounded(
        metrics.segment_metrics(
            labelled_rows(d, "test"), "tier", round(d.get("thresholds").high, 6)
        )
    ),
    "segment_metrics_service": lambda d: metrics.rounded(
        metrics.segment_metrics(
            labelled_rows(d, "test"), "service_type", round(d.get("thresholds").high, 6)
        )
    ),
    "constant_baseline": constant_baseline,
}


def enrich_training(desk: Desk) -> DataFrame:
    rows = desk.facts.filter(enrich.labelled())
    return rows.select("ticket_id", F.col("sla_breached").cast("int").alias("y"), "split")


def split_summary(desk: Desk) -> DataFrame:
    """Rows, breaches, rate and month span per split; an empty split is an error at training."""
    rows = desk.facts.filter(enrich.labelled())
    month = F.date_format("creation_ts", "yyyy-MM")
    agg = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("sla_breached").alias("breached"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
    )
    rate = F.round(F.col("breached") / F.col("rows"), 6)
    return agg.withColumn("breach_rate", rate)


# --- findings --------------------------------------------------------------------------

FINDINGS: dict[str, Build] = {
    "breach_by_time_of_day": findings.breach_by_time_of_day,
    "breach_by_backlog_quintile": findings.breach_by_backlog_quintile,
    "breach_by_dimension": findings.breach_by_dimension,
    "breach_by_month": findings.breach_by_month,
    "outage_flag_agreement": findings.outage_flag_agreement,
}

SOURCES: dict[str, Build] = {
    "source_reconciliation": source_reconciliation,
    "raw_extract_counts": raw_extract_counts,
    "snapshot_of_extract": snapshot_of_extract,
    "processed_roundtrip": processed_roundtrip,
    "extract_to_report": extract_to_report,
    "load_table_counts": load_table_counts,
    "load_run_latest": load_run_latest,
    "overwritten_scores": overwritten_scores,
    "extract_manifest": extract_manifest,
    "view_registry": view_registry,
}


# --- model -----------------------------------------------------------------------------

def feature_rows(desk: Desk) -> DataFrame:
    return FT.project_features(desk.tickets, ["ticket_id"])


def model_rows(desk: Desk) -> DataFrame:
    """Labelled tickets: features, y, split and the columns that probes need; staged once."""
    if "model_rows" not in desk._built:
        rows = desk.tickets.filter(enrich.labelled()).withColumns(
            {
                "y": F.col("sla_breached").cast("int"),
                "resolution_hours": F.col("resolution_hours").cast("double"),
            }
        )
        keep = ["ticket_id", "y", "split", "site_id", "service_id", "reopen_count", "resolution_hours"]
        prepared = FT.prepare_features(rows, testdata.FEATURE_LEVELS, keep)
        desk._built["model_rows"] = stage(prepared, "model_rows")
    return desk._built["model_rows"]


def baseline_rows(desk: Desk) -> DataFrame:
    """The columns of ``model_rows`` that a baseline reads; the backlog is not built for them."""
    keep = ["ticket_id", "split", "tier", "severity", "resolution_hours"]
    if "model_rows" in desk._built or not desk.has("unscored"):
        return model_rows(desk).select(*keep)
    rows = desk.unscored.filter(enrich.labelled()).withColumns(
        {
            "split": enrich.split_or_unlabelled(),
            "resolution_hours": F.col("resolution_hours").cast("double"),
            "open_backlog_at_creation": F.lit(None).cast("int"),
        }
    )
    prepared = FT.prepare_features(rows, testdata.FEATURE_LEVELS, ["ticket_id", "split", "resolution_hours"])
    return stage(prepared.select(*keep), "baseline_rows")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    training.check_splits(rows)
    train, valid, test = (
        rows.filter(F.col("split") == s).drop("split") for s in ("train", "validation", "test")
    )
    return train, valid, test


def _parts(desk: Desk) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _split(model_rows(desk))


def record_errors(desk: Desk) -> DataFrame:
    """Text records with one defect per id modulo 1000, and the errors found in them."""
    slot = F.col("ticket_id") % 1000
    text = FT.project_features(desk.tickets, ["ticket_id"]).select(
        "ticket_id", *[F.col(c).cast("string").alias(c) for c in FT.FEATURES]
    )
    edits = [
        (11, "severity", None), (12, "severity", "urgent"), (13, "channel", "fax"),
        (14, "priority", "5"), (15, "priority", "0"), (16, "creation_hour_local", "24"),
        (17, "creation_dow_local", "-1"), (21, "open_backlog_at_creation", "-3"),
        (22, "sla_target_hours", "0"), (23, "priority", "two"),
        (24, "has_active_outage", "maybe"), (25, "customer_id", ""),
    ]
    for number, column, value in edits:
        text = text.withColumn(
            column, F.when(slot == number, F.lit(value)).otherwise(F.col(column))
        )
    text = text.withColumns(
        {
            "sla_breached": F.when(slot == 26, "true"),
            "reopen_count": F.when(slot == 27, "1"),
        }
    )
    records = stage(text, "records")
    checked = FT.validate_records(records, "ticket_id", testdata.FEATURE_LEVELS)
    return FT.split_valid(checked, "ticket_id")[1]


def _fitted_encoders(desk: Desk, spec: training.Spec):
    train, valid, test = _parts(desk)
    stages = training._stages(spec)
    model = training.Pipeline(stages=stages).fit(training._inputs(train, spec))
    later = training._inputs(valid.unionByName(test), spec)
    return model, model.transform(later)


def one_hot_levels(desk: Desk) -> DataFrame:
    """Validation and test rows per hot level of each category; unseen levels are all zeros."""
    cats = list(testdata.FEATURE_LEVELS)
    spec = training.Spec(categorical=tuple(cats), target_encoded=())
    model, out = _fitted_encoders(desk, spec)
    names = dict(zip(cats, model.stages[0].labelsArray))
    entries = []
    for c in cats:
        hot = F.array_position(training.vector_to_array(f"{c}_oh"), F.lit(1.0))
        known = F.array(*[F.lit(x) for x in names[c]])
        level = F.when(hot > 0, F.try_element_at(known, hot.cast("int")))
        entries.append(F.struct(F.lit(c).alias("feature"), level.alias("level")))
    long = out.select(F.inline(F.array(*entries)))
    return long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("rows"))


def scaled_numerics(desk: Desk) -> DataFrame:
    """Mean and sd of the training-scaled numbers on validation and test rows."""
    spec = training.Spec(categorical=(), target_encoded=())
    _, out = _fitted_encoders(desk, spec)
    values = training.vector_to_array("scaled")
    numbers = [*training.OTHER_NUMERIC, *training.TIME]
    entries = [
        F.struct(F.lit(c).alias("feature"), values[i].alias("v")) for i, c in enumerate(numbers)
    ]
    long = out.select(F.inline(F.array(*entries)))
    return long.groupBy("feature").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd")
    )


def cyclical_time(desk: Desk) -> DataFrame:
    cols = encoding.cyclical()
    return desk.facts.select(
        "ticket_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in cols.items()]
    )


def ordinal_codes(desk: Desk) -> DataFrame:
    """Code of each level among the training levels in alphabetical order; unseen = -1."""
    cats = [*testdata.FEATURE_LEVELS, "customer_id"]
    train, valid, test = _parts(desk)

    def long(df: DataFrame) -> DataFrame:
        pairs = [
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cats
        ]
        return df.select(F.inline(F.array(*pairs)))

    known = long(train).filter("level is not null").distinct()
    codes = row_numbers(known, ["level"], ["feature"], "code").withColumn(
        "code", (F.col("code") - 1).cast("int")
    )
    seen = long(valid.unionByName(test)).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("rows"))
    return seen.join(codes, ["feature", "level"], "left").select(
        "feature", "level", F.coalesce("code", F.lit(-1)).alias("code"), "rows"
    )


def target_encoding(desk: Desk) -> DataFrame:
    """Customer codes: cross-fitted for training rows, full statistics for the others."""
    train, valid, test = _parts(desk)
    inside = encoding.cross_fit_encode(train, "customer_id", "ticket_id", "code")
    stats = encoding.level_statistics(train, "customer_id")
    later = encoding.encode_with(valid.unionByName(test), "customer_id", stats, "code")
    both = inside.select("ticket_id", "code").unionByName(later.select("ticket_id", "code"))
    return both.select("ticket_id", F.round("code", 6).alias("code"))


def _frame(desk: Desk, rows: list[dict], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    data = [tuple(r.get(n) if n != "params" else str(r.get(n)) for n in names) for r in rows]
    return _spark(desk).createDataFrame(data, schema)


METRICS = "roc_auc double, pr_auc double, brier double, log_loss double"


def _experiments(desk: Desk) -> list[dict]:
    """The experiment matrix; the fits run once for all queries of a desk."""
    if "experiments" not in desk._built:
        train, valid, _ = _parts(desk)
        desk._built["experiments"] = training.run_experiments(train, valid, training.experiment_specs())
    return desk._built["experiments"]


def _tuned(desk: Desk) -> tuple[list[dict], dict[str, tuple], str]:
    """Both full grids, with the time encoding that the experiments chose for each family."""
    if "tuned" not in desk._built:
        train, valid, _ = _parts(desk)
        chosen = {m: training.pick_time_encoding(_experiments(desk), m) for m in ("lr", "gbt")}
        desk._built["tuned"] = training.tune(train, valid, time_encoding=chosen)
    return desk._built["tuned"]


def model_grid(desk: Desk) -> DataFrame:
    rows, _, winner = _tuned(desk)
    for r in rows:
        r["chosen"] = r["model"] == winner
    return _frame(desk, rows, f"model string, params string, chosen boolean, {METRICS}")


def feature_experiments(desk: Desk) -> DataFrame:
    return _frame(desk, _experiments(desk), f"group string, variant string, model string, {METRICS}")


def _scoring_model(desk: Desk) -> training.BreachModel:
    """The winner of both grids, with its thresholds, the test metrics of both families, and its card."""
    if "scoring_model" not in desk._built:
        train, valid, test = _parts(desk)
        counts = training.check_splits(model_rows(desk))
        _, best, winner = _tuned(desk)
        spec, fitted = best[winner]
        facts = {
            "test_metrics": {m: training.evaluate(f, test) for m, (_, f) in best.items() if f},
            "split_months": {r["split"]: [r["first_month"], r["last_month"]] for r in split_summary(desk).collect()},
        }
        desk._built["scoring_model"] = training.train_model(
            train, valid, spec, f"{winner}-1", counts, fitted=fitted, facts=facts
        )
    return desk._built["scoring_model"]


def model_scores(desk: Desk) -> DataFrame:
    """Every ticket scored by a model that was saved and loaded again."""
    spark = _spark(desk)
    path = f"{shared_root(spark)}/model"
    training.save_model(_scoring_model(desk), spark, path)
    model = training.load_model(spark, path)
    scored = scoring.score_table(
        desk.facts, model.predict(feature_rows(desk)), model.cuts, model.card["model_version"]
    )
    return scored


def model_test_metrics(desk: Desk) -> DataFrame:
    _, _, test = _parts(desk)
    return metrics.ranking_metrics(_scoring_model(desk).predict(test))


def permutation_importance(desk: Desk) -> DataFrame:
    _, valid, test = _parts(desk)
    fitted = _scoring_model(desk).fitted
    parts = [
        training.permutation_importance(fitted, rows).withColumn("split", F.lit(name))
        for name, rows in (("validation", valid), ("test", test))
    ]
    return parts[0].unionByName(parts[1])


def leakage_checks(desk: Desk) -> DataFrame:
    train, valid, test = _parts(desk)
    rows = training.leakage_checks(train, valid, test)
    return _frame(desk, rows, f"probe string, {METRICS}")


def resolve_time_baseline(desk: Desk) -> DataFrame:
    train, _, test = _split(baseline_rows(desk))
    base = training.median_baseline(train, test)
    return metrics.rounded(
        training.regression_errors(base, "pred", "resolution_hours", "ticket_id")
    )


def time_to_resolve(desk: Desk) -> DataFrame:
    train, _, test = _parts(desk)
    return training.time_to_resolve(train, test)


def feature_permutations(desk: Desk) -> DataFrame:
    """The donor of each labelled validation and test ticket in every repeat of the importance."""
    out = None
    for split in ("validation", "test"):
        rows = labelled_rows(desk, split).select("ticket_id")
        numbered = stage(row_numbers(rows, ["ticket_id"], name="_rn"), "permuted")
        n = numbered.count()
        lent = numbered.select(F.col("_rn").alias("_from"), F.col("ticket_id").alias("donor_id"))
        for r in range(5):
            part = training.donors(numbered, r, 0, n).join(lent, "_from").select(
                F.lit(split).alias("split"), F.lit(r).alias("repeat"), "ticket_id", "donor_id"
            )
            out = part if out is None else out.unionByName(part)
    return out


def bootstrap_intervals(desk: Desk) -> DataFrame:
    reps = stage(metrics.bootstrap_ranking(labelled_rows(desk, "test")), "bootstrap")
    both = metrics.confidence_interval(reps, "roc_auc").unionByName(metrics.confidence_interval(reps, "pr_auc"))
    return metrics.rounded(both)


def model_invariants(desk: Desk) -> DataFrame:
    """What must hold of fitted models whatever their numbers: one row per statement."""
    spark = _spark(desk)
    train, valid, _ = _parts(desk)
    # No encoding that depends on folds, so that training rows are scored as they were trained.
    spec = training.Spec(target_encoded=(), params={"C": 1.0})
    fitted = training.fit(train, spec)
    rows, features = fitted.inputs(train), fitted.features
    data = stage(training.design.blocks(rows, features, "y"), "invariants")
    gap = training.newton.score_equations(data, [fitted.model], features, 1)[0]
    names = training.newton.names(features, fitted.model.columns)
    path = f"{shared_root(spark)}/invariant-model"
    model = training.train_model(train, valid, spec, "lr-1", {}, fitted=fitted)
    training.save_model(model, spark, path)
    kept = model.predict(valid).select("ticket_id", "p")
    again = training.load_model(spark, path).predict(valid).select("ticket_id", "p")
    scored = fitted.predict(train)
    sums = scored.agg(F.avg("p"), F.avg(F.col("y").cast("double")), F.min("p"), F.max("p")).first()
    ll = metrics.ranking_metrics(scored).first()["log_loss"]
    constant = metrics.ranking_metrics(train.withColumn("p", F.lit(float(sums[1])))).first()["log_loss"]
    facts = [
        ("score_equations_hold", bool(max(abs(g) for g in gap) < 1e-6), len(gap) - len(names)),
        ("mean_probability_is_the_rate", bool(abs(sums[0] - sums[1]) < 1e-6), 0),
        ("probabilities_in_range", bool(0 <= sums[2] and sums[3] <= 1), 0),
        ("beats_the_constant", bool(ll < constant), 0),
        ("saved_equals_loaded", kept.exceptAll(again).count() == 0, kept.count() - again.count()),
        ("training_rows", True, train.count()),
    ]
    return spark.createDataFrame(facts, "statement string, holds boolean, rows long")


MODEL: dict[str, Build] = {
    "prepared_features": lambda d: FT.prepare_features(
        d.tickets, testdata.FEATURE_LEVELS, ["ticket_id"]
    ),
    "record_errors": record_errors,
    "one_hot_levels": one_hot_levels,
    "scaled_numerics": scaled_numerics,
    "cyclical_time": cyclical_time,
    "ordinal_codes": ordinal_codes,
    "target_encoding": target_encoding,
    "resolve_time_baseline": resolve_time_baseline,
    "model_grid": model_grid,
    "feature_experiments": feature_experiments,
    "model_scores": model_scores,
    "model_test_metrics": model_test_metrics,
    "permutation_importance": permutation_importance,
    "leakage_checks": leakage_checks,
    "time_to_resolve": time_to_resolve,
    "bootstrap_intervals": bootstrap_intervals,
    "feature_permutations": feature_permutations,
    "model_invariants": model_invariants,
}


def _on_desk(build: Build) -> Query:
    return lambda spark, sf_dir: build(testdata_desk(spark, sf_dir))


GROUPS = [VIEW_QUERIES, SOURCES, CLEANING, ENRICHMENT, REPORT, EXTRACTS, SCORES, FINDINGS, MODEL]

QUERIES: dict[str, Query] = {
    name: _on_desk(build) for group in GROUPS for name, build in group.items()
}

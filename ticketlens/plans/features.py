"""The model's feature contract: names, levels, preparation and record validation."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens import constants as C
from ticketlens.operators.staging import shared_root
from ticketlens.plans.enrich import OUTCOME_FIELDS, has_active_outage

# The closed levels of the service-desk domain (customer ids are open).
LEVELS: dict[str, list[str]] = {
    "ticket_type": C.TICKET_TYPES,
    "severity": C.SEVERITIES,
    "channel": C.CHANNELS,
    "tier": C.TIERS,
    "industry": [
        "financial_services", "healthcare", "retail", "manufacturing", "public_sector",
        "logistics", "education", "energy",
    ],
    "region": ["atlantic", "ontario", "prairies", "quebec", "west"],
    "province": sorted(C.PROVINCE_NAMES),
    "service_type": list(C.SERVICE_LABELS),
    "assignment_group": sorted(C.GROUP_LABELS),
}
CATEGORICAL = [*LEVELS, "customer_id"]
NUMERIC = [
    "priority",
    "open_backlog_at_creation",
    "sla_target_hours",
    "creation_hour_local",
    "creation_dow_local",
]
BOOLEAN = ["has_active_outage", "is_weekend", "is_after_hours", "has_requested_resolution_date"]
FEATURES = CATEGORICAL + NUMERIC + BOOLEAN
DROPPED = ["site_id", "service_id", "active_outage_id"]

leaked = set(FEATURES) & set(OUTCOME_FIELDS)
if leaked:
    raise AssertionError(f"outcome fields among the features: {sorted(leaked)}")

# Numeric ranges (low, high, low is exclusive).
RANGES: dict[str, tuple[float | None, float | None, bool]] = {
    "priority": (1, 4, False),
    "open_backlog_at_creation": (0, None, False),
    "sla_target_hours": (0, None, True),
    "creation_hour_local": (0, 23, False),
    "creation_dow_local": (0, 6, False),
}
TRUE_WORDS, FALSE_WORDS = ["true", "1", "t"], ["false", "0", "f"]


def feature_schema(levels: Mapping[str, Sequence[str]] = LEVELS) -> list[dict]:
    """The features for the model card: a list of levels, a range, or neither for booleans and ids."""
    lists = {n: list(levels[n]) for n in CATEGORICAL if n in levels}
    ranges = {n: [low, high] for n, (low, high, _) in RANGES.items()}
    return [{"name": n, "levels": lists.get(n), "range": ranges.get(n)} for n in FEATURES]


def _level(name: str) -> Column:
    text = F.trim(F.col(name).cast("string"))
    return F.upper(text) if name == "province" else F.lower(text)


def _boolean(name: str) -> Column:
    text = F.lower(F.trim(F.col(name).cast("string")))
    return F.when(text.isin(TRUE_WORDS), True).when(text.isin(FALSE_WORDS), False)


def project_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 19 features, case-normalised and typed, plus ``keep`` columns; lazy."""
    if "has_active_outage" not in df.columns and "active_outage_id" in df.columns:
        df = df.withColumn("has_active_outage", has_active_outage())
    missing = [c for c in FEATURES if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    numeric = [
        F.col(c).cast("double" if c == "sla_target_hours" else "int").alias(c) for c in NUMERIC
    ]
    return df.select(
        *keep,
        *[_level(c).alias(c) for c in CATEGORICAL if c not in keep],
        *numeric,
        *[_boolean(c).alias(c) for c in BOOLEAN],
    )


def unknown_levels(
    features: DataFrame, levels: Mapping[str, Sequence[str]] = LEVELS
) -> DataFrame:
    """All (feature, level) pairs outside the closed lists, in one scan."""
    entries = [
        F.when(
            F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)),
            F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")),
        )
        for c, allowed in levels.items()
    ]
    found = features.select(F.inline(F.array_compact(F.array(*entries))))
    return found.distinct()


def prepare_features(
    df: DataFrame,
    levels: Mapping[str, Sequence[str]] = LEVELS,
    keep: Sequence[str] = (),
    check: bool = True,
) -> DataFrame:
    """Exactly the features (and ``keep``); bad booleans or unknown levels raise ValueError."""
    out = project_features(df, keep)
    if check:
        # One pass: rows with a level outside its list, and rows without a readable boolean.
        strange = [
            F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(allowed))).alias(c)
            for c, allowed in levels.items()
        ]
        row = out.agg(*strange, *[F.count_if(F.col(c).isNull()).alias(c) for c in BOOLEAN]).first()
        off = {c: row[c] for c in levels if row[c]}
        if off:
            listed = f"{shared_root(df.sparkSession)}/unknown-levels-{uuid.uuid4().hex}"
            unknown_levels(out, levels).write.parquet(listed)
            raise ValueError(f"unknown categorical values, rows by feature: {off}; levels in {listed}")
        wrong = [c for c in BOOLEAN if row[c]]
        if wrong:
            raise ValueError(f"columns must be boolean: {wrong}")
    return out


# --- record validation -----------------------------------------------------------------


def _error(field: str, kind: str, test: Column) -> Column:
    return F.when(test, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("error_type")))


def validate_records(
    records: DataFrame,
    key: str,
    levels: Mapping[str, Sequence[str]] = LEVELS,
) -> DataFrame:
    """Adds ``errors``, an array of (field, error_type); empty for a valid record.

    Records hold text or typed cells. A NULL feature is ``missing``; any other non-NULL
    column is ``extra_forbidden``, so an outcome cannot slip in.
    """
    blank = {c: F.lit(None).cast("string") for c in FEATURES if c not in records.columns}
    df = records.withColumns(blank)
    errors = [_error(c, "missing", F.col(c).isNull()) for c in FEATURES]
    for c, allowed in levels.items():
        errors.append(_error(c, "value_error", ~_level(c).isin(list(allowed))))
    size = F.length(F.trim(F.col("customer_id").cast("string")))
    errors.append(_error("customer_id", "string_too_short", size < 1))
    errors.append(_error("customer_id", "string_too_long", size > 64))
    for c, (low, high, open_low) in RANGES.items():
        value = F.col(c).cast("string").try_cast("double")
        whole = c != "sla_target_hours"
        bad = value.isNull() | (value != F.floor(value)) if whole else value.isNull()
        kind = "int_parsing" if whole else "float_parsing"
        errors.append(_error(c, kind, F.col(c).isNotNull() & bad))
        if high is not None:
            errors.append(_error(c, "less_than_equal", value > high))
        under = value <= low if open_low else value < low
        errors.append(_error(c, "greater_than" if open_low else "greater_than_equal", under))
    for c in BOOLEAN:
        errors.append(_error(c, "bool_parsing", F.col(c).isNotNull() & _boolean(c).isNull()))
    extra = [c for c in records.columns if c not in FEATURES and c != key]
    errors += [_error(c, "extra_forbidden", F.col(c).isNotNull()) for c in extra]
    return df.withColumn("errors", F.array_compact(F.array(*errors)))


def split_valid(validated: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(typed features of valid records, (key, field, error_type) of the others)."""
    good = project_features(validated.filter(F.size("errors") == 0), [key])
    bad = validated.select(key, F.inline("errors"))
    return good, bad

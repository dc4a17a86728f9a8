"""The scoring service as a streaming job: validate records, score the good, keep the bad.

Validation, preparation and scoring are stateless projections, so the batch functions run
unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketlens.plans.features import LEVELS, split_valid, validate_records
from ticketlens.plans.scoring import flag_for_review, risk_band
from ticketlens.plans.training import BreachModel


def score_records(
    records: DataFrame,
    key: str,
    model: BreachModel,
    levels: Mapping[str, Sequence[str]] = LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """(scores of valid records, field errors of the others); batch or stream."""
    good, bad = split_valid(validate_records(records, key, levels), key)
    scored = model.predict(good).select(
        key,
        F.round("p", 6).alias("probability"),
        risk_band("p", model.cuts).alias("risk_band"),
        flag_for_review("p", model.cuts.high).alias("flag_for_review"),
        F.lit(model.card["model_version"]).alias("model_version"),
    )
    return scored, bad


def start_scoring(
    records: DataFrame,
    key: str,
    model: BreachModel,
    out_dir: str,
    checkpoint_dir: str,
    levels: Mapping[str, Sequence[str]] = LEVELS,
) -> StreamingQuery:
    """Score a stream of records; each micro-batch writes its scores and its rejects."""

    def write(batch: DataFrame, batch_id: int) -> None:
        scored, bad = score_records(batch, key, model, levels)
        # One folder per micro-batch, overwritten when the batch is retried.
        scored.write.mode("overwrite").parquet(f"{out_dir}/scores/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{out_dir}/rejected/batch={batch_id}")

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )

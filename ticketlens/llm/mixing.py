"""Mix sources to target weights: capped water-filling, then seeded whole and fractional epochs.

Targets: every source gets total * weight / sum(weights), but no more than ``max_epochs`` times
its own size. What capped sources leave over goes to the others in proportion to their weights,
until none is above its cap. The level (words per unit of weight) only rises from round to
round, so each round caps more sources or is the last one; a round is one sum over the table of
sources.

Sampling: a source with target / size = 2.3 takes each of its documents twice, and a seeded
part of them a third time. That part are the first documents in the order of a hash of
(seed, id), up to the point where their sizes reach the remainder, to the nearest document. The
point is found by radix selection on 36 bits of the hash, 12 at a time: every level sums sizes
per (source, 12 bits) with map-side combine and goes on inside the one bin that holds the
point, so the hot source never meets in one task.

Defined results: null text has size 0; a null source is a source of its own and comes last;
rows with equal id share their fate; sources of size 0 get target 0; an empty table gives no
rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import hex_bits, id_text, word_count
from ticketlens.operators.ordering import row_numbers
from ticketlens.operators.staging import stage

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
LEVELS, LEVEL_BITS = 3, 12


def source_key(source: Column) -> Column:
    """Joinable and sorted by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def cyclic_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Sources by code point, null last, weigh ``weights`` over and over."""
    ranked = row_numbers(sources, ["_source"], name="_rank")
    turn = (F.col("_rank") - 1) % len(weights) + 1
    table = F.array(*[F.lit(int(w)) for w in weights])
    return ranked.withColumn("_weight", F.element_at(table, turn.cast("int")).cast("bigint"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add ``_target`` to rows of (_source, _total, _weight)."""
    cap, weight = F.col("_total") * max_epochs, F.col("_weight")
    total, free = sources.agg(F.sum("_total"), F.sum("_weight")).first()
    total, free, capped = total or 0, free or 0, 0
    level = 0.0
    while free:
        level = (total - capped) / free
        full = cap <= weight * F.lit(level)
        now, left = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, weight))).first()
        if (left or 0) == free:
            break
        capped, free = now or 0, left or 0
    return sources.withColumn(
        "_target", F.least(cap.cast("double"), weight * F.lit(float(level)))
    )


def _threshold(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source the hash up to which documents are taken once more (exclusive end)."""
    point = wanted.select("_source", F.lit(0).cast("bigint").alias("_prefix"), "_rest", F.lit(0).cast("bigint").alias("_before"))
    for depth in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - depth)
        prefix = F.shiftright("_hash", shift)
        inside = rows.withColumn("_up", F.shiftright("_hash", shift + LEVEL_BITS)).join(
            point.withColumnRenamed("_prefix", "_up"), ["_source", "_up"]
        )
        bins = inside.groupBy("_source", prefix.alias("_prefix"), "_rest", "_before").agg(
            F.sum("_size").alias("_in_bin")
        )
        # At most 4,096 bins of each source meet here.
        run = Window.partitionBy("_source").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("_before") + F.coalesce(F.sum("_in_bin").over(run), F.lit(0))
        placed = bins.select("_source", "_prefix", "_rest", "_in_bin", before.alias("_start"))
        point = placed.filter(
            (F.col("_start") <= F.col("_rest")) & (F.col("_start") + F.col("_in_bin") > F.col("_rest"))
        ).select("_source", "_prefix", "_rest", F.col("_start").alias("_before"), "_in_bin")
        point = stage(point, "mix_point")
        if depth < LEVELS:
            point = point.drop("_in_bin")
    nearer = F.col("_before") + F.col("_in_bin") / 2 <= F.col("_rest")
    return point.select("_source", (F.col("_prefix") + nearer.cast("bigint")).alias("_end"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, repeats and taken of every row."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), id_text(F.col(id_col))))
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            source_key(F.col(source_col)).alias("_source"),
            word_count(F.col(text_col)).alias("_size"),
            hex_bits(digest, 1, LEVELS * LEVEL_BITS // 4).alias("_hash"),
        ),
        "mix_rows",
    )
    sources = rows.groupBy("_source").agg(F.sum("_size").alias("_total"))
    weighed = stage(cyclic_weights(sources, weights), "mix_sources")
    filled = water_fill(weighed, max_epochs)
    whole = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0)
    planned = filled.withColumn("_whole", whole.cast("bigint")).withColumn(
        "_rest", F.col("_target") - F.col("_whole") * F.col("_total")
    )
    # Joins on a source meet a table of one row per source; Spark checks its size before it
    # broadcasts, and splits the hot source's rows otherwise.
    ends = _threshold(rows, planned.filter("_rest > 0"))
    plan = planned.join(ends, "_source", "left")
    repeats = F.col("_whole") + (F.col("_hash") < F.coalesce("_end", F.lit(0))).cast("bigint")
    return rows.join(plan, "_source").select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        (repeats * F.col("_size")).alias("taken"),
        repeats.alias("repeats"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The rows of the mix themselves: each document as often as ``mix`` takes it."""
    plan = mix(docs, weights, max_epochs, seed=seed).groupBy(
        id_text(F.col("doc_id")).alias("_mix_id")
    ).agg(F.max("repeats").alias("_mix_times"))
    times = F.expr("sequence(1, cast(_mix_times as int))")
    return (
        docs.withColumn("_mix_id", id_text(F.col("doc_id")))
        .join(plan.filter("_mix_times > 0"), "_mix_id")
        .withColumn("_mix_copy", F.explode(times))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )

"""Exact ranking, calibration and operating-point metrics of scored rows at any size.

Input rows carry ``y`` (0/1), a probability and a unique id. Rows are first counted per
distinct probability; the cumulative counts then run over a range-partitioned order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.ordering import equal_count_bin, ordered_prefix, row_numbers
from ticketlens.operators.quantiles import position_quantiles

CLIP = 1e-6


def _div(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


def ranking_metrics(
    df: DataFrame,
    p: str = "p",
    y: str = "y",
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """ROC-AUC (ties count half), average precision (step sum), Brier score, log loss.

    One row, or one per ``by`` group; the two ranking metrics are NULL for a single class.
    ``weight`` makes every row count that many times.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    pos = F.when(F.col(y) == 1, w).otherwise(F.lit(0))
    counts = df.groupBy(*by, (-F.col(p).cast("double")).alias("_neg_p")).agg(
        F.sum(pos).cast("bigint").alias("_pos"), F.sum(w).cast("bigint").alias("_all")
    )
    run = ordered_prefix(
        counts, ["_neg_p"], {"_cpos": F.col("_pos"), "_call": F.col("_all")}, by, "ranking"
    )
    prob = -F.col("_neg_p")
    clipped = F.least(F.greatest(prob, F.lit(CLIP)), F.lit(1 - CLIP))
    neg = F.col("_all") - F.col("_pos")
    before = (F.col("_cpos") - F.col("_pos")).cast("double")
    agg = run.groupBy(*by).agg(
        F.sum("_all").alias("n"),
        F.sum("_pos").alias("positives"),
        F.sum(neg.cast("double") * (before + F.col("_pos") / 2)).alias("_auc"),
        F.sum(F.col("_pos").cast("double") * _div(F.col("_cpos"), F.col("_call"))).alias("_ap"),
        F.sum(F.col("_pos") * (1 - prob) * (1 - prob) + neg * prob * prob).alias("_sq"),
        F.sum(-F.col("_pos") * F.ln(clipped) - neg * F.ln(1 - clipped)).alias("_ll"),
    )
    n, hits = F.col("n"), F.col("positives")
    both = (hits > 0) & (hits < n)
    pairs = hits.cast("double") * (n - hits).cast("double")
    return agg.select(
        *by,
        "n",
        "positives",
        F.when(both, F.col("_auc") / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
        F.when(both, _div(F.col("_ap"), hits)).alias("pr_auc"),
        _div(F.col("_sq"), n).alias("brier"),
        _div(F.col("_ll"), n).alias("log_loss"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns for display."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def at_thresholds(
    df: DataFrame,
    cuts: dict[str, float],
    p: str = "p",
    y: str = "y",
    by: Sequence[str] = (),
) -> DataFrame:
    """Operating point per named threshold: flagged, precision, recall, lift; 0 when empty."""
    by = list(by)
    score, hit = F.col(p), F.col(y) == 1
    parts = []
    for i, t in enumerate(cuts.values()):
        parts += [
            F.count_if(score >= t).alias(f"_f{i}"),
            F.count_if((score >= t) & hit).alias(f"_t{i}"),
        ]
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("positives"), *parts
    )
    zero = F.lit(0.0)
    rows = []
    for i, (name, t) in enumerate(cuts.items()):
        flagged, tp = F.col(f"_f{i}"), F.col(f"_t{i}")
        precision = F.coalesce(_div(tp, flagged), zero)
        prevalence = _div(F.col("positives"), F.col("n"))
        rows.append(
            F.struct(
                F.lit(name).alias("operating_point"),
                F.lit(float(t)).alias("threshold"),
                flagged.alias("flagged"),
                _div(flagged, F.col("n")).alias("flagged_share"),
                tp.alias("true_positives"),
                precision.alias("precision"),
                F.coalesce(_div(tp, F.col("positives")), zero).alias("recall"),
                F.coalesce(precision / F.nullif(prevalence, zero), zero).alias(
                    "lift_vs_prevalence"
                ),
            )
        )
    return agg.select(*by, "n", F.inline(F.array(*rows)))


def top_share_table(
    df: DataFrame, item: str, p: str = "p", y: str = "y", shares: Sequence[float] = (0.05, 0.1, 0.2, 0.3)
) -> DataFrame:
    """Operating points at the probability quantiles ``1 - share``."""
    cuts = position_quantiles(df.filter(F.col(p).isNotNull()), p, item, [1 - s for s in shares])
    return at_thresholds(df, {f"top_{s:g}": c for s, c in zip(shares, cuts)}, p, y)


def reliability_table(
    df: DataFrame, item: str, p: str = "p", y: str = "y", bins: int = 10
) -> DataFrame:
    """Equal-count bins of the predicted probability against the observed rate."""
    ranked = row_numbers(df.select(item, p, y), [p, item])
    n = ranked.agg(F.max("row_number")).first()[0] or 0
    bin_no = equal_count_bin(F.col("row_number"), F.lit(n), bins)
    return ranked.groupBy(bin_no.alias("bin")).agg(
        F.min(p).alias("bin_lo"),
        F.max(p).alias("bin_hi"),
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mean_predicted"),
        F.avg(F.col(y).cast("double")).alias("observed_rate"),
    )


def expected_calibration_error(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_predicted") - F.col("observed_rate"))
    return table.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def segment_metrics(
    df: DataFrame, by: str, threshold: float, p: str = "p", y: str = "y"
) -> DataFrame:
    """Per segment: size, rate, ranking metrics and the operating point."""
    rank = ranking_metrics(df, p, y, [by])
    point = at_thresholds(df, {"review": threshold}, p, y, [by])
    rate = _div(F.col("positives"), F.col("n"))
    return rank.select(
        by, "n", rate.alias("breach_rate"), "roc_auc", "pr_auc"
    ).join(point.select(by, "flagged_share", "precision", "recall"), by)


#: Probabilities are told apart to six digits here, so that at most 2 * (SCALE + 1) counts describe all rows.
SCALE = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 32-bit number per 32-bit number (both in uint64)."""
    low = np.uint64(0xFFFFFFFF)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & low
    return x ^ (x >> np.uint64(16))


def _poisson_table(k: int) -> tuple[int, np.ndarray]:
    """(lowest count, cumulative probabilities from there) of Poisson(k), but for tails below 1e-12."""
    low, high = max(0, int(k - 9 * k**0.5 - 40)), int(k + 9 * k**0.5 + 40)
    terms = [math.exp(-k + w * math.log(k) - math.lgamma(w + 1)) for w in range(low, high + 1)]
    return low, np.cumsum(terms)


def bootstrap_ranking(
    df: DataFrame, replicates: int = 1000, p: str = "p", y: str = "y", seed: int = 0
) -> DataFrame:
    """replicate, roc_auc and pr_auc of bootstrap samples of the rows; cost free of the number of rows.

    Rows that share score and label are drawn together: the sum of k Poisson(1) weights is Poisson(k), taken
    from a uniform number by the inverse distribution. That number depends on score, label, replicate
    and seed alone, so a recomputed task draws the same. Tasks get the counts per score and label
    (bounded: scores have six digits) and work on whole replicates.
    """
    units = F.floor(F.col(p) * SCALE + 0.5).cast("bigint").alias("units")
    counts = (
        df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy(units, F.col(y).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("k"))
        .orderBy(F.col("units").desc(), "label").toArrow()
    )
    unit, label, k = (counts.column(c).to_numpy() for c in ("units", "label", "k"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = _mixed((unit * 2 + label + seed * 4_000_003).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        groups = [(np.flatnonzero(k == n), *_poisson_table(int(n))) for n in np.unique(k)]
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for r in batch.column(0).to_pylist():
                u = (_mixed(key ^ _mixed(np.uint64([r]))) + 0.5) / 2.0**32
                w = np.zeros(len(unit))
                for at, low, table in groups:
                    w[at] = low + np.searchsorted(table, u[at], side="right")
                if not len(first):
                    continue
                pos = np.add.reduceat(np.where(label == 1, w, 0.0), first)
                neg = np.add.reduceat(np.where(label == 1, 0.0, w), first)
                hits, misses = pos.sum(), neg.sum()
                above, every = np.cumsum(pos), np.cumsum(pos + neg)
                both = hits > 0 and misses > 0
                auc = float((neg * (above - pos / 2)).sum() / (hits * misses)) if both else None
                seen = every > 0
                ap = float((pos[seen] * above[seen] / every[seen]).sum() / hits) if both else None
                rows.append((r, auc, ap))
            kinds = (pa.int64(), pa.float64(), pa.float64())
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["replicate", "roc_auc", "pr_auc"]
            )

    spark = df.sparkSession
    tasks = min(replicates, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(1, replicates + 1, 1, tasks).mapInArrow(
        draw, "replicate long, roc_auc double, pr_auc double"
    )


def confidence_interval(replicates: DataFrame, metric: str) -> DataFrame:
    """Mean and 2.5 % / 97.5 % percentiles over the replicates (a few thousand rows at most)."""
    band = F.percentile(metric, [0.025, 0.975])
    return replicates.agg(
        F.lit(metric).alias("metric"),
        F.count(F.lit(1)).alias("replicates"),
        F.avg(metric).alias("mean"),
        band[0].alias("low"),
        band[1].alias("high"),
    )

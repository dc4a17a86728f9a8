"""Exact linear-interpolated percentiles that do not hold a group in memory.

Two ways with equal results. Values are integers at a fixed resolution (seconds, 1/10000 h).

:func:`grouped_percentiles`, for many groups: rows are counted per (group, value) with
map-side combine, so a hot group is spread over many reducers, and a window ranks the
distinct values of a group.

:func:`selected_percentiles`, for no or few groups: a histogram of 4096 values a bin finds the
bins that hold the wanted ranks, and a second scan counts the values of those bins only. Each
shuffle carries bins or the values of a few bins, and no task ranks all values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions.exact import idiv, ratio

Fraction = tuple[int, int]
MEDIAN: Fraction = (1, 2)
P90: Fraction = (9, 10)


def _big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _ranks(num: int, den: int) -> tuple[Column, Column, Column]:
    """0-based ranks below and above the wanted position, and its fraction in units of 1/den."""
    pos = (F.col("_n") - 1) * _big(num)
    part = pos % _big(den)
    low = idiv(pos, den)
    return low, low + F.when(part > 0, _big(1)).otherwise(_big(0)), part


def _pick(value: Column, low: Column) -> Column:
    """The value whose run of equal rows covers 0-based rank ``low``."""
    covers = (F.col("_cum") - F.col("_c") <= low) & (low < F.col("_cum"))
    return F.max(F.when(covers, value))


def _between(name: str, den: int) -> Column:
    lo, hi, part = (F.col(f"_{x}_{name}") for x in ("lo", "hi", "fr"))
    return (lo * _big(den) + (hi - lo) * part).alias(name)


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: dict[str, Fraction],
    sums: dict[str, Column] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """One row per group: ``sums`` plus each percentile as an integer times its denominator.

    ``fractions[name] = (num, den)`` yields ``den * percentile(num / den)``; NULL values are
    ignored by the percentiles but still count in ``sums``. ``weight`` is the number of rows
    a pre-aggregated input row stands for.
    """
    keys, sums = list(keys), sums or {}
    one = weight if weight is not None else _big(1)
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(
        F.sum(F.when(F.col(value).isNotNull(), one).otherwise(_big(0))).alias("_c"),
        *[F.sum(expr).alias(name) for name, expr in sums.items()],
    )
    by_value = Window.partitionBy(*keys).orderBy("_v")
    running = by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counted.withColumns(
        {"_cum": F.sum("_c").over(running), "_n": F.sum("_c").over(whole)}
    )
    picks, shaped = [], []
    for name, (num, den) in fractions.items():
        low, high, part = _ranks(num, den)
        picks += [
            _pick(F.col("_v"), low).alias(f"_lo_{name}"),
            _pick(F.col("_v"), high).alias(f"_hi_{name}"),
            F.max(part).alias(f"_fr_{name}"),
        ]
        shaped.append(_between(name, den))
    totals = ranked.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums], *picks)
    return totals.select(*keys, *sums, *shaped)


BIN_BITS = 12


def selected_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: dict[str, Fraction],
    sums: dict[str, Column] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """As :func:`grouped_percentiles`, for keys of a closed domain (or none at all).

    Two scans of ``df`` (histogram with sums; values of the bins found), each combined on the map
    side. The broadcast table has at most two rows per group and fraction, so the keys must have
    a bounded number of values. The histogram window ranks the bins of a group, at most
    (range of the values) / 4096 rows; the window over values sees 4096 a bin found.
    """
    sums = sums or {}
    by = list(keys) or ["_all"]
    value_of = F.col(value).cast("bigint")
    one = weight if weight is not None else _big(1)
    rows = df if keys else df.withColumn("_all", F.lit(0))
    rows = rows.select(
        *by,
        value_of.alias("_v"),
        F.shiftright(value_of, BIN_BITS).alias("_bin"),
        F.when(value_of.isNotNull(), one).otherwise(_big(0)).cast("bigint").alias("_w"),
        *[expr.alias(name) for name, expr in sums.items()],
    )

    of_group = Window.partitionBy(*by)
    running = of_group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    histogram = rows.groupBy(*by, "_bin").agg(
        F.sum("_w").alias("_c"), *[F.sum(name).alias(name) for name in sums]
    ).withColumns(
        {
            "_cum": F.sum("_c").over(running),
            "_n": F.sum("_c").over(of_group),
            **{name: F.sum(name).over(of_group) for name in sums},
        }
    )
    before = F.col("_cum") - F.col("_c")
    carried, marks = {name: F.col(name) for name in sums}, []
    for name, (num, den) in fractions.items():
        low, high, part = _ranks(num, den)
        for end, rank in (("lo", low), ("hi", high)):
            here = (before <= rank) & (rank < F.col("_cum"))
            carried[f"_at_{end}_{name}"] = F.when(here, rank - before)
            marks.append(f"_at_{end}_{name}")
        carried[f"_fr_{name}"] = part
    # A group without values keeps a row, so that its sums are not lost.
    places = [*by, "_bin"]
    found = histogram.select("_n", *places, *[c.alias(n) for n, c in carried.items()]).filter(
        F.coalesce(*marks).isNotNull() | (F.col("_n") == 0)
    )
    hits = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(places)], *carried)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(places)]
    inside = (
        rows.select(*places, "_v", "_w")
        .join(F.broadcast(hits), reduce(and_, same))
        .groupBy(*places, "_v")
        .agg(F.sum("_w").alias("_c"), *[F.max(n).alias(n) for n in carried])
        .repartition(*by)
    )
    line = Window.partitionBy(*places).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picks, shaped = [F.max(name).alias(name) for name in sums], []
    for name, (_, den) in fractions.items():
        picks += [
            _pick(F.col("_v"), F.col(f"_at_{end}_{name}")).alias(f"_{end}_{name}")
            for end in ("lo", "hi")
        ]
        picks.append(F.max(f"_fr_{name}").alias(f"_fr_{name}"))
        shaped.append(_between(name, den))
    picked = inside.withColumn("_cum", F.sum("_c").over(line))
    return picked.groupBy(*keys).agg(*picks).select(*keys, *sums, *shaped)


def tick_hours(name: str, fraction: Fraction = MEDIAN, digits: int = 2) -> Column:
    """Percentile of 1/10000-hour ticks (times the denominator) -> rounded hours."""
    return ratio(F.col(name), 10_000 * fraction[1], digits)


def second_hours(name: str, fraction: Fraction = MEDIAN, digits: int = 1) -> Column:
    """Percentile of seconds (times the denominator) -> rounded hours."""
    return ratio(F.col(name), 3600 * fraction[1], digits)

"""Running totals and row numbers along a global or per-key order, without a single-task window.

A window over one key runs in one task. Here the rows are range-partitioned on
(keys, order) - the order must be unique within a key, so even one key that holds most of
the table is cut into even slices - and each slice receives the total of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.operators.staging import stage

SLICE = "_slice"


def ordered_prefix(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, Column],
    keys: Sequence[str] = (),
    label: str = "ordered",
) -> DataFrame:
    """Add, per name in ``sums``, the inclusive running total of its expression.

    ``order`` columns are ascending and, with ``keys``, identify a row.
    """
    keys, order = list(keys), list(order)
    work = df.withColumns({f"_in_{name}": expr for name, expr in sums.items()})
    work = work.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id())
    # Written, so that both uses below see the same slices even after a retried task.
    work = stage(work, label)

    # A key needs a carry-in only when it spans several slices, so the carry table has
    # fewer rows than there are range partitions: a proven bound for the broadcast.
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy(*keys, SLICE).agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(SLICE).alias("_k_slice"),
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
    ).filter("_earlier > 0")
    match = F.col(SLICE) == F.col("_k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = work.join(F.broadcast(carry), match, "left")

    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = joined.withColumns(
        {n: F.sum(f"_in_{n}").over(inside) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    )
    return out.select(*df.columns, *sums)


def row_numbers(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "row_number"
) -> DataFrame:
    one = F.lit(1).cast("bigint")
    return ordered_prefix(df, order, {name: one}, keys, label=f"rows_{name}")


SHUFFLE_ROUNDS = 16


def shuffled(number: Column, n: int, seed: str, rounds: int = SHUFFLE_ROUNDS) -> Column:
    """A seeded permutation of 0 .. n - 1 as an expression: no sort, no shuffle of rows, any n.

    Swap or not: a round pairs x with k - x (modulo n) and swaps a pair if a bit says so that depends on the pair. Each
    round maps the numbers one to one, so all rounds do.
    """
    step = F.transform(
        F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.concat(F.lit(f"{seed}/"), r.cast("string"))
    )

    def swap(x: Column, name: Column) -> Column:
        k = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")
        other = F.pmod(k - x, F.lit(n).cast("bigint"))
        pair = F.concat(name, F.lit("/"), F.greatest(x, other).cast("string"))
        bit = F.conv(F.substring(F.md5(pair), 1, 1), 16, 10).cast("int") % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(step, number.cast("bigint"), swap)


def equal_count_bin(row: Column, total: Column, bins: int) -> Column:
    """Bin 1..bins of a 1-based row number; the first ``total % bins`` bins hold one row more."""
    base, extra = F.floor(total / bins), total % bins
    wide = extra * (base + 1)
    in_wide = F.floor((row - 1) / (base + 1)) + 1
    in_rest = extra + F.floor((row - 1 - wide) / F.nullif(base, F.lit(0))) + 1
    return F.when(row <= wide, in_wide).otherwise(in_rest).cast("int")


def rank_desc(df: DataFrame, part: Sequence[str], value: str, name: str) -> DataFrame:
    """SQL ``rank() over (partition by part order by value desc nulls last)``.

    ``value`` is a rounded integer measure, so the distinct values per partition are few;
    rows are counted per value first and the window only sees those counts.
    """
    part = list(part)
    key = F.coalesce(F.col(value).cast("bigint"), F.lit(-(2**62)))
    keyed = df.withColumn("_v", key)
    above = (
        Window.partitionBy(*part)
        .orderBy(F.col("_v").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = keyed.groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranks = counts.select(
        *part, "_v", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias(name)
    )
    return keyed.join(ranks, [*part, "_v"]).select(*df.columns, name)

"""Which tickets were open at each instant of a grid, without a theta join.

A ticket is open at T when ``opened <= T < closed`` (``closed`` NULL = still open). The
instants of a regular grid that fall in that interval form an index range, so a ticket can
name them itself: either one row per instant (:func:`explode_open`), or, when only counts
are needed, a +1 where the range starts and a -1 after it ends (:func:`open_counts`), which
costs the same for a ticket open for an hour or for years.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.constants import AGE_BANDS, AGE_BOUNDS_HOURS
from ticketlens.functions.exact import from_seconds, idiv, midnight, plus_seconds, seconds


def epoch(ts: datetime) -> int:
    return int(ts.replace(tzinfo=timezone.utc).timestamp())


def ntz(ts: datetime) -> Column:
    return F.expr(f"timestamp_ntz'{ts:%Y-%m-%d %H:%M:%S}'")


@dataclass(frozen=True)
class WeekGrid:
    """Week ends (Monday 00:00 UTC) from the first ticket's week to the snapshot."""

    first: datetime
    size: int

    STEP = 7 * 86400

    @classmethod
    def over(cls, first_creation: datetime, snapshot: datetime) -> WeekGrid:
        day = first_creation.date() - timedelta(days=first_creation.weekday())
        start = datetime(day.year, day.month, day.day)
        weeks = int((snapshot - start).total_seconds() // cls.STEP)
        return cls(start + timedelta(days=7), max(weeks, 0))

    def after(self, ts: Column) -> Column:
        """Index of the first instant strictly later than ``ts`` (not negative)."""
        offset = seconds(ts) - F.lit(epoch(self.first)).cast("bigint")
        return F.greatest(idiv(offset + F.lit(self.STEP).cast("bigint"), self.STEP), F.lit(0))

    def instant(self, index: Column) -> Column:
        secs = F.lit(epoch(self.first)).cast("bigint") + index * F.lit(self.STEP).cast("bigint")
        return from_seconds(secs)


@dataclass(frozen=True)
class MonthGrid:
    """Month starts after the first ticket's month, up to and including the snapshot."""

    first: date
    size: int

    @classmethod
    def over(cls, first_creation: datetime, snapshot: datetime) -> MonthGrid:
        months = first_creation.year * 12 + first_creation.month  # the following month, 0-based
        size = snapshot.year * 12 + snapshot.month - 1 - months + 1
        return cls(date(months // 12, months % 12 + 1, 1), max(size, 0))

    def after(self, ts: Column) -> Column:
        base = self.first.year * 12 + self.first.month
        index = F.year(ts) * 12 + F.month(ts) - F.lit(base) + 1
        return F.greatest(index, F.lit(0)).cast("bigint")

    def instant(self, index: Column) -> Column:
        start = F.to_date(F.lit(self.first.isoformat()))
        return midnight(F.add_months(start, index.cast("int")))


@dataclass(frozen=True)
class SingleInstant:
    """A grid of one arbitrary instant."""

    at: datetime
    size: int = 1

    def after(self, ts: Column) -> Column:
        return F.when(ts < ntz(self.at), F.lit(0)).otherwise(F.lit(1)).cast("bigint")

    def instant(self, index: Column) -> Column:
        return ntz(self.at)


Grid = WeekGrid | MonthGrid | SingleInstant


def at_or_after(grid: Grid, ts: Column) -> Column:
    return grid.after(plus_seconds(ts, F.lit(-1)))


def _bounded(grid: Grid, df: DataFrame) -> DataFrame:
    """Tickets open at one instant at least, with their index range [_i0, _i1)."""
    size = F.lit(grid.size).cast("bigint")
    start = at_or_after(grid, F.col("creation_ts"))
    still_open = F.col("closed_ts").isNull()
    stop = F.when(still_open, size).otherwise(F.least(at_or_after(grid, F.col("closed_ts")), size))
    last = grid.instant(F.lit(max(grid.size - 1, 0)))
    first = grid.instant(F.lit(0))
    # The two time predicates reach the parquet scan; the index test is exact.
    live = df.filter(F.col("creation_ts") <= last).filter(
        F.col("closed_ts").isNull() | (F.col("closed_ts") > first)
    )
    return live.withColumns({"_i0": start, "_i1": stop}).filter("_i0 < _i1")


def age_band(age_seconds: Column, numbered: bool = False) -> Column:
    """Label (or 1-based order) of the age band that an age in seconds falls into."""
    names = [F.lit(i + 1) if numbered else F.lit(b) for i, b in enumerate(AGE_BANDS)]
    out = None
    for hours, name in zip(AGE_BOUNDS_HOURS, names):
        test = age_seconds < F.lit(hours * 3600)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(names[-1])


def open_rows(df: DataFrame, as_of: datetime) -> DataFrame:
    """Tickets open at one instant, with ``as_of``, ``age_seconds`` and ``past_due``."""
    at = ntz(as_of)
    live = df.filter(F.col("creation_ts") <= at).filter(
        F.col("closed_ts").isNull() | (F.col("closed_ts") > at)
    )
    return live.withColumn("as_of", at).transform(_aged)


def explode_open(df: DataFrame, grid: Grid) -> DataFrame:
    """One row per (ticket, instant at which it was open)."""
    index = F.explode(F.sequence(F.col("_i0"), F.col("_i1") - 1)).alias("_i")
    pairs = _bounded(grid, df).select(*df.columns, index)
    return pairs.withColumn("as_of", grid.instant(F.col("_i"))).drop("_i").transform(_aged)


def _aged(df: DataFrame) -> DataFrame:
    age = seconds("as_of") - seconds("creation_ts")
    out = df.withColumn("age_seconds", age)
    return out.withColumns(
        {
            "past_due": F.col("as_of") > F.col("expected_resolution_ts"),
            "age_bucket": age_band(F.col("age_seconds")),
            "bucket_order": age_band(F.col("age_seconds"), numbered=True),
        }
    )


def _change(index: Column, band: int, sign: int, due: bool, counted: dict[str, Column]) -> Column:
    step = F.lit(sign)
    nil = F.lit(0)
    fields = [
        index.alias("_i"),
        F.lit(band).alias("bucket_order"),
        (nil if due else step).alias("open_tickets"),
        (step if due else nil).alias("past_due_tickets"),
    ]
    for name, cond in counted.items():
        hit = nil if due else F.when(cond, step).otherwise(nil)
        fields.append(hit.alias(name))
    return F.struct(*fields)


def open_counts(
    df: DataFrame,
    grid: Grid,
    keys: Sequence[str],
    counted: dict[str, Column],
    banded: bool = False,
) -> DataFrame:
    """Open, past-due and conditional counts per instant (and key, and age band).

    Instants with nothing open have no row.
    """
    keys = list(keys)
    live = _bounded(grid, df)
    due = grid.after(F.col("expected_resolution_ts"))
    edges = [0, *[h * 3600 for h in AGE_BOUNDS_HOURS], None] if banded else [0, None]
    changes = []
    for band, (low, high) in enumerate(zip(edges, edges[1:]), start=1):
        lo = F.col("_i0")
        if low:
            lo = F.greatest(lo, at_or_after(grid, plus_seconds("creation_ts", F.lit(low))))
        hi = F.col("_i1")
        if high:
            hi = F.least(hi, at_or_after(grid, plus_seconds("creation_ts", F.lit(high))))
        for begin, is_due in ((lo, False), (F.greatest(lo, due), True)):
            spans = begin < hi
            for index, sign in ((begin, 1), (hi, -1)):
                changes.append(F.when(spans, _change(index, band, sign, is_due, counted)))
    edits = live.select(*keys, F.explode(F.array_compact(F.array(*changes))).alias("_e"))
    measures = ["open_tickets", "past_due_tickets", *counted]
    net = edits.groupBy(*keys, "_e.bucket_order", "_e._i").agg(
        *[F.sum(f"_e.{m}").alias(m) for m in measures]
    )
    # At most (grid size + 1) rows per key and band reach this window.
    line = Window.partitionBy(*keys, "bucket_order").orderBy("_i")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = net.select(
        *keys,
        "bucket_order",
        "_i",
        F.lead("_i", 1, grid.size).over(line).alias("_next"),
        *[F.sum(m).over(upto).alias(m) for m in measures],
    ).filter("open_tickets > 0 and _i < _next")
    spread = levels.withColumn("_i", F.explode(F.sequence(F.col("_i"), F.col("_next") - 1)))
    out = spread.withColumn("as_of", grid.instant(F.col("_i")))
    if not banded:
        return out.select("as_of", *keys, *measures)
    label = F.element_at(F.array(*[F.lit(b) for b in AGE_BANDS]), F.col("bucket_order"))
    return out.select("as_of", *keys, label.alias("age_bucket"), "bucket_order", *measures)

"""Fill the gaps of per-key series: one row for every key and every step of a grid.

Joining keys x steps with the series would shuffle and sort that whole product. Here a row of
the series also names the empty steps before it (its last row those after it too), so that only
the sparse rows and the keys meet, on the key alone, and the product appears after the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def every_step(
    owners: DataFrame, series: DataFrame, key: str, step: str, size: int
) -> DataFrame:
    """``owners`` x steps 0 .. size - 1 with the measures of ``series`` (NULL where it has no row).

    ``owners`` has one row per key, ``series`` at most one per key and step, so a key's window
    holds at most ``size`` rows. Series rows of unknown keys have no effect.
    """
    measures = [c for c in series.columns if c not in (key, step)]
    line = Window.partitionBy(key).orderBy(step)
    last = F.lead(step).over(line).isNull()
    spans = series.filter(F.col(step).between(0, size - 1)).withColumns(
        {
            "_from": F.lag(step).over(line) + 1,
            "_to": F.when(last, F.lit(size - 1)).otherwise(F.col(step)),
        }
    ).withColumnRenamed(step, "_own")
    start = F.coalesce(F.col("_from"), F.lit(0)).cast("int")
    stop = F.coalesce(F.col("_to"), F.lit(size - 1)).cast("int")
    filled = owners.filter(F.lit(size > 0)).join(spans, key, "left").withColumn(
        step, F.explode(F.sequence(start, stop))
    )
    own = F.col(step) == F.col("_own")
    return filled.select(
        *owners.columns, step, *[F.when(own, F.col(m)).alias(m) for m in measures]
    )

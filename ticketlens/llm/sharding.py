"""Shards by weighted rendezvous hashing of stable record keys.

Every shard draws a number from (key, shard); the record goes to the shard with the best one.
Raising the shard count leaves the old draws as they are, so a record either stays or moves to
a new shard. With weight w the draw is ln(u) / w, which gives a shard a share of w / sum(w).

Rows inside a shard get gapless slots in the order of a hash of their key, so a shard is also
shuffled. Numbering a shard in one task would not scale: a shard is cut into 65,536 hash bins,
bins are counted first, and a row's slot is the number of rows in earlier bins plus its place in
its bin, whose size shrinks with the bins.

Defined results: a null key counts as the empty key; null text has size 1 and crc32 0; equal
keys share a shard and get slots of their own; an empty table gives no rows. Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import hex_bits, id_text, text_of

SEED = "shards-1"
#: Hex digits of the key's hash that name a bin inside a shard.
BIN_DIGITS = 4
#: 52 bits of a digest fill a double exactly.
DRAW_DIGITS = 13


def rendezvous(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """The shard, from 0, in which ``key`` lives; ``weights`` has one positive number per shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")

    def draw(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(shard)), key))
        unit = (hex_bits(digest, 1, DRAW_DIGITS) + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
        return F.struct((F.ln(unit) / F.lit(float(weight))).alias("draw"), F.lit(-shard).alias("n"))

    draws = [draw(i, w) for i, w in enumerate(weights)]
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return (-best["n"]).cast("int")


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    grown: Sequence[float],
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = SEED,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``grown`` are the weights after growth; ``grown_shard`` is the shard under them.
    """
    key, text = id_text(F.col(id_col)), text_of(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights, seed).alias("shard"),
        rendezvous(key, grown, seed).alias("grown_shard"),
        F.md5(F.concat_ws("|", F.lit(seed), key)).alias("place"),
    ).withColumn("bin", hex_bits(F.col("place"), 1, BIN_DIGITS).cast("int"))

    # At most 65,536 rows per shard meet in this window, however large the input is.
    earlier = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "bin").orderBy("place", "text_crc32", "size")
    return rows.join(starts, ["shard", "bin"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).cast("bigint").alias("slot"),
        "grown_shard",
    )

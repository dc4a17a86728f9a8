"""Exact duplicates by distributed most-significant-byte radix partitioning.

All documents start in one group. A round cuts the next bytes off every text and splits each
group by them; a group with one document is done (nothing equals it), a group whose texts have
ended is a class of equal texts, and only the others go on. Classes are equal byte for byte: no
digest decides. Rounds take more and more bytes (``FIRST_BYTES``, then ``GROWTH`` times more up
to ``MOST_BYTES``), so their number grows with the logarithm of the longest common prefix, and
after the first round only texts that share a beginning are left.

A group is named by its smallest row number. One round is one sum per (group, bytes), with
map-side combine, so a text that a third of all rows share crosses the network once per task;
and one join that gives the rows their new group, in which Spark splits a hot group. What is
left after a round is written to the shared folder.

The digest of a text is part of the result only.

Defined results: texts are compared without white space; null counts as empty, and empty texts
are equal; of equal texts the row with the most code points in the original text stays, then the
one with the smallest id (null ids last). Rows that repeat id and text: one of them stays. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import id_text, text_of, without_white
from ticketlens.operators.staging import discard, stage

FIRST_BYTES, GROWTH, MOST_BYTES = 64, 8, 1 << 20


def _split(left: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """One round over rows of (row, group, rest): classes of ended texts, and what goes on."""
    head = F.substring("rest", 1, width)
    cut = left.select("row", "group", head.alias("head"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
    # Written, so that the rows of a much-copied text can be split in the join.
    groups = stage(
        cut.groupBy("group", "head")
        .agg(F.min("row").alias("split"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("group", "head", "split"),
        "radix_groups",
    )
    ended = F.octet_length("head") < width
    # Merged at every size: the table of groups grows with the input.
    grouped = cut.join(groups.hint("merge"), ["group", "head"]).select(
        "row",
        F.col("split").alias("group"),
        ended.alias("ended"),
        F.when(~ended, F.col("rest")).alias("rest"),
    )
    after = stage(grouped, "radix_round")
    found = stage(after.filter("ended").select("row", F.col("group").alias("class")), "radix_found")
    discard(groups)
    return found, after


def duplicate_classes(rows: DataFrame) -> DataFrame:
    """(row, class) of the rows of (row, rest) that have an equal; ``row`` is unique."""
    left = rows.select("row", F.lit(0).cast("bigint").alias("group"), "rest")
    width, done, last = FIRST_BYTES, None, []
    while True:
        found, after = _split(left, width)
        done = found if done is None else done.unionByName(found)
        # The texts of the round before are not needed any more.
        discard(*last)
        left, last = after.filter("not ended").drop("ended"), [after]
        if left.isEmpty():
            discard(after)
            return done
        width = min(width * GROWTH, MOST_BYTES)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    text = text_of(F.col(text_col))
    plain = without_white(text)
    # Written, so that every reader sees the same row numbers.
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            F.char_length(text).cast("bigint").alias("points"),
            F.sha2(plain, 256).alias("text_sha256"),
            plain.cast("binary").alias("rest"),
        ),
        "radix_rows",
    )
    classed = stage(
        rows.drop("rest").join(duplicate_classes(rows.select("row", "rest")), "row", "left"), "radix_classed"
    )
    discard(rows)
    single = classed.filter("class is null").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    members = classed.filter("class is not null")
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    # Written, so that the class of a much-copied text can be split in the join.
    best = stage(
        members.groupBy("class").agg(
            F.min(order)["row"].alias("best"),
            F.min_by("doc_id", order).alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
        ),
        "radix_best",
    )
    several = members.join(best, "class").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("best")).alias("kept"), "text_sha256"
    )
    return single.unionByName(several)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = deduplicate(docs, id_col, text_col).filter("kept").select(
        id_text(F.col("doc_id")).alias("_dedup_id"), F.col("text_sha256").alias("_dedup_sha")
    )
    text = text_of(F.col(text_col))
    keyed = docs.withColumns(
        {"_dedup_id": id_text(F.col(id_col)), "_dedup_sha": F.sha2(without_white(text), 256)}
    )
    # Rows that repeat id and text meet here, and one of them goes on.
    first = Window.partitionBy("_dedup_id", "_dedup_sha").orderBy(F.char_length(text).desc(), text)
    return (
        keyed.join(stay, ["_dedup_id", "_dedup_sha"], "left_semi")
        .withColumn("_dedup_turn", F.row_number().over(first))
        .filter("_dedup_turn = 1")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )

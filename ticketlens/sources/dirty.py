"""Deterministic defects on the adapter's tickets, to exercise the cleaning jobs.

A ticket's defect is chosen by its id modulo 1000, so the expected result of every cleaning
step can be stated from the clean tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.constants import TICKET_TIMESTAMPS

CODES = ["ticket_type", "severity", "status", "channel", "assignment_group"]


def _slot(key: str) -> Column:
    return F.col(key) % 1000


def _stamp(ts: str, slot: Column) -> Column:
    """ISO text of a UTC instant: five hours behind with an offset, naive, or with Z."""
    shifted = F.timestamp_add("SECOND", F.lit(-5 * 3600), F.col(ts))
    return (
        F.when(slot < 50, F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
        .when(slot < 70, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    )


def _code(name: str, slot: Column) -> Column:
    text = F.col(name)
    return (
        F.when(slot.between(70, 99), F.replace(F.upper(text), F.lit("_"), F.lit(" ")))
        .when(slot.between(100, 119), F.concat(F.lit("\t "), text, F.lit("  ")))
        .otherwise(text)
    )


def _set(name: str, slot: Column, number: int, value: Column) -> tuple[str, Column]:
    return name, F.when(slot == number, value).otherwise(F.col(name))


def dirty_tickets(clean: DataFrame) -> DataFrame:
    """All-string raw tickets with ``raw_row``; some rows appear twice."""
    df = clean.withColumn("_slot", _slot("id"))
    slot = F.col("_slot")
    day = 86400
    before = F.timestamp_add("SECOND", F.lit(-day), F.col("creation_date"))
    broken = df.withColumns(
        {
            "resolution_date": F.when(
                (slot == 183) & F.col("resolution_date").isNotNull(), before
            ).otherwise(F.col("resolution_date")),
            "last_update": F.when(slot == 191, before).otherwise(F.col("last_update")),
        }
    )
    text = broken.withColumns({c: _stamp(c, slot) for c in TICKET_TIMESTAMPS})
    text = text.withColumns({c: _code(c, slot) for c in CODES})
    strings = [
        "id", "priority", "customer_id", "site_id", "service_id", "open_backlog_at_creation",
        "reopen_count",
    ]
    text = text.withColumns({c: F.col(c).cast("string") for c in strings})
    text = text.withColumn(
        "id", F.when(slot.between(100, 119), F.concat(F.lit(" "), "id")).otherwise(F.col("id"))
    )
    blank = F.lit("")
    edits = [
        ("priority", F.when(slot.between(120, 129), blank).otherwise(F.col("priority"))),
        ("description", F.when(slot.between(130, 179), blank).otherwise(F.col("description"))),
        _set("severity", slot, 184, F.lit("urgent")),
        _set("creation_date", slot, 185, F.lit("garbage")),
        _set("site_id", slot, 186, blank),
        _set("customer_id", slot, 187, F.lit("no-such-customer")),
        _set("name", slot, 192, blank),
        _set("expected_resolution_date", slot, 193, blank),
        _set("open_backlog_at_creation", slot, 195, F.lit("n/a")),
        _set("reopen_count", slot, 195, F.lit("3.7")),
        _set("channel", slot, 197, F.lit("fax")),
    ]
    for name, value in edits:
        text = text.withColumn(name, value)
    # 196 last: its priority is a word.
    text = text.withColumn("priority", _set("priority", slot, 196, F.lit("two"))[1])
    copies = F.when(slot.isin(181, 182, 194), 2).otherwise(1)
    copied = text.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    status = F.when((slot == 194) & (F.col("_copy") == 2), F.upper("status"))
    return copied.select(
        *[c for c in clean.columns if c != "status"],
        F.coalesce(status, F.col("status")).alias("status"),
        (F.trim("id").cast("bigint") * 10 + F.col("_copy")).alias("raw_row"),
    )


def dirty_history(history: DataFrame) -> DataFrame:
    """All-string raw status changes with ``raw_row``."""
    df = history.withColumn("_slot", _slot("ticket_id"))
    slot = F.col("_slot")
    last = F.col("step") == 8
    shaped = df.select(
        F.col("ticket_id").cast("string").alias("ticket_id"),
        F.when((slot == 222) & last, "finished").otherwise(_code("status", slot)).alias("status"),
        F.when((slot == 221) & last, "not a date")
        .otherwise(_stamp("change_date", slot))
        .alias("change_date"),
        "change_reason",
        (F.col("ticket_id") * 100 + F.col("step")).alias("raw_row"),
        F.explode(F.sequence(F.lit(1), F.when(slot.isin(181, 182), 2).otherwise(1))).alias("_c"),
    )
    return shaped.withColumn("raw_row", F.col("raw_row") * 10 + F.col("_c")).drop("_c")

"""The documented ad-hoc questions: what goes with breaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.exact import pct
from ticketlens.operators.ordering import equal_count_bin, ordered_prefix, row_numbers
from ticketlens.operators.percentile import MEDIAN, grouped_percentiles, tick_hours
from ticketlens.plans.desk import Desk
from ticketlens.plans.enrich import ever_in_state, has_active_outage
from ticketlens.plans.views import during_outage, flag, not_cancelled, one, ticks


def _rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if("sla_breached").alias("breached")
    )
    return agg.select(*keys, "tickets", "breached", pct("breached", "tickets").alias("breach_pct"))


def breach_by_time_of_day(desk: Desk) -> DataFrame:
    """Weekend x after-hours flags of creation, resolved tickets."""
    return _rate(desk.facts.filter("is_resolved"), ["is_weekend", "is_after_hours"])


def breach_by_backlog_quintile(desk: Desk, bins: int = 5) -> DataFrame:
    """Equal-count bins of the backlog at creation, ties by ticket id.

    Tickets are counted per backlog; only those of a backlog that falls into several bins, of
    which there are fewer than bins, are put in order.
    """
    backlog = "open_backlog_at_creation"
    base = desk.resolved_backlog
    counts = base.groupBy(backlog).agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if("sla_breached").alias("breached")
    )
    upto = ordered_prefix(counts, [backlog], {"_upto": F.col("tickets")}, label="backlogs")
    n = upto.agg(F.max("_upto")).first()[0] or 0

    def bin_of(row: Column) -> Column:
        return equal_count_bin(row, F.lit(n), bins)

    before = F.col("_upto") - F.col("tickets")
    placed = upto.withColumns({"quintile": bin_of(before + 1), "_last": bin_of(F.col("_upto"))})
    columns = ["quintile", backlog, "tickets", "breached"]
    whole = placed.filter("quintile = _last").select(*columns)
    cut = placed.filter("quintile < _last").select(F.col(backlog).alias("_cut"), before.alias("_before"))
    rows = base.join(F.broadcast(cut), F.col(backlog).eqNullSafe(F.col("_cut"))).drop("_cut")
    ranked = row_numbers(rows, ["ticket_id"], [backlog])
    apart = ranked.select(
        bin_of(F.col("_before") + F.col("row_number")).alias("quintile"),
        backlog,
        one().alias("tickets"),
        flag("sla_breached").alias("breached"),
    )
    agg = whole.unionByName(apart).groupBy("quintile").agg(
        F.min(backlog).alias("backlog_from"),
        F.max(backlog).alias("backlog_to"),
        F.sum("tickets").alias("tickets"),
        F.sum("breached").alias("breached"),
    )
    return agg.withColumn("breach_pct", pct("breached", "tickets"))


def breach_by_dimension(desk: Desk) -> DataFrame:
    """Rate and median hours per level of several dimensions, in one pass."""
    resolved = desk.unscored.filter("is_resolved").withColumn("ticks", ticks())
    base = ever_in_state(resolved, desk.history, "pending", "waited")
    dims: dict[str, Column] = {
        **{c: F.col(c) for c in ("assignment_group", "tier", "channel", "service_type", "ticket_type")},
        "reopened": F.when(F.col("reopen_count") > 0, "yes").otherwise("no"),
        "pending": F.when(F.col("waited"), "yes").otherwise("no"),
    }
    entries = [F.struct(F.lit(n).alias("dimension"), c.alias("level")) for n, c in dims.items()]
    long = base.select("ticks", "sla_breached", F.inline(F.array(*entries)))
    sums = {"tickets": one(), "breached": flag("sla_breached")}
    agg = grouped_percentiles(long, ["dimension", "level"], "ticks", {"p50": MEDIAN}, sums)
    return agg.select(
        "dimension",
        "level",
        "tickets",
        "breached",
        pct("breached", "tickets").alias("breach_pct"),
        tick_hours("p50").alias("median_hours"),
    )


def breach_by_month(desk: Desk) -> DataFrame:
    return _rate(desk.facts.filter("is_resolved"), ["creation_month"])


def outage_flag_agreement(desk: Desk) -> DataFrame:
    """Stored outage ids against membership derived from time, region and service."""
    base = not_cancelled(desk.facts).select(
        "region", "service_type", "creation_ts", "active_outage_id"
    )
    derived = during_outage(base, desk.outages)
    stored = has_active_outage()
    return derived.agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(stored).alias("stored"),
        F.count_if("during_outage").alias("derived"),
        F.count_if(stored != F.col("during_outage")).alias("disagreeing"),
    )


def pending_split(desk: Desk) -> DataFrame:
    """Breach rate of resolved tickets that did or did not pass through ``pending``."""
    resolved = desk.unscored.filter("is_resolved")
    return _rate(ever_in_state(resolved, desk.history, "pending", "ever_pending"), ["ever_pending"])

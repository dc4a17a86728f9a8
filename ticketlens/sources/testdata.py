"""Adapter: order/line-item tables -> raw ticket tables of the service-desk model.

One ticket per line. Order and line number do not identify a line (one pair can hold lines of
several parts), so a ticket's id also has the line's place within the pair. Every derived value is
integer arithmetic or a CASE, so any SQL engine reproduces it exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens import constants as C
from ticketlens.functions.exact import idiv, plus_seconds

#: After the last creation, so that no line falls behind it.
SNAPSHOT = datetime(2001, 8, 2)
#: Step between the ids of lines that share order and line number.
PLACE_STEP = 10**13
MODEL_VERSION = "pseudo-1"
SCORE_MODULUS = 1_000_003

# Zones by nation key modulo 5, and the outage incidents (09:00 to 09:00).
ZONES = [
    "America/Toronto",
    "America/Vancouver",
    "America/St_Johns",
    "America/Regina",
    "America/Halifax",
]
OUTAGES = [
    ("OUT-001", "AFRICA", "STANDARD", "1995-06-10", "1995-07-01", "fibre_cut"),
    ("OUT-002", "AMERICA", "PROMO", "1996-03-05", "1996-04-04", "power_failure"),
    ("OUT-003", "ASIA", "SMALL", "1997-01-12", "1997-01-26", "sbc_software_fault"),
    ("OUT-004", "EUROPE", "LARGE", "1997-11-01", "1997-12-19", "ddos_attack"),
    ("OUT-005", "MIDDLE EAST", "ECONOMY", "1998-08-15", "1998-08-21", "fibre_cut"),
    ("OUT-006", "AFRICA", "MEDIUM", "1999-05-02", "1999-05-22", "core_router_fault"),
    ("OUT-007", "AMERICA", "STANDARD", "2000-02-10", "2000-02-21", "power_failure"),
    ("OUT-008", "EUROPE", "PROMO", "2001-01-20", "2001-02-25", "dns_outage"),
]


# The closed feature levels of these tables, case-normalised.
REGIONS = ["africa", "america", "asia", "europe", "middle east"]
SERVICE_TYPES = ["economy", "large", "medium", "promo", "small", "standard"]
FEATURE_LEVELS = {
    "ticket_type": C.TICKET_TYPES,
    "severity": C.SEVERITIES,
    "channel": C.CHANNELS,
    "tier": C.TIERS,
    "industry": ["automobile", "building", "furniture", "household", "machinery"],
    "region": REGIONS,
    "province": [*sorted(C.PROVINCE_NAMES), "NU"],
    "service_type": SERVICE_TYPES,
    "assignment_group": [
        *[f"field_{r.replace(' ', '_')}" for r in REGIONS],
        "economy_ops", "large_ops", "promo_ops",
    ],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tier() -> Column:
    bal = F.col("c_acctbal")
    return (
        F.when(bal >= 7500, "platinum").when(bal >= 5000, "gold").when(bal >= 2500, "silver")
    ).otherwise("bronze")


def _group(service_type: str, region: str) -> Column:
    kind = F.col(service_type)
    field = F.concat(F.lit("field_"), F.replace(F.lower(region), F.lit(" "), F.lit("_")))
    return F.when(kind.isin("STANDARD", "SMALL", "MEDIUM"), field).otherwise(
        F.concat(F.lower(kind), F.lit("_ops"))
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = F.array(*[F.lit(p) for _, p, *_ in C.CITY_CENTROIDS])
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.lower("c_mktsegment").alias("industry"),
        _tier().alias("tier"),
        F.element_at(cities, F.col("c_nationkey").cast("int") + 1).alias("hq_province"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per nation; the last nation has a city without a known centroid."""
    key = F.col("n_nationkey").cast("int")
    known = C.CITY_CENTROIDS[:24]
    city = F.element_at(F.array(*[F.lit(c) for c, *_ in known], F.lit("Iqaluit")), key + 1)
    prov = F.element_at(F.array(*[F.lit(p) for _, p, *_ in known], F.lit("NU")), key + 1)
    owner = (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.min("c_custkey").alias("customer_id"))
    )
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return nation.join(owner, "n_nationkey", "left").select(
        F.col("n_nationkey").cast("bigint").alias("site_id"),
        "customer_id",
        F.col("n_name").alias("site_name"),
        city.alias("city"),
        prov.alias("province"),
        F.col("r_name").alias("region"),
        F.element_at(F.array(*[F.lit(z) for z in ZONES]), key % 5 + 1).alias("timezone"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = sites(spark, sf_dir).select("site_id", "customer_id", "region")
    part = table(spark, sf_dir, "part").withColumn("site_id", F.col("p_partkey") % 25)
    return part.join(site, "site_id").select(
        F.col("p_partkey").alias("service_id"),
        "site_id",
        "customer_id",
        F.col("p_type").alias("service_type"),
        F.when(F.col("p_size") % 7 > 0, F.col("p_size") * 10).cast("int").alias("bandwidth_mbps"),
        _group("p_type", "region").alias("assignment_group"),
    )


def sla_targets(spark: SparkSession) -> DataFrame:
    rows = [(t, s, h) for t, by in C.SLA_TARGET_HOURS.items() for s, h in by.items()]
    df = spark.createDataFrame(rows, "tier string, severity string, target_hours int")
    return df.withColumn("target_hours", F.col("target_hours").cast("decimal(8,2)"))


def outages(spark: SparkSession) -> DataFrame:
    cols = "outage_id string, region string, service_type string, s string, e string, cause string"
    df = spark.createDataFrame(OUTAGES, cols)
    nine = F.lit(9 * 3600)
    return df.select(
        "outage_id",
        "region",
        "service_type",
        plus_seconds(F.to_date("s").cast("timestamp_ntz"), nine).alias("start_ts"),
        plus_seconds(F.to_date("e").cast("timestamp_ntz"), nine).alias("end_ts"),
        "cause",
    )


LINE_ORDER = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
#: Lines equal in these differ for a ticket in nothing but the return flag.
TIE_COLUMNS = ["l_partkey", "l_suppkey"]


def numbered_lines(lines: DataFrame, order: list[str] = LINE_ORDER) -> DataFrame:
    """Lines with their place (from 0) among those of their order and line number.

    Partitioned by order, so that the join with the orders needs no second shuffle of the lines.
    Only the columns kept of a line and those of ``order`` are shuffled. ``swapped`` marks a
    line that is equal to the one before it in ``TIE_COLUMNS`` but not in its return flag.
    """
    kept = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)

    def as_before(name: str) -> Column:
        return F.lag(name).over(same).eqNullSafe(F.col(name))

    place = (F.row_number().over(same) - 1).cast("bigint")
    tied = reduce(and_, [as_before(c) for c in TIE_COLUMNS])
    return (
        lines.select(*dict.fromkeys([*kept, *order]))
        .repartition("l_orderkey")
        .withColumns({"place": place, "swapped": tied & ~as_before("l_returnflag")})
        .withColumn("swapped", F.col("swapped") & (F.col("place") > 0))
        .select("l_orderkey", "l_linenumber", "place", "l_partkey", "l_suppkey", "l_returnflag", "swapped")
    )


def source_reconciliation(spark: SparkSession, sf_dir: str, tickets: DataFrame) -> DataFrame:
    """Lines read, tickets made of them, and lines that could not become one, by reason."""
    there = {
        "order": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
        "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        "part": table(spark, sf_dir, "part").select("p_partkey"),
        "nation": table(spark, sf_dir, "nation").select("n_nationkey"),
    }
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(there["order"], F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(there["customer"], F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(there["part"], F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(there["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    reason = (
        F.when(F.col("o_orderkey").isNull(), "no_order")
        .when(F.col("c_custkey").isNull(), "no_customer")
        .when(F.col("p_partkey").isNull(), "no_part")
        .when(F.col("n_nationkey").isNull(), "no_nation")
    )
    reasons = ["no_order", "no_customer", "no_part", "no_nation"]
    counts = lines.select(reason.alias("r")).agg(
        F.count(F.lit(1)).alias("lines_read"),
        *[F.count(F.when(F.col("r") == r, 1)).alias(r) for r in reasons],
    )
    made = tickets.agg(F.count(F.lit(1)).alias("tickets"))
    rows = F.array(
        *[F.struct(F.lit(n).alias("outcome"), F.col(n).alias("row_count")) for n in ["lines_read", *reasons]]
    )
    out = counts.select(F.inline(rows))
    return out.unionByName(made.select(F.lit("tickets").alias("outcome"), F.col("tickets").alias("row_count")))


#: What is kept of a line and of its order, customer and part; all else is worked out row by row.
LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "place", "l_partkey", "l_suppkey", "l_returnflag", "o_custkey",
    "o_orderdate", "o_orderpriority", "customer_name", "c_mktsegment", "tier", "site_id", "p_name",
    "p_type",
]


def joined_lines(
    spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """Every line with its order, customer and part, in source columns; ``keep`` stages them.

    Customers meet the orders, not the lines, so a line is shuffled twice: by order and by part.
    Lines are put in order by the columns that a ticket has. The others of ``LINE_ORDER`` can
    change a ticket only where lines of one order, line number, part and supplier have several
    return flags; the lines of those pairs alone are read again and put in the full order.
    """
    lines = table(spark, sf_dir, "lineitem")
    placed = _placed_orders(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")

    def joined(numbered: DataFrame) -> DataFrame:
        return numbered.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(
            part, F.col("l_partkey") == F.col("p_partkey")
        )

    pair = ["l_orderkey", "l_linenumber"]
    numbered = numbered_lines(lines, [*TIE_COLUMNS, "l_returnflag"])
    swapped = Window.partitionBy(*pair)
    marked = numbered.withColumn("swapped", F.max("swapped").over(swapped))
    most = keep(joined(marked).select(*LINE_COLUMNS, "swapped"))
    again = most.filter("swapped").select(*[F.col(c).alias(f"_{c}") for c in pair]).distinct()
    if again.isEmpty():
        return most.select(*LINE_COLUMNS)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair])
    rest = joined(numbered_lines(lines.join(again, same, "left_semi"))).select(*LINE_COLUMNS)
    return most.filter("not swapped").select(*LINE_COLUMNS).unionByName(keep(rest))


def _placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer."""
    buyers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_name").alias("customer_name"),
        "c_mktsegment",
        _tier().alias("tier"),
        F.col("c_nationkey").cast("bigint").alias("site_id"),
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    )


def ticket_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("place") * PLACE_STEP


def base_tickets(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """Typed ticket columns plus the working columns that history and scores derive from.

    A projection of the joined lines: whoever reads few columns works out few. Columns that
    ``lines`` has besides its own (the backlog) are handed on.
    """
    snap = F.expr(f"timestamp_ntz'{SNAPSHOT:%Y-%m-%d %H:%M:%S}'")
    site = sites.select("site_id", "site_name", "city", "province", "region", "timezone")
    raw = lines.join(site, "site_id")
    extra = [c for c in lines.columns if c not in (*LINE_COLUMNS, "creation_date")]
    severity = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "major")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "minor")
        .otherwise("low")
    )
    offset = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 86400
    slow = F.when((F.col("l_orderkey") + F.col("l_partkey")) % 53 == 0, 3_000_000).otherwise(0)
    u = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey")) % 30
    timed = raw.withColumns(
        {
            "id": ticket_id(),
            "severity": severity,
            # A stored instant lets time filters skip row groups.
            "creation_date": F.col("creation_date")
            if "creation_date" in lines.columns
            else plus_seconds("o_orderdate", offset),
            "u": u,
            "work": u * u * 300 + 60 + slow,
            "drops": (F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 67 == 0,
        }
    )
    ended = timed.withColumns(
        {
            "end_ts": plus_seconds("creation_date", F.col("work")),
            "target_hours": _target_hours(),
            "reopens": (F.col("id") % 25 == 0) & ~F.col("drops"),
        }
    )
    rank = F.element_at(_severity_rank(), F.col("severity"))
    priority = (
        F.when((F.col("tier") == "platinum") & (F.col("l_suppkey") % 2 == 0), rank - 1)
        .when((F.col("tier") == "bronze") & (F.col("l_suppkey") % 10 < 3), rank + 1)
        .otherwise(rank)
    )
    done = ~F.col("drops") & (F.col("end_ts") < snap)
    cancelled = F.col("drops") & (F.col("end_ts") < snap)
    reopen_at = plus_seconds("creation_date", idiv(F.col("work") * 4, 5))
    expected = plus_seconds("creation_date", F.col("target_hours") * 3600)
    asked = (F.col("l_orderkey") + F.col("l_linenumber")) % 10 < 3
    channels = F.array(*[F.lit(c) for c in C.CHANNELS])
    return ended.select(
        "id",
        F.concat(F.lit("Ticket "), F.col("id")).alias("name"),
        F.concat(F.lit("Problem with "), F.col("p_name")).alias("description"),
        F.when(F.col("l_returnflag") == "A", "incident")
        .when(F.col("l_returnflag") == "N", "service_request")
        .otherwise("query")
        .alias("ticket_type"),
        "severity",
        F.least(F.greatest(priority, F.lit(1)), F.lit(4)).alias("priority"),
        F.when(cancelled, "cancelled")
        .when(done, "closed")
        .otherwise("in_progress")
        .alias("status"),
        F.element_at(channels, (F.col("l_suppkey") % 6).cast("int") + 1).alias("channel"),
        "creation_date",
        F.least(F.col("end_ts"), snap).alias("last_update"),
        expected.alias("expected_resolution_date"),
        F.when(asked, plus_seconds(expected, (F.col("l_partkey") % 48) * 3600)).alias(
            "requested_resolution_date"
        ),
        F.when(done, F.col("end_ts")).alias("resolution_date"),
        F.col("o_custkey").alias("customer_id"),
        "site_id",
        F.col("l_partkey").alias("service_id"),
        _group("p_type", "region").alias("assignment_group"),
        F.when(F.col("reopens") & (reopen_at < snap), 1).otherwise(0).alias("reopen_count"),
        "customer_name",
        F.lower("c_mktsegment").alias("industry"),
        "tier",
        "site_name",
        "city",
        "province",
        "region",
        "timezone",
        F.col("p_type").alias("service_type"),
        "work",
        "drops",
        "reopens",
        F.when(F.col("reopens"), idiv(F.col("work") * 3, 5))
        .otherwise(F.col("work"))
        .alias("first_work"),
        ((F.col("l_orderkey") * 37 + F.col("l_partkey") * 11 + F.col("u") * 900) % SCORE_MODULUS)
        .alias("score_units"),
        *extra,
    )


def _severity_rank() -> Column:
    return F.create_map(*[F.lit(x) for i, s in enumerate(C.SEVERITIES) for x in (s, i + 1)])


def _target_hours() -> Column:
    out = None
    for tier, by in C.SLA_TARGET_HOURS.items():
        for sev, hours in by.items():
            test = (F.col("tier") == tier) & (F.col("severity") == sev)
            out = F.when(test, hours) if out is None else out.when(test, hours)
    return out


def timeline() -> Column:
    """A base ticket's status changes before the snapshot in time order, equal times by step.

    An array of (change_date, step, status, change_reason); a ticket has nine changes at most.
    """
    snap = F.expr(f"timestamp_ntz'{SNAPSHOT:%Y-%m-%d %H:%M:%S}'")
    live, waits, again = ~F.col("drops"), F.col("id") % 7 == 0, F.col("reopens")
    work = F.col("work")
    steps = [
        (F.lit(True), "acknowledged", F.lit(0).cast("bigint"), "ticket_created"),
        (live, "in_progress", idiv(work, 10), "assigned_to_group"),
        (live & waits, "pending", idiv(work, 4), "waiting_on_customer"),
        (live & waits, "in_progress", idiv(work, 2), "customer_responded"),
        (live, "resolved", F.col("first_work"), "fix_confirmed"),
        (again, "in_progress", idiv(work * 4, 5), "customer_reopened"),
        (again, "resolved", work, "fix_confirmed"),
        (live, "closed", work + 48 * 3600, "auto_close_after_resolution"),
        (F.col("drops"), "cancelled", work, "cancelled_by_customer"),
    ]
    entries = [
        F.when(
            cond,
            F.struct(
                plus_seconds("creation_date", secs).alias("change_date"),
                F.lit(i).alias("step"),
                F.lit(status).alias("status"),
                F.lit(reason).alias("change_reason"),
            ),
        )
        for i, (cond, status, secs, reason) in enumerate(steps, start=1)
    ]
    before = F.filter(F.array_compact(F.array(*entries)), lambda e: e["change_date"] < snap)
    return F.sort_array(before)


def raw_history(base: DataFrame) -> DataFrame:
    """Status changes before the snapshot: ticket_id, status, change_date, change_reason, step."""
    rows = base.select(F.col("id").alias("ticket_id"), F.explode(timeline()).alias("e"))
    return rows.select("ticket_id", "e.step", "e.status", "e.change_date", "e.change_reason")

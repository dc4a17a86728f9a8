"""Shared common table expressions: the ticket tables, stated in plain SQL."""

from __future__ import annotations

from ticketlens import constants as C
from ticketlens.sources.testdata import OUTAGES, ZONES

SNAP = "TIMESTAMP '2001-08-02 00:00:00'"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def rnd(num: str, den: str, d: int) -> str:
    """num / den rounded half up to d decimals, NULL when den is 0."""
    top = f"2 * {10**d} * CAST({num} AS HUGEINT) + ({den})"
    return f"(CAST(({top}) // NULLIF(2 * CAST({den} AS HUGEINT), 0) AS DOUBLE) / {10**d})"


def pct(part: str, whole: str, d: int = 2) -> str:
    return rnd(f"100 * ({part})", whole, d)


def compliance(bad: str, known: str) -> str:
    return pct(f"({known}) - ({bad})", known, 2)


def p50(x: str, unit: int, d: int, where: str = "") -> str:
    return rnd(f"CAST(2 * quantile_cont({x}, 0.5){where} AS BIGINT)", str(2 * unit), d)


def p90(x: str, unit: int, d: int, where: str = "") -> str:
    return rnd(f"CAST(round(10 * quantile_cont({x}, 0.9){where}) AS BIGINT)", str(10 * unit), d)


TARGET = "CASE " + " ".join(
    f"WHEN tier = '{t}' AND severity = '{s}' THEN {h}"
    for t, by in C.SLA_TARGET_HOURS.items()
    for s, h in by.items()
) + " END"

TIER = (
    "CASE WHEN c_acctbal >= 7500 THEN 'platinum' WHEN c_acctbal >= 5000 THEN 'gold' "
    "WHEN c_acctbal >= 2500 THEN 'silver' ELSE 'bronze' END"
)


def group_of(kind: str, region: str) -> str:
    return (
        f"CASE WHEN {kind} IN ('STANDARD', 'SMALL', 'MEDIUM') "
        f"THEN 'field_' || replace(lower({region}), ' ', '_') ELSE lower({kind}) || '_ops' END"
    )


CITY = lst([c for c, *_ in C.CITY_CENTROIDS[:24]] + ["Iqaluit"])
PROV = lst([p for _, p, *_ in C.CITY_CENTROIDS[:24]] + ["NU"])
HQ = lst([p for _, p, *_ in C.CITY_CENTROIDS])

CTES = {
    "dim_customer": f"""
        SELECT c_custkey AS customer_id, c_name AS customer_name, lower(c_mktsegment) AS industry,
               {TIER} AS tier, ({HQ})[CAST(c_nationkey AS INTEGER) + 1] AS hq_province
        FROM customer""",
    "dim_site": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS site_id,
               (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS customer_id,
               n_name AS site_name, ({CITY})[CAST(n_nationkey AS INTEGER) + 1] AS city,
               ({PROV})[CAST(n_nationkey AS INTEGER) + 1] AS province, r_name AS region,
               ({lst(ZONES)})[CAST(n_nationkey AS INTEGER) % 5 + 1] AS timezone
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "dim_service": f"""
        SELECT p_partkey AS service_id, s.site_id, s.customer_id, p_type AS service_type,
               CAST(CASE WHEN p_size % 7 > 0 THEN p_size * 10 END AS INTEGER) AS bandwidth_mbps,
               {group_of('p_type', 's.region')} AS assignment_group
        FROM part JOIN dim_site s ON s.site_id = p_partkey % 25""",
    "sla_target": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{t}', '{s}', {h})" for t, by in C.SLA_TARGET_HOURS.items() for s, h in by.items()
    )
    + ") v(tier, severity, target_hours)",
    "outage_incident": "SELECT outage_id, region, service_type, "
    "CAST(s AS TIMESTAMP) + INTERVAL 9 HOUR AS start_ts, "
    "CAST(e AS TIMESTAMP) + INTERVAL 9 HOUR AS end_ts, cause FROM (VALUES "
    + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in OUTAGES)
    + ") v(outage_id, region, service_type, s, e, cause)",
    "lines": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
               row_number() OVER (
                   PARTITION BY l_orderkey, l_linenumber
                   ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                            l_returnflag, l_linestatus, l_shipdate) - 1 AS place
        FROM lineitem""",
    "base0": f"""
        SELECT l_orderkey * 10 + l_linenumber + place * 10000000000000 AS ticket_id, l_orderkey, l_linenumber, l_partkey,
               l_suppkey, l_returnflag, p_name, o_custkey AS customer_id, c_name AS customer_name,
               lower(c_mktsegment) AS industry, {TIER} AS tier,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'major'
                    WHEN '3-MEDIUM' THEN 'minor' ELSE 'low' END AS severity,
               si.site_id, si.site_name, si.city, si.province, si.region, si.timezone,
               p_type AS service_type,
               o_orderdate + to_seconds((l_orderkey * 7919 + l_linenumber * 104729) % 86400)
                   AS creation_ts,
               (l_orderkey * 7 + l_partkey * 13 + l_suppkey) % 30 AS u,
               (l_orderkey * 31 + l_linenumber) % 67 = 0 AS drops
        FROM lines
        JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN part ON l_partkey = p_partkey
        JOIN dim_site si ON si.site_id = c_nationkey""",
    "base1": f"""
        SELECT *, {TARGET} AS target,
               u * u * 300 + 60
                 + CASE WHEN (l_orderkey + l_partkey) % 53 = 0 THEN 3000000 ELSE 0 END AS work,
               ticket_id % 25 = 0 AND NOT drops AS reopens
        FROM base0""",
    "base": f"""
        SELECT *, creation_ts + to_seconds(work) AS end_ts,
               CASE WHEN reopens THEN work * 3 // 5 ELSE work END AS first_work,
               creation_ts + to_seconds(target * 3600) AS expected_resolution_ts,
               NOT drops AND creation_ts + to_seconds(work) < {SNAP} AS done,
               drops AND creation_ts + to_seconds(work) < {SNAP} AS gone
        FROM base1""",
    "backlog_events": """
        SELECT ticket_id, assignment_group, ev_ts, kind,
               sum(d) OVER (PARTITION BY assignment_group ORDER BY ev_ts, kind, ticket_id) AS level
        FROM (SELECT ticket_id, {g} AS assignment_group, creation_ts AS ev_ts, 1 AS kind, 1 AS d
              FROM base
              UNION ALL
              SELECT ticket_id, {g}, creation_ts + to_seconds(first_work), 0, -1 FROM base)
        """.replace("{g}", group_of("service_type", "region")),
    "fact": f"""
        SELECT b.ticket_id, 'Ticket ' || b.ticket_id AS name,
               'Problem with ' || p_name AS description,
               CASE l_returnflag WHEN 'A' THEN 'incident' WHEN 'N' THEN 'service_request'
                    ELSE 'query' END AS ticket_type,
               severity,
               CAST(CASE WHEN tier = 'platinum' AND l_suppkey % 2 = 0 THEN greatest(rk - 1, 1)
                    WHEN tier = 'bronze' AND l_suppkey % 10 < 3 THEN least(rk + 1, 4)
                    ELSE rk END AS INTEGER) AS priority,
               CASE WHEN gone THEN 'cancelled' WHEN done THEN 'closed' ELSE 'in_progress' END
                   AS status,
               ({lst(C.CHANNELS)})[CAST(l_suppkey % 6 AS INTEGER) + 1] AS channel,
               creation_ts, least(end_ts, {SNAP}) AS last_update_ts, expected_resolution_ts,
               CASE WHEN (l_orderkey + l_linenumber) % 10 < 3
                    THEN expected_resolution_ts + to_seconds((l_partkey % 48) * 3600) END
                   AS requested_resolution_ts,
               CASE WHEN done THEN end_ts END AS resolution_ts,
               b.customer_id, b.site_id, l_partkey AS service_id,
               {group_of('service_type', 'region')} AS assignment_group,
               (SELECT max(o.outage_id) FROM outage_incident o
                WHERE o.region = b.region AND o.service_type = b.service_type
                  AND b.creation_ts >= o.start_ts AND b.creation_ts < o.end_ts)
                   AS active_outage_id,
               CAST(ev.level - 1 AS INTEGER) AS open_backlog_at_creation,
               target AS sla_target_hours,
               CAST(extract(hour FROM loc) AS INTEGER) AS creation_hour_local,
               CAST(extract(isodow FROM loc) - 1 AS INTEGER) AS creation_dow_local,
               extract(isodow FROM loc) >= 6 AS is_weekend,
               extract(hour FROM loc) < 8 OR extract(hour FROM loc) >= 18 AS is_after_hours,
               CAST(CASE WHEN reopens AND creation_ts + to_seconds(work * 4 // 5) < {SNAP}
                    THEN 1 ELSE 0 END AS INTEGER) AS reopen_count,
               CASE WHEN done THEN (50 * work + 9) // 18 END AS h4,
               done AS is_resolved,
               CASE WHEN gone THEN NULL
                    WHEN done THEN (50 * work + 9) // 18 > target * 10000
                    WHEN {SNAP} > expected_resolution_ts THEN true END AS sla_breached,
               customer_name, tier, industry, site_name, city, province, region, service_type,
               (l_orderkey + l_linenumber) % 10 < 3 AS has_requested_resolution_date,
               CAST(date_trunc('month', creation_ts) AS DATE) AS creation_month,
               CASE WHEN done OR gone THEN end_ts END AS closed_ts,
               (l_orderkey * 37 + l_partkey * 11 + u * 900) % 1000003 AS score_units,
               done AND NOT gone AS labelled,
               CASE WHEN NOT (done AND NOT gone) THEN 'unlabelled'
                    WHEN creation_ts < TIMESTAMP '2000-01-01' THEN 'train'
                    WHEN creation_ts < TIMESTAMP '2001-01-01' THEN 'validation'
                    ELSE 'test' END AS split
        FROM (SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2
                        WHEN 'minor' THEN 3 ELSE 4 END AS rk,
                     timezone(timezone, timezone('UTC', creation_ts)) AS loc
              FROM base) b
        JOIN backlog_events ev ON ev.ticket_id = b.ticket_id AND ev.kind = 1""",
    "cuts": """
        SELECT quantile_cont(score_units / 1000003.0::DOUBLE, 0.7) AS medium,
               quantile_cont(score_units / 1000003.0::DOUBLE, 0.9) AS high
        FROM fact WHERE split = 'validation'""",
    "tickets": """
        SELECT f.*, (2000000 * score_units + 1000003) // 2000006 AS p6,
               CAST((2000000 * score_units + 1000003) // 2000006 AS DOUBLE) / 1000000
                   AS probability,
               CASE WHEN score_units / 1000003.0::DOUBLE >= high THEN 'high'
                    WHEN score_units / 1000003.0::DOUBLE >= medium THEN 'medium'
                    ELSE 'low' END AS risk_band,
               'pseudo-1' AS model_version
        FROM fact f CROSS JOIN cuts""",
    "history": f"""
        SELECT ticket_id, step, status, change_ts, change_reason,
               row_number() OVER (PARTITION BY ticket_id ORDER BY change_ts, step) AS sequence_no
        FROM (
            SELECT ticket_id, 1 AS step, 'acknowledged' AS status, creation_ts AS change_ts,
                   'ticket_created' AS change_reason FROM base
            UNION ALL SELECT ticket_id, 2, 'in_progress', creation_ts + to_seconds(work // 10),
                   'assigned_to_group' FROM base WHERE NOT drops
            UNION ALL SELECT ticket_id, 3, 'pending', creation_ts + to_seconds(work // 4),
                   'waiting_on_customer' FROM base WHERE NOT drops AND ticket_id % 7 = 0
            UNION ALL SELECT ticket_id, 4, 'in_progress', creation_ts + to_seconds(work // 2),
                   'customer_responded' FROM base WHERE NOT drops AND ticket_id % 7 = 0
            UNION ALL SELECT ticket_id, 5, 'resolved', creation_ts + to_seconds(first_work),
                   'fix_confirmed' FROM base WHERE NOT drops
            UNION ALL SELECT ticket_id, 6, 'in_progress',
                   creation_ts + to_seconds(work * 4 // 5), 'customer_reopened'
                   FROM base WHERE reopens
            UNION ALL SELECT ticket_id, 7, 'resolved', end_ts, 'fix_confirmed'
                   FROM base WHERE reopens
            UNION ALL SELECT ticket_id, 8, 'closed', end_ts + to_seconds(172800),
                   'auto_close_after_resolution' FROM base WHERE NOT drops
            UNION ALL SELECT ticket_id, 9, 'cancelled', end_ts, 'cancelled_by_customer'
                   FROM base WHERE drops)
        WHERE change_ts < {SNAP}""",
    "months": f"""
        SELECT unnest(generate_series(
            (SELECT date_trunc('month', min(creation_ts)) + INTERVAL 1 MONTH FROM base)::TIMESTAMP,
            {SNAP}, INTERVAL 1 MONTH)) AS as_of""",
    "weeks": f"""
        SELECT CAST(ws AS DATE) AS week_start,
               CAST(ws + INTERVAL 6 DAY AS DATE) AS week_ending,
               ws + INTERVAL 7 DAY AS backlog_as_of
        FROM (SELECT unnest(generate_series(
            (SELECT date_trunc('week', min(creation_ts)) FROM base)::TIMESTAMP,
            {SNAP} - INTERVAL 7 DAY, INTERVAL 7 DAY)) AS ws)""",
}

NEEDS = {
    "dim_service": ["dim_site"],
    "base0": ["lines", "dim_site"],
    "base1": ["base0"],
    "base": ["base1"],
    "backlog_events": ["base"],
    "fact": ["base", "backlog_events", "outage_incident"],
    "cuts": ["fact"],
    "tickets": ["fact", "cuts"],
    "history": ["base"],
    "months": ["base"],
    "weeks": ["base"],
}


def with_ctes(sql: str, names: list[str], extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the named CTEs, their needs first, then ``extra`` in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({body})" for n, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + sql


BAND = (
    "CASE WHEN {a} < 86400 THEN '0-24h' WHEN {a} < 259200 THEN '1-3d' "
    "WHEN {a} < 604800 THEN '3-7d' WHEN {a} < 2592000 THEN '7-30d' ELSE '30d+' END"
)
BAND_NO = (
    "CAST(CASE WHEN {a} < 86400 THEN 1 WHEN {a} < 259200 THEN 2 WHEN {a} < 604800 THEN 3 "
    "WHEN {a} < 2592000 THEN 4 ELSE 5 END AS INTEGER)"
)


def open_at(instants: str) -> str:
    """Theta join of tickets with a relation of instants (column as_of)."""
    return f"""
        SELECT *, {BAND.format(a='age')} AS age_bucket, {BAND_NO.format(a='age')} AS bucket_order
        FROM (SELECT m.as_of, t.*,
                     CAST(epoch(m.as_of) - epoch(t.creation_ts) AS BIGINT) AS age,
                     m.as_of > t.expected_resolution_ts AS past_due
              FROM {instants} m JOIN tickets t
                ON t.creation_ts <= m.as_of AND (t.closed_ts IS NULL OR t.closed_ts > m.as_of))"""

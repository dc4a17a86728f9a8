"""SQL of the report, extract, dashboard, score-metric and findings queries."""

from __future__ import annotations

from checks import views_sql as v
from checks.base_sql import SNAP, compliance, open_at, p50, p90, pct, rnd, with_ctes
from checks.tables_sql import CENTROIDS, OUTCOME, PROVINCE, humanise, labelled
from ticketlens import constants as C

WEEK = "DATE '2000-06-04'"
END = "TIMESTAMP '2000-06-05 00:00:00'"
OPEN_NOW = {"o": open_at(f"(SELECT {END} AS as_of)")}
SERVICE_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

KPI_VALUES = [
    ("Tickets opened", "tickets_opened", "-", 1),
    ("Tickets resolved", "tickets_resolved", "higher", 1),
    ("SLA compliance", "1 - CAST(breached_tickets AS DOUBLE) / nullif(tickets_resolved, 0)",
     "higher", 100),
    ("SLA breaches", "breached_tickets", "lower", 1),
    ("MTTR - mean resolution (h)", "mttr_hours", "lower", 1),
    ("Resolution time p50 (h)", "p50_resolution_hours", "lower", 1),
    ("Resolution time p90 (h)", "p90_resolution_hours", "lower", 1),
    ("Open backlog at week end", "open_backlog", "lower", 1),
    ("Backlog aged over the SLA (past due)", "backlog_past_due", "lower", 1),
    ("High-risk open tickets (model)", "high_risk_open", "lower", 1),
]

WEEKLY_ALL = {**v.WEEKLY_CTES, "wk": v.WEEKLY}


def kpi_summary() -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS kpi_order, '{n}' AS kpi, week_ending, CAST({x} AS DOUBLE) AS val, "
        f"'{b}' AS better_when, CAST({s} AS DOUBLE) AS sc FROM wk"
        for i, (n, x, b, s) in enumerate(KPI_VALUES, start=1)
    )
    body = f"""
    SELECT kpi_order, kpi, round(cur, 4) AS this_week, round(prev, 4) AS prior_week,
           round((cur - prev) * sc, 4) AS change_vs_prior, round(mean, 4) AS trailing_mean,
           round((cur - mean) * sc, 4) AS change_vs_mean, better_when
    FROM (SELECT kpi_order, kpi, better_when, sc,
                 max(val) FILTER (WHERE week_ending = {WEEK}) AS cur,
                 max(val) FILTER (WHERE week_ending = {WEEK} - 7) AS prev,
                 avg(val) FILTER (WHERE week_ending BETWEEN {WEEK} - 28 AND {WEEK} - 7) AS mean
          FROM ({parts}) GROUP BY ALL)"""
    return with_ctes(body, ["tickets", "weeks"], WEEKLY_ALL)


OPEN_AGG = """
    SELECT {k}, count(*) AS open_backlog, count(*) FILTER (WHERE past_due) AS backlog_past_due,
           count(*) FILTER (WHERE risk_band = 'high') AS high_risk_open
    FROM o GROUP BY {k}"""


def sheet(key: str, ctes: dict[str, str], weekly: str) -> tuple[str, dict[str, str]]:
    body = f"""
    SELECT cur.*, prev.sla_compliance_pct AS prior_week_compliance_pct,
           coalesce(a.open_backlog, 0) AS open_backlog,
           coalesce(a.backlog_past_due, 0) AS backlog_past_due,
           coalesce(a.high_risk_open, 0) AS high_risk_open
    FROM wk cur
    LEFT JOIN wk prev ON prev.{key} = cur.{key} AND prev.week_ending = {WEEK} - 7
    LEFT JOIN agg a ON a.{key} = cur.{key}
    WHERE cur.week_ending = {WEEK}"""
    return body, {**ctes, "wk": weekly, **OPEN_NOW, "agg": OPEN_AGG.format(k=key)}


def matrix(key: str) -> str:
    bands = ", ".join(
        f"count(*) FILTER (WHERE age_bucket = '{b}') AS \"{b}\"" for b in C.AGE_BANDS
    )
    cents = "CAST((200 * age + 3600) // 7200 AS BIGINT)"
    cols = f"""{bands}, count(*) AS total_open, count(*) FILTER (WHERE past_due) AS past_due,
           count(*) FILTER (WHERE {v.URGENT}) AS critical_or_major,
           count(*) FILTER (WHERE risk_band = 'high') AS high_risk,
           {p50(cents, 100, 1)} AS median_age_hours"""
    body = f"""SELECT {key}, {cols} FROM o GROUP BY {key}
        UNION ALL SELECT NULL, {cols} FROM o"""
    return with_ctes(body, ["tickets"], OPEN_NOW)


STAMP = "coalesce(strftime({0}, '%Y-%m-%d %H:%M:%S'), '')"
DAY = "strftime({0}, '%Y-%m-%d')"
SERVICE = labelled("service_type", C.SERVICE_LABELS)
GROUP = labelled("assignment_group", C.GROUP_LABELS)
CHANNEL = labelled("channel", C.CHANNEL_LABELS)


def simple(code: str, mapping: dict[str, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in mapping.items()) + " END"


CENTS = "CAST((h4 + 50) // 100 AS BIGINT)"

FACT_EXTRACT = f"""
    SELECT ticket_id AS "Ticket ID", {STAMP.format('creation_ts')} AS "Created At (UTC)",
           customer_id AS "Customer ID", customer_name AS "Customer",
           {humanise('industry')} AS "Industry", site_id AS "Site ID", site_name AS "Site",
           t.city AS "City", t.province AS "Province",
           {PROVINCE.format('t.province')} AS "Province Name", latitude AS "Latitude",
           longitude AS "Longitude", service_id AS "Service ID", {humanise('tier')} AS "Tier",
           {humanise('region')} AS "Region", {SERVICE} AS "Service Type",
           {GROUP} AS "Assignment Group", {humanise('severity')} AS "Severity",
           {humanise('ticket_type')} AS "Ticket Type", {CHANNEL} AS "Channel",
           {humanise('status')} AS "Status",
           CASE WHEN active_outage_id IS NULL THEN 'No' ELSE 'Yes' END AS "During Outage",
           coalesce(active_outage_id, '') AS "Outage ID",
           CAST(sla_target_hours AS DOUBLE) AS "SLA Target Hours",
           {STAMP.format('resolution_ts')} AS "Resolved At (UTC)",
           CAST({CENTS} AS DOUBLE) / 100 AS "Resolution Hours",
           CAST(is_resolved AS INTEGER) AS "Is Resolved", {OUTCOME} AS "SLA Outcome",
           CAST(sla_breached IS NOT NULL AS INTEGER) AS "Has Outcome",
           CAST(coalesce(sla_breached, false) AS INTEGER) AS "Is Breached",
           probability AS "Breach Probability", {simple('risk_band', C.RISK_LABELS)} AS "Risk Band",
           {simple('split', C.SPLIT_LABELS)} AS "Model Split"
    FROM tickets t LEFT JOIN centroids c ON c.city = t.city AND c.province = t.province"""

MONTHLY_EXTRACT = f"""
    SELECT {DAY.format('month')} AS "Month", customer_id AS "Customer ID",
           customer_name AS "Customer", {humanise('tier')} AS "Tier",
           {humanise('industry')} AS "Industry", {SERVICE} AS "Service Type",
           tickets AS "Tickets", resolved_tickets AS "Resolved Tickets",
           tickets_with_outcome AS "Tickets With Outcome", breached_tickets AS "Breached Tickets",
           sla_compliance_pct AS "SLA Compliance Pct",
           p50_resolution_hours AS "P50 Resolution Hours",
           avg_target_utilisation AS "Avg Target Utilisation"
    FROM cm"""

GRID = """
    SELECT d.as_of, k.service_type, b.age_bucket, b.bucket_order,
           coalesce(c.open_tickets, 0) AS open_tickets,
           coalesce(c.past_due_tickets, 0) AS past_due_tickets,
           coalesce(c.critical_or_major, 0) AS critical_or_major,
           coalesce(c.high_risk_tickets, 0) AS high_risk_tickets
    FROM (SELECT DISTINCT as_of FROM bs) d CROSS JOIN (SELECT DISTINCT service_type FROM bs) k
    CROSS JOIN (VALUES ('0-24h', 1), ('1-3d', 2), ('3-7d', 3), ('7-30d', 4), ('30d+', 5))
        b(age_bucket, bucket_order)
    LEFT JOIN bs c ON c.as_of = d.as_of AND c.service_type = k.service_type
        AND c.age_bucket = b.age_bucket"""
GRID_CTES = {"o": open_at("months"), "bs": v.BY_SERVICE_BACKLOG, "grid": GRID}

DECILES = f"""
    SELECT CAST(least(9, 10 * (rn - 1) // n) AS INTEGER) + 1 AS "Decile",
           {rnd('min(p6)', '1000000', 4)} AS "Probability From",
           {rnd('max(p6)', '1000000', 4)} AS "Probability To",
           {rnd('sum(p6)', 'count(*) * 1000000', 4)} AS "Mean Predicted", count(*) AS "Tickets",
           count(*) FILTER (WHERE sla_breached) AS "Breached",
           {rnd('count(*) FILTER (WHERE sla_breached)', 'count(*)', 4)} AS "Observed Breach Rate",
           'Test' AS "Model Split"
    FROM (SELECT *, row_number() OVER (ORDER BY p6, ticket_id) AS rn, count(*) OVER () AS n
          FROM tickets WHERE split = 'test' AND sla_breached IS NOT NULL)
    GROUP BY 1"""

MEASURES = f"""
    count(DISTINCT ticket_id) AS tickets,
    {compliance('count(*) FILTER (WHERE sla_breached)', 'count(sla_breached)')} AS compliance_pct,
    {pct('count(*) FILTER (WHERE sla_breached)', 'count(sla_breached)')} AS breach_rate_pct,
    count(*) FILTER (WHERE sla_breached) AS breaches,
    count(*) FILTER (WHERE status <> 'cancelled' AND NOT is_resolved) AS open_tickets,
    count(*) FILTER (WHERE is_resolved) AS resolved_tickets,
    {p50(CENTS, 100, 3)} AS median_resolution_hours,
    {p90(CENTS, 100, 3)} AS p90_resolution_hours,
    count(*) FILTER (WHERE risk_band = 'high') AS high_risk_tickets,
    count(active_outage_id) AS outage_tickets"""

HEATMAP = (
    "SELECT customer_id, customer_name, "
    + ", ".join(
        compliance(
            f"count(*) FILTER (WHERE sla_breached AND service_type = '{s}')",
            f"count(sla_breached) FILTER (WHERE service_type = '{s}')",
        )
        + f" AS {s.lower()}"
        for s in SERVICE_TYPES
    )
    + f", {compliance('count(*) FILTER (WHERE sla_breached)', 'count(sla_breached)')} "
    "AS compliance_pct FROM fact WHERE status <> 'cancelled' GROUP BY ALL"
)

# --- metrics ---------------------------------------------------------------------------

SCORED = """
    SELECT ticket_id, tier, service_type, CAST(sla_breached AS INTEGER) AS y, probability AS p,
           split FROM tickets WHERE split IN ('train', 'test')"""
TEST = "SELECT * FROM scored WHERE split = 'test'"


def ranking(by: str = "", src: str = "test") -> str:
    """Metrics from counts per distinct probability."""
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
    SELECT {k} n, positives,
           CASE WHEN positives > 0 AND positives < n
                THEN round(auc / (positives * (n - positives)), 6) END AS roc_auc,
           CASE WHEN positives > 0 AND positives < n THEN round(ap / positives, 6) END AS pr_auc,
           round(sq / n, 6) AS brier, round(ll / n, 6) AS log_loss
    FROM (SELECT {k} CAST(sum(a) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS positives,
                 sum((a - s) * (cs - s + s / 2.0::DOUBLE)) AS auc,
                 sum(s * (cs / ca::DOUBLE)) AS ap,
                 sum(s * (1 - p) * (1 - p) + (a - s) * p * p) AS sq,
                 sum(-s * ln(least(greatest(p, 1e-6), 1 - 1e-6))
                     - (a - s) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS ll
          FROM (SELECT *, sum(s) OVER ({part} ORDER BY p DESC) AS cs,
                       sum(a) OVER ({part} ORDER BY p DESC) AS ca
                FROM (SELECT {k} CAST(p AS DOUBLE) AS p, CAST(sum(y) AS DOUBLE) AS s,
                             CAST(count(*) AS DOUBLE) AS a
                      FROM {src} GROUP BY ALL))
          {'GROUP BY ' + by if by else ''})"""


def point(name: str, cut: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    return f"""
    SELECT {k} count(*) AS n, '{name}' AS operating_point, round({cut}, 6) AS threshold,
           count(*) FILTER (WHERE p >= {cut}) AS flagged,
           round(count(*) FILTER (WHERE p >= {cut}) / count(*)::DOUBLE, 6) AS flagged_share,
           count(*) FILTER (WHERE p >= {cut} AND y = 1) AS true_positives,
           round(coalesce(count(*) FILTER (WHERE p >= {cut} AND y = 1)
               / nullif(count(*) FILTER (WHERE p >= {cut}), 0)::DOUBLE, 0), 6) AS precision,
           round(coalesce(count(*) FILTER (WHERE p >= {cut} AND y = 1)
               / nullif(sum(y), 0)::DOUBLE, 0), 6) AS recall,
           round(coalesce(count(*) FILTER (WHERE p >= {cut} AND y = 1)
               / nullif(count(*) FILTER (WHERE p >= {cut}), 0)::DOUBLE
               / nullif(avg(y), 0), 0), 6) AS lift_vs_prevalence
    FROM test, edges {'GROUP BY ' + by if by else ''}"""


EDGES = """
    SELECT round(high, 6) AS review, 0.5::DOUBLE AS half,
           (SELECT quantile_cont(p, 0.95) FROM test) AS q05,
           (SELECT quantile_cont(p, 0.90) FROM test) AS q10,
           (SELECT quantile_cont(p, 0.80) FROM test) AS q20,
           (SELECT quantile_cont(p, 0.70) FROM test) AS q30
    FROM cuts"""
RELIABILITY = """
    SELECT CAST(b AS INTEGER) AS bin, round(min(p), 6) AS bin_lo, round(max(p), 6) AS bin_hi,
           count(*) AS n, round(avg(p), 6) AS mean_predicted,
           round(avg(y), 6) AS observed_rate
    FROM (SELECT *, ntile(10) OVER (ORDER BY p, ticket_id) AS b FROM test) GROUP BY b"""
ECE = """
    SELECT round(sum(n * abs(mp - o)) / sum(n), 6) AS ece
    FROM (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS o
          FROM (SELECT *, ntile(10) OVER (ORDER BY p, ticket_id) AS b FROM test) GROUP BY b)"""


def segment(by: str) -> str:
    cut = "(SELECT review FROM edges)"
    return f"""
    SELECT r.{by}, r.n, round(r.positives / r.n::DOUBLE, 6) AS breach_rate, r.roc_auc, r.pr_auc,
           q.flagged_share, q.precision, q.recall
    FROM ({ranking(by)}) r JOIN ({point('review', cut, by)}) q USING ({by})"""


def grouped_rate(keys: str, where: str = "is_resolved") -> str:
    return f"""
    SELECT {keys}, count(*) AS tickets, count(*) FILTER (WHERE sla_breached) AS breached,
           {pct('count(*) FILTER (WHERE sla_breached)', 'count(*)')} AS breach_pct
    FROM fact WHERE {where} GROUP BY ALL"""


DIMENSIONS = " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, {x} AS level, h4, sla_breached FROM rf"
    for n, x in [
        *[(c, c) for c in ("assignment_group", "tier", "channel", "service_type", "ticket_type")],
        ("reopened", "CASE WHEN reopen_count > 0 THEN 'yes' ELSE 'no' END"),
        ("pending", "CASE WHEN waited THEN 'yes' ELSE 'no' END"),
    ]
)


def sql() -> dict[str, str]:
    weekly = ["tickets", "weeks"]
    customers = [*weekly, "dim_customer"]
    services = [*weekly, "dim_service"]
    csheet, cctes = sheet("customer_id", v.BY_CUSTOMER_CTES, v.BY_CUSTOMER)
    ssheet, sctes = sheet("service_type", v.BY_SERVICE_CTES, v.BY_SERVICE)
    mctes = {"scored": SCORED, "test": TEST, "edges": EDGES}

    def m(body: str) -> str:
        return with_ctes(body, ["tickets"], mctes)

    def t(body: str) -> str:
        return with_ctes(body, ["tickets"])

    one = "(SELECT {0} FROM edges)"
    impact = {**v.IMPACT_CTES, "im": v.IMPACT}
    return {
        "available_weeks": with_ctes("SELECT week_ending FROM weeks", ["weeks"]),
        "kpi_trend": with_ctes(
            f"SELECT * FROM wk WHERE week_ending <= {WEEK} ORDER BY week_ending DESC LIMIT 13",
            weekly,
            WEEKLY_ALL,
        ),
        "kpi_summary": kpi_summary(),
        "customer_week": with_ctes(csheet, customers, cctes),
        "service_week": with_ctes(ssheet, services, sctes),
        "open_by_customer": with_ctes(
            OPEN_AGG.format(k="customer_id"), ["tickets"], OPEN_NOW
        ),
        "customer_week_totals": with_ctes(
            f"""SELECT CAST(sum(tickets_opened) AS BIGINT) AS tickets_opened,
                CAST(sum(tickets_resolved) AS BIGINT) AS tickets_resolved,
                CAST(sum(breached_tickets) AS BIGINT) AS breached_tickets,
                CAST(sum(open_backlog) AS BIGINT) AS open_backlog,
                CAST(sum(backlog_past_due) AS BIGINT) AS backlog_past_due,
                CAST(sum(high_risk_open) AS BIGINT) AS high_risk_open,
                {compliance('sum(breached_tickets)', 'sum(tickets_resolved)')}
                    AS sla_compliance_pct
            FROM ({csheet})""",
            customers,
            cctes,
        ),
        "ageing_matrix_by_group": matrix("assignment_group"),
        "ageing_matrix_by_service": matrix("service_type"),
        "at_risk_top_n": with_ctes(
            f"""SELECT CAST(row_number() OVER (ORDER BY probability DESC, creation_ts, ticket_id)
                    AS INTEGER) AS rank, ticket_id, name, customer_name, tier, service_type,
                severity, assignment_group, creation_ts, {rnd('age', '3600', 1)} AS age_hours,
                CAST(sla_target_hours AS DOUBLE) AS sla_target_hours, expected_resolution_ts,
                CASE WHEN past_due THEN 'yes' ELSE 'no' END AS past_due, probability, risk_band
            FROM o ORDER BY rank LIMIT 50""",
            ["tickets"],
            OPEN_NOW,
        ),
        "report_provenance": t(
            f"SELECT CAST({SNAP} AS TIMESTAMP) AS snapshot_ts, min(model_version) AS "
            "model_version, 'testdata' AS source FROM tickets"
        ),
        "extract_fact_ticket": with_ctes(FACT_EXTRACT, ["tickets"], {"centroids": CENTROIDS}),
        "extract_monthly_compliance": with_ctes(
            MONTHLY_EXTRACT, ["fact"], {"cm": v.COMPLIANCE_MONTHLY}
        ),
        "extract_backlog_ageing": with_ctes(
            f"""SELECT {DAY.format('as_of')} AS "Snapshot Date", {SERVICE} AS "Service Type",
                age_bucket AS "Age Band", bucket_order AS "Age Band Order",
                open_tickets AS "Open Tickets", past_due_tickets AS "Past Due Tickets",
                critical_or_major AS "Critical Or Major", high_risk_tickets AS "High Risk Tickets"
            FROM grid""",
            ["tickets", "months"],
            GRID_CTES,
        ),
        "extract_risk_deciles": t(DECILES),
        "extract_weekly_kpi": with_ctes(
            f"""SELECT {DAY.format('week_start')} AS "Week Start",
                {DAY.format('week_ending')} AS "Week Ending", tickets_opened AS "Tickets Opened",
                tickets_resolved AS "Tickets Resolved", breached_tickets AS "Breached Tickets",
                sla_compliance_pct AS "SLA Compliance Pct", mttr_hours AS "MTTR Hours",
                p50_resolution_hours AS "P50 Resolution Hours",
                p90_resolution_hours AS "P90 Resolution Hours", open_backlog AS "Open Backlog",
                backlog_past_due AS "Backlog Past Due", high_risk_open AS "High Risk Open"
            FROM wk""",
            weekly,
            WEEKLY_ALL,
        ),
        "extract_dim_customer": with_ctes(
            f"""SELECT customer_id AS "Customer ID", customer_name AS "Customer",
                {humanise('industry')} AS "Industry", {humanise('tier')} AS "Tier",
                hq_province AS "HQ Province",
                {PROVINCE.format('hq_province')} AS "HQ Province Name" FROM dim_customer""",
            ["dim_customer"],
        ),
        "extract_dim_site": with_ctes(
            f"""SELECT site_id AS "Site ID", customer_id AS "Customer ID", site_name AS "Site",
                s.city AS "City", s.province AS "Province",
                {PROVINCE.format('s.province')} AS "Province Name",
                {humanise('region')} AS "Region", latitude AS "Latitude", longitude AS "Longitude"
            FROM dim_site s LEFT JOIN centroids c ON c.city = s.city AND c.province = s.province""",
            ["dim_site"],
            {"centroids": CENTROIDS},
        ),
        "extract_dim_service": with_ctes(
            f"""SELECT service_id AS "Service ID", site_id AS "Site ID",
                customer_id AS "Customer ID", {SERVICE} AS "Service Type",
                bandwidth_mbps AS "Bandwidth Mbps", {GROUP} AS "Assignment Group"
            FROM dim_service""",
            ["dim_service"],
        ),
        "extract_dim_outage": with_ctes(
            f"""SELECT outage_id AS "Outage ID", {humanise('cause')} AS "Cause",
                {humanise('region')} AS "Region", {SERVICE} AS "Service Type",
                {STAMP.format('start_ts')} AS "Start (UTC)",
                {STAMP.format('end_ts')} AS "End (UTC)", {DAY.format('start_ts')} AS "Start Date",
                duration_hours AS "Duration Hours", tickets_during AS "Tickets During",
                volume_multiplier AS "Volume Multiplier",
                breach_rate_during_pct AS "Breach Rate During Pct",
                breach_rate_baseline_pct AS "Breach Rate Baseline Pct" FROM im""",
            ["fact", "outage_incident"],
            impact,
        ),
        "dashboard_kpis": t(f"SELECT {MEASURES} FROM tickets"),
        "dashboard_kpis_filtered": t(
            f"SELECT {MEASURES} FROM tickets WHERE tier = 'gold' AND region = 'ASIA' AND "
            "creation_ts >= TIMESTAMP '1998-01-01' AND creation_ts < TIMESTAMP '2000-07-01'"
        ),
        "weekly_volume": t(
            "SELECT CAST(date_trunc('week', creation_ts) AS DATE) AS created_week, "
            "CASE WHEN active_outage_id IS NULL THEN 'No' ELSE 'Yes' END AS during_outage, "
            "count(*) AS tickets FROM tickets GROUP BY ALL"
        ),
        "compliance_heatmap": with_ctes(HEATMAP, ["fact"]),
        "backlog_area": with_ctes(
            f"""SELECT CAST(as_of AS DATE) AS snapshot_date, age_bucket, bucket_order,
                CAST(sum(open_tickets) AS BIGINT) AS open_tickets,
                {pct('sum(past_due_tickets)', 'sum(open_tickets)')} AS past_due_share_pct
            FROM grid GROUP BY ALL""",
            ["tickets", "months"],
            GRID_CTES,
        ),
        "calibration_gap": t(
            f"""SELECT "Decile", CAST(CAST(round("Observed Breach Rate" * 10000) AS BIGINT)
                - CAST(round("Mean Predicted" * 10000) AS BIGINT) AS DOUBLE) / 10000
                AS "Calibration Gap" FROM ({DECILES})"""
        ),
        "city_map": with_ctes(
            f"""SELECT t.city, {PROVINCE.format('t.province')} AS province_name, latitude,
                longitude, count(*) AS tickets,
                {pct('count(*) FILTER (WHERE sla_breached)', 'count(sla_breached)')}
                    AS breach_rate_pct,
                count(*) FILTER (WHERE risk_band = 'high') AS high_risk_tickets
            FROM tickets t LEFT JOIN centroids c ON c.city = t.city AND c.province = t.province
            GROUP BY t.city, t.province, latitude, longitude""",
            ["tickets"],
            {"centroids": CENTROIDS},
        ),
        "customer_drilldown": t(
            f"SELECT customer_id, customer_name, tier, {MEASURES} FROM tickets GROUP BY ALL"
        ),
        "probability_bins": t(
            """SELECT CAST(p6 * 10 // 1000000 + 1 AS INTEGER) AS probability_bin,
                count(*) AS tickets, count(sla_breached) AS with_outcome,
                count(*) FILTER (WHERE sla_breached) AS breached FROM tickets GROUP BY ALL"""
        ),
        "weekly_compliance": with_ctes(
            f"""SELECT week_ending, tickets_resolved, breached_tickets,
                {rnd('tickets_resolved - breached_tickets', 'tickets_resolved', 4)} AS compliance
            FROM wk""",
            weekly,
            WEEKLY_ALL,
        ),
        "training_rows": t(
            "SELECT ticket_id, CAST(sla_breached AS INTEGER) AS y, split FROM tickets "
            "WHERE is_resolved AND sla_breached IS NOT NULL"
        ),
        "split_summary": t(
            "SELECT split, count(*) AS rows, count(*) FILTER (WHERE sla_breached) AS breached, "
            "strftime(min(creation_ts), '%Y-%m') AS first_month, "
            "strftime(max(creation_ts), '%Y-%m') AS last_month, "
            "round(count(*) FILTER (WHERE sla_breached) / count(*)::DOUBLE, 6) AS breach_rate "
            "FROM tickets WHERE is_resolved AND sla_breached IS NOT NULL GROUP BY ALL"
        ),
        "score_thresholds": t(
            "SELECT 'medium' AS band, round(medium, 6) AS threshold FROM cuts "
            "UNION ALL SELECT 'high', round(high, 6) FROM cuts"
        ),
        "score_table": t(
            "SELECT ticket_id, model_version, probability, risk_band, split FROM tickets"
        ),
        "review_flags": t(
            "SELECT split, probability >= round(high, 6) AS flag_for_review, count(*) AS tickets "
            "FROM tickets CROSS JOIN cuts GROUP BY ALL"
        ),
        "ranking_metrics": m(ranking()),
        "threshold_metrics": m(
            point("review", one.format("review")) + " UNION ALL " + point("half", one.format("half"))
        ),
        "top_share_table": m(
            " UNION ALL ".join(
                point(f"top_{s}", one.format(q))
                for s, q in (("0.05", "q05"), ("0.1", "q10"), ("0.2", "q20"), ("0.3", "q30"))
            )
        ),
        "reliability_table": m(RELIABILITY),
        "calibration_error": m(ECE),
        "segment_metrics_tier": m(segment("tier")),
        "segment_metrics_service": m(segment("service_type")),
        "constant_baseline": with_ctes(
            ranking(src="flat"),
            ["tickets"],
            {
                **mctes,
                "flat": "SELECT y, (SELECT avg(y) FROM scored WHERE split = 'train') AS p FROM test",
            },
        ),
        "breach_by_time_of_day": with_ctes(
            grouped_rate("is_weekend, is_after_hours"), ["fact"]
        ),
        "breach_by_backlog_quintile": with_ctes(
            f"""SELECT CAST(b AS INTEGER) AS quintile,
                min(open_backlog_at_creation) AS backlog_from,
                max(open_backlog_at_creation) AS backlog_to, count(*) AS tickets,
                count(*) FILTER (WHERE sla_breached) AS breached,
                {pct('count(*) FILTER (WHERE sla_breached)', 'count(*)')} AS breach_pct
            FROM (SELECT *, ntile(5) OVER (ORDER BY open_backlog_at_creation, ticket_id) AS b
                  FROM fact WHERE is_resolved) GROUP BY b""",
            ["fact"],
        ),
        "breach_by_dimension": with_ctes(
            f"""SELECT dimension, level, count(*) AS tickets,
                count(*) FILTER (WHERE sla_breached) AS breached,
                {pct('count(*) FILTER (WHERE sla_breached)', 'count(*)')} AS breach_pct,
                {p50('h4', 10000, 2)} AS median_hours FROM ({DIMENSIONS}) GROUP BY ALL""",
            ["fact", "history"],
            {
                "rf": "SELECT *, EXISTS (SELECT 1 FROM history h WHERE h.ticket_id = f.ticket_id "
                "AND h.status = 'pending') AS waited FROM fact f WHERE is_resolved"
            },
        ),
        "breach_by_month": with_ctes(grouped_rate("creation_month"), ["fact"]),
        "outage_flag_agreement": with_ctes(
            """SELECT count(*) AS tickets, count(active_outage_id) AS stored,
                count(*) FILTER (WHERE inside) AS derived,
                count(*) FILTER (WHERE inside <> (active_outage_id IS NOT NULL)) AS disagreeing
            FROM (SELECT *, EXISTS (SELECT 1 FROM outage_incident o WHERE o.region = f.region
                  AND o.service_type = f.service_type AND f.creation_ts >= o.start_ts
                  AND f.creation_ts < o.end_ts) AS inside
                  FROM fact f WHERE status <> 'cancelled')""",
            ["fact", "outage_incident"],
        ),
        "view_registry": with_ctes(
            """SELECT 'compliance' AS source, service_type AS item, count(*) AS tickets
            FROM fact WHERE status <> 'cancelled' GROUP BY service_type
            UNION ALL SELECT 'risk', risk_band, count(*) FROM tickets GROUP BY risk_band
            UNION ALL SELECT 'outage', CAST(EXISTS (SELECT 1 FROM outage_incident o
                WHERE o.region = f.region AND o.service_type = f.service_type
                  AND f.creation_ts >= o.start_ts AND f.creation_ts < o.end_ts) AS VARCHAR),
                count(*) FROM fact f WHERE status <> 'cancelled' GROUP BY ALL""",
            ["tickets", "outage_incident"],
        ),
        "extract_manifest": with_ctes(
            f"""SELECT x.*, CAST({SNAP} AS TIMESTAMP) AS load_snapshot_ts,
                'pseudo-1' AS model_version
            FROM (SELECT 'fact_ticket' AS extract, count(*) AS rows FROM tickets
                  UNION ALL SELECT 'monthly_compliance', count(*) FROM cm
                  UNION ALL SELECT 'backlog_ageing', count(*) FROM grid
                  UNION ALL SELECT 'risk_deciles', count(*) FROM ({DECILES})
                  UNION ALL SELECT 'weekly_kpi', count(*) FROM weeks
                  UNION ALL SELECT 'dim_customer', count(*) FROM dim_customer
                  UNION ALL SELECT 'dim_site', count(*) FROM dim_site
                  UNION ALL SELECT 'dim_service', count(*) FROM dim_service
                  UNION ALL SELECT 'dim_outage', 8) x""",
            ["tickets", "months", "weeks", "dim_customer", "dim_service"],
            {"cm": v.COMPLIANCE_MONTHLY, **GRID_CTES},
        ),
    }

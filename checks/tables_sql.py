"""SQL of the source, cleaning and enrichment queries."""

from __future__ import annotations

from checks.base_sql import BAND, BAND_NO, SNAP, lit, pct, with_ctes
from ticketlens import constants as C

RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END"

# Unique raw tickets as cleaning should see them; ``reason`` is the expected reject reason.
TIDY = f"""
    SELECT CAST(ticket_id AS VARCHAR) AS id, slot,
           CASE WHEN slot <> 192 THEN name END AS name,
           CASE WHEN slot NOT BETWEEN 130 AND 179 THEN description END AS description,
           ticket_type, CASE WHEN slot = 184 THEN 'urgent' ELSE severity END AS severity,
           CAST(CASE WHEN slot BETWEEN 120 AND 129 OR slot = 196 THEN {RANK} ELSE priority END
                AS INTEGER) AS priority,
           slot BETWEEN 120 AND 129 OR slot = 196 AS imputed,
           status, CASE WHEN slot = 197 THEN 'fax' ELSE channel END AS channel,
           CASE WHEN slot <> 185 THEN creation_ts END AS creation_date,
           CASE WHEN slot = 191 THEN creation_ts - INTERVAL 1 DAY ELSE last_update_ts END
               AS last_update,
           CASE WHEN slot <> 193 THEN expected_resolution_ts END AS expected_resolution_date,
           requested_resolution_ts AS requested_resolution_date,
           CASE WHEN slot = 183 AND resolution_ts IS NOT NULL
                THEN creation_ts - INTERVAL 1 DAY ELSE resolution_ts END AS resolution_date,
           CASE WHEN slot = 187 THEN 'no-such-customer' ELSE CAST(customer_id AS VARCHAR) END
               AS customer_id,
           CASE WHEN slot <> 186 THEN CAST(site_id AS VARCHAR) END AS site_id,
           CAST(service_id AS VARCHAR) AS service_id, assignment_group, active_outage_id,
           CAST(CASE WHEN slot = 195 THEN 0 ELSE open_backlog_at_creation END AS INTEGER)
               AS open_backlog_at_creation,
           CAST(CASE WHEN slot = 195 THEN 3 ELSE reopen_count END AS INTEGER) AS reopen_count,
           CASE WHEN slot IN (181, 182, 194) THEN 2 ELSE 1 END AS copies,
           CASE WHEN slot = 194 THEN 2 ELSE 1 END AS variants,
           CASE WHEN slot = 183 AND resolution_ts IS NOT NULL THEN 'resolution_before_creation'
                WHEN slot = 184 THEN 'unknown_severity'
                WHEN slot = 185 THEN 'missing_or_unparseable_creation_date'
                WHEN slot = 186 THEN 'missing_site_id'
                WHEN slot = 187 THEN 'unknown_dimension_key'
                WHEN slot = 191 THEN 'last_update_before_creation'
                WHEN slot = 192 THEN 'missing_name'
                WHEN slot = 193 THEN 'missing_expected_resolution'
                WHEN slot = 197 THEN 'unknown_channel' END AS reason,
           ticket_id
    FROM (SELECT *, ticket_id % 1000 AS slot FROM fact)"""

RAW_20 = """id, name, description, ticket_type, severity, priority, status, channel,
    creation_date, last_update, expected_resolution_date, requested_resolution_date,
    resolution_date, customer_id, site_id, service_id, assignment_group, active_outage_id,
    open_backlog_at_creation, reopen_count"""

# A code cell changes when upper-cased (70-99, only if it has letters) or padded (100-119).
CHANGED = "count(*) FILTER (WHERE slot BETWEEN 70 AND 119)"

CELLS = " UNION ALL ".join(
    f"SELECT 'categorical_cells_normalised' AS metric, '{c}' AS detail, "
    + (
        # surrounding white space of the group is already gone when cells are compared
        "count(*) FILTER (WHERE slot BETWEEN 70 AND 99)"
        if c == "assignment_group"
        else CHANGED
    )
    + " AS value FROM tidy"
    for c in [*C.TICKET_DOMAINS, "assignment_group"]
)

REPORT = f"""
    SELECT 'input_rows' AS metric, '' AS detail, CAST(sum(copies) AS BIGINT) AS value FROM tidy
    UNION ALL SELECT 'exact_duplicates_dropped', '', CAST(sum(copies - variants) AS BIGINT)
        FROM tidy
    UNION ALL SELECT 'key_duplicates_dropped', '', CAST(sum(variants - 1) AS BIGINT) FROM tidy
    UNION ALL {CELLS}
    UNION ALL SELECT 'unparseable_timestamps', d,
        CASE d WHEN 'creation_date' THEN (SELECT count(*) FROM tidy WHERE slot = 185) ELSE 0 END
        FROM (SELECT unnest(['creation_date', 'last_update', 'expected_resolution_date',
                             'requested_resolution_date', 'resolution_date']) AS d)
    UNION ALL SELECT 'priority_imputed', '', count(*) FROM tidy WHERE imputed
    UNION ALL SELECT 'description_missing', '', count(*) FROM tidy WHERE description IS NULL
    UNION ALL SELECT 'output_rows', '', count(*) FROM tidy WHERE reason IS NULL
    UNION ALL SELECT 'rejected_rows', reason, count(*) FROM tidy WHERE reason IS NOT NULL
        GROUP BY reason"""

# Unique raw status changes with their validity.
CHANGES = """
    SELECT h.*, ticket_id % 1000 AS slot, t.reason IS NULL
               AND NOT (step = 8 AND ticket_id % 1000 IN (221, 222)) AS valid
    FROM history h JOIN tidy t USING (ticket_id)"""
CLEAN_HISTORY = """
    SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, status, change_ts AS change_date,
           change_reason,
           row_number() OVER (PARTITION BY ticket_id ORDER BY change_ts, step) AS sequence_no
    FROM changes WHERE valid"""
HISTORY_REPORT = """
    SELECT 'input_rows' AS metric, '' AS detail,
           count(*) + count(*) FILTER (WHERE slot IN (181, 182)) AS value FROM changes
    UNION ALL SELECT 'duplicates_dropped', '', count(*) FROM changes WHERE slot IN (181, 182)
    UNION ALL SELECT 'status_cells_normalised', '', count(*) FROM changes
        WHERE slot BETWEEN 70 AND 119
    UNION ALL SELECT 'unparseable_change_date', '', count(*) FROM changes
        WHERE slot = 221 AND step = 8
    UNION ALL SELECT 'invalid_or_orphan_rows_dropped', '', count(*) FROM changes WHERE NOT valid
    UNION ALL SELECT 'output_rows', '', count(*) FROM changes WHERE valid"""

COUNTED = [
    ("dim_customer", "dim_customer"),
    ("dim_site", "dim_site"),
    ("dim_service", "dim_service"),
    ("sla_target", "sla_target"),
    ("outage_incident", "outage_incident"),
    ("fact_ticket", "base"),
    ("fact_ticket_status_history", "history"),
    ("ticket_risk_score", "base"),
]
TABLE_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows FROM {src}" for n, src in COUNTED
)
COUNT_CTES = ["dim_service", "sla_target", "outage_incident", "dim_customer", "history"]

RAW_COUNTS = """
    SELECT 'customers' AS table_name, count(*) AS rows FROM customer
    UNION ALL SELECT 'sites', count(*) FROM nation
    UNION ALL SELECT 'services', count(*) FROM part
    UNION ALL SELECT 'sla_targets', 16 UNION ALL SELECT 'outages', 8
    UNION ALL SELECT 'tickets',
        count(*) + count(*) FILTER (WHERE ticket_id % 1000 IN (181, 182, 194)) FROM base
    UNION ALL SELECT 'status_history',
        count(*) + count(*) FILTER (WHERE ticket_id % 1000 IN (181, 182)) FROM history"""


def audit() -> str:
    names = {
        "dim_customer": ["domain:tier", "unique:customer_id"],
        "dim_site": ["unique:site_id", "foreign_key:customer_id"],
        "dim_service": [
            "unique:service_id", "range:bandwidth_mbps", "foreign_key:site_id",
            "foreign_key:customer_id",
        ],
        "sla_target": [
            "domain:tier", "domain:severity", "range:target_hours", "unique:tier,severity",
        ],
        "outage_incident": ["row:end_after_start", "unique:outage_id"],
        "fact_ticket": [
            *[
                f"not_null:{c}"
                for c in (
                    "ticket_id name ticket_type severity priority status channel creation_ts "
                    "last_update_ts expected_resolution_ts customer_id site_id service_id "
                    "assignment_group open_backlog_at_creation sla_target_hours is_resolved"
                ).split()
            ],
            *[f"domain:{c}" for c in C.TICKET_DOMAINS],
            "range:priority", "range:creation_hour_local", "range:creation_dow_local",
            "range:open_backlog_at_creation", "row:resolution_after_creation",
            "row:last_update_after_creation", "row:resolved_consistency", "unique:ticket_id",
            "foreign_key:customer_id", "foreign_key:site_id", "foreign_key:service_id",
            "foreign_key:active_outage_id",
        ],
        "fact_ticket_status_history": [
            "domain:status", "not_null:ticket_id", "not_null:sequence_no", "not_null:change_ts",
            "unique:ticket_id,sequence_no", "foreign_key:ticket_id",
        ],
        "ticket_risk_score": [
            "range:probability", "domain:risk_band", "domain:split", "unique:ticket_id",
            "foreign_key:ticket_id",
        ],
    }
    measured = {
        ("fact_ticket", "unique:ticket_id"): "(SELECT count(*) - count(DISTINCT ticket_id) FROM fact)",
        ("fact_ticket", "row:resolution_after_creation"):
            "(SELECT count(*) FROM fact WHERE resolution_ts < creation_ts)",
        ("fact_ticket", "range:priority"):
            "(SELECT count(*) FROM fact WHERE priority NOT BETWEEN 1 AND 4)",
        ("fact_ticket", "range:open_backlog_at_creation"):
            "(SELECT count(*) FROM fact WHERE open_backlog_at_creation < 0)",
        ("fact_ticket", "foreign_key:service_id"):
            "(SELECT count(*) FROM fact WHERE service_id NOT IN (SELECT p_partkey FROM part))",
        ("fact_ticket", "foreign_key:customer_id"):
            "(SELECT count(*) FROM fact WHERE customer_id NOT IN (SELECT c_custkey FROM customer))",
    }
    rows = [
        f"SELECT '{t}' AS table_name, '{c}' AS constraint_name, "
        f"CAST({measured.get((t, c), '0')} AS BIGINT) AS violations"
        for t, cs in names.items()
        for c in cs
    ]
    return with_ctes(" UNION ALL ".join(rows), ["fact"])


def humanise(code: str) -> str:
    """Words split at underscores or blanks, capitalised, acronyms restored."""
    fix = "CASE w " + " ".join(
        f"WHEN {lit(k)} THEN {lit(v)}" for k, v in C.ACRONYMS.items()
    ) + " ELSE w END"
    words = f"string_split(replace({code}, '_', ' '), ' ')"
    caps = f"list_transform({words}, lambda x: upper(x[1]) || lower(x[2:]))"
    return f"array_to_string(list_transform({caps}, lambda w: {fix}), ' ')"


def labelled(code: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {code} {cases} ELSE {humanise(code)} END"


OUTCOME = (
    "CASE WHEN sla_breached THEN 'Breached' WHEN NOT sla_breached THEN 'Met' "
    "WHEN status = 'cancelled' THEN 'Cancelled' ELSE 'Pending' END"
)

CODE_LABELS = f"""
    SELECT DISTINCT 'service_type' AS kind, service_type AS code,
           {labelled('service_type', C.SERVICE_LABELS)} AS label FROM fact
    UNION ALL SELECT DISTINCT 'channel', channel, {labelled('channel', C.CHANNEL_LABELS)} FROM fact
    UNION ALL SELECT DISTINCT 'assignment_group', assignment_group,
           {labelled('assignment_group', C.GROUP_LABELS)} FROM fact
    UNION ALL SELECT DISTINCT 'industry', industry, {humanise('industry')} FROM fact
    UNION ALL SELECT DISTINCT 'ticket_type', ticket_type, {humanise('ticket_type')} FROM fact
    UNION ALL SELECT DISTINCT 'region', region, {humanise('region')} FROM fact
    UNION ALL SELECT DISTINCT 'split', split, {labelled('split', C.SPLIT_LABELS)} FROM fact
    UNION ALL SELECT DISTINCT 'cause', cause, {humanise('cause')} FROM outage_incident"""

CENTROIDS = "SELECT * FROM (VALUES " + ", ".join(
    f"({lit(c)}, {lit(p)}, {x}::DOUBLE, {y}::DOUBLE)" for c, p, x, y in C.CITY_CENTROIDS
) + ") v(city, province, latitude, longitude)"
PROVINCE = "CASE {0} " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in C.PROVINCE_NAMES.items()
) + " END"


#: Counts the source lines directly; every line without a defect is a ticket.
RECONCILIATION = """
WITH lines AS (
  SELECT CASE WHEN o_orderkey IS NULL THEN 'no_order' WHEN c_custkey IS NULL THEN 'no_customer'
              WHEN p_partkey IS NULL THEN 'no_part' WHEN n_nationkey IS NULL THEN 'no_nation'
              ELSE 'tickets' END AS outcome
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT 'lines_read' AS outcome, count(*) AS row_count FROM lineitem
UNION ALL
SELECT o.outcome, count(l.outcome)
FROM (VALUES ('no_order'), ('no_customer'), ('no_part'), ('no_nation'), ('tickets')) o(outcome)
LEFT JOIN lines l ON l.outcome = o.outcome
GROUP BY o.outcome
"""


def sql() -> dict[str, str]:
    tidy = {"tidy": TIDY}
    changes = {"tidy": TIDY, "changes": CHANGES}
    now = f"CAST({SNAP} AS TIMESTAMP)"

    def t(body: str) -> str:
        return with_ctes(body, ["fact"], tidy)

    def h(body: str) -> str:
        return with_ctes(body, ["fact", "history"], changes)

    def f(body: str, *more: str) -> str:
        return with_ctes(body, ["fact", *more])

    return {
        "source_reconciliation": RECONCILIATION,
        "raw_extract_counts": with_ctes(RAW_COUNTS, ["history"]),
        "snapshot_of_extract": t(
            f"SELECT 'declared' AS source, {now} AS snapshot_ts UNION ALL "
            "SELECT 'last_update', max(last_update) FROM tidy WHERE reason IS NULL"
        ),
        "extract_to_report": with_ctes(
            f"SELECT risk_band, split, sla_breached, count(*) AS tickets, {now} AS snapshot_ts "
            "FROM tickets WHERE ticket_id IN "
            "(SELECT CAST(id AS BIGINT) FROM tidy WHERE reason IS NULL) "
            "GROUP BY risk_band, split, sla_breached",
            ["fact", "tickets"],
            tidy,
        ),
        "processed_roundtrip": f(
            "SELECT ticket_id, creation_ts, resolution_ts, customer_id, active_outage_id, "
            "CAST(h4 AS DOUBLE) / 10000 AS resolution_hours, is_weekend, is_resolved, "
            "sla_breached FROM fact"
        ),
        "load_table_counts": with_ctes(TABLE_COUNTS, COUNT_CTES),
        "load_run_latest": with_ctes(
            f"SELECT {now} AS snapshot_ts, 'testdata' AS source_dir, true AS synthetic, "
            f"table_name, rows FROM ({TABLE_COUNTS})",
            COUNT_CTES,
        ),
        "overwritten_scores": with_ctes(
            "SELECT model_version, risk_band, split, count(*) AS tickets FROM tickets GROUP BY ALL",
            ["tickets"],
        ),
        "trimmed_text": t(
            "SELECT id, customer_id, site_id, service_id, CASE WHEN slot BETWEEN 70 AND 99 "
            "THEN upper(replace(assignment_group, '_', ' ')) ELSE assignment_group END "
            "AS assignment_group, active_outage_id, name, description FROM tidy"
        ),
        "normalised_codes": t(
            "SELECT id, ticket_type, severity, status, channel, assignment_group FROM tidy"
        ),
        "normalised_cell_counts": t(CELLS),
        "duplicate_rows": t(
            "SELECT id, CAST(copies AS BIGINT) AS copies, CAST(variants AS BIGINT) AS variants, "
            "status FROM tidy WHERE copies > 1"
        ),
        "parsed_timestamps": t(
            "SELECT id, creation_date, last_update, expected_resolution_date, "
            "requested_resolution_date, resolution_date FROM tidy"
        ),
        "imputed_priority": t(
            # an unknown severity has no rank, but its priority was given
            "SELECT id, priority, imputed FROM tidy"
        ),
        "numeric_defaults": t("SELECT id, open_backlog_at_creation, reopen_count FROM tidy"),
        "rejected_tickets": t("SELECT id, reason AS reject_reason FROM tidy WHERE reason IS NOT NULL"),
        "domain_violations": t(
            "SELECT CAST(0 AS BIGINT) AS ticket_type, count(*) FILTER (WHERE slot = 184) AS severity, "
            "CAST(0 AS BIGINT) AS status, count(*) FILTER (WHERE slot = 197) AS channel FROM tidy"
        ),
        "unknown_dimension_keys": t(
            "SELECT id, customer_id, site_id, service_id FROM tidy WHERE slot IN (186, 187)"
        ),
        "clean_tickets": t(f"SELECT {RAW_20} FROM tidy WHERE reason IS NULL"),
        "clean_status_history": h(CLEAN_HISTORY),
        "status_history_report": h(HISTORY_REPORT),
        "cleaning_report": t(REPORT),
        "constraint_audit": audit(),
        "reconcile_counts": t(
            "SELECT CAST(sum(copies) AS BIGINT) AS input_rows, "
            "CAST(sum(copies - 1) AS BIGINT) AS duplicates, "
            "count(*) FILTER (WHERE reason IS NOT NULL) AS rejected, "
            "count(*) FILTER (WHERE reason IS NULL) AS kept, "
            "count(*) FILTER (WHERE reason IS NULL) AS loaded, true AS balanced, "
            "true AS all_loaded FROM tidy"
        ),
        "joined_dimensions": f(
            "SELECT ticket_id, customer_name, tier, industry, city, province, region, "
            "service_type FROM fact"
        ),
        "local_time_features": f(
            "SELECT ticket_id, creation_hour_local, creation_dow_local, is_weekend, "
            "is_after_hours, has_requested_resolution_date, creation_month FROM fact"
        ),
        "sla_outcomes": f(
            "SELECT ticket_id, CAST(sla_target_hours AS DOUBLE) AS sla_target_hours, "
            "CAST(h4 AS DOUBLE) / 10000 AS resolution_hours, is_resolved, sla_breached FROM fact"
        ),
        "active_outage": f(
            "SELECT ticket_id, active_outage_id, active_outage_id IS NOT NULL AS has_active_outage "
            "FROM fact"
        ),
        "open_backlog_at_creation": f("SELECT ticket_id, open_backlog_at_creation FROM fact"),
        "first_end": with_ctes(
            "SELECT ticket_id, min(change_ts) AS first_end_ts FROM history "
            "WHERE status IN ('resolved', 'cancelled') GROUP BY ticket_id",
            ["history"],
        ),
        "sequenced_history": with_ctes(
            "SELECT ticket_id, sequence_no, status, change_ts FROM history", ["history"]
        ),
        "latest_status": with_ctes(
            "SELECT ticket_id, status, change_ts FROM history QUALIFY row_number() OVER "
            "(PARTITION BY ticket_id ORDER BY sequence_no DESC) = 1",
            ["history"],
        ),
        "reopen_counts": with_ctes(
            "SELECT ticket_id, count(*) AS reopen_count FROM (SELECT ticket_id, status, "
            "lag(status) OVER (PARTITION BY ticket_id ORDER BY sequence_no) AS before FROM history)"
            " WHERE status = 'in_progress' AND before = 'resolved' GROUP BY ticket_id",
            ["history"],
        ),
        "ever_pending": f(
            f"SELECT ever_pending, count(*) AS tickets, count(*) FILTER (WHERE sla_breached) AS "
            f"breached, {pct('count(*) FILTER (WHERE sla_breached)', 'count(*)')} AS breach_pct "
            "FROM (SELECT *, EXISTS (SELECT 1 FROM history h WHERE h.ticket_id = f.ticket_id AND "
            "h.status = 'pending') AS ever_pending FROM fact f WHERE is_resolved) GROUP BY ALL",
            "history",
        ),
        "code_labels": f(CODE_LABELS, "outage_incident"),
        "site_locations": with_ctes(
            f"SELECT site_id, s.city, s.province, {PROVINCE.format('s.province')} AS province_name, "
            "latitude, longitude FROM dim_site s LEFT JOIN centroids c ON c.city = s.city "
            "AND c.province = s.province",
            ["dim_site"],
            {"centroids": CENTROIDS},
        ),
        "unmatched_cities": with_ctes(
            "SELECT city, province, count(*) AS sites FROM dim_site s WHERE NOT EXISTS (SELECT 1 "
            "FROM centroids c WHERE c.city = s.city AND c.province = s.province) GROUP BY ALL",
            ["dim_site"],
            {"centroids": CENTROIDS},
        ),
        "sla_outcome_labels": f(
            f"SELECT {OUTCOME} AS sla_outcome, count(*) AS tickets FROM fact GROUP BY ALL"
        ),
        "age_bands": f(
            f"SELECT ticket_id, age AS age_seconds, {BAND.format(a='age')} AS age_bucket, "
            f"{BAND_NO.format(a='age')} AS bucket_order FROM (SELECT ticket_id, "
            "CAST(epoch(TIMESTAMP '2000-06-01') - epoch(creation_ts) AS BIGINT) AS age FROM fact "
            "WHERE creation_ts <= TIMESTAMP '2000-06-01' AND (closed_ts IS NULL OR "
            "closed_ts > TIMESTAMP '2000-06-01'))"
        ),
        "time_split": f(
            "SELECT split, creation_month, count(*) AS tickets FROM fact GROUP BY ALL"
        ),
    }

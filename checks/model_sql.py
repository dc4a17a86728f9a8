"""SQL of the feature, encoding and baseline queries of the model."""

from __future__ import annotations

from checks.base_sql import lit, with_ctes
from ticketlens.plans import features as FT
from ticketlens.sources.testdata import FEATURE_LEVELS

LOWER = [c for c in FT.CATEGORICAL if c not in ("province", "customer_id")]
FEATURES = ", ".join(
    [
        *[f"lower({c}) AS {c}" for c in LOWER],
        "province",
        "CAST(customer_id AS VARCHAR) AS customer_id",
        "priority",
        "open_backlog_at_creation",
        "CAST(sla_target_hours AS DOUBLE) AS sla_target_hours",
        "creation_hour_local",
        "creation_dow_local",
        "active_outage_id IS NOT NULL AS has_active_outage",
        "is_weekend",
        "is_after_hours",
        "has_requested_resolution_date",
    ]
)
ROWS = f"SELECT ticket_id, CAST(sla_breached AS INTEGER) AS y, split, h4, {FEATURES} FROM fact"
LABELLED = "SELECT * FROM rows_all WHERE split <> 'unlabelled'"

ERRORS = [
    (11, "severity", "missing"), (12, "severity", "value_error"), (13, "channel", "value_error"),
    (14, "priority", "less_than_equal"), (15, "priority", "greater_than_equal"),
    (16, "creation_hour_local", "less_than_equal"),
    (17, "creation_dow_local", "greater_than_equal"),
    (21, "open_backlog_at_creation", "greater_than_equal"),
    (22, "sla_target_hours", "greater_than"), (23, "priority", "int_parsing"),
    (24, "has_active_outage", "bool_parsing"), (25, "customer_id", "string_too_short"),
    (26, "sla_breached", "extra_forbidden"), (27, "reopen_count", "extra_forbidden"),
]

HOT = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN {c} IN (SELECT {c} FROM r WHERE split = 'train') "
    f"THEN {c} END AS level, count(*) AS rows FROM r WHERE split <> 'train' GROUP BY ALL"
    for c in FEATURE_LEVELS
)
CODES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, r.{c} AS level, CAST(coalesce(k.code, -1) AS INTEGER) AS code, "
    f"count(*) AS rows FROM r LEFT JOIN (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code "
    f"FROM (SELECT DISTINCT {c} FROM r WHERE split = 'train')) k ON k.{c} = r.{c} "
    "WHERE r.split <> 'train' GROUP BY ALL"
    for c in [*FEATURE_LEVELS, "customer_id"]
)
SCALED = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(({c} - m) / s), 6) AS mean, "
    f"round(stddev_pop(({c} - m) / s), 6) AS sd FROM r CROSS JOIN "
    f"(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM r WHERE split = 'train') "
    "WHERE split <> 'train'"
    for c in FT.NUMERIC
)
TWO_PI = "(2 * pi())"
CYCLE = f"""
    SELECT ticket_id, round(sin(creation_hour_local * ({TWO_PI} / 24)), 6) + 0.0 AS hour_sin,
           round(cos(creation_hour_local * ({TWO_PI} / 24)), 6) + 0.0 AS hour_cos,
           round(sin(creation_dow_local * ({TWO_PI} / 7)), 6) + 0.0 AS dow_sin,
           round(cos(creation_dow_local * ({TWO_PI} / 7)), 6) + 0.0 AS dow_cos
    FROM fact"""


def blend(n: str, s: str, rate: str) -> str:
    mean = f"({s} / nullif({n}, 0))"
    spread = f"({rate} * (1 - {rate}))"
    trust = f"({spread} * {n} / nullif({spread} * {n} + {mean} * (1 - {mean}), 0))"
    return f"coalesce({trust} * {mean} + (1 - {trust}) * {rate}, {rate})"


ENCODED = {
    "folded": """
        SELECT *, ('0x' || substr(md5(ticket_id || '/0'), 1, 8))::BIGINT % 5 AS fold
        FROM r WHERE split = 'train'""",
    "lf": """SELECT customer_id, fold, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s
        FROM folded GROUP BY ALL""",
    "l": "SELECT customer_id, sum(n) AS n, sum(s) AS s FROM lf GROUP BY ALL",
    "ff": "SELECT fold, sum(n) AS n, sum(s) AS s FROM lf GROUP BY ALL",
    "w": "SELECT sum(n) AS n, sum(s) AS s FROM lf",
}
ENCODE = f"""
    SELECT f.ticket_id, round({blend('(l.n - lf.n)', '(l.s - lf.s)',
                                     '((w.s - ff.s) / (w.n - ff.n))')}, 6) AS code
    FROM folded f JOIN l USING (customer_id) JOIN lf USING (customer_id, fold)
    JOIN ff USING (fold) CROSS JOIN w
    UNION ALL
    SELECT r.ticket_id, round(coalesce({blend('l.n', 'l.s', '(w.s / w.n)')}, w.s / w.n), 6)
    FROM r LEFT JOIN l USING (customer_id) CROSS JOIN w WHERE r.split <> 'train'"""

BASELINE = """
    SELECT round(avg(abs(hours - med)), 6) AS mae_hours,
           round(median(abs(hours - med)), 6) AS median_abs_error_hours,
           round(sqrt(avg(power(ln(1 + hours) - ln(1 + med), 2))), 6) AS rmse_log1p_hours,
           round(1 - sum(power(ln(1 + hours) - ln(1 + med), 2))
               / (var_pop(ln(1 + hours)) * count(*)), 6) AS r2_log1p_hours
    FROM (SELECT t.h4 / 10000.0::DOUBLE AS hours,
                 coalesce(m.med, (SELECT quantile_cont(h4, 0.5) / 10000 FROM r
                                  WHERE split = 'train')) AS med
          FROM r t LEFT JOIN (SELECT tier, severity, quantile_cont(h4, 0.5) / 10000 AS med
                              FROM r WHERE split = 'train' GROUP BY ALL) m
            ON m.tier = t.tier AND m.severity = t.severity
          WHERE t.split = 'test')"""


def _permutations() -> str:
    """Sixteen rounds of swap or not over the row numbers, one CTE each."""
    steps = [
        """p0 AS (SELECT split, repeat, ticket_id, rn, rn AS x, n FROM (
            SELECT split, ticket_id, row_number() OVER (PARTITION BY split ORDER BY ticket_id) - 1 AS rn,
                   count(*) OVER (PARTITION BY split) AS n FROM r WHERE split IN ('validation', 'test')),
            range(5) AS g(repeat))"""
    ]
    for i in range(1, 17):
        name = f"'0/' || repeat || '/{i}'"
        other = f"(((('0x' || substr(md5({name}), 1, 8))::BIGINT - x) % n + n) % n)"
        steps.append(
            f"""q{i} AS (SELECT *, {other} AS o FROM p{i - 1}),
            p{i} AS (SELECT split, repeat, ticket_id, rn, n,
                CASE WHEN ('0x' || substr(md5({name} || '/' || greatest(x, o)), 1, 1))::BIGINT % 2 = 1
                     THEN o ELSE x END AS x FROM q{i})"""
        )
    return f"""SELECT * FROM (WITH {", ".join(steps)}
        SELECT a.split, a.repeat::INTEGER AS repeat, a.ticket_id, b.ticket_id AS donor_id
        FROM p16 a JOIN p0 b ON b.split = a.split AND b.repeat = a.repeat AND b.rn = a.x)"""


def _mixed(x: str) -> str:
    """The 32-bit mixer over an unsigned expression, as nested subexpressions."""
    step = lambda e, s, f: f"((xor({e}, ({e}) >> {s}) * {f}::UBIGINT) & 4294967295::UBIGINT)"
    inner = step(step(x, 16, 0x85EBCA6B), 13, 0xC2B2AE35)
    return f"xor({inner}, ({inner}) >> 16)"


BOOTSTRAP = f"""SELECT * FROM (
    WITH counts AS (
        SELECT p6 AS units, y, count(*) AS k FROM (
            SELECT CAST(floor(probability * 1000000 + 0.5) AS BIGINT) AS p6, CAST(sla_breached AS INTEGER) AS y
            FROM tickets WHERE split = 'test') GROUP BY ALL
    ), keys AS (
        SELECT *, {_mixed("(units * 2 + y)::UBIGINT")} AS key FROM counts
    ), reps AS (
        SELECT r, {_mixed("r::UBIGINT")} AS rk FROM range(1, 1001) AS g(r)
    ), drawn AS (
        SELECT r, units, y, k, xor(key, rk) AS h FROM keys, reps
    ), uniform AS (
        SELECT r, units, y, k, ({_mixed("h")}::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u FROM drawn
    ), tables AS (
        SELECT k, w, sum(exp(-k + w * ln(k) - lgamma(w + 1))) OVER (PARTITION BY k ORDER BY w) AS cdf
        FROM (SELECT DISTINCT k FROM counts),
             LATERAL (SELECT unnest(range(greatest(0, CAST(trunc(k - 9 * sqrt(k) - 40) AS BIGINT)),
                                          CAST(trunc(k + 9 * sqrt(k) + 40) AS BIGINT) + 1)) AS w)
    ), weights AS (
        SELECT u.r, u.units, u.y, coalesce(t.w + 1, greatest(0, CAST(trunc(u.k - 9 * sqrt(u.k) - 40) AS BIGINT))) AS w
        FROM uniform u ASOF LEFT JOIN tables t ON t.k = u.k AND t.cdf <= u.u
    ), per AS (
        SELECT r, units, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM weights GROUP BY ALL
    ), run AS (
        SELECT *, sum(pos) OVER o AS above, sum(pos + neg) OVER o AS every
        FROM per WINDOW o AS (PARTITION BY r ORDER BY units DESC)
    ), replicates AS (
        SELECT r, sum(neg * (above - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
               sum(pos * above / nullif(every, 0)) / sum(pos) AS pr_auc FROM run GROUP BY r
    )
    {{}})"""
INTERVALS = BOOTSTRAP.format(
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(*) AS replicates, round(avg({m}), 6) AS mean, "
        f"round(quantile_cont({m}, 0.025), 6) AS low, round(quantile_cont({m}, 0.975), 6) AS high FROM replicates"
        for m in ("roc_auc", "pr_auc")
    )
)
INVARIANTS = """
    SELECT * FROM (VALUES ('score_equations_hold', true, 0), ('mean_probability_is_the_rate', true, 0),
                          ('probabilities_in_range', true, 0), ('beats_the_constant', true, 0),
                          ('saved_equals_loaded', true, 0)) AS t(statement, holds, rows)
    UNION ALL SELECT 'training_rows', true, count(*) FROM r WHERE split = 'train'"""


def sql() -> dict[str, str]:
    base = {"rows_all": ROWS, "r": LABELLED}

    def r(body: str, **extra: str) -> str:
        return with_ctes(body, ["fact"], {**base, **extra})

    errors = " UNION ALL ".join(
        f"SELECT ticket_id, {lit(f)} AS field, {lit(e)} AS error_type FROM fact "
        f"WHERE ticket_id % 1000 = {s}"
        for s, f, e in ERRORS
    )
    return {
        "prepared_features": with_ctes(f"SELECT ticket_id, {FEATURES} FROM fact", ["fact"]),
        "record_errors": with_ctes(errors, ["fact"]),
        "one_hot_levels": r(HOT),
        "scaled_numerics": r(SCALED),
        "cyclical_time": with_ctes(CYCLE, ["fact"]),
        "ordinal_codes": r(CODES),
        "target_encoding": r(ENCODE, **ENCODED),
        "resolve_time_baseline": r(BASELINE),
        "feature_permutations": r(_permutations()),
        "model_invariants": r(INVARIANTS),
        "bootstrap_intervals": with_ctes(INTERVALS, ["tickets"]),
    }

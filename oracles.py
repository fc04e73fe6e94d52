"""Comparison SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from testviews import view_sql

LEDGER = view_sql("ledger")
INCOMING = view_sql("incoming")
COUNTERS = view_sql("counters")
RUNS = view_sql("runs")

_TOKENS = (
    "input_tokens",
    "output_tokens",
    "reasoning_tokens",
    "cache_creation_tokens",
    "cache_read_tokens",
    "total_tokens",
)
_SUMS = ", ".join(f"CAST(COALESCE(SUM({t}), 0) AS BIGINT) AS {t}" for t in _TOKENS)

# The sample price profile as rows: one per rule, in order of precedence.
_RULES = """
rules(ord, rule_id, provider_is, pat, f_ms, t_ms, min_side, as_output, conf, is_zero,
      in_n, in_d, out_n, out_d, rd_n, rd_d, cr_n, cr_d) AS (VALUES
 (0, 'unknown', NULL, 'unknown', NULL, NULL, NULL, FALSE, 'policy', TRUE, 0,1, 0,1, 0,1, 0,1),
 (1, 'alpha-1-long', NULL, 'alpha-1', NULL, NULL, 5000, FALSE, 'exact', FALSE, 5,2, 25,2, 1,4, 3,1),
 (2, 'beta-2-google', 'google', 'beta-[^/]', NULL, NULL, NULL, FALSE, 'partial', FALSE, 7,1, 21,1, 7,10, 7,1),
 (3, 'beta-2-first', NULL, 'beta-2[^/]*', NULL, epoch_ms(TIMESTAMP '2024-01-16'), NULL, FALSE, 'estimated', FALSE,
     3,1, 15,1, 3,10, 6,1),
 (4, 'beta-2-second', NULL, 'beta-2[^/]*', epoch_ms(TIMESTAMP '2024-01-16'), NULL, NULL, FALSE, 'estimated', FALSE,
     12,5, 12,1, 6,25, 3,1),
 (5, 'alpha-1', NULL, 'alpha-1', NULL, NULL, NULL, FALSE, 'exact', FALSE, 5,4, 10,1, 1,8, 5,4),
 (6, 'alpha-1-family', NULL, 'alpha-1-[^/]*', NULL, NULL, NULL, TRUE, 'approximate', FALSE,
     24,17, 2,1, 1,40, 2,5))
"""


def _micro(tokens: str, rate: str) -> str:
    return f"(2 * {rate}_n * {tokens} + {rate}_d) // (2 * {rate}_d)"


def priced(source: str = LEDGER) -> str:
    """CTEs ending in ``p``: every event with its rule, cost and coverage."""
    output = (
        "(output_tokens + CASE WHEN as_output OR token_accounting_method IN "
        "('copilot_otel_parts', 'copilot_session_model_metrics') THEN reasoning_tokens ELSE 0 END)"
    )
    cost = " + ".join(
        _micro(t, r)
        for t, r in (
            ("input_tokens", "in"),
            (output, "out"),
            ("cache_read_tokens", "rd"),
            ("cache_creation_tokens", "cr"),
        )
    )
    return f"""
{_RULES},
l AS ({source}),
named AS (
  SELECT *, lower(trim(model_normalized)) AS lm,
    CASE WHEN regexp_full_match(lower(trim(model_normalized)),
      '.+\\(\\s*(reasoning=)?(reasoning:)?(effort=)?(effort:)?(minimal|low|medium|high|xhigh|x-high)\\s*\\)')
    THEN trim(regexp_replace(lower(trim(model_normalized)), '\\([^(]*\\)$', '')) END AS alias
  FROM l
),
ranked AS (
  SELECT n.*, r.*, row_number() OVER (PARTITION BY event_id ORDER BY r.ord NULLS LAST) AS rn
  FROM named n LEFT JOIN rules r ON (regexp_full_match(lm, pat) OR regexp_full_match(alias, pat))
   AND (provider_is IS NULL OR provider_is = provider)
   AND (f_ms IS NULL OR timestamp_ms >= f_ms) AND (t_ms IS NULL OR timestamp_ms < t_ms)
   AND (min_side IS NULL OR input_tokens + cache_creation_tokens + cache_read_tokens >= min_side)
),
p AS (
  SELECT * EXCLUDE (rn),
    CASE WHEN rule_id IS NOT NULL AND is_zero THEN 'policy_zero' WHEN rule_id IS NOT NULL THEN 'priced'
      WHEN lm = 'unknown' THEN 'missing_model' ELSE 'missing_pricing_rule' END AS resolution,
    CAST(COALESCE({cost}, 0) AS BIGINT) AS micro_usd,
    CASE WHEN total_tokens > 0 THEN total_tokens ELSE input_tokens + output_tokens + reasoning_tokens
      + cache_creation_tokens + cache_read_tokens END AS coverage_tokens
  FROM ranked WHERE rn = 1
)
"""


def _cost_columns() -> str:
    kinds = {
        "priced": "resolution = 'priced'",
        "unpriced": "resolution LIKE 'missing%'",
        "policy_zero": "resolution = 'policy_zero'",
    }
    out = [
        "CAST(COALESCE(SUM(micro_usd) FILTER (resolution = 'priced'), 0) AS DOUBLE) / 1e6 AS estimated_cost_usd",
        "'available' AS pricing_status",
        "CAST(NULL AS VARCHAR) AS pricing_error_code",
        "'meterbook-sample' AS pricing_profile_id",
    ]
    for kind, cond in kinds.items():
        out.append(f"COUNT(*) FILTER ({cond}) AS {kind}_events")
    for kind, cond in kinds.items():
        out.append(
            f"CAST(COALESCE(SUM(coverage_tokens) FILTER ({cond}), 0) AS BIGINT) AS {kind}_tokens"
        )
    out.append(
        "COALESCE(CAST(COUNT(*) FILTER (resolution = 'priced') AS DOUBLE) / NULLIF(COUNT(*), 0), 0.0)"
        " AS event_coverage_ratio"
    )
    out.append(
        "COALESCE(CAST(CAST(COALESCE(SUM(coverage_tokens) FILTER (resolution = 'priced'), 0) AS BIGINT) AS DOUBLE)"
        " / CAST(NULLIF(SUM(coverage_tokens), 0) AS DOUBLE), 0.0) AS token_coverage_ratio"
    )
    out.append(
        "substr(MIN(CASE WHEN resolution <> 'priced' THEN '4missing' WHEN conf = 'exact' THEN '8exact'"
        " WHEN conf = 'estimated' THEN '7estimated' WHEN conf = 'approximate' THEN '6approximate'"
        " ELSE '5partial' END), 2) AS confidence"
    )
    return ",\n ".join(out)


def local_time(tz: str, ms: str = "timestamp_ms") -> str:
    return f"timezone('{tz}', to_timestamp(({ms}) / 1000.0))"


def bucket(kind: str, tz: str, ms: str = "timestamp_ms") -> str:
    t = local_time(tz, ms)
    if kind == "daily":
        return f"strftime({t}, '%Y-%m-%d')"
    if kind == "weekly":
        return f"strftime(date_trunc('week', {t}), '%Y-%m-%d')"
    return f"strftime({t}, '%Y-%m')"


LABEL = r"""CASE WHEN project_path IS NULL OR regexp_replace(replace(trim(project_path), chr(92), '/'), '/+$', '') = ''
  THEN 'no-project'
  ELSE regexp_extract(regexp_replace(replace(trim(project_path), chr(92), '/'), '/+$', ''), '[^/]*$') END"""


def labelled(label: str, where: str = "TRUE") -> str:
    return f"""WITH {priced()} SELECT {label} AS label, COUNT(*) AS events, {_SUMS}, {_cost_columns()}
FROM p WHERE {where} GROUP BY 1"""


def summary(where: str = "TRUE", tz: str = "America/New_York") -> str:
    return f"""WITH {priced()} SELECT COUNT(*) AS total_events, COUNT(DISTINCT session_key) AS total_sessions,
 (SELECT COUNT(*) FROM ({RUNS})) AS import_runs, {_SUMS},
 {bucket('daily', tz, 'MIN(timestamp_ms)')} AS first_date, {bucket('daily', tz, 'MAX(timestamp_ms)')} AS last_date,
 {_cost_columns()} FROM p WHERE {where}"""


def sessions(tail: str) -> str:
    tz = "America/New_York"
    return f"""WITH {priced()}, s AS (
 SELECT session_key, NULLIF(MIN(COALESCE(session_id, '')), '') AS session_id, MIN(channel) AS channel,
  MIN(source_product) AS source_product, {bucket('daily', tz, 'MIN(timestamp_ms)')} AS first_date,
  {bucket('daily', tz, 'MAX(timestamp_ms)')} AS last_date, COUNT(*) AS event_count,
  COUNT(DISTINCT model_normalized) AS model_count, {_SUMS}, {_cost_columns()}, MAX(timestamp_ms) AS last_ms
 FROM p GROUP BY session_key)
SELECT s.* EXCLUDE (last_ms), (SELECT model_normalized FROM l WHERE l.session_key = s.session_key
  GROUP BY model_normalized ORDER BY SUM(total_tokens) DESC, model_normalized LIMIT 1) AS primary_model
FROM s {tail}"""


ACCOUNTING = """CASE
 WHEN total_tokens < GREATEST(input_tokens, output_tokens, reasoning_tokens, cache_creation_tokens, cache_read_tokens)
  THEN 'accounting_total_below_bucket'
 WHEN token_accounting_method = 'codex_total_delta' THEN CASE
  WHEN input_tokens + cache_creation_tokens + cache_read_tokens + GREATEST(output_tokens, reasoning_tokens) > total_tokens
   THEN 'accounting_total_mismatch'
  WHEN input_tokens + cache_creation_tokens + cache_read_tokens + GREATEST(output_tokens, reasoning_tokens) < total_tokens
   AND observability_level <> 'partial' THEN 'accounting_total_mismatch' END
 WHEN token_accounting_method = 'workbuddy_raw_usage' THEN CASE
  WHEN reasoning_tokens > output_tokens THEN 'accounting_reasoning_exceeds_output'
  WHEN input_tokens + cache_creation_tokens + cache_read_tokens + output_tokens <> total_tokens
   THEN 'accounting_total_mismatch' END
 WHEN token_accounting_method = 'unknown_method' THEN NULL
 WHEN input_tokens + cache_creation_tokens + cache_read_tokens + output_tokens + reasoning_tokens <> total_tokens
  THEN 'accounting_total_mismatch' END"""

# Perturbed ledger for the validation rules: the event number decides what is broken.
BROKEN = """
SELECT n, CASE WHEN n % 31 = 1 THEN ' ' ELSE event_id END AS event_id,
 CASE WHEN n % 31 = 2 THEN 1 ELSE identity_version END AS identity_version,
 CASE WHEN n % 31 = 3 THEN 'guess' ELSE identity_strategy END AS identity_strategy,
 CASE WHEN n % 31 = 4 THEN 0 ELSE timestamp_ms END AS timestamp_ms,
 CASE WHEN n % 31 = 5 THEN '' ELSE session_key END AS session_key,
 CASE WHEN n % 31 = 6 THEN '' ELSE channel END AS channel,
 CASE WHEN n % 31 = 7 THEN ' ' ELSE event_granularity END AS event_granularity,
 CASE WHEN n % 31 = 8 THEN -1 ELSE cache_read_tokens END AS cache_read_tokens,
 CASE WHEN n % 31 = 9 THEN -5 ELSE source_total_tokens END AS source_total_tokens,
 CASE WHEN n % 31 = 10 THEN -5 ELSE raw_input_tokens END AS raw_input_tokens,
 CASE WHEN n % 31 = 11 THEN 0 WHEN n % 31 = 12 THEN total_tokens + 1 ELSE total_tokens END AS total_tokens,
 CASE WHEN n % 31 = 13 THEN 'unknown_method' ELSE token_accounting_method END AS token_accounting_method,
 CASE WHEN n % 31 = 14 THEN output_tokens + 1 ELSE reasoning_tokens END AS reasoning_tokens
"""
_BROKEN_COLUMNS = (
    "event_id, identity_version, identity_strategy, timestamp_ms, session_key, channel, event_granularity, "
    "cache_read_tokens, source_total_tokens, raw_input_tokens, total_tokens, token_accounting_method, reasoning_tokens"
)

VALIDATION = f"""WITH l AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ({LEDGER})),
b AS (SELECT l.* EXCLUDE ({_BROKEN_COLUMNS}, n), x.* FROM l JOIN ({BROKEN} FROM l) x ON l.n = x.n)
SELECT n, CASE WHEN trim(event_id) = '' OR identity_version <> 2 THEN 'invalid_identity'
 WHEN identity_strategy = 'guess' THEN 'unsupported_identity_strategy'
 WHEN timestamp_ms <= 0 THEN 'invalid_timestamp' WHEN session_key = '' THEN 'missing_session'
 WHEN channel = '' THEN 'missing_source' WHEN trim(event_granularity) = '' THEN 'missing_granularity'
 WHEN cache_read_tokens < 0 THEN 'negative_token' WHEN source_total_tokens < 0 THEN 'negative_source_total'
 WHEN raw_input_tokens < 0 THEN 'negative_raw_input' ELSE {ACCOUNTING} END AS reject_code FROM b"""

# What the second ledger does to the first, from how it was made.
MERGE = f"""
l AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ({LEDGER})),
d AS (
 SELECT event_id, n, provider, model_normalized, model_resolution,
  CASE WHEN model_normalized = 'unknown' THEN 0 WHEN model_resolution = 'direct_event' THEN 2 ELSE 1 END AS rank,
  (token_accounting_method = 'codex_total_delta' AND observability_level = 'partial') AS loose, n % 7 AS act
 FROM l WHERE n % 3 = 0),
decided AS (
 SELECT event_id, CASE act WHEN 0 THEN 'skipped' WHEN 6 THEN 'skipped'
   WHEN 1 THEN CASE WHEN provider IS NULL THEN 'updated' ELSE 'rejected' END
   WHEN 2 THEN CASE WHEN loose THEN 'rejected' ELSE 'skipped' END
   WHEN 3 THEN 'rejected'
   ELSE CASE WHEN rank = 2 THEN 'rejected' ELSE 'updated' END END AS status,
  CASE WHEN act = 1 AND provider IS NOT NULL THEN 'provider_conflict' WHEN act = 2 AND loose THEN 'token_conflict'
   WHEN act = 3 THEN 'timestamp_conflict' WHEN act IN (4, 5) AND rank = 2 THEN 'direct_model_conflict' END AS code
 FROM d
 UNION ALL SELECT event_id || 'x', 'inserted', NULL FROM l WHERE n % 3 = 1)
"""

# Usage per step of the cumulative counters, restart-aware.
DELTAS = f"""
c AS ({COUNTERS}),
w AS (SELECT *, lag(total) OVER win AS pt, lag(output) OVER win AS po, lag(reasoning) OVER win AS pr FROM c
 WINDOW win AS (PARTITION BY file_path ORDER BY line_number)),
u AS (SELECT file_path, conv_id, line_number, role, total AS source_total,
 CASE WHEN pt IS NULL OR total + output < pt + po THEN total ELSE GREATEST(total - pt, 0) END AS d_in,
 CASE WHEN pt IS NULL OR total + output < pt + po THEN output ELSE GREATEST(output - po, 0) END AS d_out,
 CASE WHEN pt IS NULL OR total + output < pt + po THEN reasoning ELSE GREATEST(reasoning - pr, 0) END AS d_rea,
 CASE WHEN pt IS NULL OR total + output < pt + po THEN total + output
  ELSE GREATEST(total + output - pt - po, 0) END AS d_tot FROM w)
"""

"""Ledger-shaped views of the given tables, as SQL for Spark and for the comparison engine.

Each view is one text with a few dialect placeholders. Operators and their comparison
queries start from the same view and are written independently after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIALECT = {
    "spark": {
        "STR": "STRING",
        "BS": "char(92)",
        "MS": "unix_millis(CAST(ts AS TIMESTAMP))",
        "JK": "CAST(get_json_object(props,'$.k') AS BIGINT)",
        "SHA": "sha2({0},256)",
    },
    "duckdb": {
        "STR": "VARCHAR",
        "BS": "chr(92)",
        "MS": "epoch_us(ts) // 1000",
        "JK": "CAST(json_extract_string(props,'$.k') AS BIGINT)",
        "SHA": "sha256({0})",
    },
}


def _fill(sql: str, dialect: str) -> str:
    for name, text in _DIALECT[dialect].items():
        if name == "SHA":
            while "{SHA:" in sql:
                start = sql.index("{SHA:")
                end = sql.index(":SHA}", start)
                sql = sql[:start] + text.format(sql[start + 5 : end]) + sql[end + 5 :]
        else:
            sql = sql.replace("{" + name + "}", text)
    return sql


_LEDGER = """
WITH base AS (
  SELECT event_id AS eid, event_type, user_id, {MS} AS ts_ms, {JK} AS k,
         CAST(FLOOR(value*100) AS BIGINT) AS v
  FROM events
), shaped AS (
  SELECT *,
    CASE event_type WHEN 'click' THEN 'codex' WHEN 'view' THEN 'claude' WHEN 'purchase' THEN 'copilot'
      WHEN 'signup' THEN 'gemini' ELSE 'workbuddy' END AS channel,
    CASE k % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'alpha-1' WHEN 2 THEN 'alpha-1-mini'
      WHEN 3 THEN 'Alpha-1 (high)' WHEN 4 THEN 'beta-2' WHEN 5 THEN 'beta-2-fast'
      WHEN 6 THEN 'vendor/beta-2' ELSE 'no-rule' END AS model_normalized,
    CAST(ABS(v) % 5000 AS BIGINT) AS input_tokens,
    CAST(ABS(v) % 700 AS BIGINT) AS output_tokens,
    CASE WHEN event_type = 'error' THEN LEAST(k, ABS(v) % 700) ELSE k END AS reasoning_tokens,
    CAST((ABS(v) + k) % 200 AS BIGINT) AS cache_creation_tokens,
    CAST((ABS(v) * k) % 3000 AS BIGINT) AS cache_read_tokens
  FROM base
)
SELECT CAST(eid AS {STR}) AS event_id, 2 AS identity_version,
  'native_event' AS identity_strategy, 'session' AS identity_scope,
  {SHA:CONCAT('c', CAST(eid AS {STR})):SHA} AS content_sha256,
  'view-1' AS parser_version, 'request' AS event_granularity, channel,
  CASE channel WHEN 'codex' THEN 'codex-cli' WHEN 'claude' THEN 'claude-code'
    WHEN 'gemini' THEN 'gemini-cli' WHEN 'workbuddy' THEN 'workbuddy'
    ELSE CASE WHEN k % 2 = 0 THEN 'copilot-otel' ELSE 'copilot-session-state' END END AS source_product,
  CASE channel WHEN 'codex' THEN 'openai' WHEN 'claude' THEN 'anthropic' WHEN 'copilot' THEN 'github'
    WHEN 'gemini' THEN 'google' ELSE CASE WHEN k % 4 = 0 THEN NULL ELSE 'workbuddy' END END AS provider,
  CASE WHEN k % 8 = 0 THEN NULL ELSE model_normalized END AS model_raw, model_normalized,
  CASE WHEN k % 8 = 0 THEN 'unknown' WHEN k % 3 = 0 THEN 'thread_settings' ELSE 'direct_event' END
    AS model_resolution,
  (k % 8 = 0) AS model_is_fallback,
  ts_ms AS timestamp_ms,
  CONCAT('s-', CAST(user_id AS {STR}), '-', CAST(CAST(FLOOR(ts_ms / 604800000.0) AS BIGINT) AS {STR}))
    AS session_key,
  CASE WHEN eid % 50 = 0 THEN NULL ELSE CONCAT('native-', CAST(user_id AS {STR})) END AS session_id,
  CAST(NULL AS {STR}) AS session_path_id, CAST(NULL AS {STR}) AS turn_id,
  CASE k % 5 WHEN 0 THEN NULL
    WHEN 1 THEN CONCAT('/work/team', CAST(user_id % 7 AS {STR}), '/app', CAST(k % 3 AS {STR}), '/')
    WHEN 2 THEN CONCAT('C:', {BS}, 'work', {BS}, 'app', CAST(k % 3 AS {STR}))
    WHEN 3 THEN CONCAT('solo', CAST(k % 3 AS {STR})) ELSE '/' END AS project_path,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CONCAT('msg-', CAST(eid AS {STR})) END AS message_id,
  CAST(NULL AS {STR}) AS request_id,
  CONCAT('/logs/', channel, '/', CAST(user_id AS {STR}), '.jsonl') AS source_file,
  CAST(eid % 1000 + 1 AS INT) AS line_number, CAST(NULL AS {STR}) AS raw_sha256,
  input_tokens, output_tokens, reasoning_tokens, cache_creation_tokens, cache_read_tokens,
  input_tokens + cache_creation_tokens + cache_read_tokens
    + CASE channel WHEN 'codex' THEN GREATEST(output_tokens, reasoning_tokens)
        WHEN 'workbuddy' THEN output_tokens ELSE output_tokens + reasoning_tokens END AS total_tokens,
  CAST(NULL AS BIGINT) AS source_total_tokens,
  CASE WHEN k % 2 = 0 THEN input_tokens + cache_read_tokens END AS raw_input_tokens,
  CASE channel WHEN 'codex' THEN 'codex_total_delta' WHEN 'claude' THEN 'claude_usage_sum'
    WHEN 'gemini' THEN 'gemini_usage' WHEN 'workbuddy' THEN 'workbuddy_raw_usage'
    ELSE CASE WHEN k % 2 = 0 THEN 'copilot_otel_parts' ELSE 'copilot_session_model_metrics' END END
    AS token_accounting_method,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CONCAT(channel, '_v1') END AS accounting_profile,
  CASE WHEN k % 6 = 0 THEN 'partial' ELSE 'full' END AS observability_level,
  CAST(1 AS BIGINT) AS imported_at_ms, CAST(1 AS BIGINT) AS updated_at_ms
FROM shaped
"""

# A second ledger: some events of the first with one fact changed, and new events.
_INCOMING = """
WITH l AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ({LEDGER})),
old AS (SELECT *, n % 7 AS act FROM l WHERE n % 3 = 0),
changed AS (
  SELECT * FROM old
), fresh AS (
  SELECT *, 9 AS act FROM l WHERE n % 3 = 1
)
SELECT CASE WHEN act = 9 THEN CONCAT(event_id, 'x') ELSE event_id END AS event_id,
  identity_version, identity_strategy, identity_scope,
  CASE WHEN act IN (1, 4, 5, 8) THEN {SHA:CONCAT('d', event_id):SHA} ELSE content_sha256 END AS content_sha256,
  parser_version, event_granularity, channel, source_product,
  CASE WHEN act = 1 THEN 'acme' ELSE provider END AS provider,
  CASE WHEN act IN (4, 5) THEN 'gamma-3' ELSE model_raw END AS model_raw,
  CASE WHEN act IN (4, 5) THEN 'gamma-3' ELSE model_normalized END AS model_normalized,
  CASE WHEN act IN (4, 5) THEN 'direct_event' ELSE model_resolution END AS model_resolution,
  CASE WHEN act IN (4, 5) THEN FALSE ELSE model_is_fallback END AS model_is_fallback,
  CASE WHEN act = 3 THEN timestamp_ms + 1 ELSE timestamp_ms END AS timestamp_ms,
  session_key, session_id, session_path_id,
  CASE WHEN act IN (0, 6) THEN 'turn' ELSE turn_id END AS turn_id,
  project_path, message_id, request_id, source_file, line_number, raw_sha256,
  input_tokens, output_tokens, reasoning_tokens, cache_creation_tokens, cache_read_tokens,
  CASE WHEN act = 2 AND token_accounting_method = 'codex_total_delta' AND observability_level = 'partial'
    THEN total_tokens + 1 ELSE total_tokens END AS total_tokens,
  source_total_tokens, raw_input_tokens, token_accounting_method, accounting_profile,
  observability_level, imported_at_ms, CAST(2 AS BIGINT) AS updated_at_ms
FROM (SELECT * FROM changed UNION ALL SELECT * FROM fresh)
"""

# Cumulative counters with a restart every fourth turn; text lengths are the increments.
_COUNTERS = """
WITH b AS (
  SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n, CAST(FLOOR(turn/4.0) AS BIGINT) AS seg
  FROM conversations
)
SELECT CONCAT('/logs/sessions/', CAST(conv_id AS {STR}), '.jsonl') AS file_path,
  conv_id, turn + 1 AS line_number, role, n,
  CAST(SUM(n) OVER (PARTITION BY conv_id, seg ORDER BY turn) AS BIGINT) AS total,
  CAST(SUM(n % 97) OVER (PARTITION BY conv_id, seg ORDER BY turn) AS BIGINT) AS output,
  CAST(SUM(n % 13) OVER (PARTITION BY conv_id, seg ORDER BY turn) AS BIGINT) AS reasoning
FROM b
"""

_RUNS = """
SELECT CONCAT('run-', CAST(o_orderkey AS {STR})) AS id,
  1700000000000 + (o_orderkey * 7919) % 1000003 AS started_at_ms,
  CASE WHEN o_orderstatus = 'P' THEN NULL
    ELSE 1700000000000 + (o_orderkey * 7919) % 1000003 + o_custkey END AS finished_at_ms,
  CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'completed'
    ELSE 'completed_with_warnings' END AS status,
  o_custkey % 11 AS files_scanned, o_orderkey % 5 AS events_added, o_orderkey % 3 AS events_updated,
  o_orderkey % 2 AS events_skipped, CAST(0 AS BIGINT) AS events_rejected,
  CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS error
FROM orders
"""

VIEWS = {
    "ledger": (_LEDGER, ("events",)),
    "incoming": (_INCOMING, ("events",)),
    "counters": (_COUNTERS, ("conversations",)),
    "runs": (_RUNS, ("orders",)),
}


def view_sql(name: str, dialect: str = "duckdb") -> str:
    sql = VIEWS[name][0].replace("{LEDGER}", _LEDGER)
    return _fill(sql, dialect)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the parquet tables of ``sf_dir``."""
    sql = view_sql(name, "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in VIEWS[name][1]}
    for t in tables:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return spark.sql(sql, **tables)

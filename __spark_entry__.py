
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import logviews as V
import oracles as O
from meterbook import schema as S
from meterbook.functions import identity as I
from meterbook.functions import naming as N
from meterbook.functions.clock import time_bucket
from meterbook.functions.text import project_label
from meterbook.operators import metrics as M
from meterbook.operators import normalize, pricing, quality, reconcile, replay, validate
from meterbook.operators.carry import Carry, carry
from meterbook.operators.counters import POLICY_COMPATIBLE, POLICY_LEDGER, snapshot, cumulative_deltas
from meterbook.operators.dedupe import deduplicate_messages, first_occurrences
from meterbook.operators.filters import Filters
from meterbook.operators.pricing import Costing
from meterbook.plans import pages
from meterbook.plans.ingest import import_events, import_logs
from meterbook.plans.merge import merge_decisions, merge_ledgers
from meterbook.plans.report import report
from meterbook.session import Staging, configure
from meterbook.sources import claude, codex, copilot, digests, gemini, jsonfile, ledger, lines, rollup, workbuddy
from meterbook.sources.profile import load_profile
from meterbook.streaming.incremental import import_changes
from testviews import view

Query = Callable[[SparkSession, str], DataFrame]
NEW_YORK = "America/New_York"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def entry(spark: SparkSession) -> DataFrame:
    """Daily usage with cost and coverage in a report time zone."""
    return _QUERIES["timeseries_daily"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ledger")


# Reports ---------------------------------------------------------------------------------

_ZONES = {"daily": NEW_YORK, "weekly": "Europe/Berlin", "monthly": "Asia/Kolkata"}
for _bucket, _zone in _ZONES.items():

    @_register(f"timeseries_{_bucket}", O.labelled(O.bucket(_bucket, _zone)))
    def _timeseries(spark, sf_dir, bucket=_bucket, zone=_zone):
        return M.timeseries(_ledger(spark, sf_dir), bucket, Filters(timezone=zone))


_DIMENSION_SQL = {
    "channel": "channel",
    "source_product": "source_product",
    "provider": "COALESCE(NULLIF(provider, ''), 'unknown')",
    "model": "model_normalized",
    "session": "session_key",
    "project": O.LABEL,
}
for _by, _sql in _DIMENSION_SQL.items():

    @_register(f"breakdown_{_by}", O.labelled(_sql))
    def _breakdown(spark, sf_dir, by=_by):
        return M.breakdown(_ledger(spark, sf_dir), by)


@_register("summary", O.summary())
def _summary(spark, sf_dir):
    filters = Filters(timezone=NEW_YORK)
    return M.summary(_ledger(spark, sf_dir), view(spark, sf_dir, "runs"), filters)


_WINDOW = Filters(
    since="2024-01-05",
    until="2024-01-20",
    channel="claude",
    provider="anthropic",
    source_product="claude-code",
    timezone=NEW_YORK,
)
_WINDOW_SQL = (
    "timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-05 05:00:00') AND "
    "timestamp_ms < epoch_ms(TIMESTAMP '2024-01-21 05:00:00') AND channel = 'claude' "
    "AND provider = 'anthropic' AND source_product = 'claude-code'"
)


@_register("summary_filtered", O.summary(_WINDOW_SQL))
def _summary_filtered(spark, sf_dir):
    return M.summary(_ledger(spark, sf_dir), view(spark, sf_dir, "runs"), _WINDOW)


@_register(
    "filter_instants",
    O.labelled(
        "model_normalized",
        "timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-10 10:30:00') "
        "AND timestamp_ms <= epoch_ms(TIMESTAMP '2024-01-12 00:00:00')",
    ),
)
def _filter_instants(spark, sf_dir):
    filters = Filters(since="2024-01-10T12:30:00+02:00", until="2024-01-12T00:00:00Z")
    return M.breakdown(_ledger(spark, sf_dir), "model", filters)


@_register("filter_project", O.labelled("channel", f"({O.LABEL}) = 'app1'"))
def _filter_project(spark, sf_dir):
    return M.breakdown(_ledger(spark, sf_dir), "channel", Filters(project="app1"))


@_register(
    "filter_session",
    O.labelled("channel", "session_key = 'native-7' OR session_id = 'native-7'"),
)
def _filter_session(spark, sf_dir):
    return M.breakdown(_ledger(spark, sf_dir), "channel", Filters(session="native-7"))


@_register("filter_model", O.labelled("channel", "model_normalized = 'beta-2'"))
def _filter_model(spark, sf_dir):
    return M.breakdown(_ledger(spark, sf_dir), "channel", Filters(model="beta-2"))


@_register("sessions_page", O.sessions("ORDER BY last_ms DESC, session_key LIMIT 20 OFFSET 5"))
def _sessions_page(spark, sf_dir):
    return M.sessions(_ledger(spark, sf_dir), Filters(timezone=NEW_YORK), 20, 5).items


@_register("sessions_report", O.sessions(""))
def _sessions_report(spark, sf_dir):
    return report(_ledger(spark, sf_dir), "sessions", Filters(timezone=NEW_YORK))


@_register("sessions_total", f"SELECT COUNT(DISTINCT session_key) AS total FROM ({O.LEDGER})")
def _sessions_total(spark, sf_dir):
    return M.sessions(_ledger(spark, sf_dir)).total


_EVENT_COLUMNS_SQL = ", ".join(M.EVENT_LIST)


@_register(
    "events_page",
    f"SELECT {_EVENT_COLUMNS_SQL} FROM ({O.LEDGER}) ORDER BY timestamp_ms DESC, event_id LIMIT 100 OFFSET 40",
)
def _events_page(spark, sf_dir):
    return M.event_page(_ledger(spark, sf_dir), limit=100, offset=40).items


@_register(
    "events_next_page",
    f"""SELECT {_EVENT_COLUMNS_SQL} FROM ({O.LEDGER})
 WHERE timestamp_ms < 1705000000000 OR (timestamp_ms = 1705000000000 AND event_id > '5')
 ORDER BY timestamp_ms DESC, event_id LIMIT 200""",
)
def _events_next_page(spark, sf_dir):
    return M.event_page(_ledger(spark, sf_dir), after=(1_705_000_000_000, "5")).items


@_register("runs_page", f"SELECT * FROM ({O.RUNS}) ORDER BY started_at_ms DESC, id LIMIT 50")
def _runs_page(spark, sf_dir):
    return M.run_page(view(spark, sf_dir, "runs"), 50)


@_register(
    "filter_options",
    f"""WITH l AS ({O.LEDGER}), u AS (
 SELECT 'channels' AS dimension, channel AS value FROM l UNION SELECT 'source_products', source_product FROM l
 UNION SELECT 'providers', provider FROM l UNION SELECT 'models', model_normalized FROM l
 UNION SELECT 'sessions', session_key FROM l UNION SELECT 'projects', {O.LABEL} FROM l)
 SELECT * FROM u WHERE value IS NOT NULL AND trim(value) <> ''""",
)
def _filter_options(spark, sf_dir):
    return M.filter_options(_ledger(spark, sf_dir))


@_register(
    "stats",
    f"""SELECT '3' AS schema_version, '2' AS identity_version, COUNT(*) AS total_events,
 COUNT(DISTINCT session_key) AS total_sessions, (SELECT COUNT(*) FROM ({O.RUNS})) AS total_import_runs,
 CAST(SUM(total_tokens) AS BIGINT) AS total_tokens FROM ({O.LEDGER})""",
)
def _stats(spark, sf_dir):
    return M.stats(_ledger(spark, sf_dir), view(spark, sf_dir, "runs"))


@_register(
    "event_costs",
    f"""WITH {O.priced()} SELECT event_id, rule_id, resolution, COALESCE(conf, 'missing') AS confidence, micro_usd,
 coverage_tokens FROM p""",
)
def _event_costs(spark, sf_dir):
    rows = pricing.with_cost(_ledger(spark, sf_dir), load_profile())
    return rows.select(
        "event_id", "rule_id", "resolution", "confidence", "micro_usd", "coverage_tokens"
    )


def _unpriced_sql(cond: str) -> str:
    return f"""WITH {O.priced()} SELECT COALESCE(provider, '') AS provider, channel, model_normalized AS model,
 resolution AS reason, COUNT(*) AS events, CAST(SUM(coverage_tokens) AS BIGINT) AS tokens
 FROM p WHERE {cond} GROUP BY ALL"""


@_register("unpriced_models", _unpriced_sql("resolution LIKE 'missing%'"))
def _unpriced(spark, sf_dir):
    return pricing.unpriced_models(_ledger(spark, sf_dir), load_profile())


@_register("policy_zero_models", _unpriced_sql("resolution = 'policy_zero'"))
def _policy_zero(spark, sf_dir):
    return pricing.unpriced_models(_ledger(spark, sf_dir), load_profile(), pricing.POLICY_ZERO)


@_register(
    "cost_disabled",
    f"""SELECT channel AS label, COUNT(*) AS events, {O._SUMS}, CAST(NULL AS DOUBLE) AS estimated_cost_usd,
 CAST(NULL AS VARCHAR) AS pricing_status FROM ({O.LEDGER}) GROUP BY 1""",
)
def _cost_disabled(spark, sf_dir):
    rows = report(_ledger(spark, sf_dir), "channels", cost_mode="none")
    return rows.select("label", "events", *S.TOKEN_COLUMNS, "estimated_cost_usd", "pricing_status")


@_register(
    "cost_unavailable",
    f"""SELECT channel AS label, COUNT(*) AS events, {O._SUMS}, CAST(NULL AS DOUBLE) AS estimated_cost_usd,
 'unavailable' AS pricing_status, 'pricing_profile_invalid' AS pricing_error_code,
 CAST(0 AS BIGINT) AS priced_events FROM ({O.LEDGER}) GROUP BY 1""",
)
def _cost_unavailable(spark, sf_dir):
    rows = report(_ledger(spark, sf_dir), "channels", pricing_path="/no/such/profile.json")
    columns = ("estimated_cost_usd", "pricing_status", "pricing_error_code", "priced_events")
    return rows.select("label", "events", *S.TOKEN_COLUMNS, *columns)


@_register(
    "cache_rate",
    f"""SELECT channel AS label, CAST(SUM(cache_read_tokens) AS DOUBLE)
 / CAST(SUM(input_tokens + cache_creation_tokens + cache_read_tokens) AS DOUBLE) AS cache_hit_rate
 FROM ({O.LEDGER}) GROUP BY 1""",
)
def _cache_rate(spark, sf_dir):
    rows = M.breakdown(_ledger(spark, sf_dir), "channel", costing=Costing(wanted=False))
    return M.cache_rate(rows).select("label", "cache_hit_rate")


@_register(
    "top_share",
    f"""WITH t AS (SELECT model_normalized AS label, CAST(SUM(total_tokens) AS BIGINT) AS v FROM ({O.LEDGER})
 GROUP BY 1 HAVING SUM(total_tokens) > 0),
 r AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rn, SUM(v) OVER () AS whole FROM t)
 SELECT CASE WHEN rn <= 5 THEN label ELSE 'others' END AS label, CAST(SUM(v) AS BIGINT) AS total_tokens,
 CAST(SUM(v) AS DOUBLE) / CAST(MAX(whole) AS DOUBLE) AS share FROM r GROUP BY 1""",
)
def _top_share(spark, sf_dir):
    """The five largest models and the rest, as shares of all events."""
    return M.top_share(M.breakdown(_ledger(spark, sf_dir), "model", costing=Costing(wanted=False)))


@_register(
    "source_stats",
    f"""SELECT COUNT(*) AS events, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens,
 CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(raw_input_tokens) AS BIGINT) AS raw_input_tokens,
 CAST(SUM(output_tokens) AS BIGINT) AS output_tokens, CAST(SUM(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
 CAST(SUM(reasoning_tokens) AS BIGINT) AS reasoning_tokens FROM ({O.LEDGER}) WHERE channel = 'codex'""",
)
def _source_stats(spark, sf_dir):
    return M.source_stats(_ledger(spark, sf_dir).where(F.col("channel") == "codex"))


@_register(
    "top_models",
    f"""SELECT COALESCE(model_raw, 'unknown') AS model, COUNT(*) AS events FROM ({O.LEDGER})
 WHERE channel = 'codex' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _top_models(spark, sf_dir):
    return M.top_models(_ledger(spark, sf_dir).where(F.col("channel") == "codex"), 5)


@_register(
    "primary_models",
    f"""WITH t AS (SELECT session_key, model_normalized, CAST(SUM(total_tokens) AS BIGINT) AS model_tokens
 FROM ({O.LEDGER}) GROUP BY 1, 2)
 SELECT session_key, arg_min(model_normalized, (-model_tokens, model_normalized)) AS model_normalized,
 MAX(model_tokens) AS model_tokens FROM t GROUP BY 1""",
)
def _primary_models(spark, sf_dir):
    return M.primary_models(_ledger(spark, sf_dir))


@_register(
    "chart_series",
    f"""SELECT {O.bucket('daily', 'UTC')} AS label, round(SUM(total_tokens) / 1e6, 2) AS m_tokens
 FROM ({O.LEDGER}) GROUP BY 1""",
)
def _chart_series(spark, sf_dir):
    return M.chart_series(M.timeseries(_ledger(spark, sf_dir), "daily", costing=Costing(wanted=False)))


@_register(
    "chart_labels",
    f"""SELECT session_key AS label, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens FROM ({O.LEDGER})
 GROUP BY 1 ORDER BY 1 LIMIT 12""",
)
def _chart_labels(spark, sf_dir):
    rows = M.breakdown(_ledger(spark, sf_dir), "session", costing=Costing(wanted=False))
    return M.chart_labels(rows, 12)


@_register(
    "sorted_table",
    f"""SELECT provider, COUNT(*) AS events FROM ({O.LEDGER}) GROUP BY 1
 ORDER BY provider DESC NULLS LAST LIMIT 3""",
)
def _sorted_table(spark, sf_dir):
    rows = _ledger(spark, sf_dir).groupBy("provider").agg(F.count(F.lit(1)).alias("events"))
    return M.sorted_rows(rows, "provider", True, 3)


# Scalars and identity --------------------------------------------------------------------


@_register("project_labels", f"SELECT event_id, {O.LABEL} AS project_label FROM ({O.LEDGER})")
def _project_labels(spark, sf_dir):
    return _ledger(spark, sf_dir).select(
        "event_id", project_label(F.col("project_path")).alias("project_label")
    )


@_register(
    "time_buckets",
    f"""SELECT event_id, {O.bucket('daily', 'Pacific/Auckland', 'ms')} AS daily,
 {O.bucket('weekly', NEW_YORK, 'ms')} AS weekly, {O.bucket('monthly', 'Asia/Kolkata', 'ms')} AS monthly
 FROM (SELECT event_id, timestamp_ms + 86400000 * (CAST(event_id AS BIGINT) % 400) AS ms FROM ({O.LEDGER}))""",
)
def _time_buckets(spark, sf_dir):
    ms = F.col("timestamp_ms") + 86_400_000 * (F.col("event_id").cast("bigint") % 400)
    return _ledger(spark, sf_dir).select(
        "event_id",
        time_bucket(ms, "Pacific/Auckland", "daily").alias("daily"),
        time_bucket(ms, NEW_YORK, "weekly").alias("weekly"),
        time_bucket(ms, "Asia/Kolkata", "monthly").alias("monthly"),
    )


@_register(
    "provider_inference",
    """SELECT doc_id, CASE WHEN contains(m, 'claude') THEN 'anthropic' WHEN contains(m, 'gpt') THEN 'openai'
 WHEN regexp_matches(m, 'o[134]') THEN 'openai' WHEN contains(m, 'gemini') THEN 'google'
 WHEN contains(m, 'codex') THEN 'openai' ELSE 'unknown' END AS provider
 FROM (SELECT doc_id, lower(text) || (CASE doc_id % 5 WHEN 0 THEN 'Gemini' WHEN 1 THEN 'x-Codex'
 ELSE '' END) AS m FROM (SELECT doc_id, text, lower(text) FROM documents)) AS x(doc_id, m)""".replace(
        "lower(text) || (CASE doc_id % 5 WHEN 0 THEN 'Gemini' WHEN 1 THEN 'x-Codex'\n ELSE '' END) AS m",
        "lower(text || (CASE doc_id % 5 WHEN 0 THEN 'Gemini' WHEN 1 THEN 'x-Codex' ELSE '' END)) AS m",
    ),
)
def _provider_inference(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 5 == 0, "Gemini").when(F.col("doc_id") % 5 == 1, "x-Codex")
    name = F.concat("text", F.coalesce(tail, F.lit("")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", N.infer_provider(name).alias("provider"))


def _json_escape(sql: str) -> str:
    return f"replace(replace(replace({sql}, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026')"


_KEY_SQL = f"sha256({_json_escape('to_json([' + chr(39) + 'session:v1' + chr(39) + ', source_product, seed])')})"


@_register(
    "session_keys",
    f"""SELECT event_id, {_KEY_SQL} AS session_key FROM (SELECT *, CASE WHEN session_id IS NOT NULL THEN session_id
 ELSE concat('rel/<&>/', session_key) END AS seed FROM ({O.LEDGER}))""",
)
def _session_keys(spark, sf_dir):
    path = F.concat(F.lit("./rel//x/../<&>/"), F.col("session_key"))
    key = I.session_key(F.col("source_product"), F.col("session_id"), path)
    return _ledger(spark, sf_dir).select("event_id", key.alias("session_key"))


_IDENTITY_KIND = {0: "'message'", 1: "'request'", 2: "'native_event'", 3: "'span'", 4: "'record'", 5: "'turn'", 6: "''"}
_KIND_SQL = "CASE n % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _IDENTITY_KIND.items()) + " END"


@_register(
    "event_ids",
    f"""WITH l AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ({O.LEDGER})),
 r AS (SELECT *, {_KIND_SQL} AS kind, CASE WHEN n % 7 < 4 THEN 'id-' || event_id ELSE '' END AS native,
  CASE WHEN n % 3 = 0 THEN 'seg|' || event_id ELSE '' END AS subkey,
  CASE WHEN n % 2 = 0 THEN 'turn-' || event_id ELSE '' END AS turn, COALESCE(message_id, '') AS msg,
  CASE WHEN n % 5 = 0 THEN 'global' ELSE 'session' END AS scope FROM l),
 c AS (SELECT *, CASE WHEN native <> '' THEN CASE kind WHEN 'message' THEN 'native_message'
   WHEN 'request' THEN 'native_request' ELSE 'native_event' END
  WHEN kind = 'record' THEN 'session_record' WHEN kind = 'turn' AND turn <> '' THEN 'session_turn'
  WHEN msg <> '' THEN 'native_message' WHEN turn <> '' THEN 'session_turn' ELSE 'content_fallback' END AS strategy
 FROM r),
 t AS (SELECT *, CASE strategy WHEN 'native_message' THEN 'message' WHEN 'native_request' THEN 'request'
   WHEN 'native_event' THEN CASE WHEN kind = 'span' THEN 'span' ELSE 'event' END WHEN 'session_record' THEN 'record'
   WHEN 'session_turn' THEN 'turn' ELSE 'content' END AS k2,
  CASE WHEN native <> '' THEN native WHEN strategy = 'session_record' THEN CASE WHEN subkey <> '' THEN subkey
    ELSE 'record' END WHEN strategy = 'native_message' THEN msg WHEN strategy = 'session_turn' THEN turn
   ELSE content_sha256 END AS id2 FROM c)
 SELECT n, strategy AS identity_strategy, CASE WHEN scope = 'global'
  THEN sha256(to_json(['event:v2', source_product, scope, k2, id2, subkey]))
  ELSE sha256(to_json(['event:v2', source_product, scope, session_key, k2, id2, subkey])) END AS event_id FROM t""",
)
def _event_ids(spark, sf_dir):
    n = F.col("event_id").cast("bigint")
    kinds = ("message", "request", "native_event", "span", "record", "turn", "")
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (n % 7).cast("int"))
    native = F.when(n % 7 < 4, F.concat(F.lit("id-"), F.col("event_id")))
    subkey = F.when(n % 3 == 0, F.concat(F.lit("seg|"), F.col("event_id")))
    turn = F.when(n % 2 == 0, F.concat(F.lit("turn-"), F.col("event_id")))
    scope = I.identity_scope(F.when(n % 5 == 0, "Account"))
    choice = I.identity_choice(
        kind, native, subkey, turn, F.col("message_id"), F.lit(None).cast("string"), F.col("content_sha256")
    )
    rows = _ledger(spark, sf_dir).select("*", choice.alias("c"), scope.alias("scope"), subkey.alias("sub"))
    new_id = I.event_id(
        F.col("source_product"), F.col("scope"), F.col("session_key"), F.col("c.kind"), F.col("c.id"), F.col("sub")
    )
    return rows.select(
        n.alias("n"), F.col("c.strategy").alias("identity_strategy"), new_id.alias("event_id")
    )


_FACTS_SQL = ", ".join(
    f"{name} := "
    + {
        "model": "COALESCE(model_raw, '')",
        "channel": "channel",
        "provider": "COALESCE(provider, '')",
        "accounting_profile": "COALESCE(accounting_profile, '')",
    }.get(name, name)
    for name in I.CONTENT_FACTS
)


@_register(
    "content_hashes",
    f"SELECT event_id, sha256('content:v1|' || to_json(struct_pack({_FACTS_SQL}))) AS content_sha256 FROM ({O.LEDGER})",
)
def _content_hashes(spark, sf_dir):
    facts = {name: F.col(name) for name in I.CONTENT_FACTS if name != "model"}
    facts["model"] = F.col("model_raw")
    return _ledger(spark, sf_dir).select("event_id", I.content_sha256(facts).alias("content_sha256"))


# Validation, reconcile, merge ------------------------------------------------------------


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledger(spark, sf_dir).withColumn("n", F.col("event_id").cast("bigint"))
    changed = [c.strip() for c in O._BROKEN_COLUMNS.split(",")]
    new = spark.sql(O.BROKEN + " FROM {rows}", rows=rows)
    return rows.drop(*changed).join(new, "n")


@_register("validation_codes", O.VALIDATION)
def _validation(spark, sf_dir):
    return validate.validated(_broken(spark, sf_dir)).select("n", "reject_code")


@_register(
    "ledger_audit",
    f"""WITH v AS ({O.VALIDATION}), ids AS (SELECT CASE WHEN n % 31 = 1 THEN ' ' ELSE CAST(n AS VARCHAR) END AS id FROM v)
 SELECT reject_code AS code, COUNT(*) AS events FROM v WHERE reject_code IS NOT NULL GROUP BY 1
 UNION ALL SELECT 'duplicate_event_id', CAST(SUM(c) AS BIGINT) FROM (SELECT COUNT(*) AS c FROM ids GROUP BY id
  HAVING COUNT(*) > 1)""",
)
def _audit(spark, sf_dir):
    return quality.audit(_broken(spark, sf_dir))


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = normalize.cleaned(_ledger(spark, sf_dir))
    return merge_decisions(view(spark, sf_dir, "incoming"), stored, 9, Staging(spark, "merge"))


@_register("reconcile_decisions", f"WITH {O.MERGE} SELECT event_id, status, code FROM decided")
def _reconcile(spark, sf_dir):
    return _merge(spark, sf_dir).select("event_id", "status", "code")


@_register(
    "reconcile_filled_rows",
    f"""WITH {O.MERGE} SELECT d.event_id, CASE WHEN d.act = 1 THEN 'acme' ELSE l.provider END AS provider,
 CASE WHEN d.act IN (4, 5) THEN 'gamma-3' ELSE l.model_normalized END AS model_normalized,
 CASE WHEN d.act IN (4, 5) THEN 'direct_event' ELSE l.model_resolution END AS model_resolution,
 CASE WHEN d.act IN (4, 5) THEN FALSE ELSE l.model_is_fallback END AS model_is_fallback,
 sha256('d' || d.event_id) AS content_sha256, CAST(1 AS BIGINT) AS imported_at_ms, CAST(9 AS BIGINT) AS updated_at_ms
 FROM d JOIN decided x ON x.event_id = d.event_id JOIN l ON l.event_id = d.event_id WHERE x.status = 'updated'""",
)
def _filled(spark, sf_dir):
    columns = (
        "event_id",
        "provider",
        "model_normalized",
        "model_resolution",
        "model_is_fallback",
        "content_sha256",
        "imported_at_ms",
        "updated_at_ms",
    )
    rows = _merge(spark, sf_dir).where(F.col("status") == reconcile.UPDATED)
    return rows.select(*[F.col(f"merged.{c}") for c in columns])


@_register(
    "merge_conflicts",
    f"WITH {O.MERGE} SELECT code, COUNT(*) AS count FROM decided WHERE status = 'rejected' GROUP BY 1",
)
def _conflicts(spark, sf_dir):
    return reconcile.conflict_summary(_merge(spark, sf_dir))


@_register(
    "merge_counts",
    f"""WITH {O.MERGE} SELECT COUNT(*) FILTER (status = 'inserted') AS added,
 COUNT(*) FILTER (status = 'updated') AS updated, COUNT(*) FILTER (status = 'skipped') AS skipped,
 COUNT(*) FILTER (status = 'rejected') AS rejected FROM decided""",
)
def _merge_counts(spark, sf_dir):
    return reconcile.status_counts(_merge(spark, sf_dir))


@_register(
    "batch_reconcile",
    f"""WITH l AS ({O.LEDGER}) SELECT event_id, CAST(line AS BIGINT) AS line, CASE line WHEN 0 THEN 'inserted'
 WHEN 1 THEN CASE WHEN model_normalized = 'unknown' THEN 'updated' ELSE 'skipped' END
 WHEN 2 THEN CASE WHEN model_normalized = 'unknown' THEN 'skipped' ELSE 'skipped' END
 ELSE 'rejected' END AS status FROM l, (VALUES (0), (1), (2), (3)) AS v(line)""",
)
def _batch(spark, sf_dir):
    """Each event four times: as it is, with its model found, as it is again, with other tokens."""
    return _batch_against(spark, sf_dir, spark.createDataFrame([], S.STORED_SCHEMA))


def _batch_against(spark: SparkSession, sf_dir: str, stored: DataFrame) -> DataFrame:
    base = normalize.cleaned(_ledger(spark, sf_dir))
    line = F.col("line")
    found = (line == 1) & (F.col("model_normalized") == "unknown")
    rows = base.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns(
        {
            "model_normalized": F.when(found, "found").otherwise(F.col("model_normalized")),
            "model_resolution": F.when(found, "direct_event").otherwise(F.col("model_resolution")),
            "model_is_fallback": F.when(found, False).otherwise(F.col("model_is_fallback")),
            "content_sha256": F.when(found, F.sha2("content_sha256", 256)).otherwise(
                F.col("content_sha256")
            ),
            "output_tokens": F.when(line == 3, F.col("output_tokens") + 1).otherwise(
                F.col("output_tokens")
            ),
        }
    )
    rows = rows.withColumn("reject_code", F.lit(None).cast("string")).withColumn(
        "order_key",
        F.struct(
            F.lit(0).alias("source"),
            F.array(F.lit("a")).alias("path"),
            line.cast("bigint").alias("line"),
            F.lit(0).cast("bigint").alias("part"),
        ),
    )
    outcome = reconcile.reconcile_batch(rows, stored, Staging(spark, "batch"), 9)
    return outcome.decisions.select("event_id", F.col("order_key.line").alias("line"), "status")


_DIFF_MEASURES = ("events", *S.TOKEN_COLUMNS, "micro_usd", "priced_events")


def _diff_side(source: str) -> str:
    parts = [
        f"SELECT '{d}' AS dimension, COALESCE(CAST({d} AS VARCHAR), '') AS value, * FROM p"
        for d in quality.DIFF_DIMENSIONS
    ]
    sums = ", ".join(f"SUM({t}) AS {t}" for t in S.TOKEN_COLUMNS)
    return f"""(WITH {O.priced(source)} SELECT dimension, value, COUNT(*) AS events, {sums},
 SUM(CASE WHEN resolution = 'priced' THEN micro_usd ELSE 0 END) AS micro_usd,
 COUNT(*) FILTER (resolution = 'priced') AS priced_events FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2)"""


@_register(
    "ledger_diff",
    "SELECT * FROM (SELECT COALESCE(c.dimension, b.dimension) AS dimension, COALESCE(c.value, b.value) AS value, "
    + ", ".join(
        f"CAST(COALESCE(c.{m}, 0) - COALESCE(b.{m}, 0) AS BIGINT) AS delta_{m}" for m in _DIFF_MEASURES
    )
    + f" FROM {_diff_side(O.INCOMING)} c FULL JOIN {_diff_side(O.LEDGER)} b"
    + " ON c.dimension = b.dimension AND c.value = b.value) WHERE "
    + " OR ".join(f"delta_{m} <> 0" for m in _DIFF_MEASURES),
)
def _diff(spark, sf_dir):
    incoming = view(spark, sf_dir, "incoming")
    return quality.ledger_diff(incoming, _ledger(spark, sf_dir), load_profile())


# Extractors ------------------------------------------------------------------------------

_OUT = "input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens"


@_register(
    "extract_claude",
    f"""SELECT CAST(event_id AS BIGINT) + 1 AS line_number, timestamp_ms, model_raw AS model,
 session_id AS native_session_id, COALESCE(message_id, 'req-' || event_id) AS native_event_id,
 CASE WHEN message_id IS NULL THEN 'request' ELSE 'message' END AS identity_kind,
 message_id || ':req-' || event_id AS identity_subkey,
 COALESCE(NULLIF(trim(project_path), ''), 'p' || split_part(session_key, '-', 2)) AS project_path,
 {_OUT} FROM ({O.LEDGER}) WHERE channel = 'claude'""",
)
def _extract_claude(spark, sf_dir):
    return claude.extract(V.claude_lines(spark, sf_dir), Staging(spark)).select(
        "line_number",
        "timestamp_ms",
        "model",
        "native_session_id",
        "native_event_id",
        "identity_kind",
        "identity_subkey",
        "project_path",
        "input_tokens",
        "output_tokens",
        "cache_creation_tokens",
        "cache_read_tokens",
    )


@_register(
    "extract_gemini",
    f"""SELECT CAST(event_id AS BIGINT) + 1 AS line_number, timestamp_ms, model_raw AS model,
 session_id AS native_session_id, event_id AS native_event_id, input_tokens, output_tokens, cache_read_tokens,
 reasoning_tokens, input_tokens + cache_read_tokens AS raw_input_tokens,
 COALESCE(session_id, '.gemini/tmp/' || split_part(session_key, '-', 2) || '.jsonl') AS session_id
 FROM ({O.LEDGER}) WHERE channel = 'gemini'""",
)
def _extract_gemini(spark, sf_dir):
    return gemini.extract(V.gemini_lines(spark, sf_dir), Staging(spark)).select(
        "line_number",
        "timestamp_ms",
        "model",
        "native_session_id",
        "native_event_id",
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "reasoning_tokens",
        "raw_input_tokens",
        "session_id",
    )


_BUDDY = f"""l AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ({O.LEDGER}) WHERE channel = 'workbuddy'),
 j AS (SELECT *, input_tokens + cache_creation_tokens + cache_read_tokens AS prompt FROM l),
 r AS (SELECT *, CASE WHEN n % 13 = 0 THEN 'invalid_usage_multiplicity'
  WHEN n % 11 = 0 OR prompt + output_tokens = 0 THEN 'invalid_token_totals' END AS reason FROM j)"""


@_register(
    "extract_workbuddy",
    f"""WITH {_BUDDY} SELECT n + 1 AS line_number, COALESCE(model_raw, 'auto') AS model,
 COALESCE(model_raw, 'unknown') AS model_normalized, model_raw IS NULL AS model_is_fallback, {_OUT}, reasoning_tokens,
 prompt + output_tokens AS total_tokens FROM r WHERE reason IS NULL""",
)
def _extract_workbuddy(spark, sf_dir):
    records, _ = workbuddy.extract(V.workbuddy_lines(spark, sf_dir), Staging(spark))
    return records.select(
        "line_number",
        "model",
        "model_normalized",
        "model_is_fallback",
        "input_tokens",
        "output_tokens",
        "cache_creation_tokens",
        "cache_read_tokens",
        "reasoning_tokens",
        "total_tokens",
    )


@_register(
    "refused_lines",
    f"""WITH {_BUDDY}, f AS (SELECT '/logs/projects/' || split_part(session_key, '-', 2) || '.jsonl' AS file_path, n + 1 AS ln,
  reason FROM r WHERE reason IS NOT NULL),
 c AS (SELECT file_path, reason, COUNT(*) AS k FROM f GROUP BY 1, 2),
 s AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ln) AS rn FROM f)
 SELECT file_path, (SELECT CAST(SUM(k) AS BIGINT) FROM c WHERE c.file_path = g.file_path) AS total,
  (SELECT string_agg(reason || '=' || k, ', ' ORDER BY reason) FROM c WHERE c.file_path = g.file_path) AS reasons,
  (SELECT string_agg('line ' || ln || ' ' || reason, ', ' ORDER BY ln) FROM s
   WHERE s.file_path = g.file_path AND rn <= 5) AS samples
 FROM (SELECT DISTINCT file_path FROM f) g""",
)
def _refused(spark, sf_dir):
    _, refused = workbuddy.extract(V.workbuddy_lines(spark, sf_dir), Staging(spark))
    return workbuddy.summarize_refused(refused).select("file_path", "total", "reasons", "samples")


@_register(
    "extract_copilot_spans",
    f"""SELECT CAST(event_id AS BIGINT) AS n, 'resp-' || event_id AS native_event_id, model_raw AS model,
 session_id AS native_session_id, timestamp_ms, {_OUT}, reasoning_tokens,
 input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + reasoning_tokens AS total_tokens
 FROM ({O.LEDGER}) WHERE channel = 'copilot'""",
)
def _extract_spans(spark, sf_dir):
    records = copilot.extract(V.copilot_span_lines(spark, sf_dir), Staging(spark))
    return records.select(
        F.call_function("div", F.col("line_number") - 1, F.lit(2)).alias("n"),
        "native_event_id",
        "model",
        "native_session_id",
        "timestamp_ms",
        "input_tokens",
        "output_tokens",
        "cache_creation_tokens",
        "cache_read_tokens",
        "reasoning_tokens",
        "total_tokens",
    )


@_register(
    "extract_copilot_sessions",
    f"""SELECT CAST(event_id AS BIGINT) + 2 AS line_number, model_normalized AS model,
 'session-' || split_part(session_key, '-', 2) AS native_session_id, '/repo' AS project_path,
 'line:' || (CAST(event_id AS BIGINT) + 2) || '|' || model_normalized AS identity_subkey, timestamp_ms, {_OUT},
 reasoning_tokens FROM ({O.LEDGER}) WHERE channel = 'copilot'
 AND input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + reasoning_tokens <> 0""",
)
def _extract_summaries(spark, sf_dir):
    records = copilot.extract(V.copilot_session_lines(spark, sf_dir), Staging(spark))
    return records.select(
        "line_number",
        "model",
        "native_session_id",
        "project_path",
        "identity_subkey",
        "timestamp_ms",
        "input_tokens",
        "output_tokens",
        "cache_creation_tokens",
        "cache_read_tokens",
        "reasoning_tokens",
    )


@_register(
    "line_scan",
    f"""SELECT event_id, row_number() OVER (PARTITION BY channel, CAST(event_id AS BIGINT) // 20000
  ORDER BY CAST(event_id AS BIGINT)) AS line_number, channel FROM ({O.LEDGER})""",
)
def _line_scan(spark, sf_dir):
    """Line numbers of files written from the table, each file read in several splits.

    A channel has one file for every 20000 event ids, so more events are more files and tasks.
    """
    staging = Staging(spark, "lines")
    number = F.col("event_id").cast("bigint")
    part = F.call_function("div", number, F.lit(20_000)).alias("part")
    rows = _ledger(spark, sf_dir).select("channel", part, "event_id")
    body = F.to_json(F.struct("event_id", F.repeat(F.lit("x"), 200).alias("pad"))).alias("value")
    ordered = rows.repartition("channel", "part").sortWithinPartitions("channel", "part", number)
    path = f"{staging.root}/logs"
    ordered.select("channel", "part", body).write.partitionBy("channel", "part").text(path)
    scan = lines.scan_lines(spark, [path], suffix=".txt", staging=staging)
    return scan.select(
        F.get_json_object("value", "$.event_id").alias("event_id"),
        "line_number",
        F.regexp_extract("file_path", "channel=([^/]+)/", 1).alias("channel"),
    )


# Counters and ordered chain --------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    nothing = F.lit(None).cast("bigint")
    cumulative = snapshot(
        c("total"), c("total") % 1, c("output"), c("reasoning"), c("total") + c("output")
    )
    none = F.when(F.lit(False), snapshot(*[nothing] * 5))
    last = F.when(
        c("line_number") % 3 == 0, snapshot(c("n"), nothing, c("n") % 97, nothing, c("n") + c("n") % 97)
    )
    return view(spark, sf_dir, "counters").select(
        "file_path",
        c("file_path").alias("session"),
        "line_number",
        cumulative.alias("cumulative"),
        last.alias("last"),
        none.alias("headless"),
    )


@_register(
    "counter_deltas",
    f"""WITH {O.DELTAS} SELECT file_path, line_number,
 CASE WHEN d_tot >= d_in + GREATEST(d_out, d_rea) THEN d_in WHEN GREATEST(d_out, d_rea) >= d_tot THEN 0
  ELSE LEAST(d_in, d_tot - GREATEST(d_out, d_rea)) END AS input_tokens,
 CASE WHEN d_tot < d_in + GREATEST(d_out, d_rea) AND GREATEST(d_out, d_rea) >= d_tot THEN LEAST(d_out, d_tot)
  ELSE d_out END AS output_tokens, d_tot AS total_tokens, d_tot <> d_in + GREATEST(d_out, d_rea) AS partial FROM u""",
)
def _deltas(spark, sf_dir):
    rows = cumulative_deltas(_snapshots(spark, sf_dir), POLICY_LEDGER)
    return rows.select(
        "file_path", "line_number", "input_tokens", "output_tokens", "total_tokens", "partial"
    )


@_register(
    "counter_deltas_compatible",
    f"""WITH c AS ({O.COUNTERS}), w AS (SELECT *, lag(total) OVER win AS pt, lag(output) OVER win AS po,
  lag(reasoning) OVER win AS pr FROM c WINDOW win AS (PARTITION BY file_path ORDER BY line_number))
 SELECT file_path, line_number, CASE WHEN total = pt AND output = po AND reasoning = pr THEN 0
  WHEN line_number % 3 = 0 THEN n + n % 97
  ELSE GREATEST(total + output - COALESCE(pt + po, 0), 0) END AS total_tokens,
 CASE WHEN NOT COALESCE(total = pt AND output = po AND reasoning = pr, FALSE) AND line_number % 3 <> 0
  THEN 'codex_total_delta' ELSE 'codex_last_token_usage' END AS method FROM w""",
)
def _deltas_compatible(spark, sf_dir):
    rows = cumulative_deltas(_snapshots(spark, sf_dir), POLICY_COMPATIBLE)
    return rows.select("file_path", "line_number", "total_tokens", "method")


@_register(
    "carry_forward",
    f"""SELECT file_path, line_number, CAST(SUM(n) OVER w AS BIGINT) AS units,
 last_value(CASE WHEN role = 'user' THEN line_number END IGNORE NULLS) OVER w AS last_user,
 MAX(n) OVER (PARTITION BY file_path ORDER BY line_number) AS largest FROM ({O.COUNTERS})
 WINDOW w AS (PARTITION BY file_path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""".replace(
        "CAST(SUM(n) OVER w AS BIGINT)", "COALESCE(CAST(SUM(n) OVER w AS BIGINT), 0)"
    ),
)
def _carry(spark, sf_dir):
    """Carried values with blocks of three lines, so that most values cross blocks."""
    file = ("file_path",)
    user_line = F.when(F.col("role") == "user", F.col("line_number"))
    specs = [
        Carry("units", F.col("n"), file, "sum"),
        Carry("last_user", user_line, file),
        Carry("largest", F.col("n"), file, "max", inclusive=True),
    ]
    rows = carry(view(spark, sf_dir, "counters"), specs, block_rows=3)
    return rows.select("file_path", "line_number", "units", "last_user", "largest")


@_register(
    "codex_records",
    f"""WITH {O.DELTAS}, m AS (SELECT *, last_value(CASE WHEN role = 'user' THEN 'm' || ((line_number - 1) % 3) END IGNORE NULLS)
  OVER (PARTITION BY file_path ORDER BY line_number) AS declared FROM u)
 SELECT file_path AS source_file, (line_number - 1) * 3 + 2 AS line_number, COALESCE(declared, 'unknown') AS model,
 CASE WHEN declared IS NULL THEN 'unknown' ELSE 'turn_context' END AS model_resolution,
 CASE WHEN (line_number - 1) % 2 = 1 THEN 't' || (line_number - 1) END AS turn_id,
 CASE WHEN (line_number - 1) % 2 = 1 THEN 'turn' ELSE 'record' END AS identity_kind,
 d_tot AS total_tokens, source_total + (SELECT output FROM c WHERE c.file_path = m.file_path
  AND c.line_number = m.line_number) AS source_total_tokens FROM m WHERE d_tot > 0 OR d_in > 0 OR d_out > 0 OR d_rea > 0""",
)
def _codex_records(spark, sf_dir):
    staging = Staging(spark, "codex")
    rows = codex.extract(V.codex_lines(spark, sf_dir), staging)
    result = replay.build_records(rows, POLICY_LEDGER, staging)
    return result.records.select(
        "source_file",
        "line_number",
        "model",
        "model_resolution",
        "turn_id",
        "identity_kind",
        "total_tokens",
        "source_total_tokens",
    )


# How many rows a forked log keeps, from how it was made.
_FORKS = f"""k AS (SELECT conv_id, MAX(line_number) AS turns FROM ({O.COUNTERS}) GROUP BY 1),
 f AS (SELECT *, LEAST(conv_id % 4 + 1, turns) AS copies, conv_id % 5 = 0 AS orphan,
  conv_id % 7 = 0 AND LEAST(conv_id % 4 + 1, turns) > 1 AS burst FROM k WHERE conv_id % 3 = 0)"""


@_register(
    "fork_replay",
    f"""WITH {_FORKS} SELECT '/logs/sessions/q' || conv_id || '.jsonl' AS source_file, CAST(2 AS BIGINT) AS events,
 CAST(2000017 AS BIGINT) AS total_tokens FROM f WHERE NOT orphan OR burst
 UNION ALL SELECT '/logs/sessions/p' || conv_id || '.jsonl', COUNT(*) FILTER (n > 0),
  CAST(SUM(n + n % 97) AS BIGINT) FROM ({O.COUNTERS}) GROUP BY 1 HAVING SUM(n) > 0""",
)
def _fork_replay(spark, sf_dir):
    staging = Staging(spark, "forks")
    rows = codex.extract(V.fork_lines(spark, sf_dir), staging)
    records = replay.build_records(rows, POLICY_LEDGER, staging).records
    return records.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("events"), F.sum("total_tokens").alias("total_tokens")
    )


@_register(
    "replay_diagnostics",
    f"""WITH {_FORKS}, s AS (SELECT f.conv_id, orphan, CAST(COUNT(*) AS BIGINT) AS ev, CAST(SUM(n + n % 97) AS BIGINT) AS tok
  FROM f JOIN ({O.COUNTERS}) c ON c.conv_id = f.conv_id AND c.line_number <= copies
  WHERE NOT orphan OR burst GROUP BY 1, 2),
 t AS (SELECT (SELECT COUNT(*) FROM f) AS forks, (SELECT COUNT(*) FROM f WHERE orphan) AS orphans,
  (SELECT COUNT(*) FROM f WHERE orphan AND NOT burst) AS stuck,
  (SELECT CAST(COALESCE(SUM(ev), 0) AS BIGINT) FROM s WHERE NOT orphan) AS xe,
  (SELECT CAST(COALESCE(SUM(tok), 0) AS BIGINT) FROM s WHERE NOT orphan) AS xt,
  (SELECT CAST(COALESCE(SUM(ev), 0) AS BIGINT) FROM s WHERE orphan) AS re,
  (SELECT CAST(COALESCE(SUM(tok), 0) AS BIGINT) FROM s WHERE orphan) AS rt)
 SELECT code, CAST(a AS BIGINT) AS count, CAST(b AS BIGINT) AS events, CAST(d AS BIGINT) AS tokens FROM (
  SELECT 'codex_fork_files' AS code, forks AS a, 0 AS b, 0 AS d FROM t
  UNION ALL SELECT 'codex_parent_resolved', forks - orphans, 0, 0 FROM t
  UNION ALL SELECT 'codex_parent_missing', orphans, 0, 0 FROM t
  UNION ALL SELECT 'codex_parent_ambiguous', 0, 0, 0 UNION ALL SELECT 'codex_replay_unresolved', stuck, 0, 0 FROM t
  UNION ALL SELECT 'codex_replay_exact', 0, xe, xt FROM t UNION ALL SELECT 'codex_replay_rewritten', 0, re, rt FROM t
  UNION ALL SELECT 'codex_replay_events', 0, xe + re, 0 FROM t UNION ALL SELECT 'codex_replay_tokens', 0, 0, xt + rt FROM t
  UNION ALL SELECT 'codex_replay_file_changed', 0, 0, 0 UNION ALL SELECT 'codex_replay_plan_failed', 0, 0, 0
  UNION ALL SELECT 'codex_accounting_partial', 0, 0, 0)""",
)
def _replay_diagnostics(spark, sf_dir):
    staging = Staging(spark, "forks")
    rows = codex.extract(V.fork_lines(spark, sf_dir), staging)
    return replay.build_records(rows, POLICY_LEDGER, staging).diagnostics


@_register(
    "policy_comparison",
    f"""WITH {O.DELTAS}, a AS (SELECT COUNT(*) FILTER (d_tot > 0) AS le,
  CAST(SUM(d_tot) AS BIGINT) AS lt FROM u),
 b AS (SELECT COUNT(*) FILTER (t > 0) AS ce, CAST(SUM(t) AS BIGINT) AS ct FROM (
  SELECT GREATEST(total + output - COALESCE(pt + po, 0), 0) AS t FROM w))
 SELECT ce - le AS delta_events, ct - lt AS delta_tokens FROM a, b""",
)
def _policies(spark, sf_dir):
    staging = Staging(spark, "policies")
    rows = codex.extract(V.codex_lines(spark, sf_dir), staging)
    return quality.policy_deltas(quality.compare_policies(rows, staging).stats)


@_register(
    "source_diagnostics",
    f"""WITH c AS ({O.COUNTERS}), t AS (SELECT COUNT(*) AS u, COUNT(*) FILTER (role = 'user') AS d,
  COUNT(*) FILTER ((line_number - 1) % 2 = 1) AS k, COUNT(*) FILTER (total = 0) AS z FROM c)
 SELECT metric, name, CAST(n AS BIGINT) AS n FROM (SELECT 'usage' AS metric, 'lines' AS name, u + d + k AS n FROM t
 UNION ALL SELECT 'usage', 'bad_json', 0 UNION ALL SELECT 'usage', 'token_count', u FROM t
 UNION ALL SELECT 'usage', 'last_token_usage', 0 UNION ALL SELECT 'usage', 'total_token_usage', u FROM t
 UNION ALL SELECT 'usage', 'last_and_total_usage', 0 UNION ALL SELECT 'usage', 'total_only_usage', u FROM t
 UNION ALL SELECT 'usage', 'all_zero_usage', z FROM t UNION ALL SELECT 'usage', 'task_complete', k FROM t
 UNION ALL SELECT 'usage', 'task_complete_with_turn', k FROM t
 UNION ALL SELECT 'type', 'event_msg', u + k FROM t UNION ALL SELECT 'type', 'turn_context', d FROM t
 UNION ALL SELECT 'payload_type', 'token_count', u FROM t UNION ALL SELECT 'payload_type', 'task_complete', k FROM t)""",
)
def _diagnostics(spark, sf_dir):
    return quality.source_diagnostics(V.codex_lines(spark, sf_dir))


# Duplicates ------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with shared message ids: 40 events per message, four requests, side chains."""
    n = F.col("event_id").cast("bigint")
    rows = _ledger(spark, sf_dir).withColumn("n", n)
    return rows.select(
        "n",
        F.when(F.col("n") % 29 != 0, F.concat(F.lit("m"), (F.col("n") % 250).cast("string"))).alias(
            "message_id"
        ),
        F.when(F.col("n") % 4 != 0, F.concat(F.lit("r"), (F.col("n") % 4).cast("string"))).alias(
            "request_id"
        ),
        ((F.col("n") % 250 < 60) | (F.col("n") % 3 == 0)).alias("is_sidechain"),
        (F.col("input_tokens") % 50).alias("input_tokens"),
        F.lit(0).cast("bigint").alias("output_tokens"),
        F.lit(0).cast("bigint").alias("cache_creation_tokens"),
        F.lit(0).cast("bigint").alias("cache_read_tokens"),
        F.lit(0).cast("bigint").alias("total_tokens"),
        F.when(F.col("n") % 5 == 0, "fast").alias("usage_speed"),
        F.struct(F.col("n").alias("line")).alias("order_key"),
    )


@_register(
    "message_dedupe",
    f"""WITH r AS (SELECT CAST(event_id AS BIGINT) AS n, input_tokens % 50 AS size FROM ({O.LEDGER})),
 m AS (SELECT *, CASE WHEN n % 29 <> 0 THEN n % 250 END AS msg, n % 4 AS req,
  (n % 250 < 60 OR n % 3 = 0) AS side, n % 5 = 0 AS fast FROM r),
 x AS (SELECT *, bool_and(side) OVER (PARTITION BY msg) AS all_side FROM m),
 y AS (SELECT *, row_number() OVER (PARTITION BY msg, CASE WHEN all_side THEN -1 ELSE req END
  ORDER BY side, size DESC, fast DESC, n) AS rn FROM x WHERE msg IS NOT NULL AND (all_side OR NOT side))
 SELECT n FROM y WHERE rn = 1 UNION ALL SELECT n FROM m WHERE msg IS NULL""",
)
def _message_dedupe(spark, sf_dir):
    return deduplicate_messages(_messages(spark, sf_dir)).select("n")


@_register(
    "first_occurrences",
    f"SELECT MIN(CAST(event_id AS BIGINT)) AS n, session_key FROM ({O.LEDGER}) GROUP BY 2",
)
def _first(spark, sf_dir):
    n = F.col("event_id").cast("bigint")
    rows = _ledger(spark, sf_dir).select(n.alias("n"), "session_key", F.struct(n.alias("line")).alias("order_key"))
    return first_occurrences(rows, "session_key").select("n", "session_key")


# Sinks -----------------------------------------------------------------------------------


@_register(
    "ledger_round_trip",
    f"""SELECT strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') AS event_date_utc, {O.LABEL} AS project_label,
 COUNT(*) AS events, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens FROM ({O.LEDGER}) GROUP BY 1, 2""",
)
def _round_trip(spark, sf_dir):
    path = f"{Staging(spark, 'ledger').root}/events"
    ledger.write_ledger(normalize.cleaned(_ledger(spark, sf_dir)), path)
    stored = ledger.read_ledger(spark, path)
    return stored.groupBy("event_date_utc", "project_label").agg(
        F.count(F.lit(1)).alias("events"), F.sum("total_tokens").alias("total_tokens")
    )


@_register(
    "redacted_export",
    f"""SELECT event_id, content_sha256, CAST(NULL AS VARCHAR) AS project_path, CAST(NULL AS VARCHAR) AS source_file,
 total_tokens FROM ({O.LEDGER})""",
)
def _redacted(spark, sf_dir):
    columns = ("event_id", "content_sha256", "project_path", "source_file", "total_tokens")
    return ledger.redacted(_ledger(spark, sf_dir)).select(*columns)


@_register(
    "json_report",
    f"SELECT channel AS label, COUNT(*) AS events, {O._SUMS} FROM ({O.LEDGER}) GROUP BY 1",
)
def _json_report(spark, sf_dir):
    path = f"{Staging(spark, 'report').root}/channels"
    rows = report(_ledger(spark, sf_dir), "channels", cost_mode="none")
    columns = ("label", "events", *S.TOKEN_COLUMNS)
    rows = rows.select(*columns)
    ledger.write_json_report(rows, path)
    return spark.read.schema(rows.schema).json(path)


# Jobs on files written from the tables ----------------------------------------------------

_OUTCOMES = """SELECT '{0}' AS source, CASE WHEN n % 13 = 5 THEN 'not_a_json_object' WHEN n % 17 = 3 THEN 'other'
 ELSE 'record' END AS outcome, COUNT(*) AS n FROM l WHERE channel = '{0}' GROUP BY 1, 2"""


@_register(
    "line_outcomes",
    f"WITH l AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ({O.LEDGER})) "
    + " UNION ALL ".join(_OUTCOMES.format(c) for c in ("claude", "gemini")),
)
def _outcomes(spark, sf_dir):
    """Every line ends as a record, a reject or a line without usage; some lines are cut short."""
    staging, out = Staging(spark, "outcomes"), None
    parts = (
        ("claude", V.claude_lines, claude.extract),
        ("gemini", V.gemini_lines, gemini.extract),
    )
    for source, lines_of, extract in parts:
        n = F.col("line_number") - 1
        value = (
            F.when(n % 13 == 5, F.substr(F.col("value"), F.lit(1), F.length("value") - 1))
            .when(n % 17 == 3, F.lit('{"note":"nothing"}'))
            .otherwise(F.col("value"))
        )
        raw = staging.put(lines_of(spark, sf_dir).withColumn("value", value), "raw")
        bad = []
        records = extract(raw, staging, None, bad).select("line_number", F.lit("record").alias("outcome"))
        known = records.unionByName(bad[0].select("line_number", F.col("reason").alias("outcome")))
        each = raw.join(known, "line_number", "left").select(
            F.lit(source).alias("source"), F.coalesce("outcome", F.lit("other")).alias("outcome")
        )
        out = each if out is None else out.unionByName(each)
    return out.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _written_logs(spark: SparkSession, sf_dir: str, staging: Staging) -> str:
    """Session logs as files, one per user: one line per event, every thirteenth cut short."""
    lines_of = V.claude_lines(spark, sf_dir)
    cut = F.when(
        (F.col("line_number") - 1) % 13 == 5, F.substr(F.col("value"), F.lit(1), F.length("value") - 1)
    ).otherwise(F.col("value"))
    root = f"{staging.root}/projects"
    by_user = F.regexp_extract("file_path", "/(p[0-9]+)/", 1).alias("user")
    rows = lines_of.select(by_user, "line_number", cut.alias("value")).repartition("user")
    rows = rows.sortWithinPartitions("user", "line_number").drop("line_number")
    rows.write.partitionBy("user").text(root)
    return root


_IMPORTED = f"""l AS (SELECT *, CAST(event_id AS BIGINT) AS n FROM ({O.LEDGER}) WHERE channel = 'claude'),
 c AS (SELECT COUNT(*) FILTER (n % 13 <> 5) AS good, COUNT(*) FILTER (n % 13 = 5) AS bad FROM l)"""


def _two_imports(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    staging = Staging(spark, "imports")
    logs = {"claude": [_written_logs(spark, sf_dir, staging)]}
    stored, runs = f"{staging.root}/ledger", f"{staging.root}/runs"
    # The files have Spark's own suffix.
    for n in (1, 2):
        import_logs(spark, logs, stored, runs, n, f"run-{n}", grace_minutes=None, suffix=".txt")
    return stored, runs


@_register(
    "import_twice",
    f"""WITH {_IMPORTED} SELECT 'run-1' AS id, good AS events_added, 0 AS events_skipped, 0 AS events_rejected,
 bad || ' rejects; claude not_a_json_object: ' || bad AS error FROM c
 UNION ALL SELECT 'run-2', 0, good, 0, bad || ' rejects; claude not_a_json_object: ' || bad FROM c""",
)
def _import_twice(spark, sf_dir):
    """The second import of the same files adds nothing."""
    _, runs = _two_imports(spark, sf_dir)
    return ledger.read_runs(spark, runs).select(
        "id", "events_added", "events_skipped", "events_rejected", "error"
    )


@_register(
    "import_rejects",
    f"""WITH {_IMPORTED} SELECT run_id, 'claude' AS source, 'not_a_json_object' AS reason, COUNT(*) AS n
 FROM l, (VALUES ('run-1'), ('run-2')) AS r(run_id) WHERE n % 13 = 5 GROUP BY 1""",
)
def _import_rejects(spark, sf_dir):
    _, runs = _two_imports(spark, sf_dir)
    rows = ledger.read_rejects(spark, f"{runs}-rejects")
    # every reject names a line of its own
    return rows.distinct().groupBy("run_id", "source", "reason").agg(F.count(F.lit(1)).alias("n"))


@_register(
    "imported_tokens",
    f"""WITH {_IMPORTED} SELECT timestamp_ms, COUNT(*) AS events, {", ".join(f"CAST(SUM({t}) AS BIGINT) AS {t}" for t in
 ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"))}
 FROM l WHERE n % 13 <> 5 GROUP BY 1""",
)
def _imported_tokens(spark, sf_dir):
    stored, _ = _two_imports(spark, sf_dir)
    sums = [
        F.sum(t).alias(t)
        for t in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    ]
    rows = ledger.read_ledger(spark, stored).groupBy("timestamp_ms")
    return rows.agg(F.count(F.lit(1)).alias("events"), *sums)


@_register(
    "ledger_after_merge",
    f"""WITH {O.MERGE}, u AS (SELECT l.event_id, CASE WHEN x.status = 'updated' AND d.act = 1 THEN 'acme' ELSE l.provider END
   AS provider, CASE WHEN x.status = 'updated' AND d.act IN (4, 5) THEN 'gamma-3' ELSE l.model_normalized END
   AS model_normalized, l.total_tokens, l.turn_id FROM l LEFT JOIN d USING (event_id) LEFT JOIN decided x USING (event_id)
  UNION ALL SELECT event_id || 'x', provider, model_normalized, total_tokens, turn_id FROM l WHERE n % 3 = 1)
 SELECT event_id, provider, model_normalized, total_tokens FROM u""",
)
def _after_merge(spark, sf_dir):
    """Both ledgers as files; what the second may change is merged into the first."""
    staging = Staging(spark, "merged")
    stored, incoming = f"{staging.root}/first", f"{staging.root}/second"
    ledger.write_ledger(normalize.cleaned(_ledger(spark, sf_dir)), stored)
    allowed = _merge(spark, sf_dir).where(F.col("status") != reconcile.REJECTED).select("event_id")
    ledger.write_ledger(view(spark, sf_dir, "incoming").join(allowed, "event_id", "left_semi"), incoming)
    merge_ledgers(spark, incoming, stored, 9)
    columns = ("event_id", "provider", "model_normalized", "total_tokens")
    return ledger.read_ledger(spark, stored).select(*columns)


@_register(
    "batch_reconcile_stored",
    f"""WITH l AS (SELECT *, CAST(event_id AS BIGINT) % 2 = 0 AS known FROM ({O.LEDGER}))
 SELECT event_id, CAST(line AS BIGINT) AS line, CASE WHEN line = 3 THEN 'rejected'
 WHEN line = 0 THEN CASE WHEN known THEN 'skipped' ELSE 'inserted' END
 WHEN line = 1 AND model_normalized = 'unknown' THEN 'updated' ELSE 'skipped' END AS status
 FROM l, (VALUES (0), (1), (2), (3)) AS v(line)""",
)
def _batch_stored(spark, sf_dir):
    """The batch of ``batch_reconcile`` against a ledger that has every second event."""
    even = F.col("event_id").cast("bigint") % 2 == 0
    stored = normalize.with_derived(normalize.cleaned(_ledger(spark, sf_dir)).where(even))
    return _batch_against(spark, sf_dir, stored.select(*S.STORED_SCHEMA.fieldNames()))


# Every reason for which an envelope is refused, and what is wrong with the line.
_FAULTS = f"""WITH {_BUDDY}, f AS (SELECT *, CASE n % 7 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'missing_required_fields'
 ELSE CASE WHEN reason IS NOT NULL THEN reason WHEN n % 7 = 3 THEN 'invalid_token_details' END END AS why FROM r)"""


@_register("refused_reasons", f"{_FAULTS} SELECT n + 1 AS line_number, why AS reason FROM f WHERE why IS NOT NULL")
def _refused_reasons(spark, sf_dir):
    n = F.col("line_number") - 1
    value = (
        F.when(n % 7 == 1, F.concat(F.col("value"), F.lit("}")))
        .when(n % 7 == 2, F.regexp_replace("value", '^\\{"id"', '{"idx"'))
        .when(n % 7 == 3, F.regexp_replace("value", '"reasoning_tokens":[0-9]+', '"reasoning_tokens":99999999999'))
        .otherwise(F.col("value"))
    )
    lines_of = V.workbuddy_lines(spark, sf_dir).withColumn("value", value)
    _, refused = workbuddy.extract(lines_of, Staging(spark))
    return refused.select("line_number", "reason")


@_register(
    "extract_gemini_documents",
    f"""WITH g AS (SELECT *, CAST(event_id AS BIGINT) AS n, split_part(session_key, '-', 2) AS who FROM ({O.LEDGER})
  WHERE channel = 'gemini')
 SELECT '/home/.gemini/tmp/' || who || '.json' AS source_file, row_number() OVER (PARTITION BY who ORDER BY n) AS line_number,
 event_id AS native_event_id, model_raw AS model, input_tokens, output_tokens, reasoning_tokens FROM g""",
)
def _gemini_documents(spark, sf_dir):
    """The lines of a log as the elements of one array per file.

    A user has one file for every 20000 event ids, so more events are more files and tasks. The rows
    are numbered on over the files of a user by the line counts of the files before.
    """
    part = F.call_function("div", F.col("line_number") - 1, F.lit(20_000)).alias("part")
    log = F.regexp_replace("file_path", "jsonl$", "json").alias("log")
    path = F.concat(F.regexp_replace("log", "json$", ""), F.col("part"), F.lit(".json")).alias("file_path")
    files = V.gemini_lines(spark, sf_dir).select(log, part, "line_number", "value").groupBy("log", "part")
    values = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "value"))), lambda x: x["value"])
    whole = files.agg(F.concat(F.lit("[ "), F.concat_ws(",\n", values), F.lit("]\n")).alias("value"))
    rows = gemini.extract_documents(whole.select(path, "value"), Staging(spark))

    # one row per file
    before = Window.partitionBy("log").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    starts = files.count().select(path.alias("source_file"), "log", start)
    return rows.join(starts, "source_file").select(
        F.col("log").alias("source_file"),
        (F.col("start") + F.col("line_number")).alias("line_number"),
        "native_event_id",
        "model",
        "input_tokens",
        "output_tokens",
        "reasoning_tokens",
    )


_EVERY = f"""g AS (SELECT *, CAST(event_id AS BIGINT) AS n, split_part(session_key, '-', 2) AS who FROM ({O.LEDGER})
  WHERE channel = 'gemini'),
 d AS (SELECT who AS name, * FROM g UNION ALL SELECT 'all', * FROM g UNION ALL SELECT 'broken', * FROM g WHERE n % 10 = 3)"""


@_register(
    "documents_of_every_size",
    f"""WITH {_EVERY}
 SELECT name, row_number() OVER (PARTITION BY name ORDER BY n) AS line_number, 'record' AS outcome, event_id AS native_event_id,
 input_tokens, output_tokens, reasoning_tokens FROM d WHERE name <> 'broken'
 UNION ALL SELECT 'broken', NULL, 'not_a_json_object', NULL, NULL, NULL, NULL FROM d WHERE name = 'broken' GROUP BY ()
 HAVING COUNT(*) > 0""",
)
def _every_size(spark, sf_dir):
    """A file with one array per user, one with everything and one whose array is not closed, read
    in splits of 64 kB: an array may have any number of them."""
    staging = Staging(spark, "arrays")
    who, place = F.regexp_extract("file_path", "([^/]+)[.]jsonl$", 1), F.col("line_number") - 1
    broken = F.when(place % 10 == 3, F.array(F.lit("broken"))).otherwise(F.array().cast("array<string>"))
    names = F.explode(F.concat(F.array(who, F.lit("all")), broken)).alias("name")
    elements = V.gemini_lines(spark, sf_dir).select(names, "line_number", "value")
    # The rows of a file are dealt once, and nothing is joined to them after that: one task writes
    # them. The number of tasks is fixed, as small files cost by their number, not by their bytes.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    elements = elements.repartition(tasks, "name")
    lines_of = Window.partitionBy("name").orderBy("line_number")
    opening = F.when(F.row_number().over(lines_of) == 1, "[").otherwise(",")
    ends = F.lead(F.lit(1)).over(lines_of).isNull() & (F.col("name") != "broken")
    ending = F.when(ends, "\n]").otherwise("")
    files = elements.select("name", F.concat(opening, "value", ending).alias("value"))
    files.write.partitionBy("name").text(f"{staging.root}/files")

    name, bad = "spark.sql.files.maxPartitionBytes", []
    size = spark.conf.get(name)
    spark.conf.set(name, "65536")
    try:
        parts = jsonfile.scan_fragments(spark, [f"{staging.root}/files"], ".txt", None, staging)
    finally:
        spark.conf.set(name, size)
    records = gemini.extract_fragments(parts, staging, bad)
    of = lambda path: F.regexp_extract(path, "/name=([^/]+)/", 1).alias("name")
    counts = ("input_tokens", "output_tokens", "reasoning_tokens")
    out = records.select(of("source_file"), "line_number", F.lit("record").alias("outcome"), "native_event_id", *counts)
    for more in bad:
        told = more.select(of("file_path"), "line_number", F.col("reason").alias("outcome"))
        out = out.unionByName(told, allowMissingColumns=True)
    return out


@_register("canonical_totals", f"SELECT event_id, total_tokens AS total FROM ({O.LEDGER})")
def _canonical_totals(spark, sf_dir):
    names = ("token_accounting_method", "input_tokens", "output_tokens", "reasoning_tokens")
    cached = ("cache_creation_tokens", "cache_read_tokens")
    total = N.canonical_total(*map(F.col, (*names, *cached)))
    return _ledger(spark, sf_dir).select("event_id", total.alias("total"))


_DATE = "strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d')"


@_register(
    "import_indexed",
    f"""WITH l AS (SELECT *, CAST(event_id AS BIGINT) AS n, {_DATE} AS day FROM ({O.LEDGER}))
 SELECT event_id || 'y' AS event_id, 'inserted' AS status, day AS event_date_utc FROM l WHERE n % 100 = 7
 UNION ALL SELECT event_id, CASE WHEN n % 100 = 8 THEN 'skipped' ELSE 'rejected' END, day FROM l WHERE n % 100 IN (8, 9)""",
)
def _import_indexed(spark, sf_dir):
    """A batch with some new, some stored and some contradicting events, judged by the id index of
    a stored ledger; the dates are those that the index gives after the write."""
    staging = Staging(spark, "indexed")
    path, rows = f"{staging.root}/ledger", normalize.cleaned(_ledger(spark, sf_dir))
    ledger.write_ledger(rows, path)
    n = F.col("event_id").cast("bigint")
    arrived = F.struct(
        F.lit(0).alias("source"), F.array(F.lit("a")).alias("path"), n.alias("line"), F.lit(0).cast("bigint").alias("part")
    )
    batch = rows.where((n % 100).isin(7, 8, 9)).withColumns(
        {
            "order_key": arrived,
            "reject_code": F.lit(None).cast("string"),
            "total_tokens": F.col("total_tokens") + F.when(n % 100 == 9, 1).otherwise(0),
            "content_sha256": F.when(n % 100 == 9, F.lit("other")).otherwise(F.col("content_sha256")),
            "event_id": F.when(n % 100 == 7, F.concat("event_id", F.lit("y"))).otherwise(F.col("event_id")),
        }
    )
    decisions = import_events(staging.put(batch, "batch"), path, staging, 9)
    dates = ledger.snapshot(spark, path).dates_of(decisions.select("event_id"))
    return decisions.join(dates, "event_id").select("event_id", "status", "event_date_utc")


@_register(
    "rollup_monthly",
    f"""WITH l AS (SELECT *, CASE WHEN CAST(event_id AS BIGINT) % 3 = 1 THEN 2 ELSE 1 END AS copies FROM ({O.LEDGER}))
 SELECT {O.bucket("monthly", "Asia/Kolkata")} AS label, CAST(SUM(copies) AS BIGINT) AS events,
 {", ".join(f"CAST(SUM(copies * {t}) AS BIGINT) AS {t}" for t in S.TOKEN_COLUMNS)} FROM l GROUP BY 1""",
)
def _rollup_monthly(spark, sf_dir):
    """Sums of a ledger and of a write that came later, which has no sums of its own yet."""
    path = f"{Staging(spark, 'rollup').root}/ledger"
    rows = normalize.cleaned(_ledger(spark, sf_dir))
    ledger.write_ledger(rows, path)
    rollup.refresh(spark, path)
    more = rows.where(F.col("event_id").cast("bigint") % 3 == 1).withColumn("event_id", F.concat("event_id", F.lit("x")))
    stored = normalize.with_derived(more).select(*S.STORED_SCHEMA.fieldNames())
    ledger._commit(stored, path, None, 1, None, stored.select("event_id"))
    return rollup.timeseries(rollup.rollup(spark, path), "monthly", Filters(timezone="Asia/Kolkata"))


@_register(
    "rollup_after_merge",
    f"""WITH {O.MERGE}, u AS (SELECT l.event_id, CASE WHEN x.status = 'updated' AND d.act IN (4, 5) THEN 'gamma-3'
   ELSE l.model_normalized END AS model_normalized, l.total_tokens, l.output_tokens
   FROM l LEFT JOIN d USING (event_id) LEFT JOIN decided x USING (event_id)
  UNION ALL SELECT event_id || 'x', model_normalized, total_tokens, output_tokens FROM l WHERE n % 3 = 1)
 SELECT model_normalized AS label, COUNT(*) AS events, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens,
 CAST(SUM(output_tokens) AS BIGINT) AS output_tokens FROM u GROUP BY 1""",
)
def _rollup_merged(spark, sf_dir):
    """Sums kept before and after a merge that writes dates anew."""
    staging = Staging(spark, "rollup")
    stored, incoming = f"{staging.root}/first", f"{staging.root}/second"
    ledger.write_ledger(normalize.cleaned(_ledger(spark, sf_dir)), stored)
    rollup.refresh(spark, stored)
    allowed = _merge(spark, sf_dir).where(F.col("status") != reconcile.REJECTED).select("event_id")
    ledger.write_ledger(view(spark, sf_dir, "incoming").join(allowed, "event_id", "left_semi"), incoming)
    merge_ledgers(spark, incoming, stored, 9)
    rollup.refresh(spark, stored)
    models = rollup.breakdown(rollup.rollup(spark, stored), "model")
    return models.select("label", "events", "total_tokens", "output_tokens")


_USER = "CAST(split_part(session_key, '-', 2) AS BIGINT)"


@_register(
    "incremental_equals_full",
    f"""WITH l AS (SELECT *, CAST(event_id AS BIGINT) AS n, {_USER} AS u FROM ({O.LEDGER}) WHERE channel = 'claude'),
 good AS (SELECT *, u % 3 = 0 AS late FROM l WHERE n % 13 <> 5),
 touched AS (SELECT DISTINCT u FROM good WHERE NOT late AND u % 10 = 1 AND n % 7 = 0 AND message_id IS NOT NULL
  AND session_id IS NOT NULL)
 SELECT 'first' AS step, COUNT(*) FILTER (NOT late) AS added, 0 AS skipped, COUNT(*) FILTER (NOT late) AS stored FROM good
 UNION ALL SELECT 'none', 0, 0, COUNT(*) FILTER (NOT late) FROM good
 UNION ALL SELECT 'second', COUNT(*) FILTER (late), COUNT(*) FILTER (u IN (SELECT u FROM touched)), COUNT(*) FROM good""",
)
def _incremental(spark, sf_dir):
    """One file per user. At first two of three users are there; then nothing has changed; then the
    others come, and a file with copies of some messages. Of the first files only those that share
    a message with the copies are read again; the ledger ends as if all had been imported."""
    staging = Staging(spark, "incremental")
    n, user = F.col("line_number") - 1, F.regexp_extract("file_path", "/p([0-9]+)/", 1).cast("bigint")
    cut = F.when(n % 13 == 5, F.substr(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    rows = V.claude_lines(spark, sf_dir).select(user.alias("u"), cut.alias("value"), n.alias("n"))
    rows = staging.put(rows, "rows")
    whole = (F.col("n") % 13 != 5) & F.col("value").contains('"sessionId"') & F.col("value").contains('"id":"msg-')
    copies = rows.where(whole & (F.col("u") % 3 != 0) & (F.col("u") % 10 == 1) & (F.col("n") % 7 == 0))
    logs, out = f"{staging.root}/logs/projects", []
    steps = (
        ("first", rows.where("u % 3 <> 0")),
        ("none", None),
        ("second", rows.where("u % 3 = 0").unionByName(copies.withColumn("u", F.lit(10**12)))),
    )
    for step, new in steps:
        if new is not None:
            named = new.select(F.format_string("p%013d", "u").alias("user"), "value").repartition("user")
            named.write.mode("append").partitionBy("user").text(logs)
        places = [f"{staging.root}/{name}" for name in ("ledger", "runs", "state")]
        result = import_changes(spark, {"claude": [logs]}, *places, 1, grace_minutes=None, suffix=".txt").result
        stored = ledger.read_ledger(spark, places[0]).count()
        run = result.run if result else {"events_added": 0, "events_skipped": 0}
        out.append((step, run["events_added"], run["events_skipped"], stored))
    return spark.createDataFrame(out, "step string, added int, skipped int, stored bigint")


# Pages and comparisons of stored ledgers ---------------------------------------------------


@_register(
    "events_page_deep",
    f"""SELECT {_EVENT_COLUMNS_SQL} FROM ({O.LEDGER}) WHERE channel <> 'claude'
 ORDER BY timestamp_ms DESC, event_id LIMIT 700 OFFSET 450""",
)
def _events_page_deep(spark, sf_dir):
    """A page of a stored ledger in two versions, one of them without sums; ranges are divided down
    to 50 rows, as ranges of millions would be."""
    path = f"{Staging(spark, 'pages').root}/ledger"
    rows = _ledger(spark, sf_dir).where("channel <> 'claude'")
    even = F.col("event_id").cast("bigint") % 2 == 0
    ledger.write_ledger(rows.where(even), path)
    rollup.refresh(spark, path)
    late = normalize.with_derived(rows.where(~even)).select(*S.STORED_SCHEMA.fieldNames())
    ledger._commit(late, path, None, 1, None, late.select("event_id"))
    return pages.event_page(spark, path, limit=700, offset=450, most=50).items


@_register("sessions_page_deep", O.sessions("ORDER BY last_ms DESC, session_key LIMIT 50 OFFSET 60"))
def _sessions_page_deep(spark, sf_dir):
    return pages.session_page(_ledger(spark, sf_dir), Filters(timezone=NEW_YORK), 50, 60, most=20).items


@_register("ledger_diff_by_digests", _ORACLES["ledger_diff"])
def _diff_by_digests(spark, sf_dir):
    """The same difference, of two stored ledgers that are compared by their digests first."""
    root = Staging(spark, "diff").root
    for name, rows in (("candidate", view(spark, sf_dir, "incoming")), ("baseline", _ledger(spark, sf_dir))):
        ledger.write_ledger(rows, f"{root}/{name}")
        digests.refresh(spark, f"{root}/{name}")
    sides = [ledger.snapshot(spark, f"{root}/{name}") for name in ("candidate", "baseline")]
    return digests.diff(*sides, load_profile())


@_register(
    "ledger_changes",
    f"""WITH {O.MERGE} SELECT event_id, CASE status WHEN 'inserted' THEN 'added' ELSE 'changed' END AS change
 FROM decided WHERE status IN ('inserted', 'updated')""",
)
def _ledger_changes(spark, sf_dir):
    """What a merge has changed in a ledger, by the digests of its states before and after."""
    staging = Staging(spark, "changes")
    stored, incoming = f"{staging.root}/first", f"{staging.root}/second"
    ledger.write_ledger(normalize.cleaned(_ledger(spark, sf_dir)), stored)
    digests.refresh(spark, stored)
    before = ledger.snapshot(spark, stored)
    allowed = _merge(spark, sf_dir).where(F.col("status") != reconcile.REJECTED).select("event_id")
    ledger.write_ledger(view(spark, sf_dir, "incoming").join(allowed, "event_id", "left_semi"), incoming)
    merge_ledgers(spark, incoming, stored, 9)
    digests.refresh(spark, stored)
    return digests.changes(ledger.snapshot(spark, stored), before).select("event_id", "change")


# Training-data operators -----------------------------------------------------------------
# They live in one subpackage and one pipeline module that may be absent as a whole.

try:
    import corpus_pipeline
    from meterbook.llm import queries as _llm
except ImportError:  # the folder, or a package that only it needs, is absent
    pass
else:
    _QUERIES.update(_llm.QUERIES)
    _ORACLES.update(_llm.ORACLE_SQL)
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        _ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

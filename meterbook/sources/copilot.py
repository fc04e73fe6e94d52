"""Request-level telemetry spans, and per-session model summaries at shutdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions import jsonprobe as J
from meterbook.functions.clock import whole_div
from meterbook.functions.naming import split_cached_input
from meterbook.functions.text import (
    base_name,
    first_filled,
    none_if_empty,
    path_parts,
    record_subkey,
    tail_from_marker,
    trimmed,
)
from meterbook.operators.carry import Carry, carry
from meterbook.operators.dedupe import best_candidates
from meterbook.session import Staging
from meterbook.sources.lines import LogScan
from meterbook.sources.parsed import as_parsed, refused, settled

ATTRIBUTE_MAP = "map<string,variant>"

# Wrappers of typed attribute values, first present wins.
VALUE_WRAPPERS = ("stringValue", "intValue", "doubleValue", "boolValue")

# Attribute names of the counters, first usable wins.
SPAN_COUNTERS = {
    "raw_input": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens"),
    "output": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens"),
    "cache_read": ("gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cached_input_tokens"),
    "cache_write": (
        "gen_ai.usage.cache_creation.input_tokens",
        "gen_ai.usage.cache_write.input_tokens",
    ),
    "reasoning": ("gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens"),
    "source_total": ("gen_ai.usage.total_tokens", "gen_ai.usage.total.token_count"),
}

# Attributes that may name the session, first filled wins.
SESSION_ATTRIBUTES = (
    "gen_ai.conversation.id",
    "copilot_chat.session_id",
    "copilot_chat.chat_session_id",
    "session.id",
    "github.copilot.interaction_id",
)

# Attributes that are read at all.
WANTED = frozenset(
    (
        *[n for names in SPAN_COUNTERS.values() for n in names],
        *SESSION_ATTRIBUTES,
        "event.name",
        "name",
        "traceId",
        "spanContext.traceId",
        "spanId",
        "spanContext.spanId",
        "gen_ai.response.id",
        "gen_ai.request.id",
        "gen_ai.response.model",
        "gen_ai.request.model",
    )
)

# Counter names of a session summary in all spellings.
SUMMARY_COUNTERS = {
    "raw_input": ("inputTokens", "input_tokens"),
    "output": ("outputTokens", "output_tokens"),
    "cache_read": ("cacheReadTokens", "cache_read_tokens"),
    "cache_write": ("cacheWriteTokens", "cache_write_tokens", "cacheCreationTokens"),
    "reasoning": ("reasoningTokens", "reasoning_tokens"),
}

# Which kind of entry describes a request best.
PRIORITY = {
    "copilot_session_metrics": 5,
    "copilot_chat_span": 4,
    "copilot_inference_log": 3,
    "copilot_agent_turn": 2,
    "copilot_agent_summary": 1,
}

# Weight of every filled token bucket in the completeness score.
BUCKET_SCORE = 1_000_000

CANDIDATE_COLUMNS = ("key", "score", "priority")

_TIMES = ("timestamp", "time", "startTime", "endTime")
_NANO_TIMES = ("timeUnixNano", "startTimeUnixNano", "endTimeUnixNano")

_ATTRIBUTES = {
    "attributes": "variant",
    "resource": {"attributes": "variant"},
    "scope": {"attributes": "variant"},
}
_EVENT = {**_ATTRIBUTES, "name": "variant"}
_SPAN_IDS = J.leaves("traceId", "spanId")
_CONTEXT = J.leaves("gitRoot", "cwd")
_SUMMARY = J.leaves(*[n for names in SUMMARY_COUNTERS.values() for n in names])

SPAN_SHAPE = {
    **_ATTRIBUTES,
    **_SPAN_IDS,
    **J.leaves("name", "eventName", "model", *_TIMES, *_NANO_TIMES),
    "spanContext": _SPAN_IDS,
    "events": f"array<{J.ddl(_EVENT)}>",
}
SESSION_SHAPE = {
    **J.leaves("type", "id", "timestamp"),
    "data": {
        **_CONTEXT,
        **J.leaves("sessionId", "sessionStartTime"),
        "context": _CONTEXT,
        "modelMetrics": f"map<string,{J.ddl({'usage': _SUMMARY})}>",
    },
}


def attribute_map(value: Column) -> Column:
    """Attributes given as an object, or as a list of ``{key, value}``, as one map.

    Only attributes that are read later stay, each without its type wrapper.
    """
    empty = F.create_map().cast(ATTRIBUTE_MAP)
    entries = F.filter(
        F.try_variant_get(value, "$", "array<struct<key:variant,value:variant>>"),
        lambda e: J.text(e["key"]).isNotNull(),
    )
    as_list = F.map_from_entries(
        F.transform(
            entries, lambda e: F.struct(e["key"].try_cast("string").alias("k"), e["value"].alias("v"))
        )
    )
    every = F.coalesce(F.try_variant_get(value, "$", ATTRIBUTE_MAP), as_list, empty)
    return F.transform_values(
        F.map_filter(every, lambda k, v: k.isin(*WANTED)), lambda k, v: _unwrapped(v)
    )


def _unwrapped(value: Column) -> Column:
    wrapper = F.try_variant_get(value, "$", J.ddl(J.leaves(*VALUE_WRAPPERS)))
    return F.coalesce(*[wrapper[w] for w in VALUE_WRAPPERS], value)


def _all_attributes(doc: Column) -> Column:
    """Attributes of entry, resource and scope; later ones win."""
    return F.map_concat(
        attribute_map(doc["attributes"]),
        attribute_map(doc["resource"]["attributes"]),
        attribute_map(doc["scope"]["attributes"]),
    )


def _attribute(name: str) -> Column:
    """Value of an attribute, from the map ``attrs``; the name must be in ``WANTED``."""
    assert name in WANTED, name
    return F.try_element_at(F.col("attrs"), F.lit(name))


def _attribute_text(name: str) -> Column:
    return J.text(_attribute(name))


def _score() -> Column:
    buckets = ("plain", "output", "cache_write", "cached", "reasoning")
    filled = sum((F.when(F.col(b) > 0, BUCKET_SCORE).otherwise(0) for b in buckets), F.lit(0))
    return filled.cast("bigint") + F.col("total")


def _with_split(rows: DataFrame) -> DataFrame:
    plain, cached = split_cached_input(F.col("raw_input"), F.col("cache_read"))
    zero = F.lit(0).cast("bigint")
    return rows.withColumns({"plain": plain, "cached": cached}).withColumns(
        {name: F.coalesce(name, zero) for name in ("output", "cache_write", "reasoning")}
    )


def _sum_parts() -> Column:
    parts = ("output", "cached", "cache_write", "reasoning")
    return sum((F.col(n) for n in parts), F.col("plain"))


def _stored_counts() -> dict[str, Column]:
    return {
        "input_tokens": F.col("plain"),
        "output_tokens": F.col("output"),
        "cache_creation_tokens": F.col("cache_write"),
        "cache_read_tokens": F.col("cached"),
        "reasoning_tokens": F.col("reasoning"),
        "total_tokens": F.col("total"),
    }


def _session_path_id(path: Column) -> Column:
    parts = path_parts(path)
    return F.when(base_name(path) == "events.jsonl", F.get(parts, F.size(parts) - 2))


def _metrics(doc: Column) -> Column:
    """Summaries of a shutdown line that have usage."""

    def counters(e: Column) -> Column:
        usage = e["value"]["usage"]
        return F.struct(
            e["key"].alias("model"),
            *[
                J.long(*[usage[n] for n in names]).alias(name)
                for name, names in SUMMARY_COUNTERS.items()
            ],
        )

    def has_usage(m: Column) -> Column:
        plain, cached = split_cached_input(m["raw_input"], m["cache_read"])
        total = plain + cached
        for name in ("output", "cache_write", "reasoning"):
            total = total + F.coalesce(m[name], F.lit(0).cast("bigint"))
        return total != 0

    found = F.transform(F.map_entries(doc["data"]["modelMetrics"]), counters)
    return F.when(J.text(doc["type"]) == "session.shutdown", F.filter(found, has_usage))


def session_lines(lines: DataFrame) -> DataFrame:
    """Context and shutdown lines: every line with a ``data`` object, reduced to its facts."""
    doc = F.col("doc")
    data = doc["data"]
    kind = F.col("type")
    docs = J.read(lines.where(J.may_contain(F.col("value"), '"data"')), SESSION_SHAPE)
    typed = docs.withColumn("type", J.text(doc["type"]))
    starts = kind.isin("session.start", "session.resume")
    return typed.select(
        "file_path",
        "line_number",
        F.sha2("value", 256).alias("raw_sha256"),
        J.refusal(doc).alias("refusal"),
        data.isNotNull().alias("has_data"),
        F.when(starts, J.text(data["sessionId"])).alias("started_session"),
        F.when(starts, J.filled_text(data["context"]["gitRoot"], data["context"]["cwd"]))
        .when(kind == "session.context_changed", J.filled_text(data["gitRoot"], data["cwd"]))
        .alias("project"),
        J.text(data["sessionId"]).alias("data_session"),
        none_if_empty(trimmed(J.text(doc["id"]))).alias("shutdown_id"),
        F.coalesce(
            J.instant(doc["timestamp"], data["sessionStartTime"]), F.lit(0).cast("bigint")
        ).alias("ts"),
        _metrics(doc).alias("metrics"),
    )


def session_context(rows: DataFrame) -> DataFrame:
    """Session id and project from earlier context lines of the same file.

    Adds ``ctx_session``, ``ctx_project`` and ``ctx_seen`` (whether any earlier line carried
    data) as of the line before.
    """
    return carry(
        rows,
        [
            Carry("ctx_session", F.col("started_session"), ("file_path",)),
            Carry("ctx_project", F.col("project"), ("file_path",)),
            Carry("ctx_seen", F.when(F.col("has_data"), F.lit(True)), ("file_path",)),
        ],
    )


def extract(
    lines: DataFrame,
    staging: Staging | None = None,
    scan: LogScan | None = None,
    rejects: list[DataFrame] | None = None,
) -> DataFrame:
    """Both shapes of lines to records, best candidate per request and file."""
    bad: list[DataFrame] = []
    sessions = refused(settled(session_lines(lines), staging, "sessions", scan), bad)
    sessions = sessions.where(F.col("has_data"))
    summaries = summary_candidates(sessions)
    shutdowns = sessions.where(F.size("metrics") > 0).select("file_path", "line_number")
    spans = refused(settled(span_fields(lines), staging, "spans", scan), bad)
    if rejects is not None:
        # A line may have the words of both shapes.
        rejects.append(bad[0].unionByName(bad[1]).distinct())
    spans = span_candidates(spans).join(
        shutdowns.withColumnRenamed("file_path", "source_file"),
        ["source_file", "line_number"],
        "left_anti",
    )
    return best_candidates(summaries.unionByName(spans))


def summary_candidates(sessions: DataFrame) -> DataFrame:
    """One candidate per model of a shutdown line."""
    path_id = _session_path_id(F.col("file_path"))
    rows = (
        session_context(sessions)
        .where(F.size("metrics") > 0)
        .select(
            "file_path",
            "line_number",
            "raw_sha256",
            "ctx_project",
            "data_session",
            F.coalesce("ctx_session", F.when(F.col("ctx_seen"), path_id)).alias("ctx_session"),
            path_id.alias("path_id"),
            "shutdown_id",
            "ts",
            F.posexplode("metrics").alias("pos", "m"),
        )
        .select("*", "m.*")
    )
    rows = _with_split(rows).withColumn("total", _sum_parts())
    native = first_filled(F.col("data_session"), F.col("ctx_session"))
    label = F.coalesce("shutdown_id", F.concat(F.lit("line:"), F.col("line_number").cast("string")))
    session = F.coalesce(native, F.col("path_id"))
    keyed = rows.withColumns(
        {
            "key": F.concat_ws(
                "|",
                F.lit("copilot-session-state"),
                F.coalesce(session, F.lit("")),
                label,
                F.col("model"),
            ),
            "score": _score(),
            "priority": F.lit(PRIORITY["copilot_session_metrics"]),
        }
    )
    return as_parsed(
        keyed,
        "copilot",
        part=F.col("pos"),
        keep=CANDIDATE_COLUMNS,
        provider="github",
        model=F.col("model"),
        native_session_id=native,
        session_path_id=F.col("path_id"),
        native_event_id=F.col("shutdown_id"),
        identity_kind=F.when(F.col("shutdown_id").isNull(), "record").otherwise("event"),
        identity_scope="session",
        identity_subkey=F.when(
            F.col("shutdown_id").isNull(), F.concat_ws("|", label, F.col("model"))
        ).otherwise(F.col("model")),
        parser_version="copilot-session-state-v1",
        granularity="session_model",
        timestamp_ms=F.col("ts"),
        session_id=session,
        project_path=F.col("ctx_project"),
        **_stored_counts(),
        raw_input_tokens=F.col("raw_input"),
        source_product="copilot-session-state",
        observability_level="session_summary",
        token_accounting_method=S.ACC_COPILOT_SESSION,
        accounting_profile="input_includes_cache_read",
    )


def span_fields(lines: DataFrame) -> DataFrame:
    """One row for each entry, and one for each of its events, with what they report.

    Events inherit the attributes of the entry; their own attributes win.
    """
    doc = F.col("doc")
    event = F.col("event")
    docs = J.read(lines.where(J.may_contain(F.col("value"), "gen_ai.usage.")), SPAN_SHAPE)
    no_event = F.lit(None).cast(J.ddl(_EVENT))
    # The entry itself is element 0; non-object events are NULL elements.
    all_parts = F.concat(F.array(no_event), F.coalesce(doc["events"], F.array().cast(f"array<{J.ddl(_EVENT)}>")))
    parts = (
        docs.withColumn("base", _all_attributes(doc))
        .select("*", F.posexplode(all_parts).alias("part", "event"))
        .where((F.col("part") == 0) | event.isNotNull())
    )
    attrs = F.when(F.col("part") == 0, F.col("base")).otherwise(
        F.map_concat(F.col("base"), _all_attributes(event))
    )
    label = F.when(F.col("part") == 0, "root").otherwise(
        F.concat(F.lit("event:"), (F.col("part") - 1).cast("string"))
    )
    context = doc["spanContext"]
    text = _attribute_text
    name = first_filled(
        J.text(doc["name"]),
        J.text(doc["eventName"]),
        F.coalesce(J.text(event["name"]), text("event.name")),
        text("name"),
    )
    nanos = [J.long(doc[n]) for n in _NANO_TIMES]
    return parts.withColumn("attrs", attrs).select(
        "file_path",
        "line_number",
        F.sha2("value", 256).alias("raw_sha256"),
        J.refusal(doc).alias("refusal"),
        "part",
        label.alias("label"),
        *[J.long(*[_attribute(a) for a in names]).alias(n) for n, names in SPAN_COUNTERS.items()],
        first_filled(
            J.text(doc["traceId"]),
            J.text(context["traceId"]),
            text("traceId"),
            text("spanContext.traceId"),
        ).alias("trace"),
        first_filled(
            J.text(doc["spanId"]),
            J.text(context["spanId"]),
            text("spanId"),
            text("spanContext.spanId"),
        ).alias("span"),
        text("gen_ai.response.id").alias("response"),
        text("github.copilot.interaction_id").alias("interaction"),
        text("gen_ai.request.id").alias("request"),
        first_filled(
            text("gen_ai.response.model"), text("gen_ai.request.model"), J.text(doc["model"])
        ).alias("model"),
        first_filled(*[text(a) for a in SESSION_ATTRIBUTES]).alias("session"),
        F.lower(F.coalesce(name, F.lit(""))).alias("name"),
        F.coalesce(J.text(doc["spanId"]), J.text(context["spanId"])).isNotNull().alias("has_span"),
        F.coalesce(
            J.instant(*[doc[n] for n in _TIMES]),
            *[F.when(n > 0, whole_div(n, 1_000_000)) for n in nanos],
            F.lit(0).cast("bigint"),
        ).alias("ts"),
    )


def span_candidates(fields: DataFrame) -> DataFrame:
    """Candidates from the rows of ``span_fields`` that report any counter."""
    rows = fields.where(F.coalesce(*[F.col(n) for n in SPAN_COUNTERS]).isNotNull())
    has_parts = F.coalesce(*[F.col(n) for n in SPAN_COUNTERS if n != "source_total"]).isNotNull()
    rows = _with_split(rows.withColumn("has_parts", has_parts))
    parts = _sum_parts()
    traced = F.col("trace").isNotNull() & F.col("span").isNotNull()
    pair = F.when(traced, F.concat_ws(":", "trace", "span"))
    name = F.col("name")
    kind = (
        F.when(name.contains("summary"), "copilot_agent_summary")
        .when(name.contains("turn"), "copilot_agent_turn")
        .when(name.contains("inference"), "copilot_inference_log")
        .when(name.contains("chat") | F.col("has_span"), "copilot_chat_span")
        .otherwise("copilot_inference_log")
    )
    ranks = F.create_map(*[F.lit(x) for item in PRIORITY.items() for x in item])
    rows = rows.withColumn(
        "total", F.when((parts == 0) & F.col("source_total").isNotNull(), F.col("source_total")).otherwise(parts)
    )
    keyed = rows.withColumns(
        {
            "key": F.coalesce(pair, F.col("response"), F.col("interaction"), F.col("request")),
            "score": _score(),
            "priority": F.element_at(ranks, kind),
        }
    )
    ids = F.coalesce(pair, first_filled(F.col("response"), F.col("interaction")))
    native = F.coalesce(ids, F.col("request"))
    total_only = ~F.col("has_parts")
    return as_parsed(
        keyed,
        "copilot",
        part=F.col("part"),
        keep=CANDIDATE_COLUMNS,
        provider="github",
        model=F.col("model"),
        native_session_id=F.col("session"),
        session_path_id=tail_from_marker(F.col("file_path"), "otel", "session-state"),
        native_event_id=native,
        identity_kind=F.when(ids.isNotNull(), "event")
        .when(F.col("request").isNotNull(), "request")
        .otherwise("record"),
        identity_scope="session",
        identity_subkey=F.when(native.isNull(), record_subkey(F.col("line_number"), F.col("label"))),
        parser_version="copilot-otel-v1",
        granularity="request",
        timestamp_ms=F.col("ts"),
        session_id=F.col("session"),
        message_id=F.col("key"),
        request_id=first_filled(F.col("response"), F.col("request"), F.col("interaction")),
        **_stored_counts(),
        source_total_tokens=F.col("source_total"),
        raw_input_tokens=F.col("raw_input"),
        source_product="copilot-otel",
        observability_level=F.when(total_only, "inferred").otherwise("full"),
        token_accounting_method=F.when(total_only, S.ACC_COPILOT_TOTAL).otherwise(
            S.ACC_COPILOT_PARTS
        ),
        accounting_profile="input_includes_cache_read",
    )

"""Cumulative-counter logs. One typed row per relevant line; no order-dependent work here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions import jsonprobe as J
from meterbook.functions.text import (
    base_name,
    none_if_empty,
    path_parts,
    strip_extension,
    tail_from_marker,
    trimmed,
)
from meterbook.operators.counters import SNAPSHOT_DDL, snapshot
from meterbook.session import Staging
from meterbook.sources.lines import LogScan
from meterbook.sources.parsed import refused, settled

# Counter names in all spellings.
COUNTERS = (
    ("input_tokens", "prompt_tokens", "input"),
    ("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"),
    ("output_tokens", "completion_tokens", "output"),
    ("reasoning_output_tokens", "reasoning_tokens"),
    ("total_tokens",),
)

_USAGE = J.leaves(*[n for names in COUNTERS for n in names])
_MODEL = {**J.leaves("model", "model_name"), "metadata": J.leaves("model")}
_TIMES = ("timestamp", "created_at", "createdAt")
_BODY = {**_MODEL, **J.leaves(*_TIMES), "usage": _USAGE}
SHAPE = {
    **_BODY,
    **J.leaves("type", "session_id", "sessionId", "event_id", "eventId", "id"),
    **J.leaves("message_id", "request_id", "segment_id"),
    "turn_context": J.leaves("model"),
    "data": _BODY,
    "result": _BODY,
    "response": _BODY,
    "payload": {
        **_MODEL,
        **J.leaves("type", "id", "event_id", "eventId", "session_id", "request_id"),
        **J.leaves("segment_id", "turn_id", "forked_from_id"),
        "thread_settings": J.leaves("model"),
        "source": {"subagent": {"thread_spawn": J.leaves("parent_thread_id")}},
        "info": {**_MODEL, "total_token_usage": _USAGE, "last_token_usage": _USAGE},
    },
}
# Where usage, model and time may stand, in order of preference.
BODIES = ("data", "result", "response")

# A line without any of these words has no usage, model, turn or fork information.
WORDS = ("usage", "thread_settings", "turn_context", "task_complete", "session_meta")


def _snapshot(usage: Column) -> Column:
    values = snapshot(*[J.long(*[usage[n] for n in names]) for names in COUNTERS])
    return F.when(usage.isNotNull(), values).cast(SNAPSHOT_DDL)


def file_stem(path: Column) -> Column:
    return strip_extension(base_name(path))


def session_path_id(path: Column) -> Column:
    """Path below the sessions folder without extension; archived sessions keep their folder."""
    tail = tail_from_marker(path, "sessions", "archived_sessions")
    live = F.regexp_replace(tail, "^sessions/", "")
    return F.coalesce(strip_extension(live), file_stem(path))


def path_rank(path: Column) -> Column:
    """0 below a live sessions folder, 1 below an archive, 2 elsewhere; the nearest counts."""
    kinds = F.filter(path_parts(path), lambda p: p.isin("sessions", "archived_sessions"))
    nearest = F.try_element_at(kinds, F.lit(-1))
    return F.when(nearest == "sessions", 0).when(nearest == "archived_sessions", 1).otherwise(2)


def extract(
    lines: DataFrame,
    staging: Staging | None = None,
    scan: LogScan | None = None,
    rejects: list[DataFrame] | None = None,
) -> DataFrame:
    """Typed rows: ``row_kind`` is usage, declaration, task_complete or meta."""
    doc = F.col("doc")
    payload, info = doc["payload"], doc["payload"]["info"]
    docs = J.read(lines.where(J.may_contain(F.col("value"), *WORDS)), SHAPE)

    def type_is(name: str) -> Column:
        return F.coalesce(F.col("type") == name, F.lit(False))

    def event_is(name: str) -> Column:
        return type_is("event_msg") & F.coalesce(F.col("payload_type") == name, F.lit(False))

    typed = docs.select(
        "file_path",
        "line_number",
        "value",
        "doc",
        J.text(doc["type"]).alias("type"),
        J.text(payload["type"]).alias("payload_type"),
    )
    counts = event_is("token_count")
    headless = F.coalesce(doc["usage"], *[doc[b]["usage"] for b in BODIES])
    turn_model = J.filled_text(
        payload["model"], info["model"], payload["metadata"]["model"], doc["turn_context"]["model"]
    )
    # It counts on the first line only; line numbers are known after the rows are stored.
    is_meta = type_is("session_meta")
    located = typed.select(
        "*",
        F.when(
            event_is("thread_settings_applied"),
            none_if_empty(trimmed(J.text(payload["thread_settings"]["model"]))),
        ).alias("settings_model"),
        type_is("turn_context").alias("is_turn"),
        F.when(type_is("turn_context"), trimmed(turn_model)).alias("turn_model"),
        F.when(counts, info["total_token_usage"]).alias("total_usage"),
        F.when(counts, info["last_token_usage"]).alias("last_usage"),
        F.when(~type_is("event_msg"), headless).alias("headless_usage"),
        is_meta.alias("is_meta"),
    )
    has_usage = (
        F.col("total_usage").isNotNull()
        | F.col("last_usage").isNotNull()
        | F.col("headless_usage").isNotNull()
    )
    row_kind = (
        F.when(F.col("settings_model").isNotNull(), "declaration")
        .when(F.col("is_turn"), F.when(F.col("turn_model").isNotNull(), "declaration"))
        .when(event_is("task_complete"), "task_complete")
        .when(has_usage, "usage")
    )
    kept = located.withColumn("row_kind", row_kind)

    models = [m for body in (doc, payload, info, *[doc[b] for b in BODIES])
              for m in (body["model"], body["model_name"], body["metadata"]["model"])]
    times = [body[t] for body in (doc, *[doc[b] for b in BODIES]) for t in _TIMES]
    rows = kept.select(
        "file_path",
        "line_number",
        F.sha2("value", 256).alias("raw_sha256"),
        J.refusal(doc).alias("refusal"),
        "row_kind",
        J.filled_text(doc["session_id"], doc["sessionId"], payload["session_id"]).alias(
            "explicit_session"
        ),
        F.coalesce(J.instant(*times), F.lit(0).cast("bigint")).alias("ts"),
        F.coalesce("settings_model", "turn_model").alias("declared_model"),
        F.when(F.col("settings_model").isNotNull(), F.lit("thread_settings"))
        .otherwise(F.lit("turn_context"))
        .alias("declared_by"),
        F.when(event_is("task_complete"), J.text(payload["turn_id"])).alias("turn_id"),
        _snapshot(F.col("total_usage")).alias("cumulative"),
        _snapshot(F.col("last_usage")).alias("last"),
        _snapshot(F.col("headless_usage")).alias("headless"),
        trimmed(J.filled_text(*models)).alias("direct_model"),
        trimmed(
            J.filled_text(
                doc["event_id"],
                doc["eventId"],
                payload["event_id"],
                payload["eventId"],
                doc["id"],
                payload["id"],
            )
        ).alias("event_id"),
        J.filled_text(doc["request_id"], payload["request_id"]).alias("request_id"),
        J.filled_text(doc["id"], doc["message_id"]).alias("message_id"),
        J.filled_text(doc["segment_id"], payload["segment_id"]).alias("segment_id"),
        F.when(F.col("is_meta"), J.text(payload["id"])).alias("meta_session"),
        F.when(
            F.col("is_meta"),
            J.filled_text(
                payload["forked_from_id"],
                payload["source"]["subagent"]["thread_spawn"]["parent_thread_id"],
            ),
        ).alias("meta_parent"),
        "is_meta",
    )
    stem = file_stem(F.col("file_path"))
    rows = refused(settled(rows, staging, "codex", scan), rejects)
    first = F.col("is_meta") & (F.col("line_number") == 1)
    rows = rows.withColumns(
        {
            "row_kind": F.coalesce("row_kind", F.when(first, F.lit("meta"))),
            "is_meta": first,
            "meta_session": F.when(first, F.col("meta_session")),
            "meta_parent": F.when(first, F.col("meta_parent")),
        }
    ).where(F.col("row_kind").isNotNull())
    return rows.withColumn(
        "session",
        F.coalesce("explicit_session", F.when(F.trim(stem) != "", stem), F.lit("unknown")),
    )

"""Message logs with one usage object per assistant message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions import jsonprobe as J
from meterbook.functions.naming import speed_model
from meterbook.functions.text import is_blank, none_if_blank, path_parts, tail_from_marker
from meterbook.session import Staging
from meterbook.sources.lines import LogScan
from meterbook.sources.parsed import as_parsed, refused, settled

# A line with one of these fields set to null is not usage.
NULL_FIELDS = (
    "id",
    "cwd",
    "model",
    "speed",
    "costUSD",
    "version",
    "sessionId",
    "requestId",
    "isApiErrorMessage",
    "cache_read_input_tokens",
    "cache_creation_input_tokens",
)

COUNTERS = {
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_creation_tokens": "cache_creation_input_tokens",
    "cache_read_tokens": "cache_read_input_tokens",
}


def has_null_field(line: Column) -> Column:
    found = F.lit(False)
    for name in NULL_FIELDS:
        found = found | line.contains(f'"{name}":null')
    return found


def _below_projects(path: Column) -> Column:
    return path_parts(tail_from_marker(path, "projects", include_marker=False))


def session_from_path(path: Column) -> Column:
    """Session id by depth below the projects folder; sub-agent files name their parent."""
    rel = _below_projects(path)
    n = F.size(rel)
    parts = path_parts(path)
    return (
        F.when(rel.isNull(), F.get(parts, F.size(parts) - 2))
        .when(n == 2, F.regexp_replace(F.get(rel, F.lit(1)), r"\.jsonl$", ""))
        .when((n >= 4) & (F.get(rel, n - 2) == "subagents"), F.get(rel, n - 3))
        .when(n >= 3, F.get(rel, n - 2))
        .otherwise(F.get(parts, F.size(parts) - 2))
    )


def project_from_path(path: Column) -> Column:
    rel = _below_projects(path)
    n = F.size(rel)

    def head(count: Column) -> Column:
        return F.array_join(F.slice(rel, F.lit(1), count), "/")

    return (
        F.when(n == 2, F.get(rel, F.lit(0)))
        .when((n >= 4) & (F.get(rel, n - 2) == "subagents"), head(n - 3))
        .when(n > 2, head(n - 2))
        .otherwise(F.get(rel, F.lit(0)))
    )


_USAGE = J.leaves(*COUNTERS.values(), "speed")
_MESSAGE = {**J.leaves("id", "model"), "usage": _USAGE}
_META = J.leaves("timestamp", "requestId", "isSidechain")
SHAPE = {
    **_META,
    **J.leaves("sessionId", "uuid", "model", "cwd"),
    "usage": _USAGE,
    "message": _MESSAGE,
    "data": {"message": {**_META, "message": _MESSAGE}},
}


def extract(
    lines: DataFrame,
    staging: Staging | None = None,
    scan: LogScan | None = None,
    rejects: list[DataFrame] | None = None,
) -> DataFrame:
    doc = F.col("doc")
    value = F.col("value")
    docs = J.read(lines.where(J.may_contain(value, "usage") & ~has_null_field(value)), SHAPE)

    # Usage stands beside a message, in it, or in a message wrapped by a progress entry.
    plain_usage = F.when(
        doc["message"].isNotNull(), F.coalesce(doc["usage"], doc["message"]["usage"])
    )
    wrapper = doc["data"]["message"]
    located = docs.select(
        "file_path",
        "line_number",
        "value",
        "doc",
        plain_usage.isNotNull().alias("plain"),
        F.coalesce(plain_usage, wrapper["message"]["usage"]).alias("usage"),
    )

    def choose(plain: Column, inner: Column) -> Column:
        return F.when(F.col("plain"), plain).otherwise(inner)

    use = F.col("usage")
    message = choose(doc["message"], wrapper["message"])
    meta = {name: choose(doc[name], wrapper[name]) for name in _META}
    fields = located.select(
        "file_path",
        "line_number",
        F.sha2("value", 256).alias("raw_sha256"),
        J.refusal(doc).alias("refusal"),
        use.isNotNull().alias("has_usage"),
        *[J.count(use[key]).alias(name) for name, key in COUNTERS.items()],
        J.text(use["speed"]).alias("speed"),
        choose(
            J.filled_text(doc["model"], doc["message"]["model"]), J.text(message["model"])
        ).alias("model"),
        J.instant(meta["timestamp"]).alias("timestamp_ms"),
        F.when(F.col("plain"), J.text(doc["sessionId"])).alias("native_session"),
        J.text(meta["requestId"]).alias("request_id"),
        F.coalesce(
            J.text(message["id"]), F.when(F.col("plain"), J.text(doc["uuid"]))
        ).alias("message_id"),
        J.flag(meta["isSidechain"]).alias("is_sidechain"),
        J.filled_text(doc["cwd"]).alias("cwd"),
    )

    used = sum((F.col(name) for name in COUNTERS), F.lit(0))
    kept = refused(settled(fields, staging, "claude", scan), rejects).where(
        F.col("has_usage")
        & ~F.coalesce((F.col("model") == "<synthetic>") & (used == 0), F.lit(False))
    )
    path, message_id, request_id = F.col("file_path"), F.col("message_id"), F.col("request_id")
    has_message = ~is_blank(message_id)
    by_request = ~has_message & request_id.isNotNull()
    return as_parsed(
        kept,
        "claude",
        provider="anthropic",
        model=speed_model(F.col("model"), F.col("speed")),
        native_session_id=none_if_blank(F.col("native_session")),
        session_path_id=tail_from_marker(path, "projects"),
        native_event_id=F.when(by_request, request_id).otherwise(message_id),
        identity_kind=F.when(by_request, F.lit("request")).otherwise(F.lit("message")),
        identity_scope="session",
        identity_subkey=F.when(
            message_id.isNotNull(), F.concat_ws(":", message_id, request_id)
        ),
        parser_version="claude-v1",
        granularity="request",
        timestamp_ms=F.coalesce("timestamp_ms", F.lit(0)),
        session_id=F.coalesce("native_session", session_from_path(path)),
        project_path=F.coalesce("cwd", project_from_path(path)),
        message_id=message_id,
        request_id=request_id,
        is_sidechain=F.col("is_sidechain"),
        usage_speed=F.col("speed"),
        source_product="claude-code",
        token_accounting_method=S.ACC_CLAUDE_USAGE_SUM,
        accounting_profile="claude_usage_v1",
        reasoning_tokens=0,
        total_tokens=0,
        **{name: F.col(name) for name in COUNTERS},
    )

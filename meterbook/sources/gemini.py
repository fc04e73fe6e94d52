"""Usage metadata lines, or whole JSON documents holding one object or an array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions import jsonprobe as J
from meterbook.functions.text import record_subkey, tail_from_marker, trimmed
from meterbook.session import Staging
from meterbook.sources import jsonfile
from meterbook.sources.lines import LogScan
from meterbook.sources.parsed import as_parsed, refused, settled

# Counter names in both spellings.
ALIASES = {
    "prompt": ("promptTokenCount", "prompt_token_count"),
    "output": ("candidatesTokenCount", "candidates_token_count"),
    "cache_read": ("cachedContentTokenCount", "cached_content_token_count"),
    "reasoning": ("thoughtsTokenCount", "thoughts_token_count"),
    "tool_input": ("toolUsePromptTokenCount", "tool_use_prompt_token_count"),
    "total": ("totalTokenCount", "total_token_count"),
}

_USAGE = J.leaves(*[n for names in ALIASES.values() for n in names])
_IDS = J.leaves("event_id", "eventId", "id", "message_id", "request_id", "session_id")
_COMMON = {**_IDS, **J.leaves("model", "timestamp"), "usageMetadata": _USAGE}
SHAPE = {
    **_COMMON,
    **J.leaves("messageId", "requestId", "sessionId", "segment_id", "part_id"),
    "metadata": J.leaves("session_id"),
    "response": _COMMON,
}


def extract(
    lines: DataFrame,
    staging: Staging | None = None,
    scan: LogScan | None = None,
    rejects: list[DataFrame] | None = None,
) -> DataFrame:
    """JSONL lines to records."""
    docs = J.read(lines.where(J.may_contain(F.col("value"), "usageMetadata")), SHAPE)
    return _records(refused(settled(_fields(docs), staging, "gemini", scan), rejects))


def extract_documents(
    documents: DataFrame, staging: Staging, rejects: list[DataFrame] | None = None
) -> DataFrame:
    """Whole texts ``file_path, value`` to records; see ``extract_fragments``."""
    return extract_fragments(jsonfile.fragments_of(documents), staging, rejects)


def extract_fragments(
    fragments: DataFrame, staging: Staging, rejects: list[DataFrame] | None = None
) -> DataFrame:
    """Documents in parts (``jsonfile``): an object is line 1, elements of an array are numbered from 1.

    A file that is neither an object nor an array of objects and nulls, or has an element that
    cannot be parsed, is refused as a whole if it has usage words.
    """
    values, refused_files = jsonfile.values(fragments, ("usageMetadata",), staging)
    fields = _fields(J.read(values, SHAPE), "in_array")
    stored = settled(fields, staging, "documents")
    broken = stored.where(F.col("in_array") & F.col("refusal").isNotNull()).select("file_path").distinct()
    broken = staging.put(broken, "broken")
    whole = F.lit(None).cast("bigint")
    no_array = refused_files.where("is_array AND has_words").select("file_path").unionByName(broken)
    # What begins like a null is no log, and no line that failed.
    failed = refused_files.where(~F.col("is_array") & F.col("has_words") & F.col("head").rlike(r"^\s*[^nN\s]"))
    if rejects is not None:
        told = no_array.withColumn("line_number", whole).unionByName(
            failed.select("file_path", F.lit(1).cast("bigint").alias("line_number"))
        )
        rejects.append(told.withColumn("reason", F.lit(J.NOT_JSON)))
    rows = stored.join(broken, "file_path", "left_anti").drop("in_array")
    return _records(refused(rows.where("refusal IS NULL OR has_words"), rejects))


def _fields(docs: DataFrame, *keep: str) -> DataFrame:
    doc = F.col("doc")
    inner = doc["response"]
    use = F.col("usage")
    rows = docs.withColumn(
        "usage", F.coalesce(doc["usageMetadata"], inner["usageMetadata"])
    )

    event_names = ("event_id", "eventId", "id")
    native_event = J.filled_text(*[d[n] for d in (doc, inner) for n in event_names])
    native_message = J.filled_text(doc["message_id"], doc["messageId"], inner["message_id"])
    native_request = J.filled_text(doc["request_id"], doc["requestId"], inner["request_id"])
    return rows.select(
        "file_path",
        "line_number",
        F.sha2("value", 256).alias("raw_sha256"),
        # A line that begins like a null is no line that failed.
        F.when(F.col("value").rlike(r"^\s*(\{|[^nN\s])"), J.refusal(doc)).alias("refusal"),
        J.may_contain(F.col("value"), "usageMetadata").alias("has_words"),
        use.isNotNull().alias("has_usage"),
        native_event.alias("native_event"),
        native_message.alias("native_message"),
        native_request.alias("native_request"),
        J.filled_text(
            doc["session_id"], doc["sessionId"], doc["metadata"]["session_id"], inner["session_id"]
        ).alias("native_session"),
        J.filled_text(doc["segment_id"], doc["part_id"]).alias("segment"),
        F.coalesce(J.text(doc["model"]), J.text(inner["model"])).alias("model"),
        F.coalesce(J.instant(doc["timestamp"], inner["timestamp"]), F.lit(0)).alias("timestamp_ms"),
        *[J.long(*[use[n] for n in names]).alias(name) for name, names in ALIASES.items()],
        *keep,
    )


def _records(fields: DataFrame) -> DataFrame:
    ids = ("native_event", "native_message", "native_request")
    fields = fields.where(F.col("has_usage")).withColumn("native", trimmed(F.coalesce(*ids))).withColumn(
        "kind",
        F.when(F.col(ids[0]).isNotNull(), "event")
        .when(F.col(ids[1]).isNotNull(), "message")
        .when(F.col(ids[2]).isNotNull(), "request")
        .otherwise("record"),
    )
    zero = F.lit(0).cast("bigint")
    raw_input = F.coalesce("prompt", zero) + F.coalesce("tool_input", zero)
    cache_read = F.coalesce("cache_read", zero)
    path_id = tail_from_marker(F.col("file_path"), ".gemini", "sessions", "projects")
    return as_parsed(
        fields,
        "gemini",
        provider="google",
        model=F.col("model"),
        native_session_id=F.col("native_session"),
        session_path_id=path_id,
        native_event_id=F.col("native"),
        identity_kind=F.col("kind"),
        identity_scope="session",
        identity_subkey=F.when(
            F.col("native").isNull(), record_subkey(F.col("line_number"), F.col("segment"))
        ).otherwise(F.col("segment")),
        parser_version="gemini-v1",
        granularity="request",
        timestamp_ms=F.col("timestamp_ms"),
        session_id=F.coalesce("native_session", path_id),
        # Not saturating: a negative difference must be seen and refused by validation.
        input_tokens=raw_input - cache_read,
        output_tokens=F.coalesce("output", zero),
        cache_creation_tokens=0,
        cache_read_tokens=cache_read,
        reasoning_tokens=F.coalesce("reasoning", zero),
        total_tokens=F.coalesce("total", zero),
        source_total_tokens=F.col("total"),
        raw_input_tokens=F.when(
            F.col("prompt").isNotNull() | F.col("tool_input").isNotNull(), raw_input
        ),
        source_product="gemini-cli",
        observability_level="full",
        token_accounting_method=S.ACC_GEMINI,
        accounting_profile="gemini_usage_v1",
    )

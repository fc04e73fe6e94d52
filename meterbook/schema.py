"""Table schemas, fixed vocabularies and the schema conformance check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA_VERSION = "3"
IDENTITY_VERSION = 2

# Accounting methods.
ACC_CLAUDE_USAGE_SUM = "claude_usage_sum"
ACC_CODEX_LAST = "codex_last_token_usage"
ACC_CODEX_DELTA = "codex_total_delta"
ACC_CODEX_HEADLESS = "codex_headless_usage"
ACC_COPILOT_PARTS = "copilot_otel_parts"
ACC_COPILOT_TOTAL = "copilot_otel_total_fallback"
ACC_COPILOT_SESSION = "copilot_session_model_metrics"
ACC_GEMINI = "gemini_usage"
ACC_WORKBUDDY = "workbuddy_raw_usage"

CODEX_METHODS = (ACC_CODEX_LAST, ACC_CODEX_DELTA, ACC_CODEX_HEADLESS)
PLAIN_SUM_METHODS = (
    ACC_CLAUDE_USAGE_SUM,
    ACC_COPILOT_PARTS,
    ACC_COPILOT_SESSION,
    ACC_GEMINI,
)

# How the model of an event was found.
MODEL_DIRECT = "direct_event"
MODEL_THREAD_SETTINGS = "thread_settings"
MODEL_TURN_CONTEXT = "turn_context"
MODEL_UNKNOWN = "unknown"

# Identity strategies in order of precedence.
IDENTITY_STRATEGIES = (
    "native_event",
    "native_message",
    "native_request",
    "session_turn",
    "session_record",
    "content_fallback",
)

TOKEN_COLUMNS = (
    "input_tokens",
    "output_tokens",
    "reasoning_tokens",
    "cache_creation_tokens",
    "cache_read_tokens",
    "total_tokens",
)

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


LEDGER_SCHEMA = _struct(
    ("event_id", _S, False),
    ("identity_version", _I, False),
    ("identity_strategy", _S, False),
    ("identity_scope", _S, False),
    ("content_sha256", _S, False),
    ("parser_version", _S, True),
    ("event_granularity", _S, False),
    ("channel", _S, False),
    ("source_product", _S, False),
    ("provider", _S, True),
    ("model_raw", _S, True),
    ("model_normalized", _S, False),
    ("model_resolution", _S, True),
    ("model_is_fallback", _B, False),
    ("timestamp_ms", _L, False),
    ("session_key", _S, False),
    ("session_id", _S, True),
    ("session_path_id", _S, True),
    ("turn_id", _S, True),
    ("project_path", _S, True),
    ("message_id", _S, True),
    ("request_id", _S, True),
    ("source_file", _S, True),
    ("line_number", _I, True),
    ("raw_sha256", _S, True),
    ("input_tokens", _L, False),
    ("output_tokens", _L, False),
    ("reasoning_tokens", _L, False),
    ("cache_creation_tokens", _L, False),
    ("cache_read_tokens", _L, False),
    ("total_tokens", _L, False),
    ("source_total_tokens", _L, True),
    ("raw_input_tokens", _L, True),
    ("token_accounting_method", _S, True),
    ("accounting_profile", _S, True),
    ("observability_level", _S, True),
    ("imported_at_ms", _L, False),
    ("updated_at_ms", _L, False),
)

EVENT_COLUMNS = tuple(LEDGER_SCHEMA.fieldNames())

# Added when a ledger is written: partition key and the label the project filter uses.
DERIVED_SCHEMA = _struct(("project_label", _S, True), ("event_date_utc", _S, True))
STORED_SCHEMA = T.StructType(LEDGER_SCHEMA.fields + DERIVED_SCHEMA.fields)

RUN_SCHEMA = _struct(
    ("id", _S, False),
    ("started_at_ms", _L, False),
    ("finished_at_ms", _L, True),
    ("status", _S, False),
    ("files_scanned", _L, False),
    ("events_added", _L, False),
    ("events_updated", _L, False),
    ("events_skipped", _L, False),
    ("events_rejected", _L, False),
    ("error", _S, True),
)

# What an import refused. ``line_number`` is NULL for a whole file; ``detail`` says more where the
# reason alone does not.
REJECT_SCHEMA = _struct(
    ("run_id", _S, False),
    ("source", _S, False),
    ("file_path", _S, True),
    ("line_number", _L, True),
    ("reason", _S, False),
    ("detail", _S, True),
)

# Position of a record in the import: source, path by component, line, part of the line.
ORDER_TYPE = _struct(
    ("source", _I, True),
    ("path", T.ArrayType(_S), True),
    ("line", _L, True),
    ("part", _L, True),
)

# What every extractor emits.
PARSED_SCHEMA = _struct(
    ("agent", _S, True),
    ("provider", _S, True),
    ("model", _S, True),
    ("model_normalized", _S, True),
    ("model_resolution", _S, True),
    ("model_is_fallback", _B, True),
    ("timestamp_ms", _L, True),
    ("native_session_id", _S, True),
    ("session_path_id", _S, True),
    ("native_event_id", _S, True),
    ("identity_kind", _S, True),
    ("identity_scope", _S, True),
    ("identity_subkey", _S, True),
    ("parser_version", _S, True),
    ("granularity", _S, True),
    ("session_id", _S, True),
    ("project_path", _S, True),
    ("message_id", _S, True),
    ("request_id", _S, True),
    ("turn_id", _S, True),
    ("input_tokens", _L, True),
    ("output_tokens", _L, True),
    ("reasoning_tokens", _L, True),
    ("cache_creation_tokens", _L, True),
    ("cache_read_tokens", _L, True),
    ("total_tokens", _L, True),
    ("source_total_tokens", _L, True),
    ("raw_input_tokens", _L, True),
    ("is_sidechain", _B, True),
    ("usage_speed", _S, True),
    ("source_product", _S, True),
    ("observability_level", _S, True),
    ("token_accounting_method", _S, True),
    ("accounting_profile", _S, True),
    ("source_file", _S, True),
    ("line_number", _L, True),
    ("raw_sha256", _S, True),
    ("order_key", ORDER_TYPE, True),
)


def conformance_problems(df: DataFrame, expected: T.StructType = LEDGER_SCHEMA) -> list[str]:
    """Q2: required, unexpected and mistyped columns; an empty list means conformant."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in expected.fields}
    problems = [f"missing column {name}" for name in wanted if name not in actual]
    problems += [f"unexpected column {name}" for name in actual if name not in wanted]
    problems += [
        f"column {name} is {actual[name].simpleString()}, expected {dtype.simpleString()}"
        for name, dtype in wanted.items()
        if name in actual and actual[name] != dtype
    ]
    return problems


def require_conformance(df: DataFrame, expected: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    problems = conformance_problems(df, expected)
    if problems:
        raise ValueError("ledger schema mismatch: " + "; ".join(problems))
    return df

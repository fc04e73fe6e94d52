"""Parsed records to events with identity, or to rejects with a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions import identity as I
from meterbook.functions import naming as N
from meterbook.functions.clock import utc_date
from meterbook.functions.text import (
    first_filled,
    is_blank,
    none_if_blank,
    or_empty,
    project_label,
    trimmed,
)


def with_defaults(records: DataFrame) -> DataFrame:
    """Fill what an extractor left open: model, provider, product, accounting, total."""
    c = F.col
    zero = F.lit(0).cast("bigint")
    named = F.coalesce(c("model_normalized"), trimmed(c("model")))
    normalized = F.when(is_blank(named), F.lit("unknown")).otherwise(named)
    fallback = F.coalesce("model_is_fallback", F.lit(False)) | N.is_unknown(normalized)
    resolution = F.coalesce(
        "model_resolution", F.when(fallback, S.MODEL_UNKNOWN).otherwise(S.MODEL_DIRECT)
    )
    provider = F.when(
        c("provider").isNull() | (c("provider") == "unknown"), N.infer_provider(c("model"))
    ).otherwise(c("provider"))
    out = records.withColumns(
        {
            "model_normalized": normalized,
            "model_is_fallback": fallback,
            "model_resolution": resolution,
            "provider": provider,
            "observability_level": F.coalesce(
                "observability_level", N.default_observability(c("agent"))
            ),
            "token_accounting_method": F.coalesce(
                "token_accounting_method",
                F.when(c("agent") == "claude", F.lit(S.ACC_CLAUDE_USAGE_SUM)),
            ),
            "source_product": F.coalesce("source_product", N.product_of_channel(c("agent"))),
            "identity_scope": I.identity_scope(c("identity_scope")),
            **{t: F.coalesce(t, zero) for t in S.TOKEN_COLUMNS},
        }
    )
    computed = N.canonical_total(
        c("token_accounting_method"),
        c("input_tokens"),
        c("output_tokens"),
        c("reasoning_tokens"),
        c("cache_creation_tokens"),
        c("cache_read_tokens"),
    )
    return out.withColumn(
        "total_tokens",
        F.when(c("total_tokens") == 0, F.coalesce(computed, zero)).otherwise(c("total_tokens")),
    )


def with_identity(records: DataFrame) -> DataFrame:
    """Add ``session_key``, ``event_id``, strategy, content hash and ``reject_code``."""
    c = F.col
    facts = {name: c(name) for name in I.CONTENT_FACTS if name in records.columns}
    facts["channel"] = c("agent")
    facts["event_granularity"] = c("granularity")
    keyed = records.withColumns(
        {
            "reject_code": I.identity_error(
                c("source_product"), c("timestamp_ms"), c("native_session_id"), c("session_path_id")
            ),
            "session_key": I.session_key(
                c("source_product"), c("native_session_id"), c("session_path_id")
            ),
            "content_sha256": I.content_sha256(facts),
        }
    )
    choice = I.identity_choice(
        c("identity_kind"),
        c("native_event_id"),
        c("identity_subkey"),
        c("turn_id"),
        c("message_id"),
        c("request_id"),
        c("content_sha256"),
    )
    return (
        keyed.withColumn("_id", choice)
        .withColumn("identity_strategy", c("_id.strategy"))
        .withColumn(
            "event_id",
            I.event_id(
                c("source_product"),
                c("identity_scope"),
                c("session_key"),
                c("_id.kind"),
                c("_id.id"),
                c("identity_subkey"),
            ),
        )
        .drop("_id")
    )


def as_events(records: DataFrame, now_ms: int) -> DataFrame:
    """Ledger columns, ``order_key`` and ``reject_code`` for every parsed record."""
    c = F.col
    rows = with_identity(with_defaults(records))
    now = F.lit(now_ms).cast("bigint")
    renamed = {
        "identity_version": F.lit(S.IDENTITY_VERSION),
        "event_granularity": c("granularity"),
        "channel": c("agent"),
        "model_raw": c("model"),
        "session_id": trimmed(first_filled(c("native_session_id"), c("session_id"))),
        "imported_at_ms": now,
        "updated_at_ms": now,
    }
    columns = [
        renamed.get(f.name, c(f.name)).cast(f.dataType).alias(f.name)
        for f in S.LEDGER_SCHEMA.fields
    ]
    return cleaned(rows.select(*columns, "order_key", "reject_code"))


# Columns trimmed before rows are compared.
_TRIMMED = (
    "event_id",
    "identity_strategy",
    "identity_scope",
    "content_sha256",
    "channel",
    "source_product",
    "provider",
    "model_raw",
    "model_normalized",
    "model_resolution",
    "session_key",
)


def cleaned(events: DataFrame) -> DataFrame:
    """Trims, defaults and blank-to-NULL of stored text."""
    c = F.col
    cols: dict[str, Column] = {}
    for field in S.LEDGER_SCHEMA.fields:
        value = c(field.name)
        if field.name in _TRIMMED:
            value = trimmed(value)
        if field.dataType.simpleString() == "string" and field.nullable:
            value = none_if_blank(value)
        cols[field.name] = value
    no_model = is_blank(c("model_normalized"))
    is_unknown = F.lower(trimmed(or_empty(c("model_normalized")))).isin("", "unknown")
    no_evidence = is_blank(c("model_resolution")) & is_unknown
    cols["model_normalized"] = F.when(no_model, "unknown").otherwise(cols["model_normalized"])
    cols["model_resolution"] = F.when(no_evidence, S.MODEL_UNKNOWN).otherwise(
        cols["model_resolution"]
    )
    cols["model_is_fallback"] = no_evidence | F.coalesce("model_is_fallback", F.lit(False))
    cols["line_number"] = F.when(c("line_number") > 0, c("line_number"))
    cols["identity_version"] = F.coalesce(
        F.when(c("identity_version") != 0, c("identity_version")), F.lit(S.IDENTITY_VERSION)
    )
    return events.withColumns(cols)


def with_derived(events: DataFrame) -> DataFrame:
    """Columns the stored table adds: project label and UTC date."""
    return events.withColumn("project_label", project_label(F.col("project_path"))).withColumn(
        "event_date_utc", utc_date(F.col("timestamp_ms"))
    )

"""Q1: the first rule an event breaks, or NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions.text import is_blank

_BUCKETS = tuple(t for t in S.TOKEN_COLUMNS if t != "total_tokens")


def accounting_error() -> Column:
    """Conservation of tokens, by the accounting method of the row."""
    c = F.col
    side = c("input_tokens") + c("cache_creation_tokens") + c("cache_read_tokens")
    method, total = c("token_accounting_method"), c("total_tokens")
    mismatch = F.lit("accounting_total_mismatch")
    shared = side + F.greatest("output_tokens", "reasoning_tokens")
    is_partial = F.coalesce(c("observability_level") == "partial", F.lit(False))
    codex = F.when((shared > total) | ((shared < total) & ~is_partial), mismatch)
    summed = F.when(side + c("output_tokens") + c("reasoning_tokens") != total, mismatch)
    buddy = F.when(
        c("reasoning_tokens") > c("output_tokens"), F.lit("accounting_reasoning_exceeds_output")
    ).when(side + c("output_tokens") != total, mismatch)
    return (
        F.when(method.isin(*S.CODEX_METHODS), codex)
        .when(method.isin(*S.PLAIN_SUM_METHODS), summed)
        .when(method == S.ACC_WORKBUDDY, buddy)
    )


def reject_code() -> Column:
    c = F.col
    required = ("event_id", "identity_strategy", "identity_scope", "content_sha256")
    no_identity = F.coalesce(c("identity_version") != S.IDENTITY_VERSION, F.lit(True))
    for name in required:
        no_identity = no_identity | is_blank(c(name))
    negative = F.least(*S.TOKEN_COLUMNS) < 0
    return (
        F.when(no_identity, "invalid_identity")
        .when(~c("identity_strategy").isin(*S.IDENTITY_STRATEGIES), "unsupported_identity_strategy")
        .when(F.coalesce("timestamp_ms", F.lit(0)) <= 0, "invalid_timestamp")
        .when(is_blank(c("session_key")), "missing_session")
        .when(is_blank(c("channel")) | is_blank(c("source_product")), "missing_source")
        .when(is_blank(c("event_granularity")), "missing_granularity")
        .when(negative, "negative_token")
        .when(c("source_total_tokens") < 0, "negative_source_total")
        .when(c("raw_input_tokens") < 0, "negative_raw_input")
        .when(c("total_tokens") < F.greatest(*_BUCKETS), "accounting_total_below_bucket")
        .otherwise(accounting_error())
    )


def validated(events: DataFrame) -> DataFrame:
    """Events with ``reject_code``; a code set earlier (no identity) stays."""
    if "reject_code" in events.columns:
        return events.withColumn("reject_code", F.coalesce("reject_code", reject_code()))
    return events.withColumn("reject_code", reject_code())

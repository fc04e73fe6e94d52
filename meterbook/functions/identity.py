"""Content-addressed identity: session keys, event ids and content hashes.

Hash input is JSON text with ``<``, ``>``, ``&``, U+2028 and U+2029 written as escapes, so
ids agree with ids computed by encoders that escape HTML characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterbook.functions.text import cleaned_path, first_filled, is_blank, or_empty, trimmed

# Characters the JSON encoder of the identity contract escapes.
ESCAPED = {
    "<": "\\u003c",
    ">": "\\u003e",
    "&": "\\u0026",
    "\u2028": "\\u2028",
    "\u2029": "\\u2029",
}

# Facts covered by the content hash, in key order.
CONTENT_FACTS = (
    "accounting_profile",
    "cache_creation_tokens",
    "cache_read_tokens",
    "channel",
    "event_granularity",
    "input_tokens",
    "model",
    "model_is_fallback",
    "model_normalized",
    "model_resolution",
    "observability_level",
    "output_tokens",
    "provider",
    "raw_input_tokens",
    "reasoning_tokens",
    "source_product",
    "source_total_tokens",
    "timestamp_ms",
    "token_accounting_method",
    "total_tokens",
)

_TEXT_FACTS = {
    "accounting_profile",
    "channel",
    "event_granularity",
    "model",
    "model_normalized",
    "model_resolution",
    "observability_level",
    "provider",
    "source_product",
    "token_accounting_method",
}

# Scopes that make an event id independent of its session.
GLOBAL_SCOPES = ("global", "source", "account")


def escaped_json(json: Column) -> Column:
    for char, escape in ESCAPED.items():
        json = F.replace(json, F.lit(char), F.lit(escape))
    return json


def hash_tuple(*parts: Column) -> Column:
    """SHA-256 of the JSON array of the parts; boundaries between parts are preserved."""
    return hash_array(F.array(*parts))


def hash_array(parts: Column) -> Column:
    return F.sha2(escaped_json(F.to_json(parts)), 256)


def stable_session_path(path: Column) -> Column:
    """Cleaned source-relative path, or NULL if the path is absolute or leaves its root."""
    unified = trimmed(F.translate(path, "\\", "/"))
    unstable = (
        (unified == "") | unified.startswith("/") | unified.rlike(r"^[\x00-\x7F]:")
    )
    clean = cleaned_path(unified)
    outside = (clean == "") | (clean == "..") | clean.startswith("../")
    return F.when(~unstable & ~outside, clean)


def session_seed(native_id: Column, path_id: Column) -> Column:
    return F.when(~is_blank(native_id), trimmed(native_id)).otherwise(stable_session_path(path_id))


def session_key(product: Column, native_id: Column, path_id: Column) -> Column:
    seed = session_seed(native_id, path_id)
    return F.when(
        seed.isNotNull(), hash_tuple(F.lit("session:v1"), trimmed(product), seed)
    )


def content_sha256(facts: dict[str, Column]) -> Column:
    """Hash of the normalised usage facts; absent numbers are explicit nulls."""
    fields = []
    for name in CONTENT_FACTS:
        value = trimmed(or_empty(facts[name])) if name in _TEXT_FACTS else facts[name]
        fields.append(value.alias(name))
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit("content:v1|"), escaped_json(body)), 256)


def identity_scope(scope: Column) -> Column:
    is_global = F.lower(trimmed(or_empty(scope))).isin(*GLOBAL_SCOPES)
    return F.when(is_global, F.lit("global")).otherwise(F.lit("session"))


def identity_choice(
    kind: Column,
    native_id: Column,
    subkey: Column,
    turn_id: Column,
    message_id: Column,
    request_id: Column,
    content: Column,
) -> Column:
    """``struct(strategy, kind, id)``: the strongest identifier the record carries."""

    def pick(strategy: str, as_kind: Column, value: Column) -> Column:
        return F.struct(
            F.lit(strategy).alias("strategy"), as_kind.alias("kind"), value.alias("id")
        )

    kind = trimmed(or_empty(kind))
    folded = F.lower(kind)
    native = trimmed(or_empty(native_id))
    turn, message, request = (trimmed(or_empty(c)) for c in (turn_id, message_id, request_id))
    has_native = native != ""
    has_subkey = ~is_blank(subkey)
    # A subkey separates segments of one identifier; it needs an identifier to qualify.
    request_value = F.when((request == "") & has_subkey, content).otherwise(request)
    turn_value = F.when((turn == "") & has_subkey, content).otherwise(turn)
    return (
        F.when(
            has_native & folded.isin("message", "native_message"),
            pick("native_message", F.lit("message"), native),
        )
        .when(
            has_native & folded.isin("request", "native_request"),
            pick("native_request", F.lit("request"), native),
        )
        .when(
            has_native & folded.isin("event", "native_event"),
            pick("native_event", F.lit("event"), native),
        )
        .when(
            has_native,
            pick("native_event", F.when(kind == "", F.lit("event")).otherwise(kind), native),
        )
        .when(
            folded.isin("record", "session_record"),
            pick(
                "session_record",
                F.lit("record"),
                F.coalesce(trimmed(first_filled(subkey)), F.lit("record")),
            ),
        )
        .when((folded == "turn") & (turn != ""), pick("session_turn", F.lit("turn"), turn))
        .when(message != "", pick("native_message", F.lit("message"), message))
        .when(
            or_empty(request_id) != "", pick("native_request", F.lit("request"), request_value)
        )
        .when(or_empty(turn_id) != "", pick("session_turn", F.lit("turn"), turn_value))
        .otherwise(pick("content_fallback", F.lit("content"), content))
    )


def event_id(
    product: Column, scope: Column, key: Column, kind: Column, native: Column, subkey: Column
) -> Column:
    head = [F.lit("event:v2"), trimmed(product), scope]
    tail = [kind, native, trimmed(or_empty(subkey))]
    return F.when(scope == "session", hash_tuple(*head, key, *tail)).otherwise(
        hash_tuple(*head, *tail)
    )


def identity_error(
    product: Column, timestamp_ms: Column, native_id: Column, path_id: Column
) -> Column:
    """First reason why a record cannot have an identity, or NULL."""
    return (
        F.when(is_blank(product), F.lit("missing_source_product"))
        .when(F.coalesce(timestamp_ms, F.lit(0)) <= 0, F.lit("invalid_timestamp"))
        .when(is_blank(native_id) & is_blank(path_id), F.lit("missing_session"))
        .when(
            session_seed(native_id, path_id).isNull(), F.lit("unstable_session_path")
        )
    )

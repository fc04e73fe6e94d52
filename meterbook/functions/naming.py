"""Names of models, providers and products, and token arithmetic by accounting method."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions.text import is_blank, trimmed

# Model name fragments that identify a provider, first match wins.
PROVIDER_FRAGMENTS = (
    ("claude", "anthropic"),
    ("gpt", "openai"),
    ("o1", "openai"),
    ("o3", "openai"),
    ("o4", "openai"),
    ("gemini", "google"),
    ("codex", "openai"),
)

# Product recorded for a channel that names none.
PRODUCT_OF_CHANNEL = {
    "claude": "claude-code",
    "codex": "codex-cli",
    "copilot": "copilot-otel",
    "gemini": "gemini-cli",
    "workbuddy": "workbuddy",
}

# Channels whose usage is complete unless a record says otherwise.
FULL_CHANNELS = ("claude", "codex", "copilot", "workbuddy")

# Model ids known under another name in one of the log families.
WORKBUDDY_MODELS = {
    "deepseek-v4-pro-202606": "deepseek-v4-pro",
    "k3": "kimi-k3",
    "kimi-k3-2": "kimi-k3",
}


def infer_provider(model: Column) -> Column:
    lowered = F.lower(F.coalesce(model, F.lit("")))
    found = F.lit("unknown")
    for fragment, provider in reversed(PROVIDER_FRAGMENTS):
        found = F.when(lowered.contains(fragment), F.lit(provider)).otherwise(found)
    return found


def speed_model(model: Column, speed: Column) -> Column:
    """``-fast`` variant of a model; the synthetic placeholder has no model."""
    return F.when(model != "<synthetic>", F.when(speed == "fast", F.concat(model, F.lit("-fast"))).otherwise(model))


def workbuddy_model(model: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in WORKBUDDY_MODELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, trimmed(model)), model)


def product_of_channel(channel: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PRODUCT_OF_CHANNEL.items() for x in pair])
    return F.coalesce(F.try_element_at(names, channel), channel)


def default_observability(channel: Column) -> Column:
    return F.when(channel.isin(*FULL_CHANNELS), F.lit("full")).otherwise(F.lit("unknown"))


def is_unknown(name: Column) -> Column:
    return is_blank(name) | (F.lower(trimmed(name)) == "unknown")


def less(a: Column, b: Column) -> Column:
    """Saturating difference."""
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def split_cached_input(raw_input: Column, cache_read: Column) -> tuple[Column, Column]:
    """Where the input counter includes cached tokens: ``(uncached input, cached part)``.

    Applies only where both counters are present; otherwise both stay as reported.
    """
    both = raw_input.isNotNull() & cache_read.isNotNull()
    zero = F.lit(0).cast("bigint")
    cached = F.when(both, F.least(raw_input, cache_read)).otherwise(F.coalesce(cache_read, zero))
    plain = F.when(both, less(raw_input, cached)).otherwise(F.coalesce(raw_input, zero))
    return plain, cached


def canonical_total(
    method: Column, inp: Column, out: Column, reasoning: Column, creation: Column, read: Column
) -> Column:
    """Total by accounting method, for records that report none."""
    side = inp + creation + read
    return (
        F.when(method.isin(*S.CODEX_METHODS), side + F.greatest(out, reasoning))
        .when(method == S.ACC_WORKBUDDY, side + out)
        .otherwise(side + out + reasoning)
    )

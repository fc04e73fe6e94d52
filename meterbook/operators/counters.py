"""Per-event usage from cumulative counters.

A snapshot is a struct of nullable longs ``(input, cached, output, reasoning, total)``;
a NULL part was absent in the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions.naming import less
from meterbook.operators.carry import Carry, carry

PARTS = ("input", "cached", "output", "reasoning", "total")
SNAPSHOT_DDL = "struct<" + ",".join(f"{p}:bigint" for p in PARTS) + ">"

# The two ways to read a cumulative log.
POLICY_LEDGER = "ledger"
POLICY_COMPATIBLE = "ccusage_compatible"


def policy_name(policy: str | None) -> str:
    name = (policy or "").strip()
    return name if name == POLICY_COMPATIBLE else POLICY_LEDGER


def snapshot(*values: Column) -> Column:
    return F.struct(*[v.cast("bigint").alias(p) for p, v in zip(PARTS, values)])


def part(snap: Column, name: str) -> Column:
    return F.coalesce(snap[name], F.lit(0).cast("bigint"))


def is_zero(snap: Column) -> Column:
    zero = F.lit(True)
    for p in PARTS:
        zero = zero & (part(snap, p) == 0)
    return zero


def same_values(a: Column, b: Column) -> Column:
    equal = F.lit(True)
    for p in PARTS:
        equal = equal & (part(a, p) == part(b, p))
    return equal


def difference(cur: Column, prev: Column) -> Column:
    """Part-wise saturating difference; absent parts stay absent."""
    return snapshot(
        *[F.when(cur[p].isNotNull(), less(cur[p], part(prev, p))) for p in PARTS]
    )


def reset_aware_difference(cur: Column, prev: Column) -> Column:
    """As ``difference``, but a total below the previous one means the counter restarted."""
    restarted = F.coalesce(part(cur, "total") < prev["total"], F.lit(False))
    return F.when(restarted, cur).otherwise(difference(cur, prev))


def usage_by_policy(
    policy: str, cumulative: Column, last: Column, prev: Column, headless: Column
) -> tuple[Column, Column]:
    """``(usage snapshot, accounting method)`` of one usage row."""
    single = F.coalesce(last, headless)
    single_method = F.when(last.isNotNull(), S.ACC_CODEX_LAST).otherwise(S.ACC_CODEX_HEADLESS)
    if policy == POLICY_LEDGER:
        usage = reset_aware_difference(cumulative, prev)
        method = F.lit(S.ACC_CODEX_DELTA)
    else:
        unchanged = prev.isNotNull() & same_values(cumulative, prev)
        nothing = snapshot(*[F.lit(0)] * 4, F.lit(None))
        usage = (
            F.when(unchanged, nothing)
            .when(last.isNull(), difference(cumulative, prev))
            .otherwise(last)
        )
        method = F.when(~unchanged & last.isNull(), S.ACC_CODEX_DELTA).otherwise(S.ACC_CODEX_LAST)
    is_cumulative = cumulative.isNotNull()
    return (
        F.when(is_cumulative, usage).otherwise(single),
        F.when(is_cumulative, method).otherwise(single_method),
    )


def bound_to_total(usage: Column) -> tuple[Column, Column]:
    """O3: ``(usage, partial)`` with ``input + max(output, reasoning) <= total``.

    The total is authoritative; parts that do not add up to it are partial detail.
    """
    total = usage["total"]
    span = F.greatest(part(usage, "output"), part(usage, "reasoning"))
    explained = part(usage, "input") + span
    checked = F.coalesce(total >= 0, F.lit(False))
    too_much = checked & (explained > total)
    span_fills = too_much & (span >= total)
    new_input = F.least(part(usage, "input"), total - span)
    zero = F.lit(0)
    squeezed = snapshot(
        zero,
        zero,
        F.least(part(usage, "output"), total),
        F.least(part(usage, "reasoning"), total),
        total,
    )
    # The presence of the input counter decides whether a raw input is recorded.
    squeezed = squeezed.withField(
        "input", F.when(usage["input"].isNotNull(), F.lit(0).cast("bigint"))
    )
    trimmed_input = usage.withField(
        "input", F.when(usage["input"].isNotNull(), new_input)
    ).withField("cached", F.least(part(usage, "cached"), new_input))
    bounded = F.when(span_fills, squeezed).when(too_much, trimmed_input).otherwise(usage)
    return bounded, checked & (explained != total)


def stored_counts(usage: Column) -> dict[str, Column]:
    """Cached part out of the input; the total falls back to the sum of the parts."""
    cached = F.least(part(usage, "cached"), part(usage, "input"))
    plain = less(part(usage, "input"), cached)
    output, reasoning = part(usage, "output"), part(usage, "reasoning")
    return {
        "input_tokens": plain,
        "cache_read_tokens": cached,
        "output_tokens": output,
        "reasoning_tokens": reasoning,
        "total_tokens": F.coalesce(usage["total"], plain + cached + F.greatest(output, reasoning)),
        "raw_input_tokens": usage["input"],
    }


def cumulative_deltas(
    df: DataFrame,
    policy: str = POLICY_LEDGER,
    file: str = "file_path",
    session: str = "session",
    order: str = "line_number",
) -> DataFrame:
    """O1-O4 over rows with ``cumulative``, ``last`` and ``headless`` snapshots.

    Adds the stored counters, ``method``, ``partial`` and ``is_empty`` (zero usage).
    """
    rows = carry(df, [Carry("previous", F.col("cumulative"), (file, session))], order)
    return with_usage(rows, policy, "previous")


def with_usage(rows: DataFrame, policy: str, previous: str) -> DataFrame:
    usage, method = usage_by_policy(
        policy, F.col("cumulative"), F.col("last"), F.col(previous), F.col("headless")
    )
    rows = rows.withColumn("usage", usage).withColumn("method", method)
    bounded, partial = bound_to_total(F.col("usage"))
    rows = rows.withColumn("bounded", bounded).withColumn("partial", partial)
    nothing = (
        (F.col("input_tokens") == 0)
        & (F.col("cache_read_tokens") == 0)
        & (F.col("output_tokens") == 0)
        & (F.col("reasoning_tokens") == 0)
        & (part(F.col("bounded"), "total") == 0)
    )
    return (
        rows.withColumns(stored_counts(F.col("bounded")))
        .withColumn("is_empty", nothing)
        .withColumn(
            "source_total_tokens",
            F.coalesce("cumulative", "last", "headless")["total"],
        )
        .drop("usage", "bounded", previous)
    )

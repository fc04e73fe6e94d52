"""Q3-Q7: audits of a ledger, diagnostics of raw logs, and comparisons of two results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions import jsonprobe as J
from meterbook.functions.text import or_empty
from meterbook.operators import pricing, replay
from meterbook.operators.counters import POLICY_COMPATIBLE, POLICY_LEDGER
from meterbook.operators.dedupe import first_occurrences
from meterbook.operators.metrics import source_stats
from meterbook.operators.normalize import as_events
from meterbook.operators.validate import validated
from meterbook.session import Staging
from meterbook.sources.codex import BODIES, COUNTERS
from meterbook.sources.profile import Profile


def audit(events: DataFrame) -> DataFrame:
    """Q3: stored rows that break a rule, and event ids stored more than once, by code."""
    broken = (
        validated(events)
        .where(F.col("reject_code").isNotNull())
        .groupBy(F.col("reject_code").alias("code"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    twice = (
        events.groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .agg(F.lit("duplicate_event_id").alias("code"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))
        .where(F.col("events") > 0)
    )
    return broken.unionByName(twice).orderBy("code")


_USAGE = J.leaves(*[n for names in COUNTERS for n in names])
_RAW_SHAPE = {
    "type": "variant",
    "usage": _USAGE,
    **{b: {"usage": _USAGE} for b in BODIES},
    "payload": {
        **J.leaves("type", "turn_id"),
        "info": {"total_token_usage": _USAGE, "last_token_usage": _USAGE},
    },
}


def source_diagnostics(lines: DataFrame) -> DataFrame:
    """Q4: what a cumulative-counter log is made of, as ``(metric, name, n)``."""
    doc = F.col("doc")
    payload = doc["payload"]
    info = payload["info"]
    docs = J.read(lines, _RAW_SHAPE)
    kinds = docs.select(
        doc.isNull().alias("bad"),
        F.coalesce(J.text(doc["type"]), F.lit("unknown")).alias("type"),
        J.text(payload["type"]).alias("payload_type"),
        J.text(payload["turn_id"]).isNotNull().alias("has_turn"),
        info["total_token_usage"].alias("total"),
        info["last_token_usage"].alias("last"),
        F.coalesce(doc["usage"], *[doc[b]["usage"] for b in BODIES]).alias("headless"),
    )
    is_event = F.col("type") == "event_msg"
    counted = is_event & F.coalesce(F.col("payload_type") == "token_count", F.lit(False))
    done = is_event & F.coalesce(F.col("payload_type") == "task_complete", F.lit(False))
    has_last = counted & F.col("last").isNotNull()
    has_total = counted & F.col("total").isNotNull()
    sample = F.when(counted, F.coalesce("last", "total")).when(~is_event, F.col("headless"))
    rows = kinds.withColumn("sample", sample)

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    # Zero usage is judged on what would be stored: cached input counts only within input.
    values = [J.long(*[F.col("sample")[c] for c in names]) for names in COUNTERS]
    inp, cached, output, reasoning, total = (F.coalesce(v, F.lit(0)) for v in values)
    zero = (inp == 0) & (F.least(cached, inp) == 0) & (output == 0) & (reasoning == 0) & (total == 0)
    counts = {
        "lines": F.count(F.lit(1)),
        "bad_json": n(F.col("bad")),
        "token_count": n(counted),
        "last_token_usage": n(has_last),
        "total_token_usage": n(has_total),
        "last_and_total_usage": n(has_last & has_total),
        "total_only_usage": n(has_total & F.col("last").isNull()),
        "all_zero_usage": n(F.col("sample").isNotNull() & zero),
        "task_complete": n(done),
        "task_complete_with_turn": n(done & F.col("has_turn")),
    }
    totals = rows.agg(*[c.alias(name) for name, c in counts.items()])
    entries = [
        F.struct(F.lit("usage").alias("metric"), F.lit(name).alias("name"), F.col(name).alias("n"))
        for name in counts
    ]
    summary = totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    good = rows.where(~F.col("bad"))
    by_type = good.groupBy(F.lit("type").alias("metric"), F.col("type").alias("name"))
    by_payload = good.where(F.col("payload_type").isNotNull()).groupBy(
        F.lit("payload_type").alias("metric"), F.col("payload_type").alias("name")
    )
    one = F.count(F.lit(1)).alias("n")
    return summary.unionByName(by_type.agg(one)).unionByName(by_payload.agg(one)).orderBy(
        "metric", "name"
    )


@dataclass
class PolicyComparison:
    """Stats of both policies, their difference, and files where the replay verdicts differ."""

    stats: DataFrame
    disagreements: DataFrame


def compare_policies(rows: DataFrame, staging: Staging) -> PolicyComparison:
    """Q5: both accounting policies over the same extracted rows.

    The comparison is conclusive only if ``disagreements`` is empty.
    """
    results = {p: replay.build_records(rows, p, staging) for p in (POLICY_LEDGER, POLICY_COMPATIBLE)}
    stats = None
    for policy, result in results.items():
        events = first_occurrences(as_events(result.records, 0).where(F.col("reject_code").isNull()))
        row = source_stats(events).withColumn("policy", F.lit(policy))
        stats = row if stats is None else stats.unionByName(row)

    def verdict(policy: str, side: str) -> DataFrame:
        v = results[policy].verdicts
        return v.select(
            "file_path", F.struct("quarantine", "skipped", "method").alias(side)
        )

    both = verdict(POLICY_LEDGER, "ledger").join(
        verdict(POLICY_COMPATIBLE, "compatible"), "file_path", "full_outer"
    )
    return PolicyComparison(stats, both.where(~F.col("ledger").eqNullSafe(F.col("compatible"))))


def policy_deltas(stats: DataFrame) -> DataFrame:
    """Compatible minus ledger, per statistic."""
    sign = F.when(F.col("policy") == POLICY_COMPATIBLE, 1).otherwise(-1)
    return stats.agg(
        F.sum(sign * F.col("events")).alias("delta_events"),
        F.sum(sign * F.col("total_tokens")).alias("delta_tokens"),
    )


# Dimensions two ledgers are compared by.
DIFF_DIMENSIONS = (
    "channel",
    "source_product",
    "provider",
    "model_normalized",
    "model_is_fallback",
    "identity_strategy",
)


def _profile_of(events: DataFrame, profile: Profile | None) -> DataFrame:
    """``(dimension, value, events, tokens, micro_usd, priced_events)`` in one pass."""
    rows = events
    if profile is not None:
        rows = pricing.with_cost(events, profile)
        priced = F.col("resolution") == pricing.PRICED
        micro, count = F.when(priced, F.col("micro_usd")).otherwise(0), F.when(priced, 1).otherwise(0)
    else:
        micro, count = F.lit(0), F.lit(0)
    # Combine all dimensions first; the explode then sees one row per combination.
    combos = rows.groupBy(*DIFF_DIMENSIONS).agg(
        F.count(F.lit(1)).alias("events"),
        *[F.sum(t).alias(t) for t in S.TOKEN_COLUMNS],
        F.sum(micro).cast("bigint").alias("micro_usd"),
        F.sum(count).cast("bigint").alias("priced_events"),
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"), or_empty(F.col(d).cast("string")).alias("value")
            )
            for d in DIFF_DIMENSIONS
        ]
    )
    measures = ("events", *S.TOKEN_COLUMNS, "micro_usd", "priced_events")
    return (
        combos.withColumn("p", F.explode(pairs))
        .groupBy("p.dimension", "p.value")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def ledger_diff(
    candidate: DataFrame, baseline: DataFrame, profile: Profile | None = None
) -> DataFrame:
    """Q6: candidate minus baseline by six dimensions; unchanged values are left out."""
    measures = ("events", *S.TOKEN_COLUMNS, "micro_usd", "priced_events")
    left = _profile_of(candidate, profile).select(
        "dimension", "value", *[F.col(m).alias(f"c_{m}") for m in measures]
    )
    right = _profile_of(baseline, profile).select(
        "dimension", "value", *[F.col(m).alias(f"b_{m}") for m in measures]
    )
    joined = left.join(right, ["dimension", "value"], "full_outer")
    zero = F.lit(0).cast("bigint")
    deltas = [
        (F.coalesce(f"c_{m}", zero) - F.coalesce(f"b_{m}", zero)).alias(f"delta_{m}")
        for m in measures
    ]
    out = joined.select("dimension", "value", *deltas)
    changed = F.lit(False)
    for m in measures:
        changed = changed | (F.col(f"delta_{m}") != 0)
    return out.where(changed).orderBy("dimension", "value")


"""Query-time cost of an event from a price profile.

Rules are few and known before the query, so they are compiled into the expression: the
price of a row is a projection, without join or shuffle, whatever the number of models.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions.text import or_empty, trimmed
from meterbook.sources.profile import Profile, ProfileError, Rule, load_profile

PRICED, POLICY_ZERO = "priced", "policy_zero"
MISSING_MODEL, MISSING_RULE = "missing_model", "missing_pricing_rule"
ZERO_BASIS = "unknown_model_zero_policy"

# Effort notes that may follow a model name in parentheses.
EFFORTS = ("minimal", "low", "medium", "high", "xhigh", "x-high")
_SUFFIX = (
    r"^(?s)(.+)\((?U:\s*)(?:reasoning=)?(?:reasoning:)?(?:effort=)?(?:effort:)?"
    r"(?:" + "|".join(EFFORTS) + r")(?U:\s*)\)$"
)

# Order of confidences from best to worst; others rank as "estimated".
CONFIDENCE_RANK = {"exact": 1, "estimated": 2, "approximate": 3, "partial": 4, "missing": 5}


def glob_regex(pattern: str) -> str | None:
    """Anchored regex of a glob whose wildcards stop at ``/``; None if it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\":
            i += 1
            if i >= len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif ch == "[":
            body = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", pattern[i:])
            if body is None:
                return None
            inner = re.sub(r"([\[&])", r"\\\1", body.group(2))
            out.append(f"[{body.group(1)}{inner}]")
            i += len(body.group(0)) - 1
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def _matches(patterns: tuple[str, ...], *values: Column) -> Column:
    """Equal to a pattern or matched by it; only real globs cost a regex."""
    plain = list(patterns)
    globs = [p for p in patterns if re.search(r"[*?\[\\]", p)]
    hit = F.lit(False)
    for value in values:
        hit = hit | F.coalesce(value.isin(*plain), F.lit(False))
        for glob in globs:
            regex = glob_regex(glob)
            if regex is not None:
                hit = hit | F.coalesce(value.rlike(regex), F.lit(False))
    return hit


def _applies(rule: Rule, model: Column, alias: Column) -> Column:
    c = F.col
    test = _matches(rule.patterns, model, alias)
    if rule.provider:
        test = test & _matches((rule.provider,), F.lower(trimmed(or_empty(c("provider")))))
    if rule.channel:
        test = test & _matches((rule.channel,), F.lower(trimmed(c("channel"))))
    if rule.from_ms is not None:
        test = test & (c("timestamp_ms") >= rule.from_ms)
    if rule.to_ms is not None:
        test = test & (c("timestamp_ms") < rule.to_ms)
    if rule.observability:
        level = F.lower(or_empty(c("observability_level")))
        test = test & (level == rule.observability.lower())
    if rule.min_input_side is not None:
        side = c("input_tokens") + c("cache_creation_tokens") + c("cache_read_tokens")
        test = test & (side >= rule.min_input_side)
    return test


def _lookup(values: list, index: Column, dtype: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(dtype) for v in values]), index)


def _rate_parts(rate: Fraction | None) -> tuple[int, int]:
    rate = rate or Fraction(0)
    if 2 * rate.numerator * rate.denominator >= 2**62:
        raise ProfileError(f"rate {rate} has too many digits")
    return rate.numerator, rate.denominator


def _micro_usd(tokens: Column, num: Column, den: Column) -> Column:
    """``tokens * num / den`` rounded half up, in longs: whole multiples of ``den`` first."""
    whole = F.call_function("div", tokens, den)
    rest = tokens - whole * den
    return whole * num + F.call_function("div", rest * num * 2 + den, den * 2)


def event_tokens() -> Column:
    """Tokens that count for coverage."""
    c = F.col
    parts = (
        c("input_tokens")
        + c("output_tokens")
        + c("cache_creation_tokens")
        + c("cache_read_tokens")
        + c("reasoning_tokens")
    )
    return F.when(c("total_tokens") > 0, c("total_tokens")).otherwise(parts)


def with_cost(df: DataFrame, profile: Profile) -> DataFrame:
    """Add ``rule_id``, ``resolution``, ``confidence``, ``micro_usd`` and ``coverage_tokens``.

    Needs provider, channel, model, time, observability, method and token columns only.
    """
    c = F.col
    named = df.withColumn("_model", F.lower(trimmed(or_empty(c("model_normalized")))))
    named = named.withColumn(
        "_alias",
        F.when(c("_model").endswith(")") & c("_model").rlike(_SUFFIX),
               trimmed(F.regexp_extract("_model", _SUFFIX, 1))),
    )
    model = c("_model")
    rules = profile.rules
    blocked = model == ""
    if not profile.unknown_is_zero:
        blocked = blocked | (model == "unknown")
    first = F.coalesce(
        *[F.when(_applies(r, model, c("_alias")), F.lit(i)) for i, r in enumerate(rules)]
    )
    ruled = named.withColumn("_rule", F.when(~blocked, first))
    rule = c("_rule")
    is_zero_rule = F.coalesce(_lookup([r.basis == ZERO_BASIS for r in rules], rule, "boolean"), F.lit(False))
    resolution = (
        F.when(rule.isNotNull(), F.when(is_zero_rule, POLICY_ZERO).otherwise(PRICED))
        .when(blocked | (model == "unknown"), MISSING_MODEL)
        .otherwise(MISSING_RULE)
    )
    separate = c("token_accounting_method").isin(S.ACC_COPILOT_PARTS, S.ACC_COPILOT_SESSION)
    as_output = _lookup([r.reasoning_as_output for r in rules], rule, "boolean")
    charged = F.coalesce(separate, F.lit(False)) | as_output
    output = c("output_tokens") + F.when(charged, c("reasoning_tokens")).otherwise(0)
    cost = F.lit(0).cast("bigint")
    buckets = (c("input_tokens"), output, c("cache_read_tokens"), c("cache_creation_tokens"))
    for n, tokens in enumerate(buckets):
        parts = [_rate_parts(r.rates[n]) for r in rules]
        num = _lookup([p[0] for p in parts], rule, "bigint")
        den = _lookup([p[1] for p in parts], rule, "bigint")
        cost = cost + _micro_usd(tokens, num, den)
    confidences = ["policy" if r.basis == ZERO_BASIS else r.confidence for r in rules]
    return ruled.withColumns(
        {
            "rule_id": _lookup([r.id for r in rules], rule, "string"),
            "basis": _lookup([r.basis for r in rules], rule, "string"),
            "resolution": resolution,
            "confidence": F.coalesce(_lookup(confidences, rule, "string"), F.lit("missing")),
            "micro_usd": F.coalesce(cost, F.lit(0).cast("bigint")),
            "coverage_tokens": event_tokens(),
        }
    ).drop("_model", "_alias", "_rule")


@dataclass(frozen=True)
class Costing:
    """P10: how a report shows cost: a profile, an unusable profile, or not at all."""

    profile: Profile | None = None
    error_code: str | None = None
    wanted: bool = True

    @classmethod
    def load(cls, mode: str = "estimated", path: str | None = None, explicit: bool = False):
        """A broken configured profile leaves usage answerable; a broken explicit one is an error."""
        mode = (mode or "").strip().lower() or "estimated"
        if mode not in ("estimated", "none"):
            raise ValueError(f"unsupported cost mode {mode!r}: expected estimated or none")
        if explicit and not (path or "").strip():
            raise ValueError("explicit pricing path cannot be empty")
        try:
            profile = load_profile(path)
        except ProfileError:
            if explicit:
                raise
            return cls(None, "pricing_profile_invalid", mode == "estimated")
        return cls(profile if mode == "estimated" else None, None, mode == "estimated")

    def prepare(self, df: DataFrame) -> DataFrame:
        return with_cost(df, self.profile) if self.profile else df

    def _codes(self) -> dict[str, int]:
        """Confidences as integers: the maximum is the worst, on ties the first by name."""
        names = {r.confidence for r in self.profile.rules} | {"missing"}
        return {
            name: CONFIDENCE_RANK.get(name, 2) * 1000 + 999 - position
            for position, name in enumerate(sorted(names))
        }

    def aggregates(self) -> list[Column]:
        """Conditional sums that share the aggregation of the usage sums."""
        if not self.profile:
            return []
        resolution, tokens = F.col("resolution"), F.col("coverage_tokens")
        priced, zero = resolution == PRICED, resolution == POLICY_ZERO
        codes = self._codes()
        code = F.lit(codes["missing"])
        for name, value in codes.items():
            code = F.when(priced & (F.col("confidence") == name), F.lit(value)).otherwise(code)
        return [
            F.sum(F.when(priced, F.col("micro_usd"))).alias("micro_usd"),
            F.count(F.when(priced, 1)).alias("priced_events"),
            F.count(F.when(~priced & ~zero, 1)).alias("unpriced_events"),
            F.count(F.when(zero, 1)).alias("policy_zero_events"),
            F.sum(F.when(priced, tokens)).alias("priced_tokens"),
            F.sum(F.when(~priced & ~zero, tokens)).alias("unpriced_tokens"),
            F.sum(F.when(zero, tokens)).alias("policy_zero_tokens"),
            F.max(code).alias("confidence_code"),
        ]

    COUNTS = (
        "priced_events",
        "unpriced_events",
        "policy_zero_events",
        "priced_tokens",
        "unpriced_tokens",
        "policy_zero_tokens",
    )

    def combine(self) -> list[Column]:
        """Aggregates over rows that already carry ``aggregates`` of finer groups."""
        if not self.profile:
            return []
        sums = [F.sum(n).alias(n) for n in ("micro_usd", *self.COUNTS)]
        return [*sums, F.max("confidence_code").alias("confidence_code")]

    def columns(self) -> list[Column]:
        """Report columns from the aggregates."""
        nothing = F.lit(None)
        if not self.profile:
            zero = F.lit(0) if self.wanted else nothing
            return [
                nothing.cast("double").alias("estimated_cost_usd"),
                F.lit("unavailable" if self.wanted else None).cast("string").alias("pricing_status"),
                F.lit(self.error_code).cast("string").alias("pricing_error_code"),
                nothing.cast("string").alias("pricing_profile_id"),
                *[zero.cast("bigint").alias(n) for n in self.COUNTS],
                zero.cast("double").alias("event_coverage_ratio"),
                zero.cast("double").alias("token_coverage_ratio"),
                nothing.cast("string").alias("confidence"),
            ]
        c = F.col
        counts = {n: F.coalesce(n, F.lit(0).cast("bigint")) for n in self.COUNTS}

        def ratio(kind: str) -> Column:
            whole = (
                counts[f"priced_{kind}"] + counts[f"unpriced_{kind}"] + counts[f"policy_zero_{kind}"]
            )
            share = counts[f"priced_{kind}"].cast("double") / F.nullif(whole, F.lit(0)).cast("double")
            return F.coalesce(share, F.lit(0.0))

        names = F.create_map(
            *[F.lit(x) for name, code in self._codes().items() for x in (code, name)]
        )
        return [
            (F.coalesce("micro_usd", F.lit(0)).cast("double") / 1e6).alias("estimated_cost_usd"),
            F.lit("available").alias("pricing_status"),
            nothing.cast("string").alias("pricing_error_code"),
            F.lit(self.profile.id).alias("pricing_profile_id"),
            *[counts[n].alias(n) for n in self.COUNTS],
            ratio("events").alias("event_coverage_ratio"),
            ratio("tokens").alias("token_coverage_ratio"),
            F.try_element_at(names, c("confidence_code")).alias("confidence"),
        ]


def unpriced_models(df: DataFrame, profile: Profile, resolution: str | None = None) -> DataFrame:
    """Models without price, or with the zero policy, by tokens."""
    wanted = (POLICY_ZERO,) if resolution == POLICY_ZERO else (MISSING_MODEL, MISSING_RULE)
    # Rows are classified once and selected as groups: a filter on the class before the
    # aggregation would evaluate the price rules twice per row.
    return (
        with_cost(df, profile)
        .groupBy(
            or_empty(F.col("provider")).alias("provider"),
            "channel",
            F.col("model_normalized").alias("model"),
            F.col("resolution").alias("reason"),
        )
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum("coverage_tokens").alias("tokens"),
            F.bool_or(F.col("resolution").isin(*wanted)).alias("wanted"),
        )
        .where("wanted")
        .drop("wanted")
        .orderBy(F.desc("tokens"), "model", "provider", "channel", "reason")
    )

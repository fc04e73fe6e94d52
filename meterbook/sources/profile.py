"""Price profiles. A profile is a small JSON document read on the driver."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field
from datetime import date, timedelta, timezone, datetime
from fractions import Fraction
from importlib import resources

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# The only schema and unit of a profile.
PROFILE_VERSION = 1
PROFILE_UNIT = "usd_per_1m_tokens"

RATE_NAMES = (
    "input",
    "cached_input",
    "output",
    "cache_creation",
    "cache_write",
    "cache_write_5m",
    "cache_write_1h",
    "cache_read",
)
UNSUPPORTED_RATES = ("reasoning", "request")


class ProfileError(ValueError):
    """The profile cannot be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    patterns: tuple[str, ...]
    provider: str
    channel: str
    basis: str
    confidence: str
    from_ms: int | None
    to_ms: int | None
    min_input_side: int | None
    observability: str
    reasoning_as_output: bool
    # Rates of input, output, cache read and cache creation; None charges nothing.
    rates: tuple[Fraction | None, ...] = field(default=())


@dataclass(frozen=True)
class Profile:
    id: str
    currency: str
    unknown_is_zero: bool
    rules: tuple[Rule, ...]


def load_profile(path: str | None = None) -> Profile:
    """The profile at ``path``, or the sample profile of the package."""
    if path and path.strip():
        # A profile is one small file, wherever Spark can read.
        spark = SparkSession.builder.getOrCreate()
        try:
            text = spark.read.text(path, wholetext=True).first()[0]
        except (AnalysisException, TypeError) as err:
            raise ProfileError(f"no price profile can be read from {path}") from err
    else:
        text = resources.files("meterbook").joinpath("prices.json").read_text("utf-8")
    return parse_profile(text)


def parse_profile(text: str) -> Profile:
    try:
        raw = json.loads(text, parse_float=str, parse_int=str)
    except ValueError as err:
        raise ProfileError(f"the price profile is not JSON: {err}") from err
    _check(raw)
    defaults = raw.get("defaults") or {}
    ordered = sorted(raw["rules"], key=lambda r: -int(r.get("priority") or 0))
    return Profile(
        id=raw["id"],
        currency=raw["currency"],
        unknown_is_zero=str(defaults.get("unknown_model_policy") or "").lower() == "zero",
        rules=tuple(_rule(r, defaults) for r in ordered),
    )


def _filled(*values) -> str:
    return next((v for v in values if v and str(v).strip()), "")


def _rate(value) -> Fraction | None:
    if value is None:
        return None
    text = str(value).strip() or "0"
    try:
        return Fraction(text.replace(" ", ""))
    except (ValueError, ZeroDivisionError) as err:
        raise ProfileError(f"{text!r} is no rate") from err


def _day(name: str, value) -> date | None:
    if not value or not str(value).strip():
        return None
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        raise ProfileError(f"{name}: {value!r} is no day")
    try:
        return date.fromisoformat(value)
    except ValueError as err:
        raise ProfileError(f"{name}: {value!r} is no day") from err


def _utc_ms(day: date | None) -> int | None:
    if day is None:
        return None
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)


# What a profile must look like, as a table: where, field, kind, and whether it must be there.
_FIELDS = (
    ("profile", "id", "text", True),
    ("profile", "currency", "text", True),
    ("profile", "checked_at", "day", False),
    ("profile", "rules", "list", True),
    ("source", "checked_at", "day", False),
    ("rule", "id", "text", True),
    ("rule", "model_patterns", "list", True),
    ("rule", "effective_from", "day", False),
    ("rule", "effective_to", "day", False),
    ("rule", "as_of", "day", False),
)


def _field_problems(where: str, name: str, entry: dict) -> list[str]:
    problems = []
    for place, key, kind, needed in _FIELDS:
        if place != where:
            continue
        value = entry.get(key)
        if kind == "day":
            try:
                _day(key, value)
            except ProfileError:
                problems.append(f"{name}: {key} is no calendar day like 2024-01-31")
        elif needed and not (value if kind == "list" else _filled(value)):
            problems.append(f"{name}: {key} is missing or empty")
    return problems


def _rule_problems(rule: dict, name: str) -> list[str]:
    problems = _field_problems("rule", name, rule)
    if not problems:
        span = [_day("", rule.get(key)) for key in ("effective_from", "effective_to")]
        if all(span) and span[0] > span[1]:
            problems.append(f"{name}: it ends before it starts")
    rates = rule.get("rates") or {}
    if any(rates.get(r) is not None for r in UNSUPPORTED_RATES):
        problems.append(f"{name}: it has a rate for something that events do not report")
    known = [r for r in (_rate(rates.get(n)) for n in RATE_NAMES) if r is not None]
    if not known:
        problems.append(f"{name}: it prices no kind of token")
    if any(r < 0 for r in known):
        problems.append(f"{name}: a rate is below zero")
    return problems


def _check(raw: dict) -> None:
    """Refuse a profile with all that is wrong with it."""
    if not isinstance(raw, dict) or str(raw.get("schema_version")) != str(PROFILE_VERSION):
        raise ProfileError(f"only price profiles of schema version {PROFILE_VERSION} can be read")
    problems = _field_problems("profile", "profile", raw)
    if _filled(raw.get("unit")).strip() != PROFILE_UNIT:
        problems.append(f"profile: unit must be {PROFILE_UNIT}")
    for n, source in enumerate(raw.get("sources") or [], 1):
        problems += _field_problems("source", f"source {n}", source)
    ids = [rule.get("id") for rule in raw.get("rules") or []]
    for n, rule in enumerate(raw.get("rules") or [], 1):
        problems += _rule_problems(rule, f"rule {rule.get('id') or n}")
    problems += [f"rule {i}: its id is used {k} times" for i, k in Counter(ids).items() if k > 1 and i]
    if problems:
        raise ProfileError("; ".join(problems))


def _creation_rate(rates: dict, assumption: str) -> Fraction | None:
    """Rate of cache writes: the explicit one, then the assumed lifetime, then the input rate."""
    order = ["cache_creation", "cache_write"]
    if assumption in ("1h_if_unknown", "assume_1h"):
        order.append("cache_write_1h")
    order += ["cache_write_5m", "input"]
    return next((rates[name] for name in order if rates[name] is not None), None)


def _rule(raw: dict, defaults: dict) -> Rule:
    rates = {name: _rate((raw.get("rates") or {}).get(name)) for name in RATE_NAMES}
    assumption = _filled(
        raw.get("cache_write_assumption"), defaults.get("cache_write_assumption")
    ).lower()
    reasoning = _filled(
        raw.get("reasoning_policy"), defaults.get("reasoning_policy"), "included_in_output"
    ).lower()
    condition = raw.get("condition") or {}
    end = _day("effective_to", raw.get("effective_to"))
    minimum = condition.get("min_input_side_tokens")
    read = rates["cache_read"] if rates["cache_read"] is not None else rates["cached_input"]
    return Rule(
        id=raw["id"],
        patterns=tuple(p.strip().lower() for p in raw["model_patterns"] if p.strip()),
        provider=_filled(raw.get("provider")).strip().lower(),
        channel=_filled(raw.get("channel")).strip().lower(),
        basis=_filled(raw.get("basis"), "api_equivalent"),
        confidence=_filled(raw.get("confidence"), defaults.get("confidence"), "estimated"),
        from_ms=_utc_ms(_day("effective_from", raw.get("effective_from"))),
        to_ms=_utc_ms(end + timedelta(days=1)) if end else None,
        min_input_side=None if minimum is None else int(minimum),
        observability=_filled(condition.get("requires_observability")),
        reasoning_as_output=reasoning in ("separate_as_output", "priced_as_output"),
        rates=(rates["input"], rates["output"], read, _creation_rate(rates, assumption)),
    )

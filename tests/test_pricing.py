import json

import pytest
from meterbook.operators import pricing
from meterbook.operators.metrics import breakdown
from meterbook.operators.pricing import Costing, glob_regex, with_cost
from meterbook.sources.profile import ProfileError, load_profile, parse_profile

SCHEMA = (
    "id string, provider string, channel string, model_normalized string, timestamp_ms bigint, "
    "observability_level string, token_accounting_method string, input_tokens bigint, "
    "output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, "
    "reasoning_tokens bigint, total_tokens bigint"
)


def event(id, model, inp=0, out=0, create=0, read=0, reason=0, *, method="m", ts=1, obs="full", provider="p"):
    total = inp + out + create + read + reason
    return (id, provider, "c", model, ts, obs, method, inp, out, create, read, reason, total)


def profile(*rules, **defaults):
    body = {
        "schema_version": 1,
        "id": "t",
        "currency": "USD",
        "unit": "usd_per_1m_tokens",
        "defaults": defaults,
        "rules": list(rules),
    }
    return parse_profile(json.dumps(body))


def rule(id="r", patterns=("m",), **more):
    return {"id": id, "model_patterns": list(patterns), "rates": {"input": 1}, **more}


def costs(spark, prof, *events):
    rows = with_cost(spark.createDataFrame(list(events), SCHEMA), prof).collect()
    return {r.id: (r.resolution, r.rule_id, r.micro_usd) for r in rows}


def test_rounding_is_half_up_and_exact(spark):
    third = profile(rule(rates={"input": "1/3", "output": 0.5, "cache_read": "24/17"}))
    got = costs(
        spark,
        third,
        event("a", "m", inp=1),
        event("b", "m", inp=2),
        event("c", "m", out=1),
        event("d", "m", out=3),
        event("e", "m", read=10**15 + 1),
    )
    assert {k: v[2] for k, v in got.items()} == {
        "a": 0,
        "b": 1,
        "c": 1,
        "d": 2,
        "e": ((10**15 + 1) * 24 * 2 + 17) // 34,
    }


def test_threshold_counts_the_input_side(spark):
    prof = profile(
        rule("long", priority=5, condition={"min_input_side_tokens": 100}, rates={"input": 2}),
        rule("short"),
    )
    got = costs(spark, prof, event("a", "m", inp=50, create=25, read=24), event("b", "m", inp=50, create=25, read=25))
    assert got["a"][1] == "short" and got["b"][1] == "long"


def test_patterns_aliases_and_slashes(spark):
    prof = profile(rule("glob", ["gpt-*"]), rule("exact", ["o3"]), rule("one", ["z?[a-c]"]))
    got = costs(
        spark,
        prof,
        event("a", "GPT-5 (reasoning=xhigh)"),
        event("b", "tenant/gpt-5"),
        event("c", "o3 (low)"),
        event("d", "o3 (fast)"),
        event("e", "zxb"),
        event("f", "zxd"),
        event("g", " O3 "),
    )
    assert [got[k][1] for k in "abcdefg"] == ["glob", None, "exact", None, "one", None, "exact"]
    assert got["b"][0] == pricing.MISSING_RULE


def test_unknown_model_policies(spark):
    zero_rule = rule("zero", ["unknown"], basis="unknown_model_zero_policy")
    zero = costs(spark, profile(zero_rule, unknown_model_policy="zero"), event("a", "unknown", inp=9), event("b", ""))
    assert zero["a"][0] == pricing.POLICY_ZERO and zero["b"][0] == pricing.MISSING_MODEL
    strict = costs(spark, profile(zero_rule), event("a", "Unknown", inp=9))
    assert strict["a"][:2] == (pricing.MISSING_MODEL, None)


def test_windows_are_utc_days_inclusive(spark):
    prof = profile(rule("w", effective_from="2024-01-02", effective_to="2024-01-02"))
    day = 1704153600000
    got = costs(spark, prof, *[event(str(t), "m", ts=t) for t in (day - 1, day, day + 86399999, day + 86400000)])
    assert [v[1] for _, v in sorted(got.items())] == [None, "w", "w", None]


def test_reasoning_and_cache_rates(spark):
    rates = {"input": 1, "output": 10, "cached_input": 2, "cache_write_5m": 3, "cache_write_1h": 4}
    prof = profile(
        rule("plain", ["plain"], rates=rates),
        rule("sep", ["sep"], rates=rates, reasoning_policy="separate_as_output"),
        rule("hour", ["hour"], rates=rates, cache_write_assumption="assume_1h"),
        rule("none", ["none"], rates={"input": 1}),
    )
    got = costs(
        spark,
        prof,
        event("a", "plain", 1, 1, 1, 1, 1),
        event("b", "sep", 1, 1, 1, 1, 1),
        event("c", "hour", 1, 1, 1, 1, 1),
        event("d", "none", 1, 1, 1, 1, 1),
        event("e", "plain", 1, 1, 1, 1, 1, method="copilot_otel_parts"),
    )
    assert [got[k][2] for k in "abcde"] == [16, 26, 17, 2, 26]


def test_condition_on_observability_and_provider(spark):
    prof = profile(
        rule("obs", priority=2, condition={"requires_observability": "Full"}),
        rule("prov", priority=1, provider="AC*"),
    )
    got = costs(spark, prof, event("a", "m"), event("b", "m", obs="partial", provider="acme"), event("c", "m", obs="x"))
    assert [got[k][1] for k in "abc"] == ["obs", "prov", None]


def test_confidence_of_a_group_is_the_worst(spark):
    prof = profile(rule("a", ["a"], confidence="exact"), rule("b", ["b"], confidence="approximate"))
    df = spark.createDataFrame([event("1", "a", 1), event("2", "b", 1), event("3", "a", 1)], SCHEMA)
    df = df.selectExpr("*", "'s' AS session_key", "cast(null as string) AS project_path", "'x' AS source_product")
    rows = {r.label: r for r in breakdown(df, "model", costing=Costing(prof)).collect()}
    whole = breakdown(df, "channel", costing=Costing(prof)).first()
    assert rows["a"].confidence == "exact" and whole.confidence == "approximate"
    assert whole.event_coverage_ratio == 1.0 and whole.estimated_cost_usd == 3e-6


@pytest.mark.parametrize(
    "change",
    [
        {"schema_version": 2},
        {"id": " "},
        {"currency": ""},
        {"unit": "usd"},
        {"rules": []},
        {"rules": [rule(), rule()]},
        {"rules": [rule(patterns=())]},
        {"rules": [rule(effective_from="2024-02-31")]},
        {"rules": [rule(effective_from="2024-02-02", effective_to="2024-02-01")]},
        {"rules": [rule(rates={"reasoning": 1, "input": 1})]},
        {"rules": [rule(rates={})]},
        {"rules": [rule(rates={"input": -1})]},
        {"rules": [rule(rates={"input": "abc"})]},
    ],
)
def test_bad_profiles_are_refused(change):
    body = {"schema_version": 1, "id": "t", "currency": "USD", "unit": "usd_per_1m_tokens", "rules": [rule()]}
    parse_profile(json.dumps(body))
    with pytest.raises(ProfileError):
        parse_profile(json.dumps({**body, **change}))


def test_costing_modes(tmp_path):
    assert Costing.load().profile.id == load_profile().id
    assert Costing.load("none").profile is None
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    assert Costing.load(path=str(bad)).error_code == "pricing_profile_invalid"
    with pytest.raises(ProfileError):
        Costing.load(path=str(bad), explicit=True)
    with pytest.raises(ValueError):
        Costing.load("actual")


def test_malformed_globs_match_nothing():
    assert glob_regex("a[") is None and glob_regex("a\\") is None

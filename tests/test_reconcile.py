"""Verdicts in arrival order, against a plain fold over one event at a time."""

import random

import pytest
from meterbook import schema as S
from meterbook.operators import reconcile as R
from meterbook.operators.normalize import cleaned
from meterbook.operators.validate import validated
from pyspark.sql import functions as F

BASE = {
    "event_id": "e",
    "identity_version": 2,
    "identity_strategy": "native_event",
    "identity_scope": "session",
    "content_sha256": "h0",
    "event_granularity": "request",
    "channel": "c",
    "source_product": "p",
    "model_normalized": "unknown",
    "model_resolution": "unknown",
    "model_is_fallback": True,
    "timestamp_ms": 5,
    "session_key": "s",
    "input_tokens": 1,
    "output_tokens": 1,
    "reasoning_tokens": 0,
    "cache_creation_tokens": 0,
    "cache_read_tokens": 0,
    "total_tokens": 2,
    "imported_at_ms": 1,
    "updated_at_ms": 1,
}


@pytest.fixture
def frame(spark):
    def make(rows):
        full = [tuple({**BASE, **r}.get(f.name) for f in S.LEDGER_SCHEMA.fields) for r in rows]
        relaxed = S.T.StructType([S.T.StructField(f.name, f.dataType) for f in S.LEDGER_SCHEMA.fields])
        return spark.createDataFrame(full, relaxed)

    return make


def batch(frame, rows):
    df = validated(cleaned(frame([{**r, "raw_sha256": str(i)} for i, r in enumerate(rows)])))
    key = F.struct(
        F.lit(0).alias("source"),
        F.array(F.lit("f")).alias("path"),
        F.col("raw_sha256").cast("bigint").alias("line"),
        F.lit(0).cast("bigint").alias("part"),
    )
    # The position must not count as a fact to fill in.
    return df.withColumn("order_key", key).withColumn("raw_sha256", F.lit("x"))


CASES = [
    ({}, ("skipped", None)),
    ({"content_sha256": "h1"}, ("rejected", "content_conflict")),
    ({"identity_scope": "global"}, ("rejected", "identity_conflict")),
    ({"timestamp_ms": 6}, ("rejected", "timestamp_conflict")),
    ({"session_key": "t"}, ("rejected", "session_conflict")),
    ({"session_id": "other"}, ("rejected", "session_conflict")),
    ({"session_id": "SID", "content_sha256": "h1", "turn_id": "t"}, ("updated", None)),
    ({"channel": "d"}, ("rejected", "source_conflict")),
    ({"event_granularity": "session"}, ("rejected", "granularity_conflict")),
    ({"input_tokens": 2, "total_tokens": 3}, ("rejected", "token_conflict")),
    ({"raw_input_tokens": 9}, ("rejected", "token_conflict")),
    ({"accounting_profile": "z"}, ("rejected", "accounting_conflict")),
    ({"provider": "acme"}, ("rejected", "provider_conflict")),
    ({"provider": "Unknown", "content_sha256": "h1"}, ("rejected", "content_conflict")),
    ({"model_normalized": "m2", "model_resolution": "direct_event", "model_is_fallback": False},
     ("rejected", "direct_model_conflict")),
    ({"model_normalized": "m2", "model_resolution": "turn_context", "model_is_fallback": False,
      "content_sha256": "h1"}, ("skipped", None)),
    ({"model_normalized": "unknown", "content_sha256": "h1"}, ("skipped", None)),
    ({"input_tokens": -1}, ("rejected", "negative_token")),
]


def test_verdicts_against_a_stored_event(frame, staging):
    stored = {
        "session_id": "sid",
        "raw_input_tokens": 8,
        "accounting_profile": "a",
        "provider": "openai",
        "model_normalized": "m1",
        "model_resolution": "direct_event",
        "model_is_fallback": False,
    }
    rows, want = [], []
    for i, (change, verdict) in enumerate(CASES):
        rows.append({**stored, **change, "event_id": f"e{i}"})
        want.append((f"e{i}", *verdict))
    known = cleaned(frame([{**stored, "event_id": f"e{i}"} for i in range(len(CASES))]))
    out = R.reconcile_batch(batch(frame, rows), known, staging, 7)
    got = {r.event_id: (r.status, r.code) for r in out.decisions.collect()}
    # raw_sha256 of the stored rows is missing, so a row with new content would fill it.
    filled = {e for e, _, c in want if c == "content_conflict"}
    weaker = {"e15", "e16"}
    for event, status, code in want:
        expected = ("updated", None) if event in filled | weaker else (status, code)
        assert got[event] == expected, event


def test_equal_hash_skips_before_filling(frame, staging):
    known = cleaned(frame([{}]))
    out = R.reconcile_batch(batch(frame, [{"turn_id": "t"}]), known, staging, 7)
    assert out.decisions.first().status == "skipped" and out.changes.count() == 0


def fold(rows):
    """Statuses of one event's rows in order, for the few facts the random test varies."""
    state, out = None, []
    rank = lambda r: 0 if r["model_normalized"] == "unknown" else (2 if r["model_resolution"] == "direct_event" else 1)
    for r in rows:
        if state is None:
            state = dict(r)
            out.append("inserted")
            continue
        clash = any(
            state.get(k) and r.get(k) and state[k] != r[k] for k in ("provider", "session_id", "accounting_profile")
        )
        both = rank(state) == rank(r) == 2 and state["model_normalized"] != r["model_normalized"]
        if clash or both or state["total_tokens"] != r["total_tokens"]:
            out.append("rejected")
            continue
        if state["content_sha256"] == r["content_sha256"]:
            out.append("skipped")
            continue
        new, content, meta = dict(state), False, False
        if rank(r) > rank(state):
            new.update({k: r[k] for k in ("model_normalized", "model_resolution", "model_is_fallback")})
            content = True
        for k in ("provider", "accounting_profile"):
            if not state.get(k) and r.get(k):
                new[k], content = r[k], True
        for k in ("session_id", "turn_id"):
            if not state.get(k) and r.get(k):
                new[k], meta = r[k], True
        if not content and not meta:
            out.append("skipped" if rank(r) < rank(state) else "rejected")
            continue
        if content:
            new["content_sha256"] = r["content_sha256"]
        state = new
        out.append("updated")
    return out, state


def test_random_batches_match_the_fold(frame, staging):
    rng = random.Random(3)
    models = [
        ("unknown", "unknown", True),
        ("m1", "turn_context", False),
        ("m1", "direct_event", False),
        ("m2", "direct_event", False),
    ]
    rows = []
    for i in range(150):
        name, how, fallback = rng.choice(models)
        rows.append(
            {
                # One event takes half of the batch.
                "event_id": "hot" if i % 2 else f"e{rng.randrange(12)}",
                "content_sha256": f"h{rng.randrange(9)}",
                "provider": rng.choice([None, None, "a", "b"]),
                "session_id": rng.choice([None, "x"]),
                "accounting_profile": rng.choice([None, None, None, "q"]),
                "turn_id": rng.choice([None, "t"]),
                "model_normalized": name,
                "model_raw": None,
                "model_resolution": how,
                "model_is_fallback": fallback,
                **({"output_tokens": 2, "total_tokens": 3} if rng.random() < 0.1 else {"total_tokens": 2}),
            }
        )
    out = R.reconcile_batch(batch(frame, rows), frame([]), staging, 7)
    got = {r.order_key.line: r.status for r in out.decisions.collect()}
    final = {r.event_id: r for r in out.changes.collect()}
    want = {}
    for event in {r["event_id"] for r in rows}:
        places = [i for i, r in enumerate(rows) if r["event_id"] == event]
        statuses, state = fold([rows[i] for i in places])
        want.update(dict(zip(places, statuses)))
        assert final[event].content_sha256 == state["content_sha256"]
        assert final[event].provider == state["provider"] and final[event].turn_id == state["turn_id"]
        assert final[event].change == "inserted"
    assert got == want
    assert sum(R.status_counts(out.decisions).first()) == len(rows)


def test_rounds_keep_no_rows_and_marks_leave_none_out(spark, staging, frame, monkeypatch):
    """Stored rounds hold verdicts, not the batch; with few slots many events share one."""
    monkeypatch.setattr(R, "SLOTS", 64)
    better = {"model_normalized": "m", "model_resolution": "direct_event", "model_is_fallback": False, "content_sha256": "h1"}
    rows = [{"event_id": f"e{n}", **more} for more in ({}, better, {"provider": "p"}) for n in range(200)]
    stored = cleaned(frame([{"event_id": f"e{n}", **({} if n % 3 else better)} for n in range(0, 200, 2)]))
    kept, put = {}, staging.put

    def watched(df, name):
        kept[name] = df.columns
        return put(df, name)

    monkeypatch.setattr(staging, "put", watched)
    got = R.reconcile_batch(batch(frame, rows), stored, staging, 9).decisions
    found = {(r.event_id, r.order_key.line): r.status for r in got.collect()}
    assert got.count() == len(rows) == len(found)
    assert "inc" not in kept["round1"]
    for n in range(200):
        # a stored event with the better model only lacks what the first row names beside it
        first = "inserted" if n % 2 else "updated" if n % 6 == 0 else "skipped"
        second = "skipped" if n % 6 == 0 else "updated"
        assert [found[f"e{n}", n + 200 * k] for k in range(2)] == [first, second], n

    ids = spark.range(500).selectExpr("CAST(id AS STRING) AS event_id")
    marks = R.slots_of(ids.where("event_id % 9 = 0"))
    sides = [R.may_be_in(ids, marks, side) for side in (True, False)]
    assert sorted(r[0] for r in sides[0].unionByName(sides[1]).collect()) == sorted(r[0] for r in ids.collect())
    assert sides[1].where("event_id % 9 = 0").isEmpty() and not sides[1].isEmpty()


def test_an_id_stored_twice_is_met_twice_in_every_round(staging, frame):
    """A row is judged against both stored rows; the rows after a change go on as often."""
    better = {"model_normalized": "m", "model_resolution": "direct_event", "model_is_fallback": False, "content_sha256": "h1"}
    known = cleaned(frame([{"raw_sha256": "x"}] * 2 + [{"event_id": "f", "raw_sha256": "x"}]))
    rows = [{}, better, better, {"event_id": "f"}, {"event_id": "f", **better}, {"event_id": "f", **better}]
    got = R.reconcile_batch(batch(frame, rows), known, staging, 9).decisions.collect()
    counts = {}
    for r in got:
        key = (r.event_id, r.order_key.line, r.status)
        counts[key] = counts.get(key, 0) + 1
    statuses = ("skipped", "updated", "skipped")
    assert counts == {(e, n + k, s): times for e, n, times in (("e", 0, 2), ("f", 3, 1)) for k, s in enumerate(statuses)}

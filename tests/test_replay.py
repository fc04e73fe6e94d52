"""Forked logs: named cases, and random file sets against a plain per-file walk."""

import random

import pytest
from meterbook.operators import replay
from meterbook.operators.counters import POLICY_COMPATIBLE, POLICY_LEDGER
from meterbook.operators.quality import compare_policies
from meterbook.sources import codex

DAY = "/c/sessions/"
OLD = "/c/archived_sessions/"


def stamp(seconds):
    whole, milli = divmod(round(seconds * 1000), 1000)
    h, rest = divmod(whole, 3600)
    return f"2024-01-01T{h:02d}:{rest // 60:02d}:{rest % 60:02d}.{milli:03d}Z"


def usage(parts):
    keys = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
    return dict(zip(keys, parts))


def use(at, last=None, total=None, **more):
    info = {}
    if last:
        info["last_token_usage"] = usage(last)
    if total:
        info["total_token_usage"] = usage(total)
    row = {"type": "event_msg", "payload": {"type": "token_count", "info": info}, **more}
    return {**row, "timestamp": stamp(at)} if at is not None else row


def n(k):
    """A usage sample with one number in it."""
    return (k, 0, 1, 0, k + 1)


def meta(id, at=0, parent=None):
    payload = {"id": id}
    if parent:
        payload["forked_from_id"] = parent
    row = {"type": "session_meta", "payload": payload}
    return {**row, "timestamp": stamp(at)} if at is not None else row


def turn(model, at=None):
    row = {"type": "turn_context", "payload": {"model": model}}
    return {**row, "timestamp": stamp(at)} if at is not None else row


def done(id):
    return {"type": "event_msg", "payload": {"type": "task_complete", "turn_id": id}}


@pytest.fixture
def run(lines_of, staging):
    def go(files, policy=POLICY_LEDGER):
        rows = staging.put(codex.extract(lines_of(files)), "rows")
        result = replay.build_records(rows, policy, staging)
        records = sorted(result.records.collect(), key=lambda r: (r.source_file, r.line_number))
        verdicts = {r.file_path: r for r in result.verdicts.collect()}
        counters = {r.code: (r["count"], r.events, r.tokens) for r in result.diagnostics.collect()}
        return records, verdicts, counters

    return go


def kept(records, path):
    return [r.line_number for r in records if r.source_file == path]


def test_named_fork_cases(run):
    parent = [meta("P"), use(10, n(5)), use(20, n(6)), use(30, n(7))]
    files = {
        DAY + "p.jsonl": parent,
        # Exact copy of the two rows before the fork, then own usage.
        DAY + "exact.jsonl": [meta("a", 25, "P"), use(25.1, n(5)), use(25.2, n(6)), use(60, n(9))],
        # The fork time cuts the parent: the third row is not replay although equal.
        DAY + "cut.jsonl": [meta("b", 25, "P"), use(26, n(5)), use(36, n(6)), use(46, n(7))],
        # Copy to the end of the file: nothing of its own.
        DAY + "only.jsonl": [meta("c", 25, "P"), use(26, n(5)), use(27, n(6))],
        # Opening mismatch and no burst: all usage is its own.
        DAY + "own.jsonl": [meta("d", 25, "P"), use(26, n(1)), use(36, n(6))],
        # Rewritten burst: gaps of 999 and 1000 ms belong to it, 1001 ms does not.
        DAY + "burst.jsonl": [
            meta("e", 25, "P"), use(26, n(1)), use(26.999, n(2)), use(27.999, n(3)), use(29, n(4)),
        ],
        DAY + "gone.jsonl": [meta("f", 25, "nobody"), use(26, n(1)), use(40, n(2))],
        DAY + "goneburst.jsonl": [meta("g", 25, "nobody"), use(26, n(1)), use(26.5, n(2)), use(40, n(3))],
        DAY + "self.jsonl": [meta("h", 25, "h"), use(26, n(1)), use(26.1, n(2)), use(40, n(2))],
        # Fork before the first parent row: proven empty prefix, so no burst is skipped either.
        DAY + "early.jsonl": [meta("i", 5, "P"), use(6, n(5)), use(6.1, n(6))],
        # No fork time: only a burst can be proven.
        DAY + "untimed.jsonl": [meta("j", None, "P"), use(26, n(5)), use(40, n(6))],
        # Usage without comparable counters among the replay.
        DAY + "stuck.jsonl": [meta("k", 25, "P"), {"usage": {"input_tokens": 4}}, use(26, n(5)), use(99, n(8))],
        DAY + "nested.jsonl": [meta("l", 61, "a"), use(62, n(5)), use(63, n(6)), use(64, n(9)), use(99, n(3))],
    }
    records, verdicts, counters = run(files)
    got = {path[len(DAY) : -6]: kept(records, path) for path in files}
    assert got == {
        "p": [2, 3, 4],
        "exact": [4],
        "cut": [4],
        "only": [],
        "own": [2, 3],
        "burst": [5],
        "gone": [],
        "goneburst": [4],
        "self": [],
        "early": [2, 3],
        "untimed": [],
        "stuck": [],
        "nested": [5],
    }
    reasons = {p[len(DAY) : -6]: v.quarantine for p, v in verdicts.items() if v.quarantine}
    assert reasons == {
        "gone": replay.NO_PARENT,
        "self": replay.SELF_PARENT,
        "untimed": replay.NO_FORK_TIME,
        "stuck": replay.UNCOMPARABLE,
    }
    assert counters["codex_fork_files"][0] == 12
    assert counters["codex_parent_missing"][0] == 2
    assert counters["codex_parent_ambiguous"][0] == 1
    assert counters["codex_replay_unresolved"][0] == 4
    assert counters["codex_replay_exact"] == (0, 2 + 2 + 2 + 3, 13 + 13 + 13 + 23)
    assert counters["codex_replay_rewritten"] == (0, 3 + 2, 9 + 5)


def test_several_parents(run):
    live = [meta("P"), use(10, n(5)), use(20, n(6))]
    child = [meta("x", 15, "P"), use(15.5, n(5)), use(40, n(9))]
    # Live beats archived, whatever the archived one holds.
    records, verdicts, _ = run(
        {DAY + "p.jsonl": live, OLD + "p.jsonl": [meta("P"), use(1, n(1))], DAY + "x.jsonl": child}
    )
    assert kept(records, DAY + "x.jsonl") == [3]
    # Equal up to the fork: differences after it do not matter.
    twin = [meta("P"), use(11, n(5)), use(21, n(7))]
    records, verdicts, _ = run({DAY + "p.jsonl": live, DAY + "q.jsonl": twin, DAY + "x.jsonl": child})
    assert kept(records, DAY + "x.jsonl") == [3]
    # Different values before the fork.
    other = [meta("P"), use(10, n(4)), use(20, n(6))]
    _, verdicts, counters = run({DAY + "p.jsonl": live, DAY + "q.jsonl": other, DAY + "x.jsonl": child})
    assert verdicts[DAY + "x.jsonl"].quarantine == replay.AMBIGUOUS
    assert counters["codex_parent_ambiguous"][0] == 1
    # Different lengths at the fork.
    late = [meta("P"), use(16, n(5)), use(20, n(6))]
    _, verdicts, _ = run({DAY + "p.jsonl": live, DAY + "q.jsonl": late, DAY + "x.jsonl": child})
    assert verdicts[DAY + "x.jsonl"].quarantine == replay.AMBIGUOUS


def test_declarations_among_replay(run):
    parent = [meta("P"), use(10, n(5)), use(20, n(6))]
    files = {
        DAY + "p.jsonl": parent,
        # Before or within a second of the replay: part of it. Later: a real declaration.
        DAY + "early.jsonl": [meta("a", 25, "P"), turn("old", 26), use(27, n(5)), turn("near", 28), use(60, n(9))],
        DAY + "late.jsonl": [meta("b", 25, "P"), turn("old", 26), use(27, n(5)), turn("new", 28.001), use(60, n(9))],
        # Nothing skipped: all declarations count.
        DAY + "none.jsonl": [meta("c", 25, "P"), turn("mine"), use(27, n(1)), use(60, n(9))],
        # Turn markers among replay are ignored.
        DAY + "turn.jsonl": [meta("d", 25, "P"), use(27, n(5)), done("T0"), use(60, n(9)), done("T1"), done("T2")],
    }
    records, _, _ = run(files)
    models = {(r.source_file[len(DAY) : -6], r.line_number): r.model for r in records}
    assert models[("early", 5)] == "unknown" and models[("late", 5)] == "new"
    assert models[("none", 3)] == models[("none", 4)] == "mine"
    last = [r for r in records if r.source_file == DAY + "turn.jsonl"]
    assert [(r.turn_id, r.identity_kind, r.native_event_id, r.identity_subkey) for r in last] == [
        ("T1", "turn", None, None)
    ]


def test_models_and_turns_by_session(run):
    files = {
        DAY + "m.jsonl": [
            {**turn("scoped"), "session_id": "s1"},
            turn("general"),
            use(1, n(1), session_id="s1"),
            {**turn("scoped2"), "session_id": "s1"},
            use(2, n(2), session_id="s1"),
            use(3, n(3)),
            use(4, n(4), model="direct"),
            {**done("T"), "session_id": "s1"},
            done("U"),
            {**done("V"), "session_id": "elsewhere"},
        ]
    }
    records, _, _ = run(files)
    assert [(r.line_number, r.model, r.model_resolution, r.turn_id) for r in records] == [
        (3, "general", "turn_context", None),
        (5, "scoped2", "turn_context", "T"),
        (6, "general", "turn_context", None),
        (7, "direct", "direct_event", "U"),
    ]


def test_counters_per_session_and_resets(run):
    rows = [
        use(1, total=(10, 2, 5, 1, 15), session_id="a"),
        use(2, total=(100, 0, 1, 0, 101), session_id="b"),
        use(3, total=(10, 2, 5, 1, 15), session_id="a"),
        use(4, total=(30, 4, 9, 2, 39), session_id="a"),
        use(5, total=(4, 1, 1, 0, 5), session_id="a"),
        use(6, last=(7, 0, 0, 3, 10), session_id="a"),
    ]
    records, _, _ = run({DAY + "c.jsonl": rows})
    assert [(r.line_number, r.input_tokens, r.cache_read_tokens, r.total_tokens) for r in records] == [
        (1, 8, 2, 15),
        (2, 100, 0, 101),
        (4, 18, 2, 24),
        (5, 3, 1, 5),
        (6, 7, 0, 10),
    ]
    records, _, _ = run({DAY + "c.jsonl": rows}, POLICY_COMPATIBLE)
    assert [(r.line_number, r.total_tokens) for r in records] == [(1, 15), (2, 101), (4, 24), (6, 10)]


def test_component_reset_is_partial(run):
    rows = [use(1, total=(100, 50, 20, 0, 120)), use(2, total=(10, 5, 40, 0, 130))]
    records, _, counters = run({DAY + "c.jsonl": rows})
    second = records[1]
    assert (second.input_tokens, second.output_tokens, second.total_tokens) == (0, 10, 10)
    assert second.observability_level == "partial"
    assert counters["codex_accounting_partial"] == (0, 1, 10)


def walk(files):
    """Kept lines per file, one file at a time; usage rows are single samples here."""
    heads = {p: rows[0] for p, rows in files.items()}
    ident = {p: h["payload"]["id"] for p, h in heads.items()}
    samples = {
        p: [(i, r["_at"], r["_n"]) for i, r in enumerate(rows, 1) if "_n" in r] for p, rows in files.items()
    }
    out = {}
    for path, head in heads.items():
        own = samples[path]
        parent = head["payload"].get("forked_from_id")
        if parent is None:
            out[path] = [i for i, _, _ in own]
            continue
        if parent == ident[path]:
            out[path] = []
            continue
        found = sorted(p for p in files if ident[p] == parent)
        prefixes = [[k for _, at, k in samples[p] if at <= head["_at"]] for p in found]
        # Times only grow in these files, so a prefix is everything up to the fork.
        if any(q != prefixes[0] for q in prefixes[1:]):
            out[path] = []
            continue
        prefix = prefixes[0] if prefixes else []
        same = 0
        while same < min(len(prefix), len(own)) and own[same][2] == prefix[same]:
            same += 1
        burst = len(own) > 1 and own[1][1] - own[0][1] <= 1
        if not found and not burst:
            out[path] = []
            continue
        if same == 0 and burst and (not found or prefix):
            same = 1
            while same < len(own) and own[same][1] - own[same - 1][1] <= 1:
                same += 1
        out[path] = [i for i, _, _ in own[same:]]
    return out


def test_random_file_sets(run, lines_of, staging):
    rng = random.Random(23)
    files = {}
    for i in range(70):
        at = rng.randrange(0, 40)
        parent = rng.choice([None, f"s{rng.randrange(14)}", f"s{rng.randrange(14)}"])
        head = {**meta(f"s{rng.randrange(12)}", at, parent), "_at": at}
        rows, t = [head], at if parent else 0
        for _ in range(rng.randrange(0, 7)):
            t += rng.choice([0.5, 1, 2, 5])
            k = rng.choice([1, 1, 2])
            rows.append({**use(t, n(k)), "_at": t, "_n": k})
        files[f"{DAY}{i:02d}.jsonl"] = rows
    records, _, _ = run(files)
    assert {p: kept(records, p) for p in files} == walk(files)
    result = compare_policies(staging.put(codex.extract(lines_of(files)), "rows"), staging)
    assert result.disagreements.count() == 0

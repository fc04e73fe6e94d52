"""Jobs on real files: import, merge, export, incremental import."""

import json
import os
from datetime import datetime

import pytest
from meterbook import schema as S
from meterbook.operators import metrics, normalize, quality
from meterbook.operators.filters import Filters
from meterbook.plans.ingest import import_logs
from meterbook.plans.merge import MergeConflict, merge_ledgers
from meterbook.sources import filestate, keyindex, ledger, rollup, store
from meterbook.sources import lines as L
from meterbook.streaming.incremental import follow, import_changes
from pyspark.sql import functions as F
from testviews import view


def write(root, path, *rows):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def message(id, size, session="S", **more):
    return {"timestamp": "2024-01-02T03:04:05Z", "sessionId": session, "requestId": "r" + id, "cwd": "/w/app",
            "message": {"id": id, "model": "claude-x", "usage": {"input_tokens": size}}, **more}


def counted(total, at="2024-01-02T03:04:05Z"):
    usage = {"input_tokens": total, "output_tokens": 0, "total_tokens": total}
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"total_token_usage": usage}}}


@pytest.fixture
def logs(tmp_path):
    root = tmp_path / "home dir"
    write(root, "c/projects/p/s/a.jsonl", message("1", 10), message("2", 5), "", message("2", 9))
    write(root, "c/projects/p/s/b.jsonl", message("1", 3, isSidechain=True), message("4", 4), '{"usage": broken')
    write(root, "x/sessions/2024/k.jsonl", {"type": "session_meta", "payload": {"id": "K"}}, counted(5), counted(5), counted(12))
    write(root, "x/sessions/2024/f.jsonl", {"type": "session_meta", "payload": {"id": "F", "forked_from_id": "no"}}, counted(5))
    write(root, "g/.gemini/t/g.jsonl", {"id": "g1", "timestamp": 1704164645, "model": "gemini-z",
                                         "usageMetadata": {"promptTokenCount": 4, "cachedContentTokenCount": 9}},
          {"id": "g2", "timestamp": 1704164645, "usageMetadata": {"promptTokenCount": 4, "candidatesTokenCount": 1}})
    write(root, "g/.gemini/t/doc.json", [{"id": "d1", "session_id": "D", "timestamp": 1704164645, "usageMetadata": {"promptTokenCount": 1}}])
    write(root, "o/session-state/q/events.jsonl", {"type": "session.shutdown", "timestamp": "2024-01-02T03:04:05Z",
                                                   "data": {"modelMetrics": {"gpt-x": {"usage": {"inputTokens": 3}}}}})
    write(root, "o/session-state/q/other.jsonl", {"attributes": {"gen_ai.usage.input_tokens": 5}})
    buddy = {"id": "w1", "timestamp": 1704164645, "sessionId": "W", "cwd": "/c", "providerData": {
        "model": "m", "usage": {"requests": 1}, "rawUsage": {"prompt_tokens": 2, "completion_tokens": 1, "total_tokens": 3}}}
    write(root, "w/projects/z/a.jsonl", buddy, {**buddy, "id": "w2", "timestamp": "soon"})
    write(root, "w/projects/logs/b.jsonl", {**buddy, "id": "w3"})
    return {
        "claude": [f"{root}/c"],
        "codex": [f"{root}/x"],
        "gemini": [f"{root}/g/.gemini"],
        "copilot": [f"{root}/o/session-state"],
        "workbuddy": [f"{root}/w/projects"],
    }


def test_import_twice_merge_export_and_report(spark, logs, tmp_path):
    events_path, runs_path = f"{tmp_path}/ledger", f"{tmp_path}/runs"
    first = import_logs(spark, logs, events_path, runs_path, 1_800_000_000_000, "run1", grace_minutes=None)
    run = first.run
    counts = {k: run[f"events_{k}"] for k in ("added", "updated", "skipped", "rejected")}
    # Three messages, two counter steps, two of three metadata lines, one summary, one envelope.
    assert counts == {"added": 9, "updated": 0, "skipped": 0, "rejected": 1}
    assert run["files_scanned"] == 2 + 2 + 2 + 1 + 1
    # A file left out, a broken line, a refused envelope and a refused record.
    assert run["status"] == "completed_with_warnings" and first.warnings == 4
    assert str(tmp_path) not in run["error"] and "claude not_a_json_object: 1" in run["error"]
    told = ledger.read_rejects(spark, f"{runs_path}-rejects").where("run_id = 'run1'").collect()
    assert sorted((r.source, os.path.basename(r.file_path), r.line_number) for r in told) == [
        ("claude", "b.jsonl", 3), ("codex", "f.jsonl", None), ("gemini", "g.jsonl", 1), ("workbuddy", "a.jsonl", 2)
    ]
    assert {r.code: r["count"] for r in first.diagnostics.collect()}["codex_parent_missing"] == 1

    again = import_logs(spark, logs, events_path, runs_path, 1_800_000_000_001, "run2", grace_minutes=None)
    assert [again.run[f"events_{k}"] for k in ("added", "updated", "skipped", "rejected")] == [0, 0, 9, 1]

    events, runs = ledger.read_ledger(spark, events_path), ledger.read_runs(spark, runs_path)
    assert quality.audit(events).count() == 0
    by_channel = {r.label: r.total_tokens for r in metrics.breakdown(events, "channel").collect()}
    assert by_channel == {"claude": 10 + 9 + 4, "codex": 12, "gemini": 5 + 1, "copilot": 3, "workbuddy": 3}
    assert metrics.summary(events, runs).first().import_runs == 2
    project = metrics.breakdown(events, "channel", Filters(project="app")).first()
    assert (project.label, project.events) == ("claude", 3)
    assert [r.id for r in metrics.run_page(runs).collect()] == ["run2", "run1"]

    out = f"{tmp_path}/export"
    ledger.export_ledger(spark, events_path, runs_path, out)
    copy = ledger.read_ledger(spark, f"{out}/events")
    assert copy.where("project_path IS NOT NULL OR source_file IS NOT NULL").count() == 0
    assert copy.selectExpr("sum(total_tokens)").first() == events.selectExpr("sum(total_tokens)").first()
    assert ledger.read_runs(spark, f"{out}/runs").where("error IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        ledger.export_ledger(spark, events_path, runs_path, events_path)

    # The redacted copy has nothing to add; a ledger with new and supplemented events has.
    assert vars(merge_ledgers(spark, f"{out}/events", events_path, 3)) == {"inserted": 0, "updated": 0, "skipped": 9}
    rows = events.select(*S.EVENT_COLUMNS)
    claude = F.col("channel") == "claude"
    more = rows.withColumn("turn_id", F.when(claude, "T")).withColumn(
        "content_sha256", F.when(claude, F.lit("new")).otherwise(F.col("content_sha256"))
    )
    extra = rows.where(claude).withColumn("event_id", F.concat("event_id", F.lit("x")))
    ledger.write_ledger(more.unionByName(extra), f"{tmp_path}/second")
    result = merge_ledgers(spark, f"{tmp_path}/second", events_path, 4)
    assert vars(result) == {"inserted": 3, "updated": 3, "skipped": 6}
    events = ledger.read_ledger(spark, events_path)
    assert events.count() == 12 and events.where("turn_id = 'T'").count() == 3

    bad = events.select(*S.EVENT_COLUMNS).withColumn("timestamp_ms", F.col("timestamp_ms") + 1)
    ledger.write_ledger(bad, f"{tmp_path}/third")
    with pytest.raises(MergeConflict) as refused:
        merge_ledgers(spark, f"{tmp_path}/third", events_path, 5)
    assert refused.value.conflicts == [("timestamp_conflict", 12)]
    assert ledger.read_ledger(spark, events_path).count() == 12
    with pytest.raises(ValueError):
        merge_ledgers(spark, events_path, events_path, 5)


def test_incremental_import(spark, logs, tmp_path):
    args = (f"{tmp_path}/ledger", f"{tmp_path}/runs", f"{tmp_path}/checkpoint")
    sources = {"claude": logs["claude"]}
    results = []
    for n in (1, 2, 3):
        if n == 3:
            write(tmp_path / "home dir", "c/projects/p/s/late.jsonl", message("9", 1))
        query = follow(spark, sources, *args, on_result=results.append, grace_minutes=None)
        query.awaitTermination(240)
        assert query.exception() is None
    # the third reads the new file alone
    assert [(r.run["events_added"], r.run["events_skipped"], r.run["files_scanned"]) for r in results] == [(3, 0, 2), (1, 0, 1)]


def forked(id, parent, *rows):
    return [{"type": "session_meta", "timestamp": "2024-01-02T03:04:06Z", "payload": {"id": id, "forked_from_id": parent}}, *rows]


def test_closure_of_changed_files(spark, staging, tmp_path):
    """Copies of messages pull each other in; forks pull in their parents, parents their forks."""
    def links(**files):
        rows = [("codex" if role != "shares" else "claude", f, role, name) for f, of in files.items() for role, name in of]
        return spark.createDataFrame(rows, filestate.LINKS)

    def states(*names, size=1):
        rows = [("claude" if n[0] == "c" else "codex", n, size, datetime(2024, 1, 1)) for n in names]
        return spark.createDataFrame(rows, "source string, file_path string, length bigint, changed timestamp")

    path = f"{tmp_path}/s"
    chain = {"c1": [("shares", "m1")], "c2": [("shares", "m1"), ("shares", "m2")], "c3": [("shares", "m2")], "c4": [("shares", "m4")]}
    forks = {"root": [("is", "R")], "kid": [("is", "K"), ("of", "R")], "kid2": [("is", "K2"), ("of", "R")],
             "grandkid": [("is", "G"), ("of", "K")], "twin": [("is", "R")], "alone": [("is", "m4")]}
    known = {**chain, **forks}
    filestate.FileState(spark, path).add(states(*list(known)[:5]), links(**dict(list(known.items())[:5])))
    filestate.FileState(spark, path).add(states(*list(known)[5:]), links(**dict(list(known.items())[5:])))
    state = filestate.FileState(spark, path)
    assert state.changed(states(*known)).isEmpty()
    assert [r.file_path for r in state.changed(states("c1", "c9").unionByName(states("kid", size=2))).collect()] in (
        ["c9", "kid"], ["kid", "c9"])

    def closure(**files):
        return {r.file_path for r in state.closure(states(*files), links(**files), staging).collect()}

    assert closure(c1=chain["c1"]) == {"c1", "c2", "c3"}
    assert closure(c9=[("shares", "m4")], c1=[]) == {"c9", "c4", "c1"}
    assert closure(alone=forks["alone"]) == {"alone"}
    assert closure(kid2=forks["kid2"]) == {"kid2", "root", "twin"}
    assert closure(grandkid=forks["grandkid"]) == {"grandkid", "kid", "root", "twin"}
    assert closure(root=forks["root"]) == {"root", "twin", "kid", "kid2", "grandkid"}
    assert closure(new=[("is", "N"), ("of", "G")]) == {"new", "grandkid", "kid", "root", "twin"}


@pytest.mark.skipif(not os.environ.get("METERBOOK_SLOW"), reason="ten imports; set METERBOOK_SLOW to run it")
def test_changes_read_what_they_bear_on_and_give_the_whole_result(spark, tmp_path):
    """Beside a ledger that reads all folders each time; the same events at every step."""
    home = tmp_path / "h"
    sources = {"claude": [f"{home}/c"], "codex": [f"{home}/x"], "gemini": [f"{home}/g"]}
    c, x = "c/projects/p/s", "x/sessions"
    for n in range(6):
        write(home, f"{c}/alone{n}.jsonl", message(f"a{n}", n))
        write(home, f"{x}/alone{n}.jsonl", *forked(f"A{n}", None, counted(n + 1)))
    write(home, f"{c}/one% [1].jsonl", message("m", 5), message("k", 1))
    write(home, f"{x}/root.jsonl", *forked("R", None, counted(5), counted(9)))
    write(home, f"{x}/other.jsonl", *forked("O", "R", counted(5), counted(6)))
    (home / "g").mkdir()
    steps = [
        (lambda: None, 15, 15),
        (lambda: None, 0, 0),
        # a copy of a message: the files with it, and with copies of their messages
        (lambda: write(home, f"{c}/two.jsonl", message("k", 7), message("z", 2)), 1, 2),
        # a fork reads its parent, but not the other fork of it
        (lambda: write(home, f"{x}/child.jsonl", *forked("C", "R", counted(5), counted(9), counted(30))), 1, 2),
        # a fork of the fork reads both; a file of another source is read alone
        (lambda: (write(home, f"{x}/grandchild.jsonl", *forked("G", "C", counted(5), counted(9), counted(30), counted(31))),
                  write(home, "g/new.json", [{"id": "d", "session_id": "D", "timestamp": 1704164645, "usageMetadata": {"promptTokenCount": 1}}])), 2, 4),
        # a parent that grows: all that was forked from it
        (lambda: write(home, f"{x}/root.jsonl", *forked("R", None, counted(5), counted(9), counted(50))), 1, 4),
    ]
    columns = [f for f in S.EVENT_COLUMNS if f not in ("imported_at_ms", "updated_at_ms")]
    for n, (change, changed, read) in enumerate(steps, 1):
        change()
        got = import_changes(spark, sources, f"{tmp_path}/l1", f"{tmp_path}/r1", f"{tmp_path}/s", n, grace_minutes=None)
        assert (got.changed, got.read) == (changed, read), n
        if got.result is not None:
            assert got.result.run["files_scanned"] == read
            whole = import_logs(spark, sources, f"{tmp_path}/l2", f"{tmp_path}/r2", n, grace_minutes=None)
            assert got.result.run["events_added"] == whole.run["events_added"]
            assert got.result.run["events_updated"] == whole.run["events_updated"]
    events = [ledger.read_ledger(spark, f"{tmp_path}/l{k}").select(*columns) for k in (1, 2)]
    assert events[0].exceptAll(events[1]).isEmpty() and events[1].exceptAll(events[0]).isEmpty()
    assert events[0].count() > 20


def test_line_numbers_survive_splits(spark, staging, tmp_path):
    for name, n in (("a b+c%.jsonl", 700), ("ü.JSONL", 92)):
        rows = [("" if i % 9 == 0 else f"{i}") + ("\r" if i % 7 == 0 else "") for i in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(rows), newline="")
    (tmp_path / "skip.txt").write_text("1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for stage in (None, staging):
            scan = L.scan_logs(spark, [str(tmp_path)], staging=stage)
            assert scan.splits.count() > 4
            rows = scan.lines.collect()
            assert all(r.value == str(r.line_number) for r in rows)
            files = {r.file_path: r.n for r in scan.splits.groupBy("file_path").agg(F.sum("n").alias("n")).collect()}
            assert files == {f"{tmp_path}/a b+c%.jsonl": 700, f"{tmp_path}/ü.JSONL": 92}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/ledger"
    base = spark.createDataFrame([], S.LEDGER_SCHEMA)
    ledger.write_ledger(base, path)
    assert ledger.ledger_version(spark, path) == 1 and ledger.read_ledger(spark, path).count() == 0
    with pytest.raises(ValueError):
        ledger.write_ledger(base, path)


def test_old_content_stays_until_the_manifest_is_written(spark, logs, tmp_path, monkeypatch):
    path, runs = f"{tmp_path}/ledger", f"{tmp_path}/runs"
    import_logs(spark, {"claude": logs["claude"]}, path, runs, 1, grace_minutes=None)
    before = ledger.read_ledger(spark, path)
    count = before.count()
    assert count == 3
    rows = before.select(*S.EVENT_COLUMNS)
    more = rows.withColumn("event_id", F.concat("event_id", F.lit("x")))
    filled = rows.withColumn("turn_id", F.lit("T")).withColumn("content_sha256", F.lit("new"))
    ledger.write_ledger(filled.unionByName(more), f"{tmp_path}/second")

    def lost(*args):  # after the rows are written, before the manifest is
        raise OSError("lost")

    publish = store.publish
    monkeypatch.setattr(store, "publish", lost)
    with pytest.raises(OSError):
        merge_ledgers(spark, f"{tmp_path}/second", path, 2)
    monkeypatch.setattr(store, "publish", publish)
    assert ledger.ledger_version(spark, path) == 1
    same = ledger.read_ledger(spark, path)
    assert same.count() == count and same.where("turn_id = 'T'").isEmpty()
    # Half a write is left in a folder that nothing names; the next write is not disturbed.
    assert vars(merge_ledgers(spark, f"{tmp_path}/second", path, 3)) == {"inserted": 3, "updated": 3, "skipped": 0}
    assert before.count() == count and ledger.read_ledger(spark, path).count() == 2 * count


def test_another_writer_is_noticed(spark, logs, tmp_path, monkeypatch):
    path, runs = f"{tmp_path}/ledger", f"{tmp_path}/runs"
    import_logs(spark, {"claude": logs["claude"]}, path, runs, 1, grace_minutes=None)
    rows = ledger.read_ledger(spark, path).withColumn("event_id", F.concat("event_id", F.lit("y")))
    with pytest.raises(RuntimeError):
        ledger._commit(rows, path, None, 0)
    assert ledger.read_ledger(spark, path).count() == 3


def three_events(spark):
    events = view(spark, "/root/testdata/sf0.001", "ledger").where("event_id IN ('1', '2', '3')")
    return normalize.cleaned(events)


def more_events(spark, rows, suffix, **changes):
    """Rows under other ids."""
    out = rows.withColumn("event_id", F.concat("event_id", F.lit(suffix)))
    return out.withColumns({k: F.lit(v) for k, v in changes.items()})


def test_a_writer_that_meets_another_goes_on_after_it(spark, tmp_path, monkeypatch):
    """The other one writes between the last look at the manifests and the publishing of one."""
    path = f"{tmp_path}/ledger"
    ledger.write_ledger(three_events(spark), path)
    rows = ledger.read_ledger(spark, path).select(*S.EVENT_COLUMNS)
    ledger.write_ledger(more_events(spark, rows, "a"), f"{tmp_path}/a")
    ledger.write_ledger(more_events(spark, rows, "b"), f"{tmp_path}/b")
    publish, numbers = store.publish, []

    def met(s, source, target):
        numbers.append(target)
        if len(numbers) == 1:
            merge_ledgers(spark, f"{tmp_path}/b", path, 3)
        return publish(s, source, target)

    monkeypatch.setattr(store, "publish", met)
    assert vars(merge_ledgers(spark, f"{tmp_path}/a", path, 2)) == {"inserted": 3, "updated": 0, "skipped": 0}
    # the number of the other writer was tried and taken, nothing was worked out anew
    assert [int(n[-10:-8]) for n in numbers] == [2, 2, 3] and numbers[0] == numbers[1]
    stored = ledger.read_ledger(spark, path)
    assert stored.count() == 9 and stored.select("event_id").distinct().count() == 9
    assert ledger.ledger_version(spark, path) == 3


def test_a_writer_starts_anew_where_another_has_changed_its_events(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/ledger"
    ledger.write_ledger(three_events(spark), path)
    rows = ledger.read_ledger(spark, path).select(*S.EVENT_COLUMNS)
    new = more_events(spark, rows, "n")
    filled = rows.withColumn("turn_id", F.lit("T")).withColumn("content_sha256", F.lit("t"))
    ledger.write_ledger(filled.unionByName(new), f"{tmp_path}/a")
    ledger.write_ledger(new.unionByName(filled), f"{tmp_path}/b")
    publish, calls = store.publish, []

    def met(s, source, target):
        calls.append(target)
        if len(calls) == 1:
            merge_ledgers(spark, f"{tmp_path}/b", path, 3)
        return publish(s, source, target)

    monkeypatch.setattr(store, "publish", met)
    # judged against the other's events, as if it had come after it
    with pytest.raises(MergeConflict) as refused:
        merge_ledgers(spark, f"{tmp_path}/a", path, 2)
    assert refused.value.conflicts == [("content_conflict", 3)]
    stored = ledger.read_ledger(spark, path)
    assert stored.count() == 6 and stored.where("turn_id = 'T'").count() == 3
    assert ledger.ledger_version(spark, path) == 2


def test_only_one_of_two_gets_a_name(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    assert store.publish(spark, f"{tmp_path}/a", f"{tmp_path}/c") and not store.publish(spark, f"{tmp_path}/b", f"{tmp_path}/c")
    assert (tmp_path / "c").read_text() == "a"


def test_index_runs_are_merged_and_lookups_read_few_buckets(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger.write_ledger(three_events(spark), path)
    rows = ledger.read_ledger(spark, path)
    for n in range(4):
        more = more_events(spark, rows, f"-{n}", event_date_utc=f"2024-02-0{n + 1}")
        ledger._commit(more, path, None, n + 1, None, more.select("event_id"))
        now = ledger.snapshot(spark, path)
        assert len(now.index_sizes) == (n + 2 if n < 2 else n - 1) and sum(now.index_sizes.values()) == 3 * (n + 2)
    ids = [r.event_id for r in now.rows().select("event_id").collect()]
    assert sorted(ids) == sorted({r.event_id for r in now.dates_of(now.rows()).collect()})
    wanted = spark.createDataFrame([(ids[0],), (ids[7],), ("unknown",)], "event_id string")
    found = now.dates_of(wanted)
    assert sorted(r.event_id for r in found.collect()) == sorted((ids[0], ids[7]))
    assert {r.event_id for r in now.matching(wanted).collect()} == {ids[0], ids[7]}
    buckets = {r[0] for r in wanted.select(keyindex.bucket_of(F.col("event_id"))).collect()}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "") and len(buckets) <= 3


def test_runs_of_like_size_are_merged():
    assert keyindex.to_merge({"a": 5, "b": 5, "c": 5}) == []
    assert keyindex.to_merge({"a": 5, "b": 5, "c": 5, "d": 5, "big": 10**9}) == ["a", "b", "c", "d"]
    sizes, written = {}, 0
    for n in range(1000):
        sizes[str(n)] = 1
        if gone := keyindex.to_merge(sizes):
            total = sum(sizes.pop(r) for r in gone)
            sizes[f"m{n}"] = total
            written += total
        assert len(sizes) < 20
    assert sum(sizes.values()) == 1000 and written < 1000 * 10


def test_vacuum_removes_what_no_manifest_names(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger.write_ledger(three_events(spark), path)
    rows = ledger.read_ledger(spark, path).select(*S.EVENT_COLUMNS)
    filled = rows.withColumn("turn_id", F.lit("T")).withColumn("content_sha256", F.lit("t"))
    ledger.write_ledger(filled, f"{tmp_path}/a")
    merge_ledgers(spark, f"{tmp_path}/a", path, 2)
    before = sorted(map(tuple, ledger.read_ledger(spark, path).select("event_id", "turn_id").collect()))
    later = 32_503_680_000_000
    assert ledger.vacuum(spark, path, 0) == []
    assert ledger.vacuum(spark, path, later, keep_commits=2) == []
    gone = ledger.vacuum(spark, path, later)
    assert sorted(g.split("/")[-2] for g in gone) == ["data", "manifests"]
    assert sorted(map(tuple, ledger.read_ledger(spark, path).select("event_id", "turn_id").collect())) == before
    assert ledger.vacuum(spark, path, later) == []


def test_sums_follow_the_manifest(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    ledger.write_ledger(three_events(spark), path)

    def totals():
        kept = rollup.rollup(spark, path)
        row = kept.agg(F.sum("events"), F.sum("total_tokens")).first()
        assert tuple(row) == tuple(ledger.read_ledger(spark, path).selectExpr("count(1)", "sum(total_tokens)").first())
        return row[0]

    assert totals() == 3  # from the events, as there are no sums yet
    assert (rollup.refresh(spark, path), rollup.refresh(spark, path)) == (1, 0) and totals() == 3
    old = ledger.read_ledger(spark, path)
    anew = old.withColumn("total_tokens", F.col("total_tokens") + 100)
    ledger._commit(anew, path, old.select("event_date_utc").distinct(), 1, anew.limit(0), anew.select("event_id"))
    assert totals() == 3  # the date was replaced, and its sums with it
    assert rollup.refresh(spark, path) == 1 and totals() == 3
    filters = Filters(provider=ledger.read_ledger(spark, path).where("provider IS NOT NULL").first().provider)
    assert rollup.breakdown(rollup.rollup(spark, path), "channel", filters).count() >= 1
    with pytest.raises(ValueError):
        rollup.breakdown(rollup.rollup(spark, path), "session")


def test_a_deviating_file_in_one_date_is_noticed(spark, logs, tmp_path):
    path, runs = f"{tmp_path}/ledger", f"{tmp_path}/runs"
    import_logs(spark, {"claude": logs["claude"]}, path, runs, 1, grace_minutes=None)
    odd = f"{path}/data/version=zz/event_date_utc=1999-01-01"
    spark.range(1).withColumn("extra", F.lit("x")).write.parquet(odd)
    with pytest.raises(ValueError):
        ledger.read_ledger(spark, path)


def test_long_lines_and_long_texts_are_read(spark, staging, tmp_path):
    """No line is too long; a text of 21 million characters costs nothing but its own bytes."""
    big = "x" * 21_000_000
    lines = [counted(5), {**counted(9), "note": big}, counted(12), '{"usage": ' + big]
    write(tmp_path, "x/sessions/a.jsonl", *lines)
    part = {"timestamp": 1704164645, "session_id": "D"}
    items = [{**part, "id": f"d{i}", "usageMetadata": {"promptTokenCount": i}} for i in (1, 2)]
    items[0]["note"] = big
    write(tmp_path, "g/doc.json", items)
    write(tmp_path, "g/odd.json", ["usageMetadata"])
    write(tmp_path, "g/other.json", [1, 2])
    logs = {"codex": [f"{tmp_path}/x"], "gemini": [f"{tmp_path}/g"]}
    result = import_logs(spark, logs, f"{tmp_path}/l", f"{tmp_path}/r", 1, "run", grace_minutes=None)
    events = ledger.read_ledger(spark, f"{tmp_path}/l")
    assert sorted(r.total_tokens for r in events.where("channel = 'codex'").collect()) == [3, 4, 5]
    assert sorted(r.total_tokens for r in events.where("channel = 'gemini'").collect()) == [1, 2]
    told = ledger.read_rejects(spark, f"{tmp_path}/r-rejects").collect()
    assert sorted((r.source, os.path.basename(r.file_path), r.line_number, r.reason) for r in told) == [
        ("codex", "a.jsonl", 4, "not_a_json_object"),
        ("gemini", "odd.json", None, "not_a_json_object"),
    ]
    assert result.warnings == 2


def test_files_that_change_while_they_are_read_cost_one_reject(spark, tmp_path, monkeypatch):
    for name in ("same", "grown", "emptied", "removed"):
        write(tmp_path, f"c/projects/p/{name}.jsonl", message(name, 1), message(name + "2", 2))
    scan_logs = L.scan_logs

    def scan_then_change(*args):
        scan = scan_logs(*args)
        folder = tmp_path / "c/projects/p"
        with (folder / "grown.jsonl").open("a") as f:
            f.write(json.dumps(message("late", 7)) + "\n")
        (folder / "emptied.jsonl").write_text("")
        (folder / "removed.jsonl").unlink()
        return scan

    monkeypatch.setattr(L, "scan_logs", scan_then_change)
    args = ({"claude": [f"{tmp_path}/c"]}, f"{tmp_path}/l", f"{tmp_path}/r", 1, "run")
    result = import_logs(spark, *args, grace_minutes=None)
    told = ledger.read_rejects(spark, f"{tmp_path}/r-rejects").collect()
    assert sorted((os.path.basename(r.file_path), r.reason) for r in told) == [
        (f"{n}.jsonl", "changed_while_read") for n in ("emptied", "grown", "removed")
    ]
    assert result.run["events_added"] == 2 and result.warnings == 3


def test_files_in_excluded_folders_are_not_opened(spark, staging, tmp_path):
    for folder in ("p", "p/traces"):
        write(tmp_path, f"w/{folder}/a.jsonl", {"x": 1})
    keep = lambda path: L.admitted_below(path, [f"{tmp_path}/w"])
    scan = L.scan_logs(spark, [f"{tmp_path}/w"], staging=staging, keep=keep)
    os.chmod(tmp_path / "w/p/traces/a.jsonl", 0)
    (tmp_path / "w/p/traces/a.jsonl").unlink()
    (tmp_path / "w/p/traces/a.jsonl").mkdir()  # opening it would fail
    assert [r.file_path for r in scan.lines.collect()] == [f"{tmp_path}/w/p/a.jsonl"]


def test_recent_files_wait(spark, tmp_path):
    for name, age in (("old.jsonl", 7200), ("new.jsonl", 0)):
        (tmp_path / name).write_text("x\n")
        stamp = os.path.getmtime(tmp_path / name) - age
        os.utime(tmp_path / name, (stamp, stamp))
    scan = L.scan_lines(spark, [str(tmp_path)], before=L.cutoff(15))
    assert [os.path.basename(r.file_path) for r in scan.collect()] == ["old.jsonl"]
    assert L.file_inventory(spark, {"s": [str(tmp_path)]}).first().files == 2


def test_discovery_rules(spark, tmp_path):
    for folder in ("h/projects", "x/sessions", "o/otel", "o/session-state", "w"):
        (tmp_path / folder).mkdir(parents=True)
    t = str(tmp_path)
    assert [r.removeprefix("file:") for r in L.discover_roots(spark, "claude", [f"{t}/h", f"{t}/h/", ""])] == [
        f"{t}/h/projects"
    ]
    assert [r.removeprefix("file:") for r in L.discover_roots(spark, "codex", [f"{t}/x", f"{t}/x/sessions"])] == [
        f"{t}/x/sessions"
    ]
    assert L.outermost(["/a", "/a/b", "/ab"]) == ["/a", "/ab"]
    groups = L.copilot_roots(spark, [f"{t}/o", f"{t}/w", f"{t}/z/otel/x", f"{t}/z/session-state"])
    assert len(groups["otel"]) == 2 and len(groups["session"]) == 2 and groups["other"] == [f"{t}/w"]
    # Summaries are read until the first request-level file appears.
    last = lambda: [r.rsplit("/", 1)[-1] for r in L.preferred_copilot_roots(spark, [f"{t}/o"])]
    assert last() == ["otel", "session-state"]
    (tmp_path / "o/otel/a.jsonl").write_text("{}\n")
    assert last() == ["otel"]
    df = spark.createDataFrame(
        [(f"{t}/w/p/a.jsonl", True), (f"{t}/w/Logs/a.jsonl", False), (f"{t}/w/p/blobs/q/a.jsonl", False),
         (f"{t}/w/logs.jsonl", True)], "p string, want boolean")
    assert all(r.want == r.got for r in df.select("want", L.admitted_below(F.col("p"), [f"{t}/w"]).alias("got")).collect())


def test_schema_is_strict(spark, tmp_path):
    good = spark.createDataFrame([], S.LEDGER_SCHEMA)
    assert S.conformance_problems(good) == []
    bad = good.drop("provider").withColumn("extra", F.lit(1)).withColumn("line_number", F.lit("x"))
    assert len(S.conformance_problems(bad)) == 3
    spark.range(3).withColumn("event_date_utc", F.lit("2024-01-01")).write.partitionBy("event_date_utc").parquet(
        f"{tmp_path}/odd"
    )
    with pytest.raises(ValueError):
        ledger.read_ledger(spark, f"{tmp_path}/odd")


def test_listing_and_splits_are_bounded(spark):
    """A listing of many folders is a few tasks, and a task reads 32 MB or 32 small files."""
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 4 * 8
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "32m"
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "1m"


def test_written_logs_are_a_file_per_user(spark, tmp_path):
    import __spark_entry__ as E
    from meterbook.session import Staging

    rows = [(n, datetime(2024, 1, 2), n % 5, "view", 1.5, '{"k": 3}') for n in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    with Staging(spark, "logs") as staging:
        root = E._written_logs(spark, str(tmp_path), staging)
        files = L.file_states(spark, [root], ".txt")
        assert files.count() == 5 and spark.read.text(root).count() == 400


def test_first_import_names_no_files(spark, tmp_path, monkeypatch):
    """Where all files are new, folders are read as they are; later the changed files by name."""
    from meterbook.streaming import incremental

    root, named, whole = tmp_path / "c/projects", [], incremental.import_logs

    def watched(*args, only, **options):
        named.append(only and {k: len(v) for k, v in only.items()})
        return whole(*args, only=only, **options)

    monkeypatch.setattr(incremental, "import_logs", watched)
    places = [str(tmp_path / n) for n in ("ledger", "runs", "state")]
    write(root, "p/s/a.jsonl", message("1", 10))
    write(root, "p/t/b.jsonl", message("2", 5))
    write(tmp_path / "c", "elsewhere.jsonl", message("9", 5))
    sources = {"claude": [str(tmp_path / "c")], "codex": [str(tmp_path / "none")]}
    got = [import_changes(spark, sources, *places, 1, grace_minutes=None)]
    write(root, "p/t/c.jsonl", message("3", 5))
    got.append(import_changes(spark, sources, *places, 1, grace_minutes=None))
    assert [(g.changed, g.read, g.result.run["events_added"]) for g in got] == [(2, 2, 2), (1, 1, 1)]
    assert named == [None, {"claude": 1, "codex": 0}]


def test_rows_of_a_write_are_worked_out_once(spark, tmp_path):
    """Neither the order of the files nor dates nor the index work out the rows of a write again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(n):
        made.add(1)
        return f"e{n}"

    base = view(spark, "/root/testdata/sf0.001", "ledger").limit(50).localCheckpoint()
    path = str(tmp_path / "ledger")
    ledger.write_ledger(base.withColumn("event_id", name("event_id")), path)
    assert made.value == 50
    assert ledger.read_ledger(spark, path).count() == ledger.snapshot(spark, path).dates_of(
        ledger.read_ledger(spark, path).select("event_id")
    ).count() == 50

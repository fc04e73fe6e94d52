"""The stored ledger, the run log, exports and JSON reports."""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import schema as S
from meterbook.operators.normalize import with_derived
from meterbook.session import Staging
from meterbook.sources import keyindex, store

PARTITION = "event_date_utc"
VERSION = "version"

# Layout of a ledger folder: rows below ``data/version=<id>/event_date_utc=<date>``, the places of
# event ids below ``index/run=<id>/bucket=<n>`` (``keyindex``), and which of these folders count in
# ``manifests/commit-<n>.parquet``. The manifest with the highest number is the ledger; it names
# everything, so no other is read. A write puts its rows into a version of its own and then
# publishes one manifest under the next number: the old content stays as it is, readers of it are
# not disturbed, and rows of a write that failed are in no manifest. Dates that a write does not
# touch are carried over by name, not copied.
_DATA, _INDEX = "data", "index"
_MANIFEST = "kind string, version string, event_date_utc string, schema string, rows bigint"
_OWN_FOLDER = re.compile(r"version=[0-9a-f]{32}")
_INDEX_SCHEMA = T.StructType([T.StructField("event_id", T.StringType()), T.StructField(PARTITION, T.StringType())])
#: Writers that meet start anew so often before they give up.
ATTEMPTS = 5


class LedgerConflict(RuntimeError):
    """What a write was worked out from is no longer so; nothing was written."""


def _path_missing(err: AnalysisException) -> bool:
    return err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _fingerprint(schema: T.StructType) -> str:
    fields = sorted((f.name, f.dataType.simpleString()) for f in schema.fields)
    return hashlib.sha256(repr(fields).encode()).hexdigest()[:16]


@dataclass
class Snapshot:
    """A ledger as of one manifest; later writes do not change it."""

    spark: SparkSession
    path: str
    number: int

    @cached_property
    def manifest(self) -> DataFrame:
        if not self.number:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(store.manifest_file(f"{self.path}/manifests", self.number))

    @property
    def places(self) -> DataFrame:
        """``version, event_date_utc`` that count, one row each."""
        return self.manifest.where(F.col("kind") == _DATA).select(VERSION, PARTITION)

    @cached_property
    def index_sizes(self) -> dict[str, int]:
        """Rows of each index run; a handful of runs."""
        return {r[VERSION]: r.rows for r in self.manifest.where(F.col("kind") == _INDEX).collect()}

    def rows(self, strict: bool = True) -> DataFrame:
        """The stored rows. With ``strict`` every version must have been written in the
        expected schema, which the manifest knows; no file is opened for that."""
        kinds = self.manifest.where(F.col("kind") == _DATA).select(VERSION, "schema").distinct().collect()
        if strict:
            odd = [r[VERSION] for r in kinds if r.schema != _fingerprint(S.STORED_SCHEMA)]
            folders = store.children(self.spark, f"{self.path}/data")
            odd += [name for name in folders if name.startswith("version=") and not _OWN_FOLDER.fullmatch(name)]
            if odd:
                raise ValueError(f"ledger schema mismatch: other content in {sorted(odd)}")
        if not kinds:
            return self.spark.createDataFrame([], S.STORED_SCHEMA)
        stored = T.StructType([*S.STORED_SCHEMA.fields, T.StructField(VERSION, T.StringType())])
        # one folder per write that still counts; folders of others are not even listed
        folders = [f"{self.path}/data/version={r[VERSION]}" for r in kinds]
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*folders)
        # Both are partition columns: dates that were replaced are pruned, not read.
        return rows.join(self.places, [VERSION, PARTITION], "left_semi").select(*S.STORED_SCHEMA.fieldNames())

    def dates_of(self, ids: DataFrame) -> DataFrame:
        """``event_id, event_date_utc`` of those of the ids that are stored; from the index."""
        index = keyindex.read_runs(self.spark, f"{self.path}/index", self.index_sizes, _INDEX_SCHEMA)
        return keyindex.lookup(index, ids, "event_id")

    def matching(self, ids: DataFrame) -> DataFrame:
        """Stored rows with one of the ids. The index gives their dates, and only these dates
        are read."""
        hits = self.dates_of(ids)
        dates = hits.select(PARTITION).distinct()
        return self.rows().join(dates, PARTITION, "left_semi").join(hits.select("event_id"), "event_id", "left_semi")


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The ledger as it is now."""
    path = path.rstrip("/")
    numbers = store.commits(spark, f"{path}/manifests")
    return Snapshot(spark, path, numbers[-1] if numbers else 0)


def ledger_version(spark: SparkSession, path: str) -> int:
    """Number of writes that the ledger has seen; 0 where there is none."""
    return snapshot(spark, path).number


def read_ledger(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The stored table as of now; later writes do not change what is returned."""
    now = snapshot(spark, path)
    names = [] if now.number else store.children(spark, path)
    if any(n[0] not in "._" and n not in ("data", "index", "manifests") for n in names):
        raise ValueError(f"ledger schema mismatch: {path} holds files but is no ledger")
    return now.rows(strict)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _read_log(spark, path, S.RUN_SCHEMA)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Everything that imports refused, one row per line, record or file."""
    return _read_log(spark, path, S.REJECT_SCHEMA)


def _read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if _path_missing(err):
            return spark.createDataFrame([], schema)
        raise


def _partitioned(df: DataFrame) -> DataFrame:
    """Rows by date, in order of session and event.

    Tasks are balanced by size when the shuffle has run, so a date holding much of the table is
    written by many tasks, a small date goes into one file, and row groups cover few sessions.
    Ranges would be balanced too, but to find them all rows are worked out twice.
    """
    order = (PARTITION, "session_key", "event_id")
    return df.hint("rebalance", PARTITION).sortWithinPartitions(*order)


def _still_holds(base: Snapshot, now: Snapshot, removed: DataFrame, ids: DataFrame | None) -> bool:
    """Whether what was worked out from ``base`` also follows from ``now``.

    It does if the folders it replaces still count, and none of the events it has looked at is in
    a folder that others have added.
    """
    if ids is None or not removed.exceptAll(now.places).isEmpty():
        return False
    added = now.manifest.where(F.col("kind") == _INDEX).select(VERSION)
    added = added.exceptAll(base.manifest.where(F.col("kind") == _INDEX).select(VERSION))
    runs = [r[VERSION] for r in added.collect()]  # a handful
    if runs:
        index = keyindex.read_runs(now.spark, f"{now.path}/index", runs, _INDEX_SCHEMA)
        # a merged run also holds older ids, which are no news
        news = keyindex.lookup(index, ids, "event_id").select("event_id")
        known = base.dates_of(ids).select("event_id")
        if not news.join(known, "event_id", "left_anti").isEmpty():
            return False
    changed = base.places.join(now.places, [VERSION, PARTITION], "left_anti").select(PARTITION).distinct()
    if changed.isEmpty():
        return True
    # Others have rewritten dates: the events there may have changed.
    return base.dates_of(ids).join(changed, PARTITION, "left_semi").isEmpty()


def _commit(
    rows: DataFrame,
    path: str,
    replaced: DataFrame | None,
    expected: int,
    new: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> None:
    """Write ``rows`` as a new version, then the manifest that makes it count.

    ``replaced`` has the dates whose folders, as of manifest ``expected``, no longer count; ``new``
    the rows whose ids were not stored before (by default all); ``ids`` all ids that were looked
    at. Writers do not wait for each other: whoever finds the next number taken looks at what the
    others did, and goes on with the number after theirs if nothing of that bears on this write.
    Else, or without ``ids``, this is a conflict.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    base, version = Snapshot(spark, path, expected), uuid.uuid4().hex
    written = _partitioned(rows.withColumn(VERSION, F.lit(version)))
    written.write.mode("append").partitionBy(VERSION, PARTITION).parquet(f"{path}/data")
    fingerprint, none = _fingerprint(rows.schema), F.lit(None)
    if store.children(spark, f"{path}/data/version={version}"):
        # what follows reads a column or two of the files, and does not work out the rows again
        rows = spark.read.schema(rows.schema).parquet(f"{path}/data/version={version}")
    places = (rows if new is None else new).select("event_id", PARTITION)
    removed = base.places.join(replaced, PARTITION, "left_semi") if replaced is not None else base.places.limit(0)
    entries = rows.select(PARTITION).distinct().select(
        F.lit(_DATA).alias("kind"),
        F.lit(version).alias(VERSION),
        PARTITION,
        F.lit(fingerprint).alias("schema"),
        none.cast("bigint").alias("rows"),
    )

    def runs(sizes: dict[str, int]) -> DataFrame:
        return spark.createDataFrame([(_INDEX, run, None, None, n) for run, n in sizes.items()], _MANIFEST)

    own = {}
    if n := places.count():
        keyindex.write_run(places, "event_id", f"{path}/index", version)
        own = {version: n}
    merged, inputs = {}, []
    while True:
        now = snapshot(spark, path)
        if now.number != expected and not _still_holds(base, now, removed, ids):
            raise LedgerConflict("the ledger was changed by another writer")
        sizes = now.index_sizes | own
        if not set(inputs) <= set(sizes):
            merged, inputs = {}, []  # another writer has merged some of them
        if not inputs and (inputs := keyindex.to_merge(sizes)):
            run = uuid.uuid4().hex
            whole = keyindex.read_runs(spark, f"{path}/index", inputs, _INDEX_SCHEMA).drop(keyindex.BUCKET)
            keyindex.write_run(whole, "event_id", f"{path}/index", run)
            merged = {run: sum(sizes[r] for r in inputs)}
        kept = now.manifest.where(F.col("kind") == _DATA).join(removed, [VERSION, PARTITION], "left_anti")
        index = {r: n for r, n in sizes.items() if r not in inputs} | merged
        manifest = kept.select(*[f.split()[0] for f in _MANIFEST.split(", ")]).unionByName(entries)
        if store.write_manifest(manifest.unionByName(runs(index)), f"{path}/manifests", now.number + 1):
            return


def write_ledger(events: DataFrame, path: str) -> None:
    """K1: a new ledger from event rows."""
    if ledger_version(events.sparkSession, path):
        raise ValueError(f"there is a ledger in {path}")
    _commit(with_derived(events.select(*S.EVENT_COLUMNS)), path, None, 0)


def apply_changes(
    spark: SparkSession,
    changes: DataFrame,
    path: str,
    staging: Staging,
    base: Snapshot | None = None,
    ids: DataFrame | None = None,
) -> None:
    """K1 after reconcile: all changes count at once, or none of them.

    ``base`` is the ledger that the changes were worked out from, ``ids`` are all events that were
    looked at for them. The time of an event never changes, so it stays in its date. Dates with
    updated rows are written anew as a whole; dates with new rows only get a further folder.
    """
    base = base or snapshot(spark, path)
    rows = staging.put(with_derived(changes), "changes")
    if rows.isEmpty() and base.number:
        return
    columns = S.STORED_SCHEMA.fieldNames()
    updated = rows.where(F.col("change") == "updated")
    dates = staging.put(updated.select(PARTITION).distinct(), "dates")
    old = base.rows(strict=False).join(dates, PARTITION, "left_semi")
    kept = old.join(updated.select("event_id"), "event_id", "left_anti").select(*columns)
    content = kept.unionByName(rows.select(*columns))
    new = rows.where(F.col("change") != "updated")
    _commit(content, path, dates, base.number, new, ids)


def vacuum(spark: SparkSession, path: str, now_ms: int, keep_commits: int = 1, grace_ms: int = 86_400_000) -> list[str]:
    """Remove folders that none of the newest manifests names, and older manifests; what was removed.

    A folder younger than the grace period may belong to a write that has not ended, or to a
    reader of an older manifest, and stays.
    """
    path = path.rstrip("/")
    numbers = store.commits(spark, f"{path}/manifests")
    if not numbers:
        return []
    named = {_DATA: set(), _INDEX: set()}
    for number in numbers[-keep_commits:]:
        for r in Snapshot(spark, path, number).manifest.select("kind", VERSION).distinct().collect():
            named[r.kind].add(r[VERSION])
    places = [(f"{path}/data/{n}", n.removeprefix("version=") in named[_DATA]) for n in store.children(spark, f"{path}/data")]
    places += [(f"{path}/index/{n}", n.removeprefix("run=") in named[_INDEX]) for n in store.children(spark, f"{path}/index")]
    places += [(store.manifest_file(f"{path}/manifests", n), n in numbers[-keep_commits:]) for n in numbers]
    removed = []
    for place, keep in places:
        own = re.search(r"/(version=[0-9a-f]{32}|run=[0-9a-f]{32}|commit-\d+\.parquet)$", place)
        if own and not keep and store.changed_at_ms(spark, place) + grace_ms <= now_ms:
            store.remove(spark, place)
            removed.append(place)
    return removed


def append_rejects(rejects: DataFrame, path: str) -> None:
    rejects.select(*S.REJECT_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def append_run(spark: SparkSession, path: str, run: dict) -> DataFrame:
    """K3: one finished run."""
    row = tuple(run.get(f.name) for f in S.RUN_SCHEMA.fields)
    df = spark.createDataFrame([row], S.RUN_SCHEMA)
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def redacted(events: DataFrame) -> DataFrame:
    """K2: local paths removed; identity, hashes and counts unchanged."""
    nothing = F.lit(None).cast("string")
    return events.select(*S.EVENT_COLUMNS).withColumns(
        {"project_path": nothing, "source_file": nothing}
    )


def export_ledger(
    spark: SparkSession, ledger: str, runs: str, output: str, redact: bool = True
) -> None:
    """K2: a copy of ledger and run log, by default without local paths."""
    if output.rstrip("/") in (ledger.rstrip("/"), runs.rstrip("/")):
        raise ValueError(f"an export cannot go into its own source {output}")
    events = read_ledger(spark, ledger).select(*S.EVENT_COLUMNS)
    log = read_runs(spark, runs)
    if redact:
        events = redacted(events)
        log = log.withColumn("error", F.lit(None).cast("string"))
    if ledger_version(spark, f"{output}/events"):
        raise ValueError(f"there is a ledger in {output}")
    write_ledger(events, f"{output}/events")
    log.write.mode("errorifexists").parquet(f"{output}/runs")


def write_json_report(report: DataFrame, path: str) -> None:
    """K4: one JSON object per row, explicit nulls."""
    report.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)

"""The import job, from log folders to the ledger."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.operators import reconcile
from meterbook.operators.dedupe import deduplicate_messages
from meterbook.operators.normalize import as_events
from meterbook.operators.replay import build_records
from meterbook.operators.validate import validated
from meterbook.session import Staging
from meterbook.sources import claude, codex, copilot, filestate, gemini, jsonfile, ledger, workbuddy
from meterbook.sources import lines as L
from meterbook.sources.parsed import SOURCE_ORDER

# Reasons of rejects besides those of the extractors and of reconcile.
CHANGED_FILE = "changed_while_read"
LEFT_OUT = "replay_left_out"

_REJECT_DDL = "source string, file_path string, line_number bigint, reason string, detail string"
_SUMMARY_REASONS = 5


@dataclass
class Extracted:
    """Records of one source, how many files it has, and what it refused (``_REJECT_DDL``)."""

    records: DataFrame
    files: int
    rejects: list[DataFrame] = field(default_factory=list)
    diagnostics: DataFrame | None = None


@dataclass
class ImportResult:
    run: dict
    diagnostics: DataFrame | None
    warnings: int


def _rejects(source: str, rows: DataFrame) -> DataFrame:
    detail = "detail" if "detail" in rows.columns else F.lit(None).cast("string").alias("detail")
    return rows.select(F.lit(source).alias("source"), "file_path", "line_number", "reason", detail)


class _Files:
    """The files of one source, listed before they are read and once more after that."""

    def __init__(self, job: Importer, source: str, roots: list[str], suffix: str | None = None, keep=None):
        self.job, self.source = job, source
        self.where = (job.chosen(source, roots), suffix or job.suffix, job.before, keep)
        self.listed = job.staging.put(L.file_states(job.spark, *self.where), "files")
        self.count = self.listed.count()

    def scan(self) -> L.LogScan:
        roots, suffix, before, keep = self.where
        return L.scan_logs(self.job.spark, roots, suffix, before, self.job.staging, keep)

    def steady(self, rows: DataFrame, rejects: list[DataFrame], path: str = "file_path") -> DataFrame:
        """Rows of files that did not change while they were read; the others cost one reject."""
        now = L.file_states(self.job.spark, *self.where)
        changed = self.job.staging.put(L.changed_files(self.listed, now), "changed")
        if changed.isEmpty():
            return rows
        none = F.lit(None).cast("bigint").alias("line_number")
        rejects.append(_rejects(self.source, changed.select("file_path", none, F.lit(CHANGED_FILE).alias("reason"))))
        return rows.join(changed.withColumnRenamed("file_path", path), path, "left_anti")


class Importer:
    """One import run: scans, extracts, reconciles and writes."""

    def listed(self, source: str, roots: list[str]) -> DataFrame:
        """``source, file_path, length, changed, location`` of all files that a source would read."""
        if source == "copilot":
            roots, keep = L.preferred_copilot_roots(self.spark, roots), L.copilot_session_file
        else:
            roots = self.roots_of(source, roots)
            keep = (lambda path: L.admitted_below(path, roots)) if source == "workbuddy" else None
        suffixes = [self.suffix] + [".json"] * (source == "gemini")
        none = "file_path string, length bigint, changed timestamp, location string"
        files = self.spark.createDataFrame([], none)
        for suffix in suffixes if roots else ():
            files = files.unionByName(L.file_states(self.spark, roots, suffix, self.before, keep))
        return files.withColumn("source", F.lit(source))

    def links(self, source: str, locations: list[str]) -> DataFrame:
        """What ties files together (``filestate``): messages and sessions by name."""
        found = self.spark.createDataFrame([], filestate.LINKS)
        if source not in ("claude", "codex") or not locations:
            return found
        roots = [L.as_root(f) for f in locations]
        scan = L.scan_logs(self.spark, roots, self.suffix, self.before, self.staging)
        if source == "claude":
            rows = claude.extract(scan.raw, self.staging, scan).withColumn("role", F.lit(filestate.SHARES))
            named = rows.select(F.col("source_file").alias("file_path"), "role", F.col("message_id").alias("name"))
        else:
            rows = codex.extract(scan.raw, self.staging, scan).where("is_meta")
            role = F.lit(filestate.IS).alias("role")
            named = rows.select("file_path", role, F.col("meta_session").alias("name")).unionByName(
                rows.select("file_path", F.lit(filestate.OF).alias("role"), F.col("meta_parent").alias("name"))
            )
        named = named.where(F.col("name").isNotNull()).distinct().withColumn("source", F.lit(source))
        return found.unionByName(named)

    def __init__(
        self,
        spark: SparkSession,
        staging: Staging,
        grace_minutes: int | None = 15,
        duplicate_policy: str = "ledger",
        suffix: str = ".jsonl",
        only: Mapping[str, list[str]] | None = None,
    ):
        self.only = only
        self.spark = spark
        self.staging = staging
        self.before = L.cutoff(grace_minutes)
        self.policy = duplicate_policy
        self.suffix = suffix

    def roots_of(self, product: str, roots: list[str]) -> list[str]:
        return L.existing(self.spark, L.discover_roots(self.spark, product, roots))

    def chosen(self, source: str, roots: list[str]) -> list[str]:
        """What is read below the roots of a source: everything, or files named one by one."""
        if self.only is None:
            return roots
        return [L.as_root(f) for f in self.only[source] if any(L.is_below(f, r) for r in roots)]

    def _told(self, source: str, rows: list[DataFrame]) -> list[DataFrame]:
        return [_rejects(source, r) for r in rows]

    def claude(self, roots: list[str]) -> Extracted:
        files, bad, told = _Files(self, "claude", self.roots_of("claude", roots)), [], []
        scan = files.scan()
        rows = claude.extract(scan.raw, self.staging, scan, bad)
        records = deduplicate_messages(files.steady(rows, told, "source_file"))
        return Extracted(records, files.count, told + self._told("claude", bad))

    def codex(self, roots: list[str]) -> Extracted:
        files, bad, told = _Files(self, "codex", self.roots_of("codex", roots)), [], []
        scan = files.scan()
        rows = files.steady(codex.extract(scan.raw, self.staging, scan, bad), told)
        result = build_records(rows, self.policy, self.staging)
        left_out = result.verdicts.where(F.col("quarantine").isNotNull()).select(
            "file_path",
            F.lit(None).cast("bigint").alias("line_number"),
            F.lit(LEFT_OUT).alias("reason"),
            F.col("quarantine").alias("detail"),
        )
        rejects = told + self._told("codex", [*bad, left_out])
        return Extracted(result.records, files.count, rejects, result.diagnostics)

    def gemini(self, roots: list[str]) -> Extracted:
        roots, bad, told = self.roots_of("gemini", roots), [], []
        logs, documents = _Files(self, "gemini", roots), _Files(self, "gemini", roots, ".json")
        scan = logs.scan()
        parts = jsonfile.scan_fragments(self.spark, self.chosen("gemini", roots), ".json", self.before, self.staging)
        lines = logs.steady(gemini.extract(scan.raw, self.staging, scan, bad), told, "source_file")
        whole = gemini.extract_fragments(parts, self.staging, bad)
        records = lines.unionByName(documents.steady(whole, told, "source_file"))
        return Extracted(records, logs.count + documents.count, told + self._told("gemini", bad))

    def copilot(self, roots: list[str]) -> Extracted:
        read, bad, told = L.preferred_copilot_roots(self.spark, roots), [], []
        files = _Files(self, "copilot", read, keep=L.copilot_session_file)
        scan = files.scan()
        rows = copilot.extract(scan.raw, self.staging, scan, bad)
        records = files.steady(rows, told, "source_file")
        return Extracted(records, files.count, told + self._told("copilot", bad))

    def workbuddy(self, roots: list[str]) -> Extracted:
        roots, told = self.roots_of("workbuddy", roots), []
        files = _Files(self, "workbuddy", roots, keep=lambda path: L.admitted_below(path, roots))
        scan = files.scan()
        records, bad = workbuddy.extract(scan.raw, self.staging, scan)
        records = files.steady(records, told, "source_file")
        return Extracted(records, files.count, told + self._told("workbuddy", [bad]))


def import_logs(
    spark: SparkSession,
    sources: dict[str, list[str]],
    ledger_path: str,
    runs_path: str,
    now_ms: int,
    run_id: str | None = None,
    grace_minutes: int | None = 15,
    duplicate_policy: str = "ledger",
    rejects_path: str | None = None,
    suffix: str = ".jsonl",
    only: Mapping[str, list[str]] | None = None,
) -> ImportResult:
    """Import the given folders. Rejected lines, records and files are never fatal.

    With ``only``, of each source no files but the given ones are read.

    Every one of them is a row of the table in ``rejects_path`` (by default beside the run log);
    the run itself keeps their number and a short text by reason. Files of lines end in ``suffix``.
    """
    unknown = set(sources) - set(SOURCE_ORDER)
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}")
    run_id = run_id or uuid.uuid4().hex
    with Staging(spark, "import") as staging:
        job = Importer(spark, staging, grace_minutes, duplicate_policy, suffix, only)
        wanted = [name for name in SOURCE_ORDER if sources.get(name) and (only is None or only.get(name))]
        parts = [getattr(job, name)(sources[name]) for name in wanted]
        rejects = spark.createDataFrame([], _REJECT_DDL)
        for more in [r for part in parts for r in part.rejects]:
            rejects = rejects.unionByName(more)
        if parts:
            records = parts[0].records
            for part in parts[1:]:
                records = records.unionByName(part.records)
            events = staging.put(validated(as_events(records, now_ms)), "events")
            decisions = import_events(events, ledger_path, staging, now_ms)
            counts = reconcile.status_counts(decisions).first().asDict()
            rejects = rejects.unionByName(rejected_records(decisions))
        else:
            counts = dict.fromkeys(("added", "updated", "skipped", "rejected"), 0)
        rejects = staging.put(rejects.select(F.lit(run_id).alias("run_id"), "*"), "rejects")
        n_rejects, text = reject_summary(rejects)
        if n_rejects:
            ledger.append_rejects(rejects, rejects_path or f"{runs_path.rstrip('/')}-rejects")
        diagnostics = next((p.diagnostics for p in parts if p.diagnostics is not None), None)
        if diagnostics is not None:
            # A handful of counters; kept as values because the staged tables are dropped.
            diagnostics = spark.createDataFrame(diagnostics.collect(), diagnostics.schema)
        run = {
            "id": run_id,
            "started_at_ms": now_ms,
            "finished_at_ms": now_ms,
            "status": "completed_with_warnings" if n_rejects else "completed",
            "files_scanned": sum(p.files for p in parts),
            **{f"events_{name}": n for name, n in counts.items()},
            "error": text,
        }
        ledger.append_run(spark, runs_path, run)
    return ImportResult(run, diagnostics, n_rejects)


def import_events(events: DataFrame, ledger_path: str, staging: Staging, now_ms: int) -> DataFrame:
    """R2 of checked events against the ledger as it is, written back; the decisions.

    Only stored dates that hold one of the ids are read, found by the index. If another writer
    gets in between and has changed one of these events, all is judged anew.
    """
    spark = events.sparkSession
    for _ in range(ledger.ATTEMPTS - 1):
        try:
            return _reconciled_once(events, ledger.snapshot(spark, ledger_path), staging, now_ms)
        except ledger.LedgerConflict:
            continue
    return _reconciled_once(events, ledger.snapshot(spark, ledger_path), staging, now_ms)


def _reconciled_once(events: DataFrame, base: ledger.Snapshot, staging: Staging, now_ms: int) -> DataFrame:
    outcome = reconcile.reconcile_batch(events, base.matching, staging, now_ms)
    decisions = staging.put(outcome.decisions, "decisions")
    ids = events.select("event_id").where(F.col("event_id").isNotNull())
    ledger.apply_changes(base.spark, outcome.changes, base.path, staging, base, ids)
    return decisions


def rejected_records(decisions: DataFrame) -> DataFrame:
    """Records that validation or reconcile refused."""
    names = F.array(*[F.lit(s) for s in SOURCE_ORDER])
    return decisions.where(F.col("status") == reconcile.REJECTED).select(
        F.get(names, F.col("order_key.source")).alias("source"),
        F.array_join("order_key.path", "/").alias("file_path"),
        F.col("order_key.line").alias("line_number"),
        F.col("code").alias("reason"),
        F.col("event_id").alias("detail"),
    )


def reject_summary(rejects: DataFrame) -> tuple[int, str | None]:
    """Number of rejects, and the most frequent reasons as text without any path."""
    by_reason = rejects.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are sources and reasons
    rows = by_reason.orderBy(F.desc("n"), "source", "reason").collect()
    if not rows:
        return 0, None
    total = sum(r.n for r in rows)
    shown = [f"{r.source} {r.reason}: {r.n}" for r in rows[:_SUMMARY_REASONS]]
    more = len(rows) - len(shown)
    return total, f"{total} rejects; " + "; ".join(shown) + (f"; and {more} other reasons" if more else "")

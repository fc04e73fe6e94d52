"""Line scan of log trees: files below roots, with exact line numbers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterbook.session import Staging

# Directories below a project root that hold no session logs.
EXCLUDED_DIRS = (
    "logs",
    "traces",
    "audit-log",
    "file-history",
    "blobs",
    "tool-output",
    "tool-outputs",
)

def plain_path(uri: Column) -> Column:
    """File path without scheme and authority, percent-escapes decoded."""
    path = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _suffix_glob(suffix: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def cutoff(grace_minutes: int | None, now: datetime | None = None) -> datetime | None:
    """Files changed after this moment are left to the next run; taken once per run."""
    if not grace_minutes:
        return None
    moment = now or datetime.now(timezone.utc)
    return moment.astimezone(timezone.utc) - timedelta(minutes=grace_minutes)


def reader(spark: SparkSession, suffix: str, before: datetime | None):
    reader = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", _suffix_glob(suffix))
        .option("lineSep", "\n")
        # A file that goes while it is read is found by ``changed_files``.
        .option("ignoreMissingFiles", True)
    )
    if before is not None:
        reader = reader.option("modifiedBefore", before.strftime("%Y-%m-%dT%H:%M:%S"))
        reader = reader.option("timeZone", "UTC")
    return reader


def split_bytes(spark: SparkSession) -> int:
    """Bytes of a split at most."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


@dataclass
class LogScan:
    """Lines of a scan whose numbers are not yet known.

    ``raw``: ``(file_path, line_number, value)`` without empty lines, where ``line_number`` is the
    place of the line (split and order within it). ``splits``: lines before each split.
    """

    raw: DataFrame
    splits: DataFrame

    def numbered(self, rows: DataFrame) -> DataFrame:
        """Rows taken from ``raw`` with their line numbers. Rows beyond the counted lines of
        their split are left out: their file has changed, and ``changed_files`` names it."""
        place = F.col("line_number")
        at = F.col("_seq") - F.col("_first_seq")
        keyed = rows.withColumn("_split", place["split"]).withColumn("_seq", place["seq"])
        splits = self.splits.select(
            "file_path",
            F.col("split").alias("_split"),
            F.col("first_seq").alias("_first_seq"),
            F.col("n").alias("_n"),
            F.col("lines_before").alias("_before"),
        )
        found = keyed.join(splits, ["file_path", "_split"]).where((at >= 0) & (at < F.col("_n")))
        numbers = found.withColumn("line_number", F.col("_before") + at + 1)
        return numbers.select(*rows.columns)

    @property
    def lines(self) -> DataFrame:
        return self.numbered(self.raw)


def scan_lines(spark: SparkSession, roots: list[str], suffix: str = ".jsonl", **options) -> DataFrame:
    """The lines of a scan alone."""
    return scan_logs(spark, roots, suffix, **options).lines


def scan_logs(
    spark: SparkSession,
    roots: list[str],
    suffix: str = ".jsonl",
    before: datetime | None = None,
    staging: Staging | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> LogScan:
    """Every line below the roots. ``keep`` chooses files by path; others are not read.

    No file has to pass through one task: a split is read by one task in order, so a line's
    place in its split is known locally, and the place of the split in its file comes from the
    line counts of the splits before it. Lines are parsed first and numbered after that, so
    only the fields kept are joined with the splits, never the text. Lines of any length count.
    """
    path = F.col("_metadata.file_path")
    read = reader(spark, suffix, before).text(roots)
    if keep is not None:
        # A test on file metadata alone selects files before any is opened.
        read = read.where(keep(plain_path(path)))
    raw = read.select(
        plain_path(path).alias("file_path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    return number_lines(raw, staging)


def number_lines(raw: DataFrame, staging: Staging | None = None) -> LogScan:
    """A scan from rows ``file_path, split, seq, value``."""
    splits = raw.groupBy("file_path", "split").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")
    )
    earlier = (
        Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    )
    lines_before = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint"))
    splits = splits.withColumn("lines_before", lines_before)
    if staging is not None:
        splits = staging.put(splits, "splits")
    lines = raw.select(
        "file_path",
        F.struct("split", "seq").alias("line_number"),
        F.regexp_replace("value", "\r$", "").alias("value"),
    ).where(F.col("value") != "")
    return LogScan(lines, splits)


def file_states(
    spark: SparkSession,
    roots: list[str],
    suffix: str,
    before: datetime | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``file_path, length, changed, location`` of the files a scan would read; contents are not read."""
    files = reader(spark, suffix, before).format("binaryFile").load(roots)
    path = plain_path(F.col("_metadata.file_path"))
    files = files if keep is None else files.where(keep(path))
    return files.select(
        path.alias("file_path"), "length", F.col("modificationTime").alias("changed"), F.col("path").alias("location")
    )


def as_root(location: str) -> str:
    """The name of one file, as a root to read: nothing in it stands for other names."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", location)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``file_path`` of files that grew, shrank, went or were written between two listings."""
    states = ["file_path", "length", "changed"]
    return before.select(states).exceptAll(after.select(states)).select("file_path").distinct()


def admitted_below(path: Column, roots: list[str]) -> Column:
    """Whether no directory between the file and one of the roots is an excluded one."""
    names = F.array(*[F.lit(d) for d in EXCLUDED_DIRS])
    admitted = F.lit(False)
    for root in roots:
        prefix = root.rstrip("/") + "/"
        dirs = F.split(F.lower(F.substr(path, F.lit(len(prefix) + 1))), "/")
        excluded = F.arrays_overlap(F.slice(dirs, 1, F.size(dirs) - 1), names)
        admitted = admitted | (path.startswith(prefix) & ~excluded)
    return admitted


def copilot_session_file(path: Column) -> Column:
    """Below a session-state directory only ``<session>/events.jsonl`` holds usage."""
    inside = path.rlike("(^|/)session-state/")
    events = path.rlike("(^|/)session-state/[^/]+/events\\.jsonl$")
    return ~inside | events


def _child_dir(spark: SparkSession, root: str, child: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{child}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.toString() if fs.exists(path) and fs.getFileStatus(path).isDirectory() else None


def discover_roots(spark: SparkSession, product: str, roots: list[str]) -> list[str]:
    """The folders to read for a product, given home or log folders; duplicates dropped."""
    found: list[str] = []
    for root in (r.strip().rstrip("/") for r in roots):
        if not root:
            continue
        base = root.rsplit("/", 1)[-1]
        chosen = root
        if product == "claude":
            chosen = _child_dir(spark, root, "projects") or root
        elif product == "codex" and base not in ("sessions", "archived_sessions"):
            chosen = _child_dir(spark, root, "sessions") or root
        if chosen not in found:
            found.append(chosen)
    return outermost(found)


def is_below(location: str, root: str) -> bool:
    """Whether a file lies below a root, or is it; scheme and authority do not count."""
    plain = [re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", p).rstrip("/") for p in (location, root)]
    return plain[0] == plain[1] or plain[0].startswith(plain[1] + "/")


def outermost(roots: list[str]) -> list[str]:
    """Roots that exist to be read once: folders inside another root are dropped."""
    return [r for r in roots if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in roots)]


def existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that can be read; a missing folder is not an error."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [(r, spark._jvm.org.apache.hadoop.fs.Path(r)) for r in roots]
    return [r for r, p in paths if p.getFileSystem(conf).exists(p)]


def copilot_roots(spark: SparkSession, roots: list[str]) -> dict[str, list[str]]:
    """Request-level, session-summary and other folders of the product."""
    groups: dict[str, list[str]] = {"otel": [], "session": [], "other": []}

    def add(group: str, path: str) -> None:
        if path not in groups[group]:
            groups[group].append(path)

    for root in (r.strip().rstrip("/") for r in roots):
        parts = root.split("/")
        otel, session = (_child_dir(spark, root, d) for d in ("otel", "session-state"))
        if parts[-1] == ".copilot" or (otel and session):
            for group, path in (("otel", otel), ("session", session)):
                if path:
                    add(group, path)
        elif "session-state" in parts[-2:] or (
            parts[-1] == "events.jsonl" and "session-state" in parts[-3:-2]
        ):
            add("session", root)
        elif "otel" in parts[-2:]:
            add("otel", root)
        else:
            add("other", root)
    return groups


def preferred_copilot_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """S3: session summaries are read only if there is no request-level file at all.

    The rule is global: one request-level file anywhere stands for all sessions, so that
    usage is not counted from both kinds.
    """
    groups = {name: existing(spark, paths) for name, paths in copilot_roots(spark, roots).items()}
    chosen = groups["otel"] + groups["other"]
    has_requests = groups["otel"] and list_files(spark, groups["otel"], ".jsonl").take(1)
    if not has_requests:
        chosen = chosen + groups["session"]
    return outermost(list(dict.fromkeys(chosen)))


def list_files(spark: SparkSession, roots: list[str], suffix: str) -> DataFrame:
    """Paths of the files a scan would read; only the listing is read, not the content."""
    return file_states(spark, roots, suffix).select("file_path")


def file_inventory(
    spark: SparkSession, roots_by_source: dict[str, list[str]], suffix: str = ".jsonl"
) -> DataFrame:
    """Q8: number of files per source."""
    frames = [
        list_files(spark, roots, suffix).select(F.lit(source).alias("source"), "file_path")
        for source, roots in roots_by_source.items()
    ]
    merged = frames[0]
    for other in frames[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("source").agg(F.count("file_path").alias("files")).orderBy("source")

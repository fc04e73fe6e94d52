"""Import what has changed since the last import, and what that bears on.

What a log file counts depends on its lines, on parents and other copies of forked files and on
copies of messages in other files. An import remembers in which state it has read a file and the
names that tie files together (``filestate``). The next one lists the folders, without opening a
file, takes the files that are new or not as they were, follows the names to the other files that
must be judged with them, and reads these alone. Files that have grown count as changed.

The ledger is written before the state of files. After a failure between the two the same files
are read again, which changes nothing, since stored events are skipped by identity.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meterbook.plans.ingest import Importer, ImportResult, import_logs
from meterbook.session import Staging
from meterbook.sources import filestate
from meterbook.sources.lines import plain_path
from meterbook.sources.parsed import SOURCE_ORDER

#: Files that one import names one by one; with more, whole folders are read, to the same result.
MOST_NAMED = 100_000

_LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


@dataclass
class Changes:
    """Outcome of an incremental import: how many files had changed, and how many were read."""

    changed: int
    read: int
    result: ImportResult | None


def import_changes(
    spark: SparkSession,
    sources: dict[str, list[str]],
    ledger_path: str,
    runs_path: str,
    state_path: str,
    now_ms: int,
    grace_minutes: int | None = 15,
    suffix: str = ".jsonl",
    **options,
) -> Changes:
    """Import the files that have changed since the last call, with those they bear on.

    The result is that of ``import_logs`` of all folders. One import at a time uses a state.
    """
    with Staging(spark, "changes") as staging:
        job = Importer(spark, staging, grace_minutes, suffix=suffix)
        listed = spark.createDataFrame([], "source string, file_path string, length bigint, changed timestamp, location string")
        names = [name for name in SOURCE_ORDER if sources.get(name)]
        for name in names:
            listed = listed.unionByName(job.listed(name, sources[name]))
        listed = staging.put(listed, "listed")
        state = filestate.FileState(spark, state_path)
        changed = staging.put(state.changed(listed), "changed")
        n_changed = changed.count()
        if not n_changed:
            return Changes(0, 0, None)
        links, n_listed = spark.createDataFrame([], filestate.LINKS), listed.count()
        for name, roots in _locations(changed, names, n_changed == n_listed).items():
            links = links.unionByName(job.links(name, job.roots_of(name, sources[name]) if roots is None else roots))
        links = staging.put(links, "links")
        closure = state.closure(changed, links, staging)
        wanted = staging.put(listed.join(closure, list(filestate.FILE), "left_semi"), "wanted")
        n_wanted = wanted.count()
        only = _locations(wanted, names, n_wanted == n_listed)
        whole = any(files is None for files in only.values())
        result = import_logs(
            spark, sources, ledger_path, runs_path, now_ms,
            grace_minutes=grace_minutes, suffix=suffix, only=None if whole else only, **options,
        )
        state.add(changed, links)
        return Changes(n_changed, n_listed if whole else n_wanted, result)


def _locations(files: DataFrame, names: list[str], every: bool) -> dict[str, list[str] | None]:
    """Files by source, ``MOST_NAMED`` at most, or None for a source with more. Where the files are
    ``every`` one there is, as in a first import, none has to be named."""
    if every:
        return dict.fromkeys(names)
    out: dict[str, list[str] | None] = {}
    for name in names:
        rows = files.where(F.col("source") == name).select("location").limit(MOST_NAMED + 1).collect()
        out[name] = sorted(r.location for r in rows) if len(rows) <= MOST_NAMED else None
    return out


def new_files(spark: SparkSession, root: str, files_per_trigger: int = 10_000) -> DataFrame:
    """Stream of paths below a root; the file content is not read."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_LISTING)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(root)
        .select(plain_path(F.col("path")).alias("file_path"))
    )


def follow(
    spark: SparkSession,
    sources: dict[str, list[str]],
    ledger_path: str,
    runs_path: str,
    checkpoint: str,
    on_result: Callable[[ImportResult], None] | None = None,
    clock_ms: Callable[[], int] = lambda: int(time.time() * 1000),
    state_path: str | None = None,
    **options,
) -> StreamingQuery:
    """Import everything that has changed since the last call, then stop.

    The stream tells that files have arrived; ``import_changes`` finds out what has to be read,
    files that only grew included. Where nothing but growth is expected, call it by itself.
    """
    stream = None
    for source, roots in sources.items():
        for root in roots:
            named = new_files(spark, root).withColumn("source", F.lit(source))
            stream = named if stream is None else stream.unionByName(named)

    def batch(files: DataFrame, _: int) -> None:
        if files.isEmpty():
            return
        state = state_path or f"{runs_path.rstrip('/')}-files"
        changes = import_changes(spark, sources, ledger_path, runs_path, state, clock_ms(), **options)
        if on_result is not None and changes.result is not None:
            on_result(changes.result)

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

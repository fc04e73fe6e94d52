"""What incremental imports know about log files: their states, and what ties them together.

Two kinds of runs in one folder, named by numbered manifests as in a ledger. ``files`` has the state
in which a file was last imported; ``links`` is an index (``keyindex``) of names that files have in
common, from a name to files and from a file to names:

* ``shares``: a message that occurs in the file; copies of a message are judged together;
* ``is``: the session that the file is;
* ``of``: the session that the file was forked from.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.session import Staging
from meterbook.sources import keyindex, store

SHARES, IS, OF = "shares", "is", "of"
FILE = ("source", "file_path")
_FILES = "source string, file_path string, length bigint, changed timestamp, batch bigint"
LINKS = "source string, file_path string, role string, name string"
_INDEX = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "source", "file_path", "role", "name")])
_MANIFEST = "kind string, run string, rows bigint"


def _by_name(source: Column, name: Column) -> Column:
    return F.concat_ws("\x01", F.lit("name"), source, name)


def _by_file(source: Column, path: Column) -> Column:
    return F.concat_ws("\x01", F.lit("file"), source, path)


class FileState:
    """The state as of the newest manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        numbers = store.commits(spark, self.path)
        self.number = numbers[-1] if numbers else 0

    @cached_property
    def _runs(self) -> dict[str, dict[str, int]]:
        runs: dict[str, dict[str, int]] = {"files": {}, "links": {}}
        if self.number:
            manifest = self.spark.read.schema(_MANIFEST).parquet(store.manifest_file(self.path, self.number))
            for r in manifest.collect():  # a handful of runs
                runs[r.kind][r.run] = r.rows
        return runs

    def _history(self, runs) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], _FILES)
        return self.spark.read.schema(_FILES).parquet(*[f"{self.path}/files/run={r}" for r in runs])

    @staticmethod
    def _latest(history: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct("length", "changed", "batch"), "batch").alias("s")
        return history.groupBy(*FILE).agg(newest).select(*FILE, "s.*")

    def known(self) -> DataFrame:
        """``source, file_path, length, changed``: every file as it was last imported."""
        return self._latest(self._history(self._runs["files"])).drop("batch")

    def changed(self, listed: DataFrame) -> DataFrame:
        """Files of a listing that are new, or not as they were."""
        state = [*FILE, "length", "changed"]
        return listed.join(self.known().select(state), state, "left_anti")

    def _lookup(self, keys: DataFrame) -> DataFrame:
        index = keyindex.read_runs(self.spark, f"{self.path}/links", self._runs["links"], _INDEX)
        return keyindex.lookup(index, keys, "key").select("source", "file_path", "role", "name").distinct()

    def links_of(self, files: DataFrame) -> DataFrame:
        return self._lookup(files.select(_by_file(F.col("source"), F.col("file_path")).alias("key")))

    def links_with(self, names: DataFrame) -> DataFrame:
        return self._lookup(names.select(_by_name(F.col("source"), F.col("name")).alias("key")))

    def closure(self, files: DataFrame, links: DataFrame, staging: Staging) -> DataFrame:
        """``source, file_path`` of all files that must be read for the given ones to be judged as
        if all were read; ``links`` are the links of the given files as they are now.

        Affected are the given files and, step by step, files that share a message with an
        affected file, that are the same session, or were forked from it. To judge these, the
        sessions that they were forked from are read as well, up to the first.
        """
        affected = self._spread(files.select(*FILE), links, staging, _affects)
        known = self.links_of(affected).unionByName(links).distinct()
        return self._spread(affected, known, staging, _needs)

    def _spread(self, files: DataFrame, links: DataFrame, staging: Staging, rule) -> DataFrame:
        found = staging.put(files.distinct(), "found")
        frontier = staging.put(links, "frontier")
        while True:
            names = frontier.select("source", "name").distinct()
            met = self.links_with(names).alias("b").join(
                frontier.select("source", "name", F.col("role").alias("from_role")).alias("a"), ["source", "name"]
            )
            new = staging.put(
                met.where(rule(F.col("from_role"), F.col("role"))).select(*FILE).distinct().join(found, list(FILE), "left_anti"),
                "new",
            )
            if new.isEmpty():
                return found
            found = staging.put(found.unionByName(new), "found")
            frontier = staging.put(self.links_of(new), "frontier")

    def add(self, files: DataFrame, links: DataFrame) -> None:
        """Remember files as imported, with their links."""
        batch, runs = self.number + 1, {k: dict(v) for k, v in self._runs.items()}
        run = uuid.uuid4().hex
        listed = files.select(*FILE, "length", "changed").withColumn("batch", F.lit(batch).cast("bigint"))
        self._write_files(listed, run, runs["files"])
        both = [_by_name(F.col("source"), F.col("name")), _by_file(F.col("source"), F.col("file_path"))]
        keyed = links.select(F.explode(F.array(*both)).alias("key"), "source", "file_path", "role", "name")
        if n := keyed.count():
            keyindex.write_run(keyed, "key", f"{self.path}/links", run)
            runs["links"][run] = n
        if gone := keyindex.to_merge(runs["files"]):
            self._write_files(self._latest(self._history(gone)), uuid.uuid4().hex, runs["files"], gone)
        if gone := keyindex.to_merge(runs["links"]):
            whole = keyindex.read_runs(self.spark, f"{self.path}/links", gone, _INDEX).drop(keyindex.BUCKET).distinct()
            run = uuid.uuid4().hex
            keyindex.write_run(whole, "key", f"{self.path}/links", run)
            runs["links"] = {r: k for r, k in runs["links"].items() if r not in gone} | {
                run: sum(runs["links"][r] for r in gone)
            }
        rows = [(kind, run, n) for kind, of in runs.items() for run, n in of.items()]
        if not store.write_manifest(self.spark.createDataFrame(rows, _MANIFEST), self.path, batch):
            raise RuntimeError("another import has changed the state of files")

    def _write_files(self, rows: DataFrame, run: str, runs: dict[str, int], instead_of=()) -> None:
        place = f"{self.path}/files/run={run}"
        rows.write.mode("errorifexists").parquet(place)
        for gone in instead_of:
            del runs[gone]
        runs[run] = self.spark.read.schema(_FILES).parquet(place).count()


def _affects(mine: Column, theirs: Column) -> Column:
    return ((mine == SHARES) & (theirs == SHARES)) | ((mine == IS) & theirs.isin(IS, OF))


def _needs(mine: Column, theirs: Column) -> Column:
    return mine.isin(IS, OF) & (theirs == IS)

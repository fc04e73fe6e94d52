"""Session settings the library relies on, and durable staging of intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, not only speed.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # Later attributes win when attribute lists are folded into one map.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A repeated JSON key keeps its last value instead of voiding the line.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

_TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hot event ids, files and sessions are split even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode. Wide projections (prices,
    # validation, extraction) run faster as many small methods than as one interpreted one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Unless the session says otherwise, a task reads 32 MB, not 128: staged rows are wide, and a task
# that sorts 128 MB of them as Parquet spills. As many small files as before make up a task.
_SPLITS = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.files.openCostInBytes": "1m"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above and pin the split size rule of file scans.

    Line numbers are rebuilt from two reads of the same files (rows, and row counts per
    split). Both must cut the files alike, so the split rule may not follow the number of
    executors, which can change between the two reads.
    """
    for key, value in {**_REQUIRED, **_TUNING}.items():
        spark.conf.set(key, value)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set(
            "spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)
        )
    # A log tree has a folder per project or session. By default every folder is a task of its own,
    # up to 10,000 in a listing, and an import lists its trees several times.
    if spark.conf.get(_LISTING_TASKS, None) is None:
        spark.conf.set(_LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))
    if all(spark.conf.get(key, None) is None for key in _SPLITS):
        for key, value in _SPLITS.items():
            spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so an unset folder is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="meterbook-")
    atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


#: Staged tables nobody has dropped: a lazy result still reads them.
_open: list[Staging] = []


def drop_staged(spark: SparkSession) -> None:
    """Drop all tables that this process has staged; results that read them end with that."""
    for staging in list(_open):
        if staging.spark is spark:
            staging.drop()


class Staging:
    """Tables written once and read back, to cut lineage and share work.

    Parquet is used instead of ``checkpoint()`` because the rows are then computed once,
    stored by column and pruned again on every read.
    """

    def __init__(self, spark: SparkSession, label: str = "job"):
        self.spark = spark
        self.root = f"{staging_root(spark)}/meterbook-{label}-{uuid.uuid4().hex}"
        _open.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(hadoop, True)
        if self in _open:
            _open.remove(self)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *exc) -> None:
        self.drop()

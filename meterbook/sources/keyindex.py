"""A log-structured index from keys to places, beside a table that only grows.

A run is written once, as files by bucket of the key's hash, sorted by key; what an index holds is
a list of runs, which its owner keeps. A lookup reads the buckets of its keys and no other, in all
runs. Runs of like size are merged, so their number grows with the logarithm of the index, and an
entry is rewritten as often.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
BUCKET = "bucket"
#: A merge unites at least so many runs, each smaller than so many times the ones before it.
_LEAST_RUNS, _RATIO = 4, 4


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_run(rows: DataFrame, key: str, path: str, run: str) -> None:
    """Rows in ranges of bucket and key: balanced by rows, so a large bucket has many files."""
    placed = rows.withColumn(BUCKET, bucket_of(F.col(key)))
    ranges = placed.repartitionByRange(BUCKET, key).sortWithinPartitions(BUCKET, key)
    ranges.write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{path}/run={run}")


def read_runs(spark: SparkSession, path: str, runs: Iterable[str], schema: T.StructType) -> DataFrame:
    places = [f"{path}/run={run}" for run in runs]
    placed = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    if not places:
        return spark.createDataFrame([], placed)
    return spark.read.schema(placed).option("basePath", path).parquet(*places)


def lookup(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Entries of the given keys; other buckets are not read."""
    wanted = keys.select(key).distinct()
    # at most BUCKETS rows
    touched = [r[BUCKET] for r in wanted.select(bucket_of(F.col(key)).alias(BUCKET)).distinct().collect()]
    return index.where(F.col(BUCKET).isin(sorted(touched))).join(wanted, key, "left_semi").drop(BUCKET)


def to_merge(sizes: Mapping[str, int]) -> list[str]:
    """The runs that should become one now: the smallest ones, while the next is of like size."""
    chosen, held = [], 0
    for run, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if chosen and n >= _RATIO * held:
            break
        chosen.append(run)
        held += n
    return chosen if len(chosen) >= _LEAST_RUNS else []

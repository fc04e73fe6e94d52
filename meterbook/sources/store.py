"""Names in a shared store: listing them, and taking one that nobody else may have."""

from __future__ import annotations

import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_COMMIT = re.compile(r"commit-(\d+)\.parquet")


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    place, fs = _located(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def changed_at_ms(spark: SparkSession, path: str) -> int:
    place, fs = _located(spark, path)
    return fs.getFileStatus(place).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _located(spark, path)
    fs.delete(place, True)


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Give a finished file its name, unless the name is taken; whether it got it.

    Of several callers at once only one gets the name: a local file by a link, which fails if the
    name exists, any other by a rename that does not overwrite, which stores such as HDFS do in
    one step.
    """
    here, fs = _located(spark, source)
    there, _ = _located(spark, target)
    if fs.getScheme() == "file":
        try:
            os.link(here.toUri().getPath(), there.toUri().getPath())
        except FileExistsError:
            return False
        return True
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    nothing = spark.sparkContext._gateway.new_array(kind, 0)
    try:
        files.rename(fs.makeQualified(here), fs.makeQualified(there), nothing)
    except Py4JJavaError as err:
        if "AlreadyExists" in err.java_exception.getClass().getName():
            return False
        raise
    return True


def commits(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests in a folder."""
    found = (_COMMIT.fullmatch(name) for name in children(spark, folder))
    return sorted(int(m[1]) for m in found if m)


def manifest_file(folder: str, number: int) -> str:
    return f"{folder}/commit-{number:020d}.parquet"


def write_once(rows: DataFrame, folder: str, name: str) -> bool:
    """Write a few rows as one Parquet file, unless there is one of that name; whether it was written."""
    spark = rows.sparkSession
    new = f"{folder}/_new-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(new)
    part = next(n for n in children(spark, new) if n.startswith("part-"))
    try:
        return publish(spark, f"{new}/{part}", f"{folder}/{name}")
    finally:
        remove(spark, new)


def write_manifest(entries: DataFrame, folder: str, number: int) -> bool:
    """Publish the manifest of a number unless another writer has; whether it was published."""
    return write_once(entries, folder, manifest_file("", number).removeprefix("/"))

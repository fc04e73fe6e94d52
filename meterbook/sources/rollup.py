"""Usage sums kept beside a ledger, so that reports need not read its events.

A version folder of a ledger never changes, so neither do its sums: one row per date, quarter of an
hour and combination of the dimensions, with the number of events and the sums of their counters.
Every zone's offset is a whole number of quarters, so days, weeks and months of any zone are sums of
these rows. Which of them count is what the ledger's manifest says of their folders: when a write
replaces a date, the sums of the old folder go with it, and nothing is subtracted.

A version is summed up once, by ``refresh``, after a write or on a schedule. Reports take versions
that have no sums yet from their events, so they are exact at any time. Costs are rounded per event
and are no sums of these rows; they come from the events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import schema as S
from meterbook.functions import clock
from meterbook.functions.clock import time_bucket
from meterbook.operators.filters import Filters, apply_filters
from meterbook.operators.metrics import dimension_label
from meterbook.sources import ledger, store

SLOT_MS = 900_000
_KEYS = ("timestamp_ms", "channel", "source_product", "provider", "model_normalized", "project_label")
_RUN = "version string, run string"
_SUMS_SCHEMA = T.StructType(
    [
        T.StructField(ledger.VERSION, T.StringType()),
        T.StructField(ledger.PARTITION, T.StringType()),
        *[f for name in _KEYS for f in S.STORED_SCHEMA.fields if f.name == name],
        *[T.StructField(name, T.LongType()) for name in ("events", *S.TOKEN_COLUMNS)],
    ]
)


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of one version or more as sums; counters that are absent count as zero."""
    slot = F.col("timestamp_ms") - F.pmod(F.col("timestamp_ms"), F.lit(SLOT_MS))
    sums = [F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias(t) for t in S.TOKEN_COLUMNS]
    return rows.withColumn("timestamp_ms", slot).groupBy(*keys, *_KEYS).agg(F.count(F.lit(1)).alias("events"), *sums)


def version_rows(now: ledger.Snapshot, versions: list[str]) -> DataFrame:
    stored = T.StructType([*S.STORED_SCHEMA.fields, T.StructField(ledger.VERSION, T.StringType())])
    places = [f"{now.path}/data/version={v}" for v in versions]
    return now.spark.read.schema(stored).option("basePath", f"{now.path}/data").parquet(*places)


def _runs(spark: SparkSession, path: str) -> dict[str, str]:
    """The run that holds the sums of a version, for versions that have them."""
    names = [n for n in store.children(spark, f"{path}/rollups") if n.startswith("of-")]
    if not names:
        return {}
    found = spark.read.schema(_RUN).parquet(*[f"{path}/rollups/{n}" for n in names])
    return {r.version: r.run for r in found.collect()}  # one row per version


def live_versions(now: ledger.Snapshot) -> list[str]:
    """Versions that count; one per write that has not been replaced as a whole."""
    return sorted(r[ledger.VERSION] for r in now.places.select(ledger.VERSION).distinct().collect())


def refresh(spark: SparkSession, path: str) -> int:
    """Sum up the versions that have no sums yet; how many there were."""
    now = ledger.snapshot(spark, path)
    known = _runs(spark, now.path)
    missing = [v for v in live_versions(now) if v not in known]
    if not missing:
        return 0
    run = uuid.uuid4().hex
    sums = _summed(version_rows(now, missing), ledger.VERSION, ledger.PARTITION)
    sums.select(*_SUMS_SCHEMA.fieldNames()).write.mode("errorifexists").partitionBy(
        ledger.VERSION, ledger.PARTITION
    ).parquet(f"{now.path}/rollups/run={run}")
    for version in missing:
        # Sums of two refreshes at once are the same; the first name stays.
        store.write_once(
            spark.createDataFrame([(version, run)], _RUN), f"{now.path}/rollups", f"of-{version}.parquet"
        )
    return len(missing)


def rollup(spark: SparkSession, path: str, now: ledger.Snapshot | None = None) -> DataFrame:
    """The sums that count now, shaped like events with their number in ``events``."""
    now = now or ledger.snapshot(spark, path)
    live, known = live_versions(now), _runs(spark, now.path)
    rows = spark.createDataFrame([], _SUMS_SCHEMA)
    if kept := [v for v in live if v in known]:
        base = f"{now.path}/rollups"
        schema = T.StructType([*_SUMS_SCHEMA.fields, T.StructField("run", T.StringType())])
        places = [f"{base}/run={known[v]}/version={v}" for v in kept]
        stored = spark.read.schema(schema).option("basePath", base).parquet(*places)
        rows = rows.unionByName(stored.drop("run"))
    if late := [v for v in live if v not in known]:
        rows = rows.unionByName(_summed(version_rows(now, late), ledger.VERSION, ledger.PARTITION))
    return rows.join(now.places, [ledger.VERSION, ledger.PARTITION], "left_semi").drop(ledger.VERSION)


def answers(filters: Filters) -> bool:
    """Whether the sums can tell what a selection holds: sessions are not among their dimensions,
    and bounds given as instants may cut a quarter of an hour."""
    f = filters.validate()
    bounds = [clock.since_millis(f.since, f.timezone)] if f.since else []
    bounds += [clock.until_millis(f.until, f.timezone)] if f.until else []
    return not f.session and all(ms % SLOT_MS == 0 for ms in bounds)


def _selected(sums: DataFrame, filters: Filters) -> DataFrame:
    if not answers(filters):
        raise ValueError("sums keep neither sessions nor parts of a quarter of an hour")
    return apply_filters(sums, filters)


def _report(rows: DataFrame, label: Column) -> DataFrame:
    sums = [F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias(t) for t in ("events", *S.TOKEN_COLUMNS)]
    return rows.groupBy(label.alias("label")).agg(*sums).orderBy("label")


def timeseries(sums: DataFrame, bucket: str, filters: Filters = Filters()) -> DataFrame:
    """A2 from sums: usage per day, week or month of the report zone."""
    rows = _selected(sums, filters)
    return _report(rows, time_bucket(F.col("timestamp_ms"), filters.timezone, bucket))


def breakdown(sums: DataFrame, by: str, filters: Filters = Filters()) -> DataFrame:
    """A3-A8 from sums, for the dimensions that they keep; sessions are not among them."""
    if by == "session":
        raise ValueError("sums do not keep sessions")
    rows = _selected(sums, filters)
    return _report(rows, dimension_label(rows, by))

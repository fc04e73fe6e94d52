"""Q6: digests of ledgers, so that two of them are compared without reading what is equal.

The digest of a set of rows does not depend on their order: two 64-bit hashes of every row are
summed in four parts of 32 bits, beside the number of rows. So digests add up: those of the version
folders that hold a date to that of the date, and those of its ranges, ``LEAVES`` by a hash of the
event id, likewise. A comparison goes from dates to ranges and from differing ranges to rows.

A version folder never changes, so its digests are stored once, by ``refresh``, after a write or on
a schedule; which of them count is what the manifest says. Versions without digests are taken from
their rows, so a comparison is right at any time. When an event was imported is no part of a digest.

The hashes tell rows apart by chance of 2^-128, not against somebody who makes rows to collide.
Defined cases: an empty or absent ledger has no dates; a row stored twice counts twice; an id that
is stored twice is compared as the sum of its rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.operators import quality
from meterbook.sources import ledger, rollup, store
from meterbook.sources.profile import Profile

LEAVES = 4096
DATE, RANGE = "date", "range"
_NOT_COMPARED = ("imported_at_ms", "updated_at_ms")
_COMPARED = tuple(c for c in S.EVENT_COLUMNS if c not in _NOT_COMPARED)
_PARTS = ("d0", "d1", "d2", "d3")
_SUMS = ("rows", *_PARTS)
_RUN = "version string, run string"
_FIELDS = f"event_date_utc string, leaf int, {', '.join(f'{c} bigint' for c in _SUMS)}, level string, version string"


def leaf_of(event_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("leaf"), event_id), F.lit(LEAVES)).cast("int")


def row_digest() -> list[Column]:
    """Four parts of 32 bits. A hash skips nulls, so which columns are null is hashed as well."""
    nulls = [F.col(c).isNull() for c in _COMPARED]
    parts = []
    for salt in ("a", "b"):
        h = F.xxhash64(F.lit(salt), *nulls, *[F.col(c) for c in _COMPARED])
        parts += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return [p.alias(name) for p, name in zip(parts, _PARTS)]


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in _SUMS])


def _of_rows(rows: DataFrame) -> DataFrame:
    """Digests of the ranges of every version and date."""
    place = (ledger.VERSION, ledger.PARTITION)
    each = rows.select(*place, leaf_of(F.col("event_id")).alias("leaf"), F.lit(1).alias("rows"), *row_digest())
    return _added(each, *place, "leaf").withColumn("level", F.lit(RANGE))


def _of_dates(ranges: DataFrame) -> DataFrame:
    dates = _added(ranges, ledger.VERSION, ledger.PARTITION)
    return dates.withColumns({"level": F.lit(DATE), "leaf": F.lit(None).cast("int")})


def _runs(spark: SparkSession, path: str) -> dict[str, str]:
    """The run that holds the digests of a version, for versions that have them."""
    names = [n for n in store.children(spark, f"{path}/digests") if n.startswith("of-")]
    if not names:
        return {}
    found = spark.read.schema(_RUN).parquet(*[f"{path}/digests/{n}" for n in names])
    return {r.version: r.run for r in found.collect()}  # one row per version


def _stored(spark: SparkSession, path: str, runs: list[str], level: str) -> DataFrame:
    base = f"{path}/digests"
    places = [f"{base}/run={run}" for run in runs]
    read = spark.read.schema(f"{_FIELDS}, run string").option("basePath", base).parquet(*places)
    return read.where(F.col("level") == level).drop("run")


def _write(rows: DataFrame, path: str, run: str) -> None:
    """Few files in order of date, so that the ranges of some dates are found by file statistics."""
    order = (ledger.VERSION, ledger.PARTITION, "leaf")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.mode("append").partitionBy("level", ledger.VERSION).parquet(f"{path}/digests/run={run}")


def refresh(spark: SparkSession, path: str) -> int:
    """Store the digests of the versions that have none yet; how many there were."""
    now = ledger.snapshot(spark, path)
    known = _runs(spark, now.path)
    missing = [v for v in rollup.live_versions(now) if v not in known]
    if not missing:
        return 0
    run = uuid.uuid4().hex
    _write(_of_rows(rollup.version_rows(now, missing)), now.path, run)
    _write(_of_dates(_stored(spark, now.path, [run], RANGE)), now.path, run)
    for version in missing:
        # Digests of two refreshes at once are the same; the first name stays.
        row = spark.createDataFrame([(version, run)], _RUN)
        store.write_once(row, f"{now.path}/digests", f"of-{version}.parquet")
    return len(missing)


def nodes(now: ledger.Snapshot, level: str, dates: list[str] | None = None) -> DataFrame:
    """Digests of the dates of a ledger, or of the ranges of some of them."""
    live, known = rollup.live_versions(now), _runs(now.spark, now.path)
    keys = (ledger.PARTITION,) if level == DATE else (ledger.PARTITION, "leaf")
    columns = (ledger.VERSION, *keys, *_SUMS)
    found = now.spark.createDataFrame([], _FIELDS).select(*columns)
    if kept := [v for v in live if v in known]:
        stored = _stored(now.spark, now.path, sorted({known[v] for v in kept}), level)
        found = found.unionByName(stored.where(F.col(ledger.VERSION).isin(kept)).select(*columns))
    if late := [v for v in live if v not in known]:
        ranges = _of_rows(rollup.version_rows(now, late))
        found = found.unionByName((_of_dates(ranges) if level == DATE else ranges).select(*columns))
    if dates is not None:
        found = found.where(F.col(ledger.PARTITION).isin(dates))
    return _added(found.join(now.places, [ledger.VERSION, ledger.PARTITION], "left_semi"), *keys)


def _unlike(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys whose digests differ, or that only one side has."""
    sides = [s.select(*keys, F.struct(*_SUMS).alias(name)) for s, name in ((left, "l"), (right, "r"))]
    return sides[0].join(sides[1], list(keys), "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select(*keys)


def differing(left: ledger.Snapshot, right: ledger.Snapshot) -> DataFrame:
    """``event_date_utc, leaf`` of the ranges in which two ledgers differ; reads digests only."""
    unlike = _unlike(nodes(left, DATE), nodes(right, DATE), (ledger.PARTITION,))
    dates = [r[ledger.PARTITION] for r in unlike.collect()]  # at most the dates of the calendar
    return _unlike(nodes(left, RANGE, dates), nodes(right, RANGE, dates), (ledger.PARTITION, "leaf"))


def rows_of(now: ledger.Snapshot, ranges: DataFrame) -> DataFrame:
    """The stored rows in some ranges; dates without one are not opened."""
    dates = [r[ledger.PARTITION] for r in ranges.select(ledger.PARTITION).distinct().collect()]
    rows = now.rows().where(F.col(ledger.PARTITION).isin(dates)).withColumn("leaf", leaf_of(F.col("event_id")))
    return rows.join(ranges, [ledger.PARTITION, "leaf"], "left_semi").drop("leaf")


def diff(
    candidate: ledger.Snapshot, baseline: ledger.Snapshot, profile: Profile | None = None
) -> DataFrame:
    """Q6: ``quality.ledger_diff`` of two stored ledgers. Equal ranges add nothing to a difference,
    so only the others are read and priced."""
    ranges = differing(candidate, baseline)
    return quality.ledger_diff(rows_of(candidate, ranges), rows_of(baseline, ranges), profile)


def changes(candidate: ledger.Snapshot, baseline: ledger.Snapshot) -> DataFrame:
    """``event_date_utc, event_id, change``: events added to, removed from or changed since the
    baseline, which may be an older state of the same ledger."""
    ranges, keys = differing(candidate, baseline), (ledger.PARTITION, "event_id")

    def side(now: ledger.Snapshot, name: str) -> DataFrame:
        each = rows_of(now, ranges).select(*keys, F.lit(1).alias("rows"), *row_digest())
        return _added(each, *keys).select(*keys, F.struct(*_SUMS).alias(name))

    both = side(candidate, "l").join(side(baseline, "r"), list(keys), "full_outer")
    change = F.when(F.col("r").isNull(), "added").when(F.col("l").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select(*keys, change.alias("change"))

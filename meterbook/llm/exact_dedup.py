"""Exact deduplication in two Bloom-filter passes.

The first pass fills a two-plane Bloom filter with the hash of every text: a bit of the second
plane is set where at least two entries met. The second pass tests every row against that
plane. A row with a clear bit is proven unique and passes straight through; only the others,
which hold every true copy and a few chance hits, shuffle and are compared by digest.

A filter has 16 bits a row and 64 MiB at most (``sketch.MAX_BITS``). Where one filter would have to
be larger, the hashes are cut into ranges, and each range has a filter of its own, one at a time:
the table is stored in order of the hash within every task, without a shuffle, so a range is read
by its row groups and all ranges together read the table once. So the share of rows that shuffle is the
same at every size. Copies of one text are counted with map-side combine, so a group may hold any
share of the rows.

Defined cases: a null text equals an empty text; a null id is below every other id; rows that
repeat both id and text count towards the group, and ``deduplicate`` keeps one of them; an
empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm import sketch
from meterbook.session import Staging

PROBES = 4
#: Bits of a filter per row.
PER_ROW = 16


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _hash(digest: Column) -> Column:
    return F.xxhash64(digest)


def ranges(rows: int, max_bits: int) -> list[tuple[int, int]]:
    """Bounds, both included, of hash ranges that one filter each can tell apart."""
    n = max(1, -(-rows * PER_ROW // max_bits))
    cuts = [-(1 << 63) + (i << 64) // n for i in range(n + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def _plane(digests: DataFrame, max_bits: int):
    """The broadcast second plane of the filter of these digests."""
    bits = sketch.bits_for(digests.count(), PER_ROW, max_bits)
    plane = sketch.build(digests.select("hash"), bits, PROBES, repeated=True)
    return digests.sparkSession.sparkContext.broadcast(plane)


def _maybe_repeated(plane, digest_hash: Column) -> Column:
    """Does the second plane allow a repetition of this digest?"""

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(sketch.contains(plane.value, sketch.as_hashes(hashes), PROBES))

    return test(digest_hash)


def _digests(docs: DataFrame, staging: Staging) -> DataFrame:
    rows = docs.select("doc_id", text_digest(F.col("text")).alias("digest"))
    return staging.put(rows.withColumn("hash", _hash(F.col("digest"))).sortWithinPartitions("hash"), "digests")


def _in(bounds: tuple[int, int], column: str = "hash") -> Column:
    return F.col(column).between(*map(F.lit, bounds))


def _by_range(staging: Staging, digests: DataFrame, max_bits: int, step) -> DataFrame:
    """Rows of ``step(bounds, digests, plane)`` for every range, each stored before the next filter is built."""
    for bounds in ranges(digests.count(), max_bits):
        part = digests.where(_in(bounds))
        plane = _plane(part, max_bits)
        schema = staging.put(step(bounds, part, plane), "range").schema
        plane.destroy()
    return digests.sparkSession.read.schema(schema).parquet(f"{staging.root}/range-*")


def _groups(digests: DataFrame) -> DataFrame:
    """Size and surviving id of each digest."""
    return digests.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def decisions(docs: DataFrame, max_bits: int = sketch.MAX_BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Of equal texts the row with the largest ``doc_id`` stays.
    """
    staging = Staging(docs.sparkSession, "exact-dedup")

    def flag(_, digests: DataFrame, plane) -> DataFrame:
        return digests.withColumn("maybe", _maybe_repeated(plane, F.col("hash"))).drop("hash")

    flagged = _by_range(staging, _digests(docs, staging), max_bits, flag)
    alone = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "digest"
    )
    met = flagged.where("maybe").drop("maybe")
    copies = met.join(_groups(met), "digest").select("doc_id", "keep_id", "group_size", "digest")
    return alone.unionByName(copies).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, max_bits: int = sketch.MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    One filter tests the rows as they are read. With several, the rows are stored in order of their
    hash within every task, so that each filter reads its own.
    """
    staging = Staging(docs.sparkSession, "exact-dedup")
    digests = _digests(docs, staging)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(text_digest(docs["text"]).alias("digest"), docs["doc_id"].alias("id"), row)
    keyed = keyed.withColumn("hash", _hash(F.col("digest")))

    def stay(rows: DataFrame, digests: DataFrame, plane) -> DataFrame:
        rows = rows.withColumn("maybe", _maybe_repeated(plane, F.col("hash")))
        alone = rows.where(~F.col("maybe")).select("row.*")
        winners = _groups(digests.where(_maybe_repeated(plane, F.col("hash")))).select(
            F.col("digest").alias("d"), F.col("keep_id").alias("k")
        )
        met = rows.where("maybe").join(
            winners, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("k")), "left_semi"
        )
        return alone.unionByName(met.dropDuplicates(["digest", "id"]).select("row.*"))

    if len(ranges(digests.count(), max_bits)) == 1:
        return stay(keyed, digests, _plane(digests, max_bits))
    ordered = staging.put(keyed.sortWithinPartitions("hash"), "rows")
    return _by_range(
        staging, digests, max_bits, lambda bounds, part, plane: stay(ordered.where(_in(bounds)), part, plane)
    )

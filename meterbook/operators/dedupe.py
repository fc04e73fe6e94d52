"""Duplicate removal as plain aggregates, so hot keys combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame):
    return F.struct(*[F.col(c) for c in df.columns])


def deduplicate_messages(records: DataFrame) -> DataFrame:
    """One record per (message, request) over all files of the source.

    The rule is stated as an ordered pass: a record meets an earlier one of the same
    message and request, or of the same message if either is a side chain; the better of
    the two stays (main chain, then larger total, then known speed, then first seen).
    Since a side chain meets every record of its message, at most one can be open at a
    time, the first main record replaces it, and no later side chain survives a main
    record. The outcome is therefore independent of order but for the final tie:

    * main records: the best per (message, request);
    * side chains: the best per message, if the message has no main record.

    Records without a message id are all kept.
    """
    keyed = records.where(F.col("message_id").isNotNull())
    side = F.coalesce("is_sidechain", F.lit(False))
    total = (
        F.col("input_tokens")
        + F.col("output_tokens")
        + F.col("cache_creation_tokens")
        + F.col("cache_read_tokens")
    )
    size = F.when(F.col("total_tokens") > 0, F.col("total_tokens")).otherwise(total)
    rank = F.struct(
        (-size).alias("size"),
        F.when(F.col("usage_speed").isNotNull(), 0).otherwise(1).alias("speed"),
        F.col("order_key"),
    )
    best = F.min_by(_row(records), rank).alias("r")
    request = F.coalesce("request_id", F.lit("")).alias("_request")
    main = keyed.where(~side).groupBy("message_id", request).agg(best)
    lone = (
        keyed.where(side)
        .groupBy("message_id")
        .agg(best)
        .join(main.select("message_id").distinct(), "message_id", "left_anti")
    )
    return (
        main.select("r.*")
        .unionByName(lone.select("r.*"))
        .unionByName(records.where(F.col("message_id").isNull()))
    )


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Per file and key the candidate of highest priority, then score, then first.

    Candidates without a key are all kept.
    """
    fields = [c for c in candidates.columns if c not in ("key", "priority", "score")]
    record = F.struct(*[F.col(c) for c in fields])
    rank = F.struct(
        (-F.col("priority")).alias("priority"), (-F.col("score")).alias("score"), F.col("order_key")
    )
    keyed = (
        candidates.where(F.col("key").isNotNull())
        .groupBy(F.col("source_file").alias("_file"), F.col("key").alias("_key"))
        .agg(F.min_by(record, rank).alias("r"))
        .select("r.*")
    )
    return keyed.unionByName(candidates.where(F.col("key").isNull()).select(*fields))


def first_occurrences(events: DataFrame, key: str = "event_id") -> DataFrame:
    """D3: the first row per key in arrival order."""
    return (
        events.groupBy(F.col(key).alias("_key"))
        .agg(F.min_by(_row(events), "order_key").alias("r"))
        .select("r.*")
    )

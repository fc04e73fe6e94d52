"""The closed forms against the ordered passes they replace."""

import random

from meterbook.operators.dedupe import best_candidates, deduplicate_messages
from pyspark.sql import functions as F

SCHEMA = (
    "n bigint, message_id string, request_id string, is_sidechain boolean, input_tokens bigint, "
    "output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, "
    "total_tokens bigint, usage_speed string"
)


def ordered_pass(rows):
    """Each record meets a kept one of its message and request, or of its message if either
    is a side chain; main beats side, then size, then speed, then the earlier."""
    kept = []
    for row in rows:
        n, msg, req, side, size, *_, speed = row
        if msg is None:
            kept.append(row)
            continue
        same = [i for i, k in enumerate(kept) if k[1] == msg]
        hit = next((i for i in same if (kept[i][2] or "") == (req or "")), None)
        if hit is None:
            hit = next((i for i in same if side or kept[i][3]), None)
        if hit is None:
            kept.append(row)
            continue
        old = kept[hit]
        rank = lambda r: (not r[3], r[4], r[-1] is not None)
        if rank(row) > rank(old):
            kept[hit] = row
    return sorted(r[0] for r in kept)


def test_messages_match_the_ordered_pass(spark):
    rng = random.Random(11)
    for _ in range(4):
        rows = [
            (
                n,
                rng.choice([None, "a", "a", "b", "c", "d", "e"]),
                rng.choice([None, "r", "s", "t"]),
                rng.random() < 0.5,
                rng.randrange(3),
                0,
                0,
                0,
                0,
                rng.choice([None, "fast"]),
            )
            for n in range(60)
        ]
        df = spark.createDataFrame(rows, SCHEMA).withColumn(
            "order_key", F.struct(F.col("n").alias("line"))
        )
        got = sorted(r.n for r in deduplicate_messages(df).select("n").collect())
        assert got == ordered_pass(rows)


def test_candidates_keep_best_then_first(spark):
    rows = [
        (1, "f", "k", 3, 10),
        (2, "f", "k", 4, 5),
        (3, "f", "k", 4, 5),
        (4, "f", None, 0, 0),
        (5, "f", None, 0, 0),
        (6, "g", "k", 1, 1),
    ]
    df = spark.createDataFrame(
        rows, "n bigint, source_file string, key string, priority int, score bigint"
    ).withColumn("order_key", F.struct(F.col("n").alias("line")))
    assert sorted(r.n for r in best_candidates(df).collect()) == [2, 4, 5, 6]

"""Carried values against plain Python, with blocks far smaller than the groups."""

import random

from meterbook.operators.carry import Carry, carry
from pyspark.sql import functions as F


def test_blocks_give_the_same_as_one_pass(spark):
    rng = random.Random(5)
    rows = []
    # One file holds most rows, so it spans many blocks.
    for file, n in (("a", 97), ("b", 5), ("c", 1)):
        for line in range(1, n + 1):
            value = rng.randrange(100) if rng.random() < 0.3 else None
            rows.append((file, rng.choice("xy"), line, value))
    df = spark.createDataFrame(rows, "file string, session string, line bigint, v bigint")
    out = carry(
        df,
        [
            Carry("last_file", F.col("v"), ("file",)),
            Carry("last_session", F.col("v"), ("file", "session")),
            Carry("total", F.col("v"), ("file",), "sum"),
            Carry("high", F.col("v"), ("file",), "max", inclusive=True),
        ],
        order="line",
        block_rows=7,
    )
    got = {(r.file, r.line): (r.last_file, r.last_session, r.total, r.high) for r in out.collect()}
    want, last, total, high = {}, {}, {}, {}
    for file, session, line, v in rows:
        key = (file, session)
        if v is not None:
            high[file] = max(high.get(file, v), v)
        want[(file, line)] = (last.get(file), last.get(key), total.get(file, 0), high.get(file))
        if v is not None:
            last[file] = last[key] = v
            total[file] = total.get(file, 0) + v
    assert got == want


def test_struct_values_and_rows_are_kept(spark):
    df = spark.createDataFrame([("f", i, "m" if i == 2 else None) for i in range(1, 9)], "f string, n bigint, m string")
    value = F.when(F.col("m").isNotNull(), F.struct("m", "n"))
    out = carry(df, [Carry("seen", value, ("f",))], order="n", block_rows=2).orderBy("n").collect()
    assert [r.seen and (r.seen.m, r.seen.n) for r in out] == [None, None] + [("m", 2)] * 6

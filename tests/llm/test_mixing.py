import math
import random
from fractions import Fraction

import numpy as np
import pytest

from meterbook.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, size string, copies string, k string"


def test_targets():
    assert mixing.targets([100, 100, 100]) == [Fraction(200), Fraction(250, 3), Fraction(500, 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    for seed in range(20):
        sizes = [random.Random(seed).choice([0, 1, 10, 1000]) for _ in range(9)]
        got = mixing.targets(sizes)
        assert sum(got) == Fraction(3, 2) * sum(sizes) and all(t <= 2 * s for t, s in zip(got, sizes))


def rows(n=3000):
    rng = random.Random(3)
    out = []
    for i in range(n):
        source = rng.choice(["b", "b", "b", "b", "a", "é", "z", None])
        words = rng.choice([0, 1, 3, 20, 60, 200, rng.randrange(2000) if i % 40 == 0 else 7])
        out.append((i, source, "w x \t" * words if words else rng.choice([None, "", " \n"]), "x", "y", "z"))
    return out + [(5, *out[5][1:])] * 3 + [(None, None, "q " * 30, None, None, None)] * 2


def brute_rates(sizes, target):
    """Bisection on the same tilt, in plain numpy."""
    sizes = np.array(sizes, float)
    unit = max(sizes.sum() / len(sizes), 1.0)
    if target >= 2 * sizes.sum():
        return np.full(len(sizes), 2.0)
    low, high = -2000.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        rate = np.exp(np.minimum(mid * sizes / unit, math.log(2)))
        low, high = (mid, high) if (rate * sizes).sum() < target else (low, mid)
    return np.exp(np.minimum(low * sizes / unit, math.log(2)))


@pytest.mark.parametrize("bucket_rows", [4_000, 100])
def test_rates_copies_and_reruns(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mixed(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(df.repartition(5)).collect()), key=repr)
    assert len(got) == len(data)
    names = ["a", "b", "z", "é", None]
    size = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    by = {s: [size(r[2]) for r in data if r[1] == s] for s in names}
    goals = dict(zip(names, mixing.targets([sum(by[s]) for s in names])))
    for s in names:
        mine = [r for r in got if r.source == s]
        assert sorted(r.size for r in mine) == sorted(by[s])
        assert {r.target for r in mine} == {float(goals[s])} and {r.source_size for r in mine} == {sum(by[s])}
        want = dict(zip(by[s], brute_rates(by[s], float(goals[s]))))
        for r in mine:
            assert abs(r.rate - want[r.size]) < 1e-3 or r.size == 0
            assert r.copies in (math.floor(r.rate), math.ceil(r.rate)) and r.taken == r.copies * r.size <= 2 * r.size
        assert abs(sum(r.taken for r in mine) - goals[s]) <= 0.01 * goals[s] + 10


def test_the_mix_keeps_columns_and_repeated_rows(spark):
    data = rows(400)
    df = spark.createDataFrame(data, SCHEMA.replace("copies", "row"))
    plan = mixing.mixed(df).collect()
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "copies"]
    taken = sorted(((r.doc_id, r.copies) for r in got.collect()), key=repr)
    assert taken == sorted(((r.doc_id, r.copies) for r in plan if r.copies), key=repr)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, "a", "")], "doc_id bigint, source string, text string")
    assert mixing.mixed(df).first().taken == 0
    assert mixing.mixed(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []


def test_a_column_called_copies_is_replaced(spark):
    data = [(i, "a", "word " * 5, "s", "old", "k") for i in range(20)]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA))
    assert got.columns.count("copies") == 1 and {r.copies for r in got.collect()} <= {1, 2}


def test_roots_are_found_when_newton_steps_do_not_help():
    """A derivative far too large moves the value by next to nothing; halving still ends."""
    root = mixing._Root(size=1000, docs=10, target=Fraction(777), cap=2)
    words = lambda x: min(1000 * math.exp(x), 2000.0)
    for n in range(400):
        if root.done:
            break
        root.step(words(root.value), 1e18, halve=n >= 60)
    assert root.done and n < 200 and abs(words(root.value) - 777) <= 0.25

"""Page bounds, sort order, shares and the session listing."""

import random

import pytest
from meterbook.operators import metrics as M
from meterbook.operators.normalize import cleaned
from meterbook.operators.pricing import Costing
from meterbook.plans.report import report
from pyspark.sql import functions as F
from testviews import view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit, offset", [(-1, 0), (501, 0), (5000, 0), (10, -1)])
def test_page_sizes_out_of_bounds_are_refused(limit, offset):
    with pytest.raises(ValueError):
        M.page_bounds(limit, offset, M.SESSION_PAGE)


def test_usual_page_sizes():
    assert M.page_bounds(0, 0, M.EVENT_PAGE) == (200, 0)
    assert M.page_bounds(1000, 7, M.EVENT_PAGE) == (1000, 7)


def test_digits_in_strings_sort_by_value(spark):
    names = ["m10", "m2", "m9", "m", "", "m02", "a1b20", "a1b3", "12", "7", None, "m2"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, n int")
    up = [(r.name, r.n) for r in M.sorted_rows(rows, "name", False, 0).collect()]
    assert [n for n, _ in up] == ["", "7", "12", "a1b3", "a1b20", "m", "m02", "m2", "m2", "m9", "m10", None]
    assert [i for n, i in up if n == "m2"] == [1, 11]
    down = [r.name for r in M.sorted_rows(rows, "name", True, 4).collect()]
    assert down == ["m10", "m9", "m2", "m2"]


def test_shares_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(f"l{i}", rng.choice([0, 1, 1, 5, 900, rng.randrange(10_000)])) for i in range(300)]
    df = spark.createDataFrame(rows, "label string, total_tokens bigint")
    got = [tuple(r) for r in M.top_share(df, 7).collect()]
    best = sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[1], r[0]))
    whole = sum(v for _, v in best)
    want = [(k, v, v / whole) for k, v in best[:7]]
    rest = whole - sum(v for _, v in best[:7])
    assert got == [*want, ("others", rest, rest / whole)]
    assert M.top_share(df.limit(0)).collect() == []
    assert [r.label for r in M.top_share(spark.createDataFrame([("a", 3)], df.schema)).collect()] == ["a"]


def test_session_pages_follow_each_other(spark):
    events = cleaned(view(spark, SF, "ledger"))
    none = Costing(wanted=False)
    every = [r.session_key for r in M.session_list(events, costing=none).collect()]
    assert len(every) == M.sessions(events, costing=none).total.first().total > 30
    assert [r.session_key for r in report(events, "sessions", cost_mode="none").collect()] == every
    last = events.groupBy("session_key").agg(F.max("timestamp_ms").alias("t"))
    times = {r.session_key: r.t for r in last.collect()}
    seen, after = [], None
    while len(seen) < 30:
        page = [r.session_key for r in M.sessions(events, limit=10, costing=none, after=after).items.collect()]
        seen += page
        after = (times[page[-1]], page[-1])
    assert seen == every[:30]

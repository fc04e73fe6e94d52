"""Pages at any offset, and ledgers compared by digests, against plain Python and whole scans."""

import pytest
from meterbook.operators import metrics, normalize, quality, ranks
from meterbook.operators.filters import Filters
from meterbook.plans import pages
from meterbook.sources import digests, ledger, rollup
from meterbook.sources.profile import load_profile
from pyspark.sql import functions as F
from testviews import view

SF = "/root/testdata/sf0.001"


def test_every_page_equals_the_sorted_rows(spark, staging):
    """One hot millisecond, equal rows, keys that begin each other, an empty key, letters beyond ASCII."""
    rows = [(5_000, f"{i % 40:02d}") for i in range(80)] + [(5_000, k) for k in ("", "a", "ab", "abc", "ä", "𝄞", "z")]
    rows += [(86_400_000 * d + 977 * i, f"k{i}") for d in range(3) for i in range(20)] + [(-1, "early"), (4_999, "q")]
    df = staging.put(spark.createDataFrame(rows, "t bigint, k string").repartition(3), "rows")
    want = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
    for offset, limit in ((0, 1), (0, 7), (3, 70), (60, 30), (75, 60), (100, 1), (130, 50), (len(rows) - 1, 5)):
        got = [tuple(r) for r in ranks.page(df, offset, limit, "t", "k", most=3).collect()]
        assert got == want[offset : offset + limit], (offset, limit)
    assert ranks.page(df, len(rows), 5, "t", "k", most=3).collect() == []
    assert ranks.page(df.limit(0), 0, 5, "t", "k").collect() == []


def test_a_place_is_narrowed_down_to_few_rows(spark, staging):
    df = staging.put(spark.range(50_000).select(F.lit(7).cast("bigint").alias("t"), F.format_string("%05d", "id").alias("k")), "r")
    cell = ranks.seek(df, 31_234, "t", "k", most=10)
    assert (cell.prefix, cell.before, cell.rows) == ("3123", 31_230, 10)
    plan = ranks.between(df, cell, cell, 31_234, 3, "t", "k")
    assert [r.k for r in plan.collect()] == ["31234", "31235", "31236"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "ledger")
    ledger.write_ledger(normalize.cleaned(view(spark, SF, "ledger")), path)
    return path


def ids(page):
    return [r.event_id for r in page.items.collect()], page.total.first().total


def test_event_pages_of_a_ledger_with_and_without_sums(spark, stored):
    events = ledger.read_ledger(spark, stored)
    cases = [
        (Filters(), 100, 0),
        (Filters(channel="claude", timezone="Asia/Kolkata", since="2024-01-02"), 30, 25),
        (Filters(since="2024-01-01T00:07:00Z", until="2024-01-20T03:04:05Z"), 40, 11),
        (Filters(session=events.first().session_key), 20, 0),
        (Filters(channel="none"), 10, 0),
    ]
    want = [ids(metrics.event_page(events, f, limit, offset)) for f, limit, offset in cases]
    assert [ids(pages.event_page(spark, stored, f, limit, offset, most=5)) for f, limit, offset in cases[:2]] == want[:2]
    rollup.refresh(spark, stored)
    assert [ids(pages.event_page(spark, stored, f, limit, offset, most=5)) for f, limit, offset in cases] == want
    # A sort that keeps the rows ahead of this page would not end well.
    assert ids(pages.event_page(spark, stored, limit=10, offset=10**9)) == ([], events.count())
    with pytest.raises(ValueError):
        rollup.breakdown(rollup.rollup(spark, stored), "channel", Filters(since="2024-01-01T00:07:00Z"))
    with pytest.raises(ValueError):
        pages.event_page(spark, stored, limit=5000)


def test_a_deep_page_opens_its_dates_only(spark, stored):
    page = pages.event_page(spark, stored, limit=5, offset=300, most=20)
    dates = {r[0] for r in ledger.read_ledger(spark, stored).join(page.items.select("event_id"), "event_id")
             .select("event_date_utc").distinct().collect()}
    page.items.collect()
    plan = page.items._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date_utc" in plan and all(d in plan for d in (min(dates), max(dates)))


def test_session_pages(spark, stored):
    events = ledger.read_ledger(spark, stored)
    for filters, limit, offset in ((Filters(), 20, 0), (Filters(timezone="America/New_York"), 15, 37), (Filters(), 5, 10**4)):
        want = metrics.sessions(events, filters, limit, offset)
        got = pages.session_page(events, filters, limit, offset, most=4)
        assert [tuple(r) for r in got.items.collect()] == [tuple(r) for r in want.items.collect()]
        assert got.total.first() == want.total.first()


def test_equal_ledgers_are_told_by_digests_alone(spark, stored, tmp_path):
    """The copy was written in two versions and another order, and at another time."""
    events = ledger.read_ledger(spark, stored)
    other, half = f"{tmp_path}/other", F.xxhash64("event_id") % 2 == 0
    ledger.write_ledger(events.where(half).withColumn("imported_at_ms", F.lit(77).cast("bigint")), other)
    late = events.where(~half)
    ledger._commit(late, other, None, 1, None, late.select("event_id"))
    for path in (stored, other):
        digests.refresh(spark, path)
        assert digests.refresh(spark, path) == 0
    left, right = ledger.snapshot(spark, stored), ledger.snapshot(spark, other)
    assert digests.differing(left, right).count() == 0
    read = digests.nodes(left, digests.DATE).inputFiles() + digests.nodes(right, digests.RANGE, ["2024-01-02"]).inputFiles()
    assert read and all("/data/" not in f for f in read)
    assert digests.diff(left, right).count() == digests.changes(left, right).count() == 0


def test_every_kind_of_change_is_found(spark, stored, tmp_path):
    """A value that becomes null, one that moves to the next column, a row more, a row less, a date more."""
    events = ledger.read_ledger(spark, stored)
    some = [r.event_id for r in events.where("message_id IS NOT NULL").orderBy("event_id").limit(4).collect()]
    new = events.where(F.col("event_id") != some[0]).withColumns(
        {
            "message_id": F.when(~F.col("event_id").isin(some[1:3]), F.col("message_id")),
            "request_id": F.when(F.col("event_id") == some[2], F.col("message_id")).otherwise(F.col("request_id")),
            "input_tokens": F.col("input_tokens") + F.when(F.col("event_id") == some[3], 1).otherwise(0),
        }
    )
    more = events.where(F.col("event_id") == some[0]).withColumns(
        {"event_id": F.lit("new"), "timestamp_ms": F.lit(946_684_800_000).cast("bigint")}
    )
    other = f"{tmp_path}/other"
    ledger.write_ledger(new.unionByName(more), other)
    sides = ledger.snapshot(spark, other), ledger.snapshot(spark, stored)
    want = {(some[0], "removed"), ("new", "added"), *((i, "changed") for i in some[1:])}
    assert {(r.event_id, r.change) for r in digests.changes(*sides).collect()} == want
    assert digests.differing(*sides).count() <= 5
    whole = quality.ledger_diff(ledger.read_ledger(spark, other), events, load_profile()).collect()
    assert digests.diff(*sides, load_profile()).collect() == whole
    empty = ledger.snapshot(spark, f"{tmp_path}/none")
    assert {r.change for r in digests.changes(empty, sides[0]).collect()} == {"removed"}
    assert digests.changes(empty, empty).count() == 0

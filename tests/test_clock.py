from datetime import datetime, timezone

import pytest
from meterbook.functions import clock
from pyspark.sql import functions as F

UTC = timezone.utc


def ms(*args):
    return int(datetime(*args, tzinfo=UTC).timestamp() * 1000)


def test_bounds_follow_the_zone_and_its_rules():
    assert clock.since_millis("2024-03-10", "America/New_York") == ms(2024, 3, 10, 5)
    assert clock.until_millis("2024-03-10", "America/New_York") == ms(2024, 3, 11, 4)
    assert clock.since_millis("2024-03-10T12:00:00+02:00", "UTC") == ms(2024, 3, 10, 10)
    assert clock.until_millis("2024-03-10T10:00:00.123456789Z", "UTC") == ms(2024, 3, 10, 10) + 124


def test_midnight_inside_a_gap_is_the_first_instant_of_the_day():
    # Clocks in this zone jumped from 24:00 to 01:00.
    assert clock.since_millis("2018-11-04", "America/Sao_Paulo") == ms(2018, 11, 4, 3)


@pytest.mark.parametrize("value", ["2024-13-01", "yesterday", "2024-01-01T00:00:00", "2024-1-1"])
def test_bad_dates_are_refused(value):
    with pytest.raises(ValueError):
        clock.check_date("since", value)


def test_bad_zone_is_refused():
    with pytest.raises(ValueError):
        clock.resolve_zone("Mars/Olympus")


def test_presets():
    now = datetime(2024, 3, 1, 3, 30, tzinfo=UTC)
    tz = "America/New_York"
    pick = lambda name: tuple(vars(clock.preset_range(name, now, tz)).values())
    assert pick("7d") == ("2024-02-23", "2024-02-29")
    assert pick("30d") == ("2024-01-31", "2024-02-29")
    assert pick("month") == ("2024-02-01", "2024-02-29")
    assert pick("last_month") == ("2024-01-01", "2024-01-31")
    assert pick("24h") == ("2024-02-29T03:30:00.000Z", "2024-03-01T03:30:00.000Z")
    assert pick("all") == ("", "")
    assert vars(clock.preset_range("custom", now, tz, "a", "b")) == {"since": "a", "until": "b"}


def test_epochs_and_rfc3339(spark):
    df = spark.createDataFrame(
        [
            (-5, "2024-01-02T03:04:05Z", 0, 1704164645000),
            (1704164645, "2024-01-02T03:04:05.123456789+01:00", 1704164645000, 1704161045123),
            (1704164645000, "2024-01-02 03:04:05Z", 1704164645000, None),
            (1704164645000999, "2024-02-30T03:04:05Z", 1704164645000, None),
        ],
        "n bigint, s string, want_n bigint, want_s bigint",
    )
    rows = df.select(
        "want_n",
        "want_s",
        clock.epoch_to_millis(F.col("n")).alias("n"),
        clock.rfc3339_to_millis(F.col("s")).alias("s"),
    ).collect()
    assert [(r.n, r.s) for r in rows] == [(r.want_n, r.want_s) for r in rows]


def test_buckets_use_the_offset_of_the_instant(spark):
    df = spark.createDataFrame([(ms(2024, 3, 10, 4, 59),), (ms(2024, 11, 4, 4, 59),)], "t bigint")
    b = lambda k: clock.time_bucket(F.col("t"), "America/New_York", k)
    rows = df.select(b("daily").alias("d"), b("weekly").alias("w"), b("monthly").alias("m")).collect()
    assert [tuple(r) for r in rows] == [
        ("2024-03-09", "2024-03-04", "2024-03"),
        ("2024-11-03", "2024-10-28", "2024-11"),
    ]

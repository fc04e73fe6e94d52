"""Timestamps, calendar buckets and date bounds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"

# A number below the first bound is seconds, below the second milliseconds.
SECONDS_BOUND = 4_102_444_800
MILLIS_BOUND = 4_102_444_800_000

BUCKETS = ("daily", "weekly", "monthly")


def whole_div(n: Column, by: int) -> Column:
    """Exact integer quotient of two non-negative longs."""
    return F.call_function("div", n, F.lit(by))


def epoch_to_millis(n: Column) -> Column:
    """Seconds, milliseconds or microseconds by magnitude; negative is invalid (0)."""
    return (
        F.when(n < 0, F.lit(0))
        .when(n < SECONDS_BOUND, n * 1000)
        .when(n < MILLIS_BOUND, n)
        .otherwise(whole_div(n, 1000))
    )


def rfc3339_to_millis(s: Column) -> Column:
    instant = F.replace(s, F.lit(","), F.lit(".")).try_cast("timestamp")
    return F.when(s.rlike(RFC3339), F.unix_millis(instant))


def time_bucket(ms: Column, tz: str, bucket: str) -> Column:
    """Calendar label of an instant, with the zone offset valid at that instant."""
    local = F.from_utc_timestamp(F.timestamp_millis(ms), resolve_zone(tz))
    if bucket == "daily":
        return F.date_format(local, "yyyy-MM-dd")
    if bucket == "weekly":
        return F.date_format(F.date_trunc("week", local), "yyyy-MM-dd")
    if bucket == "monthly":
        return F.date_format(local, "yyyy-MM")
    raise ValueError(f"unsupported bucket {bucket!r}")


def utc_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def utc_day_of(ms: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=ms // 86_400_000)).isoformat()


def resolve_zone(tz: str | None) -> str:
    """IANA name of a report zone; blank and ``Local`` mean the driver's own zone."""
    name = (tz or "").strip()
    if name in ("", "Local"):
        try:
            with open("/etc/timezone", encoding="utf-8") as handle:
                name = handle.read().strip() or "UTC"
        except OSError:
            name = "UTC"
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as err:
        raise ValueError(f"invalid timezone {tz!r}") from err
    return name


def _parse_instant(value: str) -> int | None:
    if not re.match(RFC3339, value):
        return None
    try:
        text = value.replace(",", ".").replace("Z", "+00:00")
        text = re.sub(r"(\.\d{6})\d+", r"\1", text)
        delta = datetime.fromisoformat(text) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    except ValueError:
        return None
    return delta // timedelta(milliseconds=1)


def _parse_day(value: str) -> date | None:
    if not re.match(r"^\d{4}-\d{2}-\d{2}$", value):
        return None
    try:
        return date.fromisoformat(value)
    except ValueError:
        return None


def check_date(name: str, value: str | None) -> None:
    if value and _parse_day(value) is None and _parse_instant(value) is None:
        raise ValueError(f"invalid {name} value {value!r}")


def _day_start_millis(day: date, tz: str) -> int:
    """First instant of a local day; a midnight inside a gap resolves to the gap's end."""
    zone = ZoneInfo(resolve_zone(tz))
    start = datetime(day.year, day.month, day.day, tzinfo=zone).astimezone(timezone.utc)
    if start.astimezone(zone).date() < day:
        start += timedelta(hours=1)
    return int(start.timestamp() * 1000)


def since_millis(value: str, tz: str) -> int:
    instant = _parse_instant(value)
    return instant if instant is not None else _day_start_millis(_parse_day(value), tz)


def until_millis(value: str, tz: str) -> int:
    """Exclusive upper bound: next local midnight, or one millisecond after an instant."""
    instant = _parse_instant(value)
    if instant is not None:
        return instant + 1
    return _day_start_millis(_parse_day(value) + timedelta(days=1), tz)


@dataclass(frozen=True)
class DateRange:
    since: str = ""
    until: str = ""


def preset_range(
    preset: str, now: datetime, tz: str, custom_since: str = "", custom_until: str = ""
) -> DateRange:
    """Named report ranges, counted in local days of the report zone."""
    today = now.astimezone(ZoneInfo(resolve_zone(tz))).date()
    if preset == "24h":
        stamps = [
            (now.astimezone(timezone.utc) - timedelta(hours=h)).isoformat(timespec="milliseconds")
            for h in (24, 0)
        ]
        return DateRange(*[s.replace("+00:00", "Z") for s in stamps])
    if preset in ("7d", "30d"):
        back = 6 if preset == "7d" else 29
        return DateRange((today - timedelta(days=back)).isoformat(), today.isoformat())
    if preset == "month":
        return DateRange(today.replace(day=1).isoformat(), today.isoformat())
    if preset == "last_month":
        last = today.replace(day=1) - timedelta(days=1)
        return DateRange(last.replace(day=1).isoformat(), last.isoformat())
    if preset == "custom":
        return DateRange(custom_since, custom_until)
    return DateRange()

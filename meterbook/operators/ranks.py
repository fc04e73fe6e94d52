"""Rows at given places of an order, found by counting.

Rows are ordered newest first, then by key. The place of a page is looked for from wide time ranges
to narrow ones, and below a single millisecond by the next character of the key: each step counts
the parts of one range and goes on in the part that holds the place. A step sees only the rows of
its range and brings back one number per part, so neither a task nor the driver ever holds the rows
ahead of a page; what is sorted at last is the page and at most ``MOST`` rows on either side.

Defined cases: a place behind the last row gives no rows; rows with the same time and key are equal
in the order, and any of them fill their places.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions import clock

#: Ranges with at most so many rows are not divided further.
MOST = 10_000
#: Each divides the one before it into at most 1,440 parts; days are as many as the calendar has.
DAY_MS = 86_400_000
WIDTHS = (DAY_MS, 900_000, 60_000, 1_000, 1)


@dataclass(frozen=True)
class Cell:
    """Consecutive rows of the order: a time range, or one time and the keys with a prefix."""

    width: int | None = None  # None: all rows
    first_ms: int = 0
    prefix: str = ""
    exact: bool = False  # the prefix is the whole key
    before: int = 0  # rows ahead of it
    rows: int | None = None


def _key_in(cell: Cell, key: str) -> Column:
    return F.col(key) == cell.prefix if cell.exact else F.col(key).startswith(cell.prefix)


def inside(rows: DataFrame, cell: Cell, time: str, key: str | None) -> DataFrame:
    if cell.width is None:
        return rows
    rows = _dated(rows, cell.first_ms, cell.first_ms + cell.width - 1)
    rows = rows.where((F.col(time) >= cell.first_ms) & (F.col(time) < cell.first_ms + cell.width))
    return rows.where(_key_in(cell, key)) if cell.prefix or cell.exact else rows


def _dated(rows: DataFrame, first_ms: int, last_ms: int) -> DataFrame:
    """Partitions that can hold the times, where the table has any."""
    if "event_date_utc" not in rows.columns:
        return rows
    return rows.where(F.col("event_date_utc").between(clock.utc_day_of(first_ms), clock.utc_day_of(last_ms)))


def _counts(rows: DataFrame, part: Column, weight: Column) -> list[tuple]:
    found = rows.groupBy(part.alias("part")).agg(F.sum(weight).cast("bigint").alias("n"))
    return [(r.part, r.n) for r in found.collect()]


def _holding(cell: Cell, parts: list[tuple], place: int) -> tuple:
    """Of parts in order, the one with the place: its value, the rows ahead of it and its rows."""
    before = cell.before
    for value, n in parts:
        if place < before + n:
            return value, before, n
        before += n
    raise IndexError(place)


def seek(
    rows: DataFrame,
    place: int,
    time: str,
    key: str | None,
    cell: Cell = Cell(),
    widths: tuple[int, ...] = WIDTHS,
    weight: str | None = None,
    most: int = MOST,
) -> Cell | None:
    """The range of the row at ``place`` (from 0), or None if there are not so many rows.

    ``weight`` names a column with the number of rows that a row stands for; such sums have no keys.
    """
    each = F.lit(1) if weight is None else F.col(weight)
    for width in widths:
        if cell.rows is not None and cell.rows <= most:
            return cell
        if cell.width is not None and cell.width <= width:
            continue
        start = F.col(time) - F.pmod(F.col(time), F.lit(width))
        parts = sorted(_counts(inside(rows, cell, time, key), start, each), reverse=True)
        if cell.rows is None and place >= sum(n for _, n in parts):
            return None
        first, before, n = _holding(cell, parts, place)
        cell = replace(cell, width=width, first_ms=first, before=before, rows=n)
    while key is not None and cell.rows > most and not cell.exact:
        letter = F.substring(F.col(key), len(cell.prefix) + 1, 1)
        parts = sorted(_counts(inside(rows, cell, time, key), letter, each))
        value, before, n = _holding(cell, parts, place)
        cell = replace(cell, prefix=cell.prefix + value, exact=value == "", before=before, rows=n)
    return cell


def _from(cell: Cell, time: str, key: str) -> Column:
    if cell.prefix or cell.exact:
        return (F.col(time) < cell.first_ms) | ((F.col(time) == cell.first_ms) & (F.col(key) >= cell.prefix))
    return F.col(time) < cell.first_ms + cell.width


def _until(cell: Cell, time: str, key: str) -> Column:
    if cell.prefix or cell.exact:
        in_key = (F.col(key) < cell.prefix) | _key_in(cell, key)
        return (F.col(time) > cell.first_ms) | ((F.col(time) == cell.first_ms) & in_key)
    return F.col(time) >= cell.first_ms


def between(
    rows: DataFrame, first: Cell, last: Cell, offset: int, limit: int, time: str, key: str
) -> DataFrame:
    """The rows at ``offset`` and after it, which begin in ``first`` and end in ``last``."""
    rows = _dated(rows, last.first_ms, first.first_ms + first.width - 1)
    rows = rows.where(_from(first, time, key) & _until(last, time, key))
    return rows.orderBy(F.desc(time), key).offset(offset - first.before).limit(limit)


def page(rows: DataFrame, offset: int, limit: int, time: str, key: str, most: int = MOST) -> DataFrame:
    """``limit`` rows from ``offset`` on. Every step reads ``rows``, so a costly one should be stored."""
    first = seek(rows, offset, time, key, most=most)
    if first is None:
        return rows.limit(0)
    end = offset + limit - 1
    last = first if end < first.before + first.rows else seek(rows, end, time, key, most=most)
    return between(rows, first, last or _oldest(rows, time), offset, limit, time, key)


def _oldest(rows: DataFrame, time: str) -> Cell:
    """The millisecond of the last row, where a page is the last one."""
    return Cell(width=1, first_ms=rows.agg(F.min(time)).first()[0])

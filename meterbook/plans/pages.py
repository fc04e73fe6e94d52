"""A9, A10 of a stored ledger: pages at any offset, without the rows ahead of them.

Events are found through the sums kept beside the ledger (``sources/rollup.py``): days, then
quarters of an hour, are counted there, and only the quarter that holds the page is opened. For a
selection that the sums cannot tell (a session, a bound within a quarter) the events are counted.
Sessions are first reduced to their time, which is stored; only those of the page are priced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.operators import metrics, ranks
from meterbook.operators.filters import Filters, apply_filters
from meterbook.operators.pricing import Costing
from meterbook.session import Staging
from meterbook.sources import ledger, rollup

_TIME = "timestamp_ms"


def event_page(
    spark: SparkSession,
    path: str,
    filters: Filters = Filters(),
    limit: int = 0,
    offset: int = 0,
    most: int = ranks.MOST,
) -> metrics.Page:
    """A10: newest events first, as ``metrics.event_page`` gives them for the whole table."""
    limit, offset = metrics.page_bounds(limit, offset, metrics.EVENT_PAGE)
    now = ledger.snapshot(spark, path)
    rows = apply_filters(now.rows(), filters).select(*metrics.EVENT_LIST, ledger.PARTITION)
    if not rollup.answers(filters):
        total = rows.agg(F.count(F.lit(1)).alias("total"))
        items = ranks.page(rows, offset, limit, _TIME, "event_id", most)
        return metrics.Page(items.select(*metrics.EVENT_LIST), total, limit, offset)
    sums = apply_filters(rollup.rollup(spark, path, now), filters)
    total = sums.agg(F.coalesce(F.sum("events"), F.lit(0)).cast("bigint").alias("total"))
    n = total.first().total
    items = rows.limit(0)
    if offset < n:
        first = _seek(sums, rows, offset, most)
        end = min(offset + limit, n) - 1
        last = first if end < first.before + first.rows else _seek(sums, rows, end, most)
        items = ranks.between(rows, first, last, offset, limit, _TIME, "event_id")
    return metrics.Page(items.select(*metrics.EVENT_LIST), total, limit, offset)


def _seek(sums: DataFrame, rows: DataFrame, place: int, most: int) -> ranks.Cell:
    cell = ranks.seek(sums, place, _TIME, None, widths=(ranks.DAY_MS, rollup.SLOT_MS), weight="events", most=most)
    return ranks.seek(rows, place, _TIME, "event_id", cell, most=most)


def session_page(
    events: DataFrame,
    filters: Filters = Filters(),
    limit: int = 0,
    offset: int = 0,
    costing: Costing | None = None,
    staging: Staging | None = None,
    most: int = ranks.MOST,
) -> metrics.Page:
    """Newest sessions first, as ``metrics.sessions`` gives them."""
    costing = costing or Costing.load()
    limit, offset = metrics.page_bounds(limit, offset, metrics.SESSION_PAGE)
    staging = staging or Staging(events.sparkSession, "sessions")
    rows = apply_filters(events, filters)
    last = staging.put(rows.groupBy("session_key").agg(F.max(_TIME).alias("last_ms")), "last")
    listed = ranks.page(last, offset, limit, "last_ms", "session_key", most)
    keys = [r.session_key for r in listed.collect()]  # one page: 500 at most
    return metrics.Page(
        metrics.session_rows(rows.where(F.col("session_key").isin(keys)), filters, costing),
        last.agg(F.count(F.lit(1)).alias("total")),
        limit,
        offset,
    )

"""The reports. Usage and cost come from one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions.clock import BUCKETS, time_bucket
from meterbook.functions.text import none_if_empty
from meterbook.operators.filters import Filters, apply_filters, is_offered, label_of
from meterbook.operators.pricing import Costing

# Fixed values: (default, highest) page sizes of the listings.
SESSION_PAGE = (50, 500)
EVENT_PAGE = (200, 1000)
RUN_PAGE = (20, 200)
_TOP_SLOTS = 64

DIMENSIONS = ("channel", "source_product", "provider", "model", "session", "project")

EVENT_LIST = (
    "event_id",
    "identity_strategy",
    "identity_scope",
    "event_granularity",
    "channel",
    "source_product",
    "provider",
    "model_raw",
    "model_normalized",
    "model_resolution",
    "model_is_fallback",
    "timestamp_ms",
    "session_key",
    *S.TOKEN_COLUMNS,
    "accounting_profile",
    "observability_level",
)


def page_bounds(limit: int, offset: int, page: tuple[int, int]) -> tuple[int, int]:
    """0 stands for the usual page size; other sizes and offsets must be within bounds."""
    default, highest = page
    if not 0 <= limit <= highest:
        raise ValueError(f"limit must be between 1 and {highest}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return limit or default, offset


def _token_sums() -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [F.coalesce(F.sum(t), zero).alias(t) for t in S.TOKEN_COLUMNS]


@dataclass
class Page:
    """One page and, as a separate one-row frame, the number of rows over all pages."""

    items: DataFrame
    total: DataFrame
    limit: int
    offset: int


def summary(
    events: DataFrame, runs: DataFrame, filters: Filters = Filters(), costing: Costing | None = None
) -> DataFrame:
    """A1: one row over the selection; the run count ignores the filters."""
    costing = costing or Costing.load()
    rows = costing.prepare(apply_filters(events, filters))
    ts = F.col("timestamp_ms")
    out = rows.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("session_key").alias("total_sessions"),
        *_token_sums(),
        F.min(ts).alias("first_ms"),
        F.max(ts).alias("last_ms"),
        *costing.aggregates(),
    )
    run_count = runs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.select(
        "total_events",
        "total_sessions",
        run_count.alias("import_runs"),
        *S.TOKEN_COLUMNS,
        time_bucket(F.col("first_ms"), filters.timezone, "daily").alias("first_date"),
        time_bucket(F.col("last_ms"), filters.timezone, "daily").alias("last_date"),
        *costing.columns(),
    )


def _by_label(rows: DataFrame, label: Column, costing: Costing) -> DataFrame:
    grouped = (
        costing.prepare(rows)
        .groupBy(label.alias("label"))
        .agg(F.count(F.lit(1)).alias("events"), *_token_sums(), *costing.aggregates())
    )
    return grouped.select("label", "events", *S.TOKEN_COLUMNS, *costing.columns()).orderBy("label")


def timeseries(
    events: DataFrame,
    bucket: str,
    filters: Filters = Filters(),
    costing: Costing | None = None,
) -> DataFrame:
    """A2: daily, weekly or monthly rows in the report zone; empty buckets are absent."""
    if bucket not in BUCKETS:
        raise ValueError(f"unsupported bucket {bucket!r}")
    label = time_bucket(F.col("timestamp_ms"), filters.timezone, bucket)
    return _by_label(apply_filters(events, filters), label, costing or Costing.load())


def dimension_label(df: DataFrame, by: str) -> Column:
    """A3-A8."""
    if by == "channel":
        return F.col("channel")
    if by in ("source", "source_product"):
        return F.col("source_product")
    if by == "provider":
        return F.coalesce(none_if_empty(F.col("provider")), F.lit("unknown"))
    if by == "model":
        return F.col("model_normalized")
    if by == "session":
        return F.col("session_key")
    if by == "project":
        return label_of(df)
    raise ValueError(f"unsupported breakdown dimension {by!r}")


def breakdown(
    events: DataFrame, by: str, filters: Filters = Filters(), costing: Costing | None = None
) -> DataFrame:
    rows = apply_filters(events, filters)
    return _by_label(rows, dimension_label(rows, by), costing or Costing.load())


def session_rollup(events: DataFrame, costing: Costing) -> DataFrame:
    """A9 without paging.

    First per (session, model, channel, product, id), with sums only, then per session:
    the second step sees few rows per session, however many events a session has.
    """
    ts = F.col("timestamp_ms")
    fine = (
        costing.prepare(events)
        .groupBy(
            "session_key",
            "model_normalized",
            "channel",
            "source_product",
            F.coalesce("session_id", F.lit("")).alias("session_id"),
        )
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            *_token_sums(),
            F.min(ts).alias("first_ms"),
            F.max(ts).alias("last_ms"),
            *costing.aggregates(),
        )
    )
    per_model = fine.groupBy("session_key", "model_normalized").agg(
        F.min("session_id").alias("session_id"),
        F.min("channel").alias("channel"),
        F.min("source_product").alias("source_product"),
        F.sum("event_count").alias("event_count"),
        *[F.sum(t).alias(t) for t in S.TOKEN_COLUMNS],
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        *costing.combine(),
    )
    return per_model.groupBy("session_key").agg(
        # An event without session id leaves the whole session without one.
        none_if_empty(F.min("session_id")).alias("session_id"),
        F.min("channel").alias("channel"),
        F.min("source_product").alias("source_product"),
        F.sum("event_count").alias("event_count"),
        F.min_by("model_normalized", F.struct(-F.col("total_tokens"), "model_normalized")).alias(
            "primary_model"
        ),
        F.count(F.lit(1)).alias("model_count"),
        *[F.sum(t).alias(t) for t in S.TOKEN_COLUMNS],
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        *costing.combine(),
    )


def session_list(events: DataFrame, filters: Filters = Filters(), costing: Costing | None = None) -> DataFrame:
    """Every session, newest first; sorted in ranges, so no task sees them all."""
    return session_rows(apply_filters(events, filters), filters, costing or Costing.load())


def session_rows(rows: DataFrame, filters: Filters, costing: Costing) -> DataFrame:
    """Every session of rows that are filtered already, newest first."""
    return _session_columns(_newest(session_rollup(rows, costing)), filters, costing)


def _newest(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.desc("last_ms"), "session_key")


def _session_columns(rollup: DataFrame, filters: Filters, costing: Costing) -> DataFrame:
    return rollup.select(
        "session_key",
        "session_id",
        "channel",
        "source_product",
        time_bucket(F.col("first_ms"), filters.timezone, "daily").alias("first_date"),
        time_bucket(F.col("last_ms"), filters.timezone, "daily").alias("last_date"),
        "event_count",
        "primary_model",
        "model_count",
        *S.TOKEN_COLUMNS,
        *costing.columns(),
    )


def sessions(
    events: DataFrame,
    filters: Filters = Filters(),
    limit: int = 0,
    offset: int = 0,
    costing: Costing | None = None,
    after: tuple[int, str] | None = None,
) -> Page:
    """A page of sessions, newest first. ``after`` (last event time, key of the last session
    seen) reads the next page without keeping the pages before it, where an offset would."""
    costing = costing or Costing.load()
    limit, offset = page_bounds(limit, offset, SESSION_PAGE)
    rows = apply_filters(events, filters)
    rollup = session_rollup(rows, costing)
    if after is not None:
        ts, key = after
        same_time = (F.col("last_ms") == ts) & (F.col("session_key") > key)
        rollup = rollup.where((F.col("last_ms") < ts) | same_time)
    listed = _newest(rollup).offset(offset).limit(limit)
    total = rows.agg(F.count_distinct("session_key").alias("total"))
    return Page(_session_columns(listed, filters, costing), total, limit, offset)


def primary_models(events: DataFrame) -> DataFrame:
    """The model with most tokens per session, ties by name."""
    totals = events.groupBy("session_key", "model_normalized").agg(
        F.sum("total_tokens").alias("model_tokens")
    )
    order = Window.partitionBy("session_key").orderBy(F.desc("model_tokens"), "model_normalized")
    return (
        totals.withColumn("model_rank", F.row_number().over(order))
        .where(F.col("model_rank") == 1)
        .drop("model_rank")
    )


def event_page(
    events: DataFrame,
    filters: Filters = Filters(),
    limit: int = 0,
    offset: int = 0,
    after: tuple[int, str] | None = None,
) -> Page:
    """A10: newest events first. ``after`` (time, id of the last row seen) reads the next
    page without sorting the pages before it, where an offset would."""
    limit, offset = page_bounds(limit, offset, EVENT_PAGE)
    rows = apply_filters(events, filters)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    if after is not None:
        ts, event_id = after
        same_time = (F.col("timestamp_ms") == ts) & (F.col("event_id") > event_id)
        rows = rows.where((F.col("timestamp_ms") < ts) | same_time)
    listed = (
        rows.select(*EVENT_LIST)
        .orderBy(F.desc("timestamp_ms"), "event_id")
        .offset(offset)
        .limit(limit)
    )
    return Page(listed, total, limit, offset)


def run_page(runs: DataFrame, limit: int = 0) -> DataFrame:
    """A11."""
    limit, _ = page_bounds(limit, 0, RUN_PAGE)
    return runs.orderBy(F.desc("started_at_ms"), "id").limit(limit)


def filter_options(events: DataFrame) -> DataFrame:
    """``(dimension, value)`` for the six filter lists, sorted.

    Rows rather than arrays, because the list of sessions grows with the table.
    """
    values = {
        "channels": F.col("channel"),
        "source_products": F.col("source_product"),
        "providers": F.col("provider"),
        "models": F.col("model_normalized"),
        "sessions": F.col("session_key"),
        "projects": label_of(events),
    }
    # Distinct combinations first: far fewer rows than events reach the six-fold explode.
    combos = events.select(*[v.alias(d) for d, v in values.items()]).distinct()
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in values]
    )
    return (
        combos.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(is_offered(F.col("value")))
        .distinct()
        .orderBy("dimension", "value")
    )


def stats(events: DataFrame, runs: DataFrame) -> DataFrame:
    """A13."""
    run_count = runs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("session_key").alias("total_sessions"),
        F.coalesce(F.sum("total_tokens"), F.lit(0).cast("bigint")).alias("total_tokens"),
    ).select(
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit(str(S.IDENTITY_VERSION)).alias("identity_version"),
        "total_events",
        "total_sessions",
        run_count.alias("total_import_runs"),
        "total_tokens",
    )


def cache_rate(rows: DataFrame) -> DataFrame:
    """Share of cached tokens on the input side, NULL without input."""
    side = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    rate = F.col("cache_read_tokens").cast("double") / F.nullif(side, F.lit(0)).cast("double")
    return rows.withColumn("cache_hit_rate", rate)


def top_share(rows: DataFrame, n: int = 5, others: str = "others") -> DataFrame:
    """The ``n`` largest labels, the rest as one row, and the share of each.

    Input is a report with one row per label; it is read once. A running top-k is kept per task
    as a grouped list of the ``n`` best, so one row of ``n`` labels and the sum decide the rest.
    """
    positive = rows.where(F.col("total_tokens") > 0).select("label", "total_tokens")
    slot = F.pmod(F.xxhash64("label"), F.lit(_TOP_SLOTS))
    best = Window.partitionBy("slot").orderBy(F.desc("total_tokens"), "label")
    # per slot: its n best labels and its sum; then one row holds them all
    slots = (
        positive.withColumn("slot", slot)
        .withColumn("place", F.row_number().over(best))
        .groupBy("slot")
        .agg(
            F.sum("total_tokens").alias("s"),
            F.collect_list(
                F.when(F.col("place") <= n, F.struct((-F.col("total_tokens")).alias("t"), "label"))
            ).alias("best"),
        )
    )
    whole = slots.agg(
        F.sum("s").alias("whole"),
        F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, n).alias("top"),
    ).where(F.col("whole").isNotNull())
    kept = F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a - x["t"])
    entry = lambda rest, label, tokens: F.struct(
        F.lit(rest).alias("is_rest"), label.alias("label"), tokens.cast("bigint").alias("total_tokens")
    )
    entries = F.concat(
        F.transform("top", lambda x: entry(0, x["label"], -x["t"])),
        F.array(entry(1, F.lit(others), F.col("whole") - kept)),
    )
    return (
        whole.select("whole", F.inline(entries))
        .where(F.col("total_tokens") > 0)
        .orderBy("is_rest", F.desc("total_tokens"), "label")
        .select("label", "total_tokens", (F.col("total_tokens").cast("double") / F.col("whole").cast("double")).alias("share"))
    )


def source_stats(events: DataFrame) -> DataFrame:
    """Token sums of distinct events of a source."""
    zero = F.lit(0).cast("bigint")
    columns = ("total_tokens", "input_tokens", "raw_input_tokens", "output_tokens",
               "cache_read_tokens", "reasoning_tokens")
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        *[F.coalesce(F.sum(t), zero).alias(t) for t in columns],
    )


def top_models(events: DataFrame, n: int = 10, column: str = "model_raw") -> DataFrame:
    """Models by number of events, ties by name."""
    name = F.coalesce(none_if_empty(F.col(column)), F.lit("unknown"))
    ranked = (
        events.groupBy(name.alias("model"))
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.desc("events"), "model")
    )
    return ranked.limit(n) if n > 0 else ranked


def chart_series(series: DataFrame) -> DataFrame:
    """Millions of tokens per bucket, two decimals."""
    return series.select("label", F.round(F.col("total_tokens") / 1e6, 2).alias("m_tokens")).orderBy(
        "label"
    )


def chart_labels(rows: DataFrame, n: int) -> DataFrame:
    """The first labels in label order, not the largest."""
    return rows.select("label", "total_tokens").orderBy("label").limit(n)


def natural_key(text: Column) -> Column:
    """Sort key of a string in which runs of digits count by value: ``m2`` before ``m10``.

    Digit runs become their length without leading zeros, six digits wide, then the digits.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        sized = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)
        return F.when(run.rlike("^[0-9]"), sized).otherwise(run)

    return F.transform(runs, part)


def sorted_rows(rows: DataFrame, column: str, descending: bool = True, limit: int = 50) -> DataFrame:
    """Any column, missing values last in both directions; ``limit`` 0 shows all.

    Strings sort by ``natural_key``, then as they are; other columns decide between equals, so
    a limit cuts at one place only.
    """
    keys = [F.col(column)]
    if rows.schema[column].dataType.typeName() == "string":
        keys.insert(0, natural_key(F.col(column)))
    others = [
        F.col(f.name).asc_nulls_last()
        for f in rows.schema.fields
        if f.name != column and f.dataType.typeName() not in ("map", "variant")
    ]
    ordered = rows.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys], *others)
    return ordered.limit(limit) if limit > 0 else ordered

"""The filters every report accepts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions import clock
from meterbook.functions.text import is_blank, project_label


@dataclass(frozen=True)
class Filters:
    since: str = ""
    until: str = ""
    channel: str = ""
    source_product: str = ""
    provider: str = ""
    model: str = ""
    session: str = ""
    project: str = ""
    timezone: str = "UTC"

    def validate(self) -> Filters:
        """errors before any job starts."""
        clock.resolve_zone(self.timezone)
        clock.check_date("since", self.since)
        clock.check_date("until", self.until)
        return self


def label_of(df: DataFrame) -> Column:
    """The stored project label, or the label derived from the path."""
    if "project_label" in df.columns:
        return F.col("project_label")
    return project_label(F.col("project_path"))


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """All filters as plain comparisons the file scan can use.

    Bounds are resolved to milliseconds on the driver. Where the table is partitioned by
    UTC date, the same bounds also select partitions.
    """
    f = filters.validate()
    dated = "event_date_utc" in df.columns

    def bounded(frame: DataFrame, ms: int, lower: bool) -> DataFrame:
        ts, day = F.col("timestamp_ms"), F.col("event_date_utc")
        frame = frame.where(ts >= ms if lower else ts < ms)
        if dated:
            limit = clock.utc_day_of(ms if lower else ms - 1)
            frame = frame.where(day >= limit if lower else day <= limit)
        return frame

    if f.since:
        df = bounded(df, clock.since_millis(f.since, f.timezone), True)
    if f.until:
        df = bounded(df, clock.until_millis(f.until, f.timezone), False)
    for column, value in (
        ("channel", f.channel),
        ("source_product", f.source_product),
        ("provider", f.provider),
        ("model_normalized", f.model),
    ):
        if value:
            df = df.where(F.col(column) == value)
    if f.session:
        df = df.where((F.col("session_key") == f.session) | (F.col("session_id") == f.session))
    if f.project:
        df = df.where(label_of(df) == f.project)
    return df


def is_offered(value: Column) -> Column:
    """values worth listing as a filter option."""
    return ~is_blank(value)

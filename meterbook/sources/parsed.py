"""The common record every extractor emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions.text import path_parts
from meterbook.schema import PARSED_SCHEMA
from meterbook.session import Staging
from meterbook.sources.lines import LogScan

# Order in which the log families are imported.
SOURCE_ORDER = ("claude", "codex", "gemini", "copilot", "workbuddy")


def order_key(agent: str, path: Column, line: Column, part: Column) -> Column:
    """Arrival order of a record: family, directory-walk order of files, line, part of line."""
    return F.struct(
        F.lit(SOURCE_ORDER.index(agent)).alias("source"),
        path_parts(path).alias("path"),
        line.cast("bigint").alias("line"),
        part.cast("bigint").alias("part"),
    )


def _raw_digest(df: DataFrame) -> Column | None:
    """Digest of the raw line, for diagnosis only."""
    if "raw_sha256" in df.columns:
        return F.col("raw_sha256")
    return F.sha2(F.col("value"), 256) if "value" in df.columns else None


def settled(
    df: DataFrame, staging: Staging | None, name: str, scan: LogScan | None = None
) -> DataFrame:
    """Store freshly parsed fields before they are filtered, then give them line numbers.

    A filter on a parsed value would otherwise move below the projection and parse every
    line a second time. With ``scan``, lines came with their place in the file instead of a
    number; the few parsed columns are joined with the splits, not the raw text.
    """
    stored = df if staging is None else staging.put(df, name)
    return stored if scan is None else scan.numbered(stored)


def refused(fields: DataFrame, into: list[DataFrame] | None) -> DataFrame:
    """Move rows with a ``refusal`` out of ``fields``; ``into`` gets them as rejects."""
    if into is not None:
        into.append(
            fields.where(F.col("refusal").isNotNull()).select(
                "file_path", "line_number", F.col("refusal").alias("reason")
            )
        )
    return fields.where(F.col("refusal").isNull()).drop("refusal")


def as_parsed(
    df: DataFrame, agent: str, part: Column | None = None, keep: tuple[str, ...] = (), **cols
) -> DataFrame:
    """Project to the parsed schema; fields not given are NULL, ``keep`` is passed through."""
    given = {
        "agent": F.lit(agent),
        "source_file": F.col("file_path"),
        "line_number": F.col("line_number"),
        "raw_sha256": _raw_digest(df),
        "order_key": order_key(
            agent, F.col("file_path"), F.col("line_number"), F.lit(0) if part is None else part
        ),
        **cols,
    }
    out = []
    for field in PARSED_SCHEMA.fields:
        value = given.get(field.name)
        column = value if isinstance(value, Column) else F.lit(value)
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out, *keep)

"""Ordered carry-forward that does not need a whole group in one task.

``last`` value, running ``sum`` and running ``max`` before each row of a group, where one
group (a log file, a session) may be a large part of all rows. Groups are cut into blocks
of consecutive lines. Windows run inside a block; one summary row per block is carried
across the blocks of a group; only rows of later blocks take a carried value.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows a single window partition holds at most, for one row per line number.
BLOCK_ROWS = 200_000


@dataclass(frozen=True)
class Carry:
    """One carried column: what is carried, within which group, and how."""

    name: str
    value: Column
    group: tuple[str, ...]
    how: str = "last"
    inclusive: bool = False


def block_of(order: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.call_function("div", order, F.lit(rows).cast("bigint"))


def _over(how: str, value: Column, window) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max}[how](value).over(window)


def _merge(how: str, local: Column, carried: Column) -> Column:
    if how == "last":
        return F.coalesce(local, carried)
    if how == "sum":
        return F.coalesce(local + carried, local, carried, F.lit(0).cast("bigint"))
    return F.greatest(local, carried)


def carry(
    df: DataFrame, specs: Iterable[Carry], order: str = "line_number", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add one column per spec. Group columns must not be NULL.

    ``df`` is read once for the rows and once per distinct group for the block summaries,
    so stage it first where it is expensive.
    """
    specs = sorted(specs, key=lambda s: len(s.group))
    groups = list(dict.fromkeys(s.group for s in specs))
    blocked = df.withColumns(
        {
            "_block": block_of(F.col(order), block_rows),
            **{f"_in{i}": s.value for i, s in enumerate(specs)},
        }
    )

    # The widest group comes first: its distribution also serves the narrower ones.
    out = blocked
    for group in groups:
        before = Window.partitionBy(*group, "_block").orderBy(order)
        frames = {
            inclusive: before.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            for inclusive in (True, False)
        }
        out = out.withColumns(
            {
                f"_local{i}": _over(s.how, F.col(f"_in{i}"), frames[s.inclusive])
                for i, s in enumerate(specs)
                if s.group == group
            }
        )
    for group in groups:
        mine = [(i, s) for i, s in enumerate(specs) if s.group == group]
        out = out.join(_carried(blocked, group, mine, order), [*group, "_block"], "left")
    return out.select(
        *df.columns,
        *[
            _merge(s.how, F.col(f"_local{i}"), F.col(f"_carried{i}")).alias(s.name)
            for i, s in enumerate(specs)
        ],
    )


def _carried(blocked: DataFrame, group, mine, order: str) -> DataFrame:
    """Values entering a block from the blocks before it; blocks nothing enters are left out."""
    summaries = []
    for i, s in mine:
        value = F.col(f"_in{i}")
        if s.how == "last":
            summary = F.max_by(value, F.when(value.isNotNull(), F.col(order)))
        else:
            summary = {"sum": F.sum, "max": F.max}[s.how](value)
        summaries.append(summary.alias(f"_sum{i}"))
    per_block = blocked.groupBy(*group, "_block").agg(*summaries)
    before = (
        Window.partitionBy(*group)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    entering = per_block.select(
        *group,
        "_block",
        *[_over(s.how, F.col(f"_sum{i}"), before).alias(f"_carried{i}") for i, s in mine],
    )
    any_value = F.coalesce(*[F.when(F.col(f"_carried{i}").isNotNull(), True) for i, _ in mine])
    return entering.where(any_value)

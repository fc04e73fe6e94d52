"""Forked logs that replay their parent, model declarations and turn markers.

A forked log starts with a copy of its parent's usage rows. Copied rows must not count
again, and a file whose copy cannot be told from its own usage contributes nothing.
No step needs all rows of one file in one task: positions come from ``carry``; "how far"
questions are minimum aggregates over row-level tests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.functions.text import record_subkey
from meterbook.operators.carry import Carry, carry
from meterbook.operators.counters import (
    is_zero,
    part,
    policy_name,
    reset_aware_difference,
    same_values,
    with_usage,
)
from meterbook.session import Staging
from meterbook.sources.codex import path_rank, session_path_id
from meterbook.sources.parsed import as_parsed

# Pauses up to this long belong to one burst.
BURST_PAUSE_MS = 1000

# Why a forked log is left out, as codes that can be grouped by.
#: The log names a parent that is not there, and its first rows do not look like a replay.
NO_PARENT = "parent_missing"
#: The log names itself, or several logs answer to the parent's name.
SELF_PARENT = "parent_is_self"
AMBIGUOUS = "parent_ambiguous"
#: Without a time of the fork, or of the parent's rows before it, nobody can tell what was copied.
NO_FORK_TIME = "fork_time_missing"
NO_ROW_TIME = "parent_time_missing"
#: A row in the copied part has usage that no row of the parent can be set against.
UNCOMPARABLE = "usage_not_comparable"

_FOREVER = 9_223_372_036_854_775_807
REPLAY_VALUES = ("r_input", "r_cached", "r_output", "r_reasoning", "r_total")


def with_replay_values(usage: DataFrame, previous: str = "previous_in_file") -> DataFrame:
    """Policy-independent usage of a row and whether it can be compared with a parent's.

    ``previous`` is the previous cumulative snapshot of the *file*, whatever its session.
    """
    cur, last, prev = F.col("cumulative"), F.col("last"), F.col(previous)
    advanced = prev.isNull() | ~same_values(cur, prev)
    from_total = F.when(last.isNotNull() & ~is_zero(last), last).otherwise(
        reset_aware_difference(cur, prev)
    )
    raw = F.when(cur.isNotNull(), F.when(advanced, from_total)).otherwise(last)
    r = F.col("_raw")
    status = (
        F.when(cur.isNotNull() & ~F.col("_advanced"), "unchanged")
        .when(r.isNotNull() & ~is_zero(r), "comparable")
        .otherwise("uncomparable")
    )
    rows = usage.withColumn("_raw", raw).withColumn("_advanced", advanced)
    return (
        rows.withColumn("replay_status", status)
        .withColumn("r_input", part(r, "input"))
        .withColumn("r_cached", F.least(part(r, "cached"), part(r, "input")))
        .withColumn("r_output", part(r, "output"))
        .withColumn("r_reasoning", part(r, "reasoning"))
        .withColumn(
            "r_total",
            F.when(r["total"] > 0, r["total"]).otherwise(part(r, "input") + part(r, "output")),
        )
        .drop("_raw", "_advanced", previous)
    )


def usage_rows(rows: DataFrame, policy: str) -> DataFrame:
    """Usage rows with stored counters (O1-O4) and replay values."""
    usage = rows.where(F.col("row_kind") == "usage")
    both = carry(
        usage,
        [
            Carry("previous_in_file", F.col("cumulative"), ("file_path",)),
            Carry("previous", F.col("cumulative"), ("file_path", "session")),
        ],
    )
    return with_usage(with_replay_values(both), policy_name(policy), "previous").drop(
        "cumulative", "last", "headless"
    )


def with_positions(usage: DataFrame) -> DataFrame:
    """Place of comparable rows in their file: ``idx``, previous and highest time so far."""
    comparable = F.col("replay_status") == "comparable"
    ts = F.when(comparable, F.col("ts"))
    placed = carry(
        usage,
        [
            Carry("idx", F.when(comparable, F.lit(1).cast("bigint")), ("file_path",), "sum"),
            Carry("prev_ts", ts, ("file_path",)),
            Carry("high_ts", F.when(ts > 0, ts), ("file_path",), "max", inclusive=True),
        ],
    )
    return placed.withColumn("idx", F.when(comparable, F.col("idx"))).withColumn(
        "high_ts", F.coalesce("high_ts", F.lit(0).cast("bigint"))
    )


def resolve_parents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(children with their parent, member files of every session id)``.

    Candidates are counted per session id, not paired: a session id copied into many files
    costs one row. Live files win over archived ones; the first path stands for the rest.
    """
    meta = rows.where(F.col("is_meta")).select(
        "file_path",
        F.col("meta_session").alias("session_id"),
        F.col("meta_parent").alias("parent_id"),
        F.col("ts").alias("fork_ts"),
        path_rank(F.col("file_path")).alias("rank"),
    )
    ranked = (
        meta.where(F.col("session_id").isNotNull())
        .groupBy("session_id", "rank")
        .agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("first"))
    )
    best = ranked.groupBy("session_id").agg(F.min_by(F.struct("rank", "n", "first"), "rank").alias("b"))
    parents = best.select(
        F.col("session_id").alias("parent_id"),
        F.col("b.rank").alias("parent_rank"),
        F.col("b.n").alias("n_parents"),
        F.col("b.first").alias("parent_path"),
    )
    status = (
        F.when(F.coalesce(F.col("session_id") == F.col("parent_id"), F.lit(False)), "self")
        .when(F.col("n_parents").isNull(), "missing")
        .otherwise("resolved")
    )
    children = (
        meta.where(F.col("parent_id").isNotNull())
        .join(parents, "parent_id", "left")
        .select(
            "file_path",
            "parent_id",
            "fork_ts",
            status.alias("status"),
            F.when(status == "resolved", F.col("parent_path")).alias("parent_path"),
            F.when(status == "resolved", F.col("n_parents")).alias("n_parents"),
        )
    )
    members = (
        meta.join(
            parents.where(F.col("n_parents") > 1)
            .withColumnRenamed("parent_id", "session_id")
            .withColumnRenamed("parent_rank", "rank"),
            ["session_id", "rank"],
        )
        .select("session_id", "n_parents", "file_path")
    )
    return children, members


def file_facts(usage: DataFrame) -> DataFrame:
    """Per file: times of the first two comparable rows, and where timeless rows begin.

    A row without time makes every prefix that would include it unusable; that is the case
    for forks at or after ``bad_from``, the highest time seen before such a row.
    """
    rows = usage.where(F.col("idx").isNotNull())
    facts = rows.groupBy("file_path").agg(
        F.max(F.when(F.col("idx") == 0, F.col("ts"))).alias("ts0"),
        F.max(F.when(F.col("idx") == 1, F.col("ts"))).alias("ts1"),
        F.min(F.when(F.col("ts") <= 0, F.col("high_ts"))).alias("bad_from"),
        F.count(F.lit(1)).alias("n_comparable"),
    )
    gap = F.col("ts1") - F.col("ts0")
    opens = (F.col("ts0") > 0) & (F.col("ts1") > 0) & gap.between(0, BURST_PAUSE_MS)
    return facts.withColumn(
        "burst_start", F.when(F.coalesce(opens, F.lit(False)), F.col("ts0")).otherwise(0)
    )


def _ambiguous_forks(
    children: DataFrame, members: DataFrame, usage: DataFrame, facts: DataFrame
) -> DataFrame:
    """Children of several equally ranked parents whose prefixes are not provably equal.

    Prefixes differ for a fork time where one copy already includes a row and another does
    not, or from the time on where an included row differs. Both are intervals per row
    position, collected once per session id and independent of the number of children.
    """
    several = children.where(F.col("n_parents") > 1)
    stream = (
        usage.where(F.col("idx").isNotNull())
        .select("file_path", "idx", "high_ts", *REPLAY_VALUES)
        .join(members, "file_path")
    )
    by_position = stream.groupBy("session_id", "idx").agg(
        F.min("high_ts").alias("lo"),
        F.max("high_ts").alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.max("n_parents").alias("n_parents"),
        *[F.min(v).alias(f"min_{v}") for v in REPLAY_VALUES],
        *[F.max(v).alias(f"max_{v}") for v in REPLAY_VALUES],
    )
    differs = F.col("n") < F.col("n_parents")
    for v in REPLAY_VALUES:
        differs = differs | (F.col(f"min_{v}") != F.col(f"max_{v}"))
    intervals = by_position.select(
        F.col("session_id").alias("parent_id"),
        "lo",
        F.when(differs, F.lit(_FOREVER)).otherwise(F.col("hi")).alias("hi"),
    ).where(F.col("lo") < F.col("hi"))
    timeless = (
        facts.where(F.col("bad_from").isNotNull())
        .join(members, "file_path")
        .select(
            F.col("session_id").alias("parent_id"),
            F.col("bad_from").alias("lo"),
            F.lit(_FOREVER).alias("hi"),
        )
    )
    # A fork lies in an interval if the latest end among intervals begun by then is still to come:
    # one running maximum per session id instead of children times intervals.
    merged = intervals.unionByName(timeless).groupBy("parent_id", "lo").agg(F.max("hi").alias("hi"))
    none = F.lit(None)
    marks = merged.select("parent_id", F.col("lo").alias("at"), "hi", none.cast("string").alias("file_path"))
    forks = several.select("parent_id", F.col("fork_ts").alias("at"), none.cast("bigint").alias("hi"), "file_path")
    begun = (
        Window.partitionBy("parent_id")
        .orderBy("at", F.col("file_path").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    latest = marks.unionByName(forks).withColumn("end", F.max("hi").over(begun))
    inside = latest.where(F.col("file_path").isNotNull() & (F.col("at") < F.col("end")))
    untimed = several.where(F.col("fork_ts") <= 0)
    return inside.select("file_path").unionByName(untimed.select("file_path")).distinct()


def plan_children(rows: DataFrame, usage: DataFrame) -> DataFrame:
    """O8/O9/O11 facts and O14 verdicts that follow from the file set alone."""
    children, members = resolve_parents(rows)
    facts = file_facts(usage)
    ambiguous = _ambiguous_forks(children, members, usage, facts).withColumn("amb", F.lit(True))
    parent_facts = facts.select(
        F.col("file_path").alias("parent_path"),
        F.col("ts0").alias("parent_ts0"),
        F.col("bad_from").alias("parent_bad_from"),
    )
    plan = (
        children.join(ambiguous, "file_path", "left")
        .join(facts.select("file_path", "burst_start", "n_comparable"), "file_path", "left")
        .join(parent_facts, "parent_path", "left")
        .withColumn("status", F.when(F.col("amb"), "ambiguous").otherwise(F.col("status")))
        .withColumn("burst_start", F.coalesce("burst_start", F.lit(0).cast("bigint")))
    )
    resolved = F.col("status") == "resolved"
    unavailable = F.when(
        resolved,
        F.when(F.col("fork_ts") <= 0, NO_FORK_TIME).when(
            F.col("parent_bad_from") <= F.col("fork_ts"), NO_ROW_TIME
        ),
    )
    prefix_is_empty = F.col("parent_ts0").isNull() | (F.col("parent_ts0") > F.col("fork_ts"))
    plan = plan.withColumn("unavailable", unavailable).withColumn(
        "has_prefix", resolved & F.col("unavailable").isNull() & ~prefix_is_empty
    )
    proven_empty = resolved & F.col("unavailable").isNull() & prefix_is_empty
    no_burst = F.col("burst_start") == 0
    reason = (
        F.when(F.col("status") == "self", SELF_PARENT)
        .when(F.col("status") == "ambiguous", AMBIGUOUS)
        .when((F.col("status") == "missing") & no_burst, NO_PARENT)
        .when(no_burst, F.col("unavailable"))
    )
    return (
        plan.withColumn("plan_reason", reason)
        .withColumn("burst_start", F.when(proven_empty, 0).otherwise(F.col("burst_start")))
        .select(
            "file_path",
            "parent_path",
            "fork_ts",
            "status",
            "has_prefix",
            "burst_start",
            "plan_reason",
        )
    )


def replay_bounds(plan: DataFrame, usage: DataFrame) -> DataFrame:
    """How many opening rows of a child are replay, and what follows from it."""
    open_plan = plan.where(F.col("plan_reason").isNull())
    rows = usage.where(F.col("idx").isNotNull()).join(
        open_plan.select("file_path", "parent_path", "fork_ts", "has_prefix", "burst_start"),
        "file_path",
    )
    parent = usage.where(F.col("idx").isNotNull()).select(
        F.col("file_path").alias("parent_path"),
        "idx",
        F.col("high_ts").alias("parent_high_ts"),
        F.lit(True).alias("in_parent"),
        *[F.col(v).alias(f"p_{v}") for v in REPLAY_VALUES],
    )
    equal = F.col("has_prefix") & F.coalesce("in_parent", F.lit(False))
    equal = equal & (F.col("parent_high_ts") <= F.col("fork_ts"))
    for v in REPLAY_VALUES:
        equal = equal & (F.col(v) == F.col(f"p_{v}"))
    gap = F.col("ts") - F.col("prev_ts")
    chained = (
        (F.col("burst_start") > 0)
        & (F.col("ts") > 0)
        & ((F.col("idx") == 0) | ((F.col("prev_ts") > 0) & gap.between(0, BURST_PAUSE_MS)))
    )
    joined = rows.join(parent, ["parent_path", "idx"], "left").select(
        "file_path",
        "idx",
        "ts",
        "line_number",
        "prev_ts",
        F.coalesce(equal, F.lit(False)).alias("is_copy"),
        F.coalesce(chained, F.lit(False)).alias("is_chained"),
    )
    lengths = joined.groupBy("file_path").agg(
        F.min(F.when(~F.col("is_copy"), F.col("idx"))).alias("first_own"),
        F.min(F.when(~F.col("is_chained"), F.col("idx"))).alias("first_pause"),
        F.count(F.lit(1)).alias("n"),
    )
    exact = F.coalesce("first_own", "n")
    skipped = F.when(exact > 0, exact).otherwise(F.coalesce("first_pause", "n"))
    lengths = lengths.select(
        "file_path",
        skipped.alias("skipped"),
        F.when(exact > 0, "exact").when(skipped > 0, "rewritten").alias("method"),
    )
    in_replay = F.col("idx") < F.col("skipped")
    in_order = (F.col("ts") > 0) & ((F.col("idx") == 0) | (F.col("ts") >= F.col("prev_ts")))
    ends = (
        joined.join(lengths, "file_path")
        .groupBy("file_path", "skipped", "method")
        .agg(
            F.min(F.when(~in_replay, F.col("line_number"))).alias("own_from"),
            F.coalesce(F.bool_and(F.when(in_replay, in_order)), F.lit(True)).alias("times_ok"),
            F.max_by("ts", F.when(in_replay, F.col("idx"))).alias("last_replay_ts"),
        )
    )
    bounds = plan.join(ends, "file_path", "left").withColumn(
        "own_from", F.coalesce("own_from", F.lit(_FOREVER))
    )
    stuck = (
        usage.where((F.col("replay_status") == "uncomparable") & ~F.col("is_empty"))
        .join(bounds.where(F.col("plan_reason").isNull()).select("file_path", "own_from"), "file_path")
        .where(F.col("line_number") < F.col("own_from"))
        .groupBy("file_path")
        .agg(F.min("line_number").alias("stuck_at"))
    )
    return (
        bounds.join(stuck, "file_path", "left")
        .withColumn(
            "quarantine",
            F.coalesce("plan_reason", F.when(F.col("stuck_at").isNotNull(), UNCOMPARABLE)),
        )
        .withColumn("skipped", F.coalesce("skipped", F.lit(0).cast("bigint")))
    )


@dataclass
class CodexResult:
    """Records, the verdict per forked file, and the replay counters."""

    records: DataFrame
    verdicts: DataFrame
    diagnostics: DataFrame


def build_records(rows: DataFrame, policy: str, staging: Staging) -> CodexResult:
    """The whole ordered chain over extracted rows; ``rows`` should be a staged table."""
    policy = policy_name(policy)
    usage = staging.put(with_positions(staging.put(usage_rows(rows, policy), "usage")), "placed")
    verdicts = staging.put(replay_bounds(plan_children(rows, usage), usage), "verdicts")
    emitted, context = own_rows(rows, usage, verdicts)
    linked = staging.put(attach_context(emitted, context), "linked")
    records = as_records(linked, policy)
    return CodexResult(records, verdicts, replay_diagnostics(verdicts, usage, linked))


def own_rows(
    rows: DataFrame, usage: DataFrame, verdicts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Usage a file may report, and the declarations and turn markers that apply to it."""
    bounds = verdicts.select(
        "file_path", "quarantine", "own_from", "skipped", "times_ok", "last_replay_ts"
    )
    is_fork = F.col("own_from").isNotNull()
    pending = is_fork & (F.col("line_number") < F.col("own_from"))
    emitted = (
        usage.where(~F.col("is_empty"))
        .join(bounds, "file_path", "left")
        .where(F.col("quarantine").isNull() & ~F.coalesce(pending, F.lit(False)))
        .drop("quarantine", "own_from", "skipped", "times_ok", "last_replay_ts")
    )
    # A declaration among replayed rows counts only if it is clearly later than the replay.
    late = (F.col("ts") > 0) & (F.col("ts") - F.col("last_replay_ts") > BURST_PAUSE_MS)
    survives = (F.col("skipped") == 0) | (F.col("times_ok") & late)
    applies = F.when(F.col("row_kind") == "declaration", survives).otherwise(False)
    context = (
        rows.where(F.col("row_kind").isin("declaration", "task_complete"))
        .join(bounds, "file_path", "left")
        .where(
            F.col("quarantine").isNull()
            & (~F.coalesce(pending, F.lit(False)) | F.coalesce(applies, F.lit(False)))
        )
        .select(
            "file_path",
            "line_number",
            "session",
            "explicit_session",
            "row_kind",
            "declared_model",
            "declared_by",
            "turn_id",
        )
    )
    return emitted, context


def attach_context(emitted: DataFrame, context: DataFrame) -> DataFrame:
    """O5 model carry-forward and O6 turn attachment."""
    line = F.col("line_number")
    merged = emitted.withColumn("row_kind", F.lit("usage")).drop("turn_id").unionByName(
        context, allowMissingColumns=True
    )
    declares = F.col("row_kind") == "declaration"
    declared = F.struct(
        F.col("declared_model").alias("model"), F.col("declared_by").alias("by"), line.alias("line")
    )
    scoped = F.col("explicit_session").isNotNull()
    is_usage = F.col("row_kind") == "usage"
    seen = carry(
        merged,
        [
            Carry("file_decl", F.when(declares & ~scoped, declared), ("file_path",)),
            Carry("session_decl", F.when(declares & scoped, declared), ("file_path", "session")),
            Carry("file_use", F.when(is_usage, line), ("file_path",)),
            Carry("session_use", F.when(is_usage, line), ("file_path", "session")),
        ],
    )
    use_session = F.col("session_decl").isNotNull() & (
        F.col("file_decl").isNull() | (F.col("session_decl.line") > F.col("file_decl.line"))
    )
    decl = F.when(use_session, F.col("session_decl")).otherwise(F.col("file_decl"))
    usage = (
        seen.where(is_usage)
        .drop("turn_id")
        .withColumn("_decl", decl)
        .withColumn("model", F.coalesce("direct_model", F.col("_decl.model"), F.lit("unknown")))
        .withColumn(
            "model_resolution",
            F.when(F.col("direct_model").isNotNull(), S.MODEL_DIRECT).otherwise(
                F.coalesce(F.col("_decl.by"), F.lit(S.MODEL_UNKNOWN))
            ),
        )
        .drop(
            "_decl",
            "file_decl",
            "session_decl",
            "file_use",
            "session_use",
            "row_kind",
            "declared_model",
            "declared_by",
        )
    )
    turns = (
        seen.where((F.col("row_kind") == "task_complete") & F.col("turn_id").isNotNull())
        .select(
            "file_path",
            F.coalesce("session_use", "file_use").alias("target"),
            "turn_id",
            line.alias("marker_line"),
        )
        .where(F.col("target").isNotNull())
        .groupBy("file_path", F.col("target").alias("line_number"))
        .agg(F.min_by("turn_id", "marker_line").alias("turn_id"))
    )
    return usage.join(turns, ["file_path", "line_number"], "left")


def as_records(linked: DataFrame, policy: str) -> DataFrame:
    """Parsed records; a row closed by a turn marker is identified by its turn."""
    has_turn = F.col("turn_id").isNotNull()
    native = F.coalesce("event_id", "request_id", "message_id")
    kind = (
        F.when(F.col("event_id").isNotNull(), "event")
        .when(F.col("request_id").isNotNull(), "request")
        .when(F.col("message_id").isNotNull(), "message")
        .otherwise("record")
    )
    subkey = F.when(native.isNull(), record_subkey(F.col("line_number"), F.col("segment_id")))
    subkey = subkey.otherwise(F.col("segment_id"))
    return as_parsed(
        linked,
        "codex",
        provider="openai",
        model=F.col("model"),
        model_resolution=F.col("model_resolution"),
        model_is_fallback=F.col("model_resolution") == S.MODEL_UNKNOWN,
        native_session_id=F.col("explicit_session"),
        native_event_id=F.when(~has_turn, native),
        identity_kind=F.when(has_turn, F.lit("turn")).otherwise(kind),
        identity_scope="session",
        identity_subkey=F.when(~has_turn, subkey),
        parser_version="codex-v1",
        granularity="request",
        timestamp_ms=F.col("ts"),
        session_id=F.col("session"),
        session_path_id=session_path_id(F.col("file_path")),
        message_id=F.col("message_id"),
        request_id=F.col("request_id"),
        turn_id=F.col("turn_id"),
        input_tokens=F.col("input_tokens"),
        output_tokens=F.col("output_tokens"),
        cache_creation_tokens=0,
        cache_read_tokens=F.col("cache_read_tokens"),
        reasoning_tokens=F.col("reasoning_tokens"),
        total_tokens=F.col("total_tokens"),
        source_total_tokens=F.col("source_total_tokens"),
        raw_input_tokens=F.col("raw_input_tokens"),
        observability_level=F.when(F.col("partial"), "partial").otherwise("full"),
        token_accounting_method=F.col("method"),
        accounting_profile=policy,
        source_product="codex-cli",
        raw_sha256=F.col("raw_sha256"),
    )


def replay_diagnostics(verdicts: DataFrame, usage: DataFrame, linked: DataFrame) -> DataFrame:
    """One row per counter ``(code, count, events, tokens)``."""
    status = F.col("status")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    per_plan = verdicts.agg(
        F.count(F.lit(1)).alias("forks"),
        n(status == "resolved").alias("resolved"),
        n(status == "missing").alias("missing"),
        n(status.isin("ambiguous", "self")).alias("ambiguous"),
        n(F.col("quarantine").isNotNull()).alias("unresolved"),
    )
    replayed = (
        usage.where(F.col("idx").isNotNull())
        .join(
            verdicts.where(F.col("plan_reason").isNull()).select(
                "file_path", "skipped", "method", "stuck_at"
            ).withColumnRenamed("method", "replay_method"),
            "file_path",
        )
        .where(
            (F.col("idx") < F.col("skipped"))
            & (F.col("line_number") < F.coalesce("stuck_at", F.lit(_FOREVER)))
        )
    )
    zero = F.lit(0).cast("bigint")

    def skipped_by(method: str) -> Column:
        hit = F.col("replay_method") == method
        return F.struct(
            n(hit).alias("events"),
            F.coalesce(F.sum(F.when(hit, F.col("total_tokens"))), zero).alias("tokens"),
        )

    per_row = replayed.agg(skipped_by("exact").alias("x"), skipped_by("rewritten").alias("r"))
    partial = linked.where(F.col("partial")).agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum("total_tokens"), zero).alias("tokens"),
    )

    def line(code: str, count=None, events=None, tokens=None) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            (zero if count is None else count).alias("count"),
            (zero if events is None else events).alias("events"),
            (zero if tokens is None else tokens).alias("tokens"),
        )

    def rows(df: DataFrame, *lines: Column) -> DataFrame:
        return df.select(F.explode(F.array(*lines)).alias("d")).select("d.*")

    c = F.col
    plans = rows(
        per_plan,
        line("codex_fork_files", c("forks")),
        line("codex_parent_resolved", c("resolved")),
        line("codex_parent_missing", c("missing")),
        line("codex_parent_ambiguous", c("ambiguous")),
        line("codex_replay_unresolved", c("unresolved")),
        # One file listing serves the whole job, so neither can happen here.
        line("codex_replay_file_changed"),
        line("codex_replay_plan_failed"),
    )
    skips = rows(
        per_row,
        line("codex_replay_exact", None, c("x.events"), c("x.tokens")),
        line("codex_replay_rewritten", None, c("r.events"), c("r.tokens")),
        line("codex_replay_events", None, c("x.events") + c("r.events")),
        line("codex_replay_tokens", None, None, c("x.tokens") + c("r.tokens")),
    )
    partials = rows(partial, line("codex_accounting_partial", None, c("events"), c("tokens")))
    return plans.unionByName(skips).unionByName(partials).orderBy("code")

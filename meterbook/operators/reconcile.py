"""What an incoming event does to the stored one.

All rows must have passed ``normalize.cleaned``: blank text is NULL, names are trimmed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import schema as S
from meterbook.session import Staging

INSERTED, UPDATED, SKIPPED, REJECTED = "inserted", "updated", "skipped", "rejected"

# Text that may be filled in later: with and without a change of content.
_CONTENT_FILLS = ("token_accounting_method", "accounting_profile", "observability_level")
_OPTIONAL_COUNTS = ("source_total_tokens", "raw_input_tokens")
_METADATA_FILLS = (
    "parser_version",
    "session_id",
    "session_path_id",
    "turn_id",
    "project_path",
    "message_id",
    "request_id",
    "source_file",
    "raw_sha256",
)
#: Hash values by which rows of changed events are told from the others; at most a 64th as many rows.
SLOTS = 1 << 25
_MODEL = ("model_raw", "model_normalized", "model_resolution", "model_is_fallback")


def event_struct() -> Column:
    return F.struct(*[F.col(c) for c in S.EVENT_COLUMNS])


def _is_unknown(c: Column) -> Column:
    return c.isNull() | (F.lower(c) == "unknown")


def evidence_rank(event: Column) -> Column:
    """0 no model, 1 model from context, 2 model named by the event itself."""
    resolution = F.coalesce(event["model_resolution"], F.lit(""))
    none = (
        _is_unknown(event["model_normalized"])
        | event["model_is_fallback"]
        | (F.lower(resolution) == S.MODEL_UNKNOWN)
    )
    return F.when(none, 0).when(resolution == S.MODEL_DIRECT, 2).otherwise(1)


def known_conflict(a: Column, b: Column) -> Column:
    """Both sides known and different, ignoring case."""
    return ~_is_unknown(a) & ~_is_unknown(b) & (F.lower(a) != F.lower(b))


def _differs(cur: Column, inc: Column, *names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | ~cur[name].eqNullSafe(inc[name])
    return out


def _known_differs(cur: Column, inc: Column, *names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | known_conflict(cur[name], inc[name])
    return out


def conflict_code(cur: Column, inc: Column, cur_rank: Column, inc_rank: Column) -> Column:
    """First incompatibility of two versions of one event, or NULL."""
    counts = F.lit(False)
    for name in _OPTIONAL_COUNTS:
        counts = counts | F.coalesce(cur[name] != inc[name], F.lit(False))
    both_direct = (cur_rank == 2) & (inc_rank == 2)
    other_model = F.lower(cur["model_normalized"]) != F.lower(inc["model_normalized"])
    return (
        F.when(
            _differs(cur, inc, "identity_version", "identity_strategy", "identity_scope"),
            "identity_conflict",
        )
        .when(_differs(cur, inc, "timestamp_ms"), "timestamp_conflict")
        .when(
            _differs(cur, inc, "session_key")
            | _known_differs(cur, inc, "session_id", "session_path_id"),
            "session_conflict",
        )
        .when(_differs(cur, inc, "channel", "source_product"), "source_conflict")
        .when(_differs(cur, inc, "event_granularity"), "granularity_conflict")
        .when(_differs(cur, inc, *S.TOKEN_COLUMNS) | counts, "token_conflict")
        .when(
            _known_differs(cur, inc, "token_accounting_method", "accounting_profile"),
            "accounting_conflict",
        )
        .when(_known_differs(cur, inc, "provider"), "provider_conflict")
        .when(both_direct & other_model, "direct_model_conflict")
    )


def _fillable(cur: Column, inc: Column, *names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | (cur[name].isNull() & inc[name].isNotNull())
    return out


def content_fills(cur: Column, inc: Column, cur_rank: Column, inc_rank: Column) -> Column:
    """Whether the incoming row knows content the current version lacks."""
    same_model = (inc_rank == cur_rank) & (
        F.lower(cur["model_normalized"]) == F.lower(inc["model_normalized"])
    )
    return (
        (inc_rank > cur_rank)
        | (same_model & _fillable(cur, inc, "model_raw", "model_resolution"))
        | (_is_unknown(cur["provider"]) & ~_is_unknown(inc["provider"]))
        | _fillable(cur, inc, *_CONTENT_FILLS, *_OPTIONAL_COUNTS)
    )


def merged_event(
    cur: Column, inc: Column, stronger: Column, content: Column, now_ms: int
) -> Column:
    """The current version with missing facts filled in."""
    out: dict[str, Column] = {name: cur[name] for name in S.EVENT_COLUMNS}
    # Texts of an equally good model may be filled in; a better model replaces all of them.
    same_name = F.lower(cur["model_normalized"]) == F.lower(inc["model_normalized"])
    for name in _MODEL:
        kept = cur[name]
        if name in ("model_raw", "model_resolution"):
            kept = F.when(same_name, F.coalesce(cur[name], inc[name])).otherwise(cur[name])
        out[name] = F.when(stronger, inc[name]).otherwise(kept)
    known_now = _is_unknown(cur["provider"]) & ~_is_unknown(inc["provider"])
    out["provider"] = F.when(known_now, inc["provider"]).otherwise(cur["provider"])
    for name in (*_CONTENT_FILLS, *_OPTIONAL_COUNTS, *_METADATA_FILLS, "line_number"):
        out[name] = F.coalesce(cur[name], inc[name])
    out["content_sha256"] = F.when(content, inc["content_sha256"]).otherwise(cur["content_sha256"])
    out["updated_at_ms"] = F.greatest(inc["updated_at_ms"], F.lit(now_ms).cast("bigint"))
    return F.struct(*[out[name].alias(name) for name in S.EVENT_COLUMNS])


def decide(pairs: DataFrame, now_ms: int) -> DataFrame:
    """``status``, ``code`` and, for updates, ``merged`` for pairs of versions.

    ``pairs`` has the structs ``cur`` (NULL for a new event) and ``inc`` with their
    evidence ranks ``cur_rank`` and ``inc_rank``, computed before the two met.
    """
    cur, inc, cur_rank, inc_rank = (F.col(n) for n in ("cur", "inc", "cur_rank", "inc_rank"))
    conflict, content = F.col("_conflict"), F.col("_content")
    changed = content | F.col("_metadata")
    status = (
        F.when(cur.isNull(), INSERTED)
        .when(conflict.isNotNull(), REJECTED)
        .when(cur["content_sha256"] == inc["content_sha256"], SKIPPED)
        .when(changed, UPDATED)
        # A weaker observation of the model cannot replace a stronger one.
        .when(inc_rank < cur_rank, SKIPPED)
        .otherwise(REJECTED)
    )
    code = F.coalesce("_conflict", F.lit("content_conflict"))
    event = merged_event(cur, inc, inc_rank > cur_rank, content, now_ms)
    return (
        pairs.withColumns(
            {
                "_conflict": conflict_code(cur, inc, cur_rank, inc_rank),
                "_content": content_fills(cur, inc, cur_rank, inc_rank),
                "_metadata": _fillable(cur, inc, *_METADATA_FILLS, "line_number"),
            }
        )
        .withColumn("status", status)
        .withColumns(
            {
                "code": F.when(F.col("status") == REJECTED, code),
                "merged": F.when(F.col("status") == UPDATED, event),
            }
        )
        .drop("_conflict", "_content", "_metadata", "cur_rank", "inc_rank")
    )


def ranked(rows: DataFrame, version: str) -> DataFrame:
    return rows.withColumn(f"{version}_rank", evidence_rank(F.col(version)))


@dataclass
class Reconciled:
    """``decisions``: one row per incoming row; ``changes``: one row per changed event."""

    decisions: DataFrame
    changes: DataFrame


def pair_with_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming events beside the stored version, if any."""
    left = ranked(incoming.select("event_id", event_struct().alias("inc")), "inc")
    right = ranked(stored.select("event_id", event_struct().alias("cur")), "cur")
    return left.join(right, "event_id", "left")


def reconcile_batch(
    incoming: DataFrame,
    stored: DataFrame | Callable[[DataFrame], DataFrame],
    staging: Staging,
    now_ms: int,
) -> Reconciled:
    """R2: apply a batch in arrival order, also where it names one event many times.

    ``stored`` is the stored table, or gives its rows for a table of ids.

    Fields of a stored event only ever go from missing to known, so an event changes at
    most once per fillable field however many rows name it. Each round judges all open
    rows against the current version, keeps the verdicts up to the first row that changes
    it, and leaves the later rows to the next round, which reads the rows of changed events
    alone. Rows never gather per event, so one event id may hold any share of the batch.
    """
    incoming = staging.put(
        incoming.select(
            "event_id", "order_key", "reject_code", event_struct().alias("inc")
        ),
        "incoming",
    )
    refused = incoming.where(F.col("reject_code").isNotNull()).select(
        "event_id",
        "order_key",
        F.lit(REJECTED).alias("status"),
        F.col("reject_code").alias("code"),
    )
    good = ranked(incoming.where(F.col("reject_code").isNull()).drop("reject_code"), "inc")
    ids = staging.put(good.select("event_id").distinct(), "ids")
    known = staging.put(
        (stored(ids) if callable(stored) else matching(stored, ids)).select("event_id", event_struct().alias("cur")),
        "known",
    )
    # rows of new events, and of some others, combine before the ids meet: the batch is not shuffled for that
    new = staging.put(slots_of(ids.join(known.select("event_id"), "event_id", "left_anti")), "new")
    first = may_be_in(good, new, True).groupBy("event_id")
    first = first.agg(F.min("order_key").alias("at"), F.min_by("inc", "order_key").alias("cur"))
    firsts = staging.put(first.join(known.select("event_id"), "event_id", "left_anti"), "firsts")
    inserted = firsts.select(
        "event_id", F.col("at").alias("order_key"), F.lit(INSERTED).alias("status"),
        F.lit(None).cast("string").alias("code"),
    )
    decisions = [refused, inserted]
    versions = [firsts.select("event_id", "cur", F.lit(0).alias("round"))]

    # A version is in force for the rows after ``at``; NULL means for all rows.
    state = firsts.unionByName(known, allowMissingColumns=True)
    rows, round_no = good, 0
    while True:
        round_no += 1
        open_rows = rows.join(ranked(state, "cur"), "event_id").where(
            F.col("at").isNull() | (F.col("order_key") > F.col("at"))
        )
        judged = staging.put(decide(open_rows, now_ms).drop("cur", "at", "inc"), f"round{round_no}")
        turns = staging.put(
            judged.where(F.col("status") == UPDATED)
            .groupBy("event_id")
            .agg(F.min("order_key").alias("at"), F.min_by("merged", "order_key").alias("cur")),
            f"turns{round_no}",
        )
        verdicts = judged.select("event_id", "order_key", "status", "code")
        if not turns.take(1):
            decisions.append(verdicts)
            break
        marks = staging.put(slots_of(turns), f"marks{round_no}")
        met = may_be_in(verdicts, marks, True).join(
            turns.select("event_id", F.col("at").alias("turn")), "event_id", "left"
        ).where(F.col("turn").isNull() | (F.col("order_key") <= F.col("turn")))
        decisions += [may_be_in(verdicts, marks, False), met.drop("turn")]
        versions.append(turns.select("event_id", "cur", F.lit(round_no).alias("round")))
        if round_no == 1:
            good = _as_often_as_stored(good, known, staging)
        state, rows = turns, may_be_in(good, marks, True)

    all_decisions = decisions[0]
    for more in decisions[1:]:
        all_decisions = all_decisions.unionByName(more)
    all_versions = versions[0]
    for more in versions[1:]:
        all_versions = all_versions.unionByName(more)
    changes = (
        all_versions.groupBy("event_id")
        .agg(F.max_by("cur", "round").alias("cur"), F.min("round").alias("first_round"))
        .select(
            F.col("cur.*"),
            F.when(F.col("first_round") == 0, INSERTED).otherwise(UPDATED).alias("change"),
        )
    )
    return Reconciled(all_decisions, changes)


def _as_often_as_stored(rows: DataFrame, known: DataFrame, staging: Staging) -> DataFrame:
    """A row meets every stored row of its id, and goes on as often, should an id be stored twice."""
    several = known.groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("_n")).where("_n > 1")
    several = staging.put(several, "several")
    if several.isEmpty():
        return rows
    times = F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))
    return rows.join(several, "event_id", "left").withColumn("_n", F.explode(times)).select(*rows.columns)


def _slot() -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(SLOTS))


def slots_of(ids: DataFrame) -> DataFrame:
    """``_word, _bits``: which of ``SLOTS`` hash values the event ids have, 64 to a row."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (_slot() % 64).cast("int"))
    return ids.groupBy(F.shiftright(_slot(), 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def may_be_in(rows: DataFrame, marks: DataFrame, wanted: bool) -> DataFrame:
    """Rows whose event may be one of those marked (all that are, and some others), or the rest.

    The marks have a bounded size and are broadcast, so rows are sorted out where they lie; only
    the few that are left have to meet the events themselves.
    """
    marked = rows.withColumn("_word", F.shiftright(_slot(), 6)).join(F.broadcast(marks), "_word", "left")
    bit = F.call_function("shiftright", F.col("_bits"), (_slot() % 64).cast("int")).bitwiseAND(1)
    hit = F.coalesce(bit == 1, F.lit(False))
    return marked.where(hit if wanted else ~hit).select(*rows.columns)


def matching(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows with one of the ids.

    Only ``event_id`` and the date are read from all partitions; full rows are read from
    the dates that hold a match, which prune the partitions while the query runs.
    """
    if "event_date_utc" not in stored.columns:
        return stored.join(ids, "event_id", "left_semi")
    hits = stored.select("event_id", "event_date_utc").join(ids, "event_id", "left_semi")
    dates = hits.select("event_date_utc").distinct()
    return stored.join(dates, "event_date_utc", "left_semi").join(ids, "event_id", "left_semi")


def conflict_summary(decisions: DataFrame) -> DataFrame:
    """Rejected rows by code."""
    return (
        decisions.where(F.col("status") == REJECTED)
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("code")
    )


def status_counts(decisions: DataFrame) -> DataFrame:
    """One row with the import counters."""
    status = F.col("status")
    return decisions.agg(
        *[
            F.count(F.when(status == value, 1)).alias(name)
            for name, value in (
                ("added", INSERTED),
                ("updated", UPDATED),
                ("skipped", SKIPPED),
                ("rejected", REJECTED),
            )
        ]
    )

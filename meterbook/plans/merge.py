"""Merge one ledger into another, all or nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.operators import reconcile
from meterbook.operators.normalize import cleaned
from meterbook.operators.validate import validated
from meterbook.session import Staging
from meterbook.sources import ledger


class MergeConflict(ValueError):
    """At least one event is incompatible; nothing was written."""

    def __init__(self, conflicts: list[tuple[str, int]]):
        total = sum(n for _, n in conflicts)
        super().__init__(f"{total} events do not fit the stored ones, by code {conflicts}; nothing is merged")
        self.conflicts = conflicts


@dataclass
class MergeResult:
    inserted: int
    updated: int
    skipped: int


def merge_decisions(
    incoming: DataFrame, stored: DataFrame, now_ms: int, staging: Staging
) -> DataFrame:
    """Verdict for every incoming event: ``event_id, status, code, inc, merged``.

    Event ids of a ledger are unique, so one join decides everything. The verdicts are
    stored: they are read several times, and filters on them should not be rewritten into
    the comparison of two rows.
    """
    rows = staging.put(validated(cleaned(incoming)), "incoming")
    refused = rows.where(F.col("reject_code").isNotNull()).select(
        "event_id",
        F.lit(reconcile.REJECTED).alias("status"),
        F.col("reject_code").alias("code"),
    )
    good = rows.where(F.col("reject_code").isNull())
    decided = reconcile.decide(reconcile.pair_with_stored(good, stored), now_ms).drop("cur")
    return staging.put(decided.unionByName(refused, allowMissingColumns=True), "decisions")


def merge_ledgers(
    spark: SparkSession, incoming_path: str, ledger_path: str, now_ms: int
) -> MergeResult:
    if incoming_path.rstrip("/") == ledger_path.rstrip("/"):
        raise ValueError(f"source and target of a merge are the same ledger {ledger_path}")
    for attempt in range(1, ledger.ATTEMPTS + 1):
        try:
            return _merged_once(spark, incoming_path, ledger_path, now_ms)
        except ledger.LedgerConflict:
            if attempt == ledger.ATTEMPTS:
                raise


def _merged_once(spark: SparkSession, incoming_path: str, ledger_path: str, now_ms: int) -> MergeResult:
    with Staging(spark, "merge") as staging:
        incoming, base = ledger.read_ledger(spark, incoming_path), ledger.snapshot(spark, ledger_path)
        ids = incoming.select("event_id")
        decisions = merge_decisions(incoming, base.matching(ids), now_ms, staging)
        conflicts = [(r["code"], r["count"]) for r in reconcile.conflict_summary(decisions).collect()]
        if conflicts:
            raise MergeConflict(conflicts)
        status = F.col("status")
        changes = decisions.where(status.isin(reconcile.INSERTED, reconcile.UPDATED)).select(
            F.coalesce("merged", "inc").alias("e"), status.alias("change")
        )
        counts = reconcile.status_counts(decisions).first()
        ledger.apply_changes(spark, changes.select("e.*", "change"), ledger_path, staging, base, ids)
    return MergeResult(counts["added"], counts["updated"], counts["skipped"])

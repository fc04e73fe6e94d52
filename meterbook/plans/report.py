"""Named reports over a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterbook.operators import metrics
from meterbook.operators.filters import Filters
from meterbook.operators.pricing import Costing

_BREAKDOWNS = {
    "models": "model",
    "channels": "channel",
    "sources": "source_product",
    "providers": "provider",
    "projects": "project",
}


def report(
    events: DataFrame,
    name: str,
    filters: Filters = Filters(),
    cost_mode: str = "estimated",
    pricing_path: str | None = None,
    explicit_pricing: bool = False,
) -> DataFrame:
    costing = Costing.load(cost_mode, pricing_path, explicit_pricing)
    if name in ("daily", "weekly", "monthly"):
        return metrics.timeseries(events, name, filters, costing)
    if name in _BREAKDOWNS:
        return metrics.breakdown(events, _BREAKDOWNS[name], filters, costing)
    if name == "sessions":
        return metrics.session_list(events, filters, costing)
    raise ValueError(f"unsupported report type {name!r}")

"""Collects the registered queries of every area."""

from adsight.plans import (  # noqa: F401
    detect_queries,
    evaluate_queries,
    explain_queries,
    ingest_queries,
    metric_queries,
    report_queries,
)
from adsight.plans.queries import REGISTRY  # noqa: F401

# Operators that share a query with the one they are computed beside.
SHARED = {
    "is_profitable_roas": "break_even_roas",
    "previous_window": "trailing_window",
    "month_to_date": "trailing_window",
    "missing_sources": "as_of_date",
    "alternatives": "observation_text",
    "band": "priority",
    "improvement_pct": "verdict",
    "recall_within": "days_to_detect",
    "recall_by_kind": "days_to_detect",
}
REGISTRY.update({name: REGISTRY[other] for name, other in SHARED.items()})

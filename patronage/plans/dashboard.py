"""All result tables for one date, ready to be published for a dashboard."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from patronage.operators import reports
from patronage.operators.segments import attach_strategies
from patronage.plans.segmentation import segment_customers
from patronage.session import materialize


def dashboard_tables(
    purchases: DataFrame,
    as_of: str | dt.date,
    strategies: DataFrame | None = None,
    top: int = 10,
    **options,
) -> dict[str, DataFrame]:
    """Segments are computed once and written; every table reads that result."""
    segments = materialize(segment_customers(purchases, as_of, **options), "segments")
    return {
        "customers": attach_strategies(segments, strategies),
        "segment_summary": reports.segment_summary(segments),
        "tier_rollup": reports.tier_rollup(segments),
        "rf_matrix": reports.rf_matrix(segments, options.get("k", 5)),
        "class_summary": reports.class_summary(reports.value_classes(segments)),
        "concentration": reports.pareto(segments),
        "top_share": reports.top_share(segments),
        "top_customers": reports.top_customers(segments, top),
    }

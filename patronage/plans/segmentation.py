"""From purchases to segments: the whole batch path in one call."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from patronage.operators.hygiene import clean_purchases
from patronage.operators.indicators import rfm_base
from patronage.operators.scoring import score_rank
from patronage.operators.segments import DEFAULT_RULES, Rule, assign_segments
from patronage.session import materialize


def customer_base(
    purchases: DataFrame,
    as_of: str | dt.date,
    start: str | dt.date | None = None,
    net: bool = False,
    unique: bool = False,
) -> DataFrame:
    """The indicators of every customer, written once because scoring passes over them again."""
    cleaned = clean_purchases(purchases, as_of, start, net, unique)
    return materialize(rfm_base(cleaned, as_of), "base")


def segment_customers(
    purchases: DataFrame,
    as_of: str | dt.date,
    start: str | dt.date | None = None,
    net: bool = False,
    unique: bool = False,
    k: int = 5,
    rules: Sequence[Rule] | DataFrame = DEFAULT_RULES,
    scorer: Callable[[DataFrame, int], DataFrame] = score_rank,
) -> DataFrame:
    """Indicators, scores, segment and value tier of every customer who bought."""
    base = customer_base(purchases, as_of, start, net, unique)
    return assign_segments(scorer(base, k), rules, k)

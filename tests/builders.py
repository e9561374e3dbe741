"""Small inputs written out by hand, and brute-force answers to compare with."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import SparkSession

PURCHASES = "customer_id bigint, txn_id bigint, ts timestamp_ntz, amount decimal(18,2)"
BASE = "customer_id bigint, last_purchase date, recency_days bigint, frequency bigint, monetary decimal(38,2)"
GROUPED = f"g bigint, {BASE}"
AS_OF = dt.date(2024, 6, 1)


def purchases(spark: SparkSession, rows):
    """Rows of (customer, transaction, ISO time, amount); any of them may be None."""
    made = [
        (c, t, dt.datetime.fromisoformat(ts) if ts else None, None if a is None else Decimal(str(a)))
        for c, t, ts, a in rows
    ]
    return spark.createDataFrame(made, PURCHASES)


def base_row(customer, recency, frequency, monetary):
    return (customer, AS_OF - dt.timedelta(days=recency), recency, frequency, Decimal(str(monetary)))


def base(spark: SparkSession, rows):
    return spark.createDataFrame([base_row(*row) for row in rows], BASE)


def goodness(rows, indicator):
    """customer -> value of which more is better, from (customer, recency, frequency, monetary)."""
    place = {"r": 1, "f": 2, "m": 3}[indicator]
    sign = -1 if indicator == "r" else 1
    return {row[0]: sign * Fraction(str(row[place])) for row in rows}


def rank_scores(values, k):
    n = len(values)
    return {c: 1 + k * sum(other < v for other in values.values()) // n for c, v in values.items()}


def ntile_scores(values, k):
    order = sorted(values, key=lambda c: (values[c], c))
    size, longer = divmod(len(order), k)
    tiles = [tile for tile in range(1, k + 1) for _ in range(size + (tile <= longer))]
    return dict(zip(order, tiles))


def quantile_scores(values, k, indicator):
    """Interpolated quantiles of the plain values (days for recency)."""
    sign = -1 if indicator == "r" else 1
    plain = {c: sign * v for c, v in values.items()}
    order, cuts = sorted(plain.values()), []
    for j in range(1, k):
        at = Fraction(j * (len(order) - 1), k)
        low = order[int(at)]
        high = order[min(int(at) + 1, len(order) - 1)]
        cuts.append(low + (high - low) * (at - int(at)))
    if indicator == "r":
        return {c: k - sum(v > cut for cut in cuts) for c, v in plain.items()}
    return {c: 1 + sum(v > cut for cut in cuts) for c, v in plain.items()}

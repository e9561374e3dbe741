"""Column expressions shared by the operators. All run inside Spark's generated code."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TOTAL_MONEY = "decimal(38,2)"


def day_of(day: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def date_literal(day: str | dt.date) -> Column:
    """A DATE constant from a date or its ISO text."""
    return F.lit(day_of(day))


def midnight(day: str | dt.date) -> Column:
    """The first instant of a day as a TIMESTAMP_NTZ constant, which Parquet can filter on."""
    return date_literal(day).cast("timestamp_ntz")


def days_since(day: str | dt.date | Column, then: Column) -> Column:
    until = day if isinstance(day, Column) else date_literal(day)
    return F.date_diff(until, then).cast("bigint")


def total(amount: Column) -> Column:
    """An exact sum of money: widened first, so no realistic number of rows overflows it."""
    return F.sum(amount.cast(TOTAL_MONEY))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def share(part: Column, whole: Column) -> Column:
    """An unrounded ratio of two money totals; NULL when there is nothing to share."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def rfm_code() -> Column:
    """The three scores written next to each other, such as ``543``."""
    return F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])


def rfm_total(r: int = 1, f: int = 1, m: int = 1) -> Column:
    """A weighted sum of the scores, in integers."""
    return F.col("r_score") * r + F.col("f_score") * f + F.col("m_score") * m


def value_tier(k: int = 5) -> Column:
    """``high`` above the middle score, ``mid`` on it, ``low`` below it."""
    twice = F.col("m_score") * 2
    return F.when(twice > k + 1, "high").when(twice == k + 1, "mid").otherwise("low")


def average_order_value() -> Column:
    return F.when(F.col("frequency") > 0, F.col("monetary").cast("double") / F.col("frequency"))


def money(value: str | int | Decimal) -> Column:
    return F.lit(Decimal(value)).cast(TOTAL_MONEY)

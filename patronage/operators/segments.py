"""Segments: a loyalty group from (R, F), a value tier from M, and a strategy for each."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.columns import rfm_code, value_tier
from patronage.session import small_table

TIERS = ("high", "mid", "low")


class Rule(NamedTuple):
    """A segment covers a rectangle of recency and frequency scores, bounds included."""

    segment: str
    r_lo: int
    r_hi: int
    f_lo: int
    f_hi: int


DEFAULT_RULES = (
    Rule("champions", 5, 5, 4, 5),
    Rule("loyal", 3, 4, 4, 5),
    Rule("potential_loyal", 4, 5, 2, 3),
    Rule("new", 5, 5, 1, 1),
    Rule("promising", 4, 4, 1, 1),
    Rule("need_attention", 3, 3, 3, 3),
    Rule("about_to_sleep", 3, 3, 1, 2),
    Rule("at_risk", 1, 2, 3, 4),
    Rule("cannot_lose", 1, 2, 5, 5),
    Rule("hibernating", 1, 2, 1, 2),
)

STRATEGY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("segment", "value_tier", "action")]
)

#: A starting point to be replaced by the user's own table of actions.
DEFAULT_STRATEGIES = (
    ("champions", "high", "early access and referral reward"),
    ("champions", "mid", "loyalty programme upgrade"),
    ("champions", "low", "bundle offer to raise basket value"),
    ("loyal", "high", "personal account manager"),
    ("loyal", "mid", "cross-sell by last category"),
    ("loyal", "low", "bundle offer to raise basket value"),
    ("potential_loyal", "high", "membership invitation"),
    ("potential_loyal", "mid", "membership invitation"),
    ("potential_loyal", "low", "second-purchase voucher"),
    ("new", "high", "personal welcome"),
    ("new", "mid", "welcome series"),
    ("new", "low", "welcome series"),
    ("promising", "high", "second-purchase voucher"),
    ("need_attention", "high", "limited-time offer"),
    ("need_attention", "mid", "limited-time offer"),
    ("about_to_sleep", "high", "reminder of favourite products"),
    ("at_risk", "high", "personal win-back call"),
    ("at_risk", "mid", "win-back voucher"),
    ("cannot_lose", "high", "personal win-back call"),
    ("cannot_lose", "mid", "win-back voucher"),
    ("hibernating", "high", "win-back voucher"),
    ("hibernating", "low", "no paid contact"),
)


def rules_from(table: DataFrame, k: int = 5) -> list[Rule]:
    """Rules kept as a table. Valid rules cannot outnumber the k * k cells they cover."""
    rows = table.select(*Rule._fields).limit(k * k + 1).collect()
    if len(rows) > k * k:
        raise ValueError(f"more than {k * k} rules: some must overlap")
    return [Rule(*row) for row in rows]


def validate_rules(rules: Iterable[Rule], k: int = 5) -> None:
    """Each of the k * k score pairs must belong to exactly one rule."""
    owner: dict[tuple[int, int], str] = {}
    for rule in rules:
        for r in range(rule.r_lo, rule.r_hi + 1):
            for f in range(rule.f_lo, rule.f_hi + 1):
                if not (1 <= r <= k and 1 <= f <= k):
                    raise ValueError(f"{rule.segment}: score pair ({r}, {f}) is outside 1..{k}")
                if (r, f) in owner:
                    raise ValueError(f"({r}, {f}) is claimed by {owner[r, f]} and {rule.segment}")
                owner[r, f] = rule.segment
    missing = [(r, f) for r in range(1, k + 1) for f in range(1, k + 1) if (r, f) not in owner]
    if missing:
        raise ValueError(f"no rule covers {missing}")


def segment_of(rules: Iterable[Rule], k: int = 5) -> Column:
    """The rules laid out over the k * k score pairs, looked up by position: no join, and
    far less generated code than a CASE over the rules."""
    cells = [""] * (k * k)
    for rule in rules:
        for r in range(rule.r_lo, rule.r_hi + 1):
            for f in range(rule.f_lo, rule.f_hi + 1):
                cells[(r - 1) * k + f - 1] = rule.segment
    place = (F.col("r_score") - 1) * k + F.col("f_score")
    return F.element_at(F.array(*[F.lit(name) for name in cells]), place)


def assign_segments(
    scored: DataFrame, rules: Sequence[Rule] | DataFrame = DEFAULT_RULES, k: int = 5
) -> DataFrame:
    """Add ``rfm_code``, ``segment`` and ``value_tier`` to scored customers."""
    rules = rules_from(rules, k) if isinstance(rules, DataFrame) else list(rules)
    validate_rules(rules, k)
    return scored.select(
        "*", rfm_code().alias("rfm_code"), segment_of(rules, k).alias("segment"), value_tier(k).alias("value_tier")
    )


def default_strategies(df: DataFrame) -> DataFrame:
    return small_table(df.sparkSession, list(DEFAULT_STRATEGIES), STRATEGY_SCHEMA)


def attach_strategies(segments: DataFrame, strategies: DataFrame | None = None) -> DataFrame:
    """Look up the action for each customer's segment and tier; NULL where none is planned.

    The table is checked first: it must name each segment and tier once, since a second
    action would count customers twice. Spark broadcasts it if it is small.
    """
    strategies = default_strategies(segments) if strategies is None else strategies
    plan = strategies.select("segment", "value_tier", "action")
    if not plan.groupBy("segment", "value_tier").count().where("count > 1").isEmpty():
        raise ValueError("strategies name a segment and tier more than once")
    return segments.join(plan, ["segment", "value_tier"], "left")

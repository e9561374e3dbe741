"""Monthly history: indicators at the start of every month, and moves between segments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.columns import date_literal, days_since, midnight
from patronage.operators.indicators import indicator_aggregates
from patronage.operators.scoring import apply_cutpoints, comparable, rank_cuts, score_sql
from patronage.operators.segments import DEFAULT_RULES, Rule, assign_segments, segment_of, validate_rules
from patronage.session import materialize

NOBODY = "(none)"


def _day(day: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def _month_number(day: dt.date) -> int:
    return day.year * 12 + day.month


def spells(
    purchases: DataFrame, first: str | dt.date, last: str | dt.date, trailing_months: int | None = None
) -> DataFrame:
    """Periods of unchanged indicators per customer, for snapshots at month starts.

    The snapshots are the firsts of the months from ``first`` to ``last``, numbered from
    zero. A customer's totals only change in months with purchases (or, with a trailing
    window, when purchases leave it). One row covers all snapshots ``from_no <= no <
    to_no``, and also holds the totals before the change. The purchases are read once
    and reduced to (customer, month) before anything else.
    """
    first, last = _day(first), _day(last)
    if first.day != 1 or last.day != 1 or last < first:
        raise ValueError("first and last must be month starts, in order")
    n = _month_number(last) - _month_number(first) + 1

    seen = purchases.where(F.col("ts") < midnight(last))
    month = F.year("ts") * 12 + F.month("ts") - _month_number(first) + 1
    if trailing_months is None:
        month = F.greatest(month, F.lit(0))  # everything older belongs to the first snapshot
    else:
        earliest = _month_number(first) - trailing_months - 1
        seen = seen.where(F.col("ts") >= midnight(dt.date(earliest // 12, earliest % 12 + 1, 1)))

    monthly = (
        seen.select("customer_id", month.cast("int").alias("no"), "ts", "amount")
        .groupBy("customer_id", "no")
        .agg(*indicator_aggregates())
    )
    if trailing_months is not None:
        arrive = F.struct("no", "last_purchase", "frequency", "monetary")
        leave = F.struct(
            (F.col("no") + trailing_months).alias("no"),
            F.lit(None).cast("date").alias("last_purchase"),
            (-F.col("frequency")).alias("frequency"),
            (-F.col("monetary")).cast("decimal(38,2)").alias("monetary"),
        )
        # Spread by customer: the merge below and the windows then need no further shuffle.
        monthly = (
            monthly.select("customer_id", F.explode(F.array(arrive, leave)).alias("c"))
            .select("customer_id", "c.*")
            .repartition("customer_id")
            .groupBy("customer_id", "no")
            .agg(
                F.max("last_purchase").alias("last_purchase"),
                F.sum("frequency").alias("frequency"),
                F.sum("monetary").cast("decimal(38,2)").alias("monetary"),
            )
        )

    in_order = Window.partitionBy("customer_id").orderBy("no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = monthly.select(
        "customer_id",
        "no",
        F.max("last_purchase").over(so_far).alias("last_purchase"),
        F.sum("frequency").over(so_far).alias("frequency"),
        F.sum("monetary").over(so_far).cast("decimal(38,2)").alias("monetary"),
        F.lead("no", 1, n).over(in_order).alias("next_no"),
    )
    before = [F.lag(c).over(in_order).alias(f"prev_{c}") for c in ("last_purchase", "frequency", "monetary")]
    return (
        totals.select("*", *before)
        .withColumn("from_no", F.greatest("no", F.lit(0)))
        .withColumn("to_no", F.least("next_no", F.lit(n)))
        .where("from_no < to_no")
        .drop("no", "next_no")
    )


def _as_of(first: str | dt.date, number: Column) -> Column:
    return F.add_months(date_literal(first), number)


def unfold(spells_table: DataFrame, first: str | dt.date) -> DataFrame:
    """One row per customer and snapshot. Happens inside each task, without a shuffle."""
    return (
        spells_table.where("frequency > 0")
        .select(
            F.explode(F.sequence("from_no", F.col("to_no") - 1)).alias("no"),
            "customer_id", "last_purchase", "frequency", "monetary",
        )
        .withColumn("as_of", _as_of(first, F.col("no")))
        .withColumn("recency_days", days_since(F.col("as_of"), F.col("last_purchase")))
        .select("as_of", "customer_id", "last_purchase", "recency_days", "frequency", "monetary")
    )


def snapshots(
    purchases: DataFrame, first: str | dt.date, last: str | dt.date, trailing_months: int | None = None
) -> DataFrame:
    """The three indicators of every customer at every month start."""
    return unfold(spells(purchases, first, last, trailing_months), first)


def segment_series(series: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, k: int = 5) -> DataFrame:
    """Score each snapshot against the customers of the same date, and assign segments."""
    cuts = rank_cuts(series, k, by=["as_of"])
    return assign_segments(apply_cutpoints(series, cuts, k, by=["as_of"]), rules, k)


def migration(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many customers moved from which segment to which, between two snapshots.

    A customer found on one side only comes from, or goes to, ``(none)``.
    """
    return (
        before.select("customer_id", F.col("segment").alias("from_segment"))
        .join(after.select("customer_id", F.col("segment").alias("to_segment")), "customer_id", "full_outer")
        .groupBy(
            F.coalesce("from_segment", F.lit(NOBODY)).alias("from_segment"),
            F.coalesce("to_segment", F.lit(NOBODY)).alias("to_segment"),
        )
        .agg(F.count("*").alias("customers"))
    )


def migration_between(
    purchases: DataFrame, before: str | dt.date, after: str | dt.date, rules: Sequence[Rule] = DEFAULT_RULES, k: int = 5
) -> DataFrame:
    """The same from the purchases, which are read and reduced to customers once for both dates."""
    dates = {"before": before, "after": after}
    sums = [
        column
        for name, day in dates.items()
        for column in (
            F.to_date(F.max(F.when(_bought_before(day), F.col("ts")))).alias(f"last_{name}"),
            F.count(F.when(_bought_before(day), 1)).alias(f"frequency_{name}"),
        )
    ]
    both = materialize(purchases.groupBy("customer_id").agg(*sums), "two-dates")

    def segmented(name: str) -> DataFrame:
        base = both.where(F.col(f"frequency_{name}") > 0).select(
            "customer_id", days_since(dates[name], F.col(f"last_{name}")).alias("recency_days"), F.col(f"frequency_{name}").alias("frequency")
        )
        scored = apply_cutpoints(base, rank_cuts(base, k, indicators=("r", "f")), k, indicators=("r", "f"))
        return scored.select("customer_id", segment_of(rules, k).alias("segment"))

    validate_rules(rules, k)
    return migration(segmented("before"), segmented("after"))


def _bought_before(day: str | dt.date) -> Column:
    return (F.col("ts") < midnight(day)) & (F.col("amount") >= 0)


def migration_by_lag(segmented: DataFrame, first: str | dt.date) -> DataFrame:
    """The same over a stored series of monthly segments that begins at ``first``.

    A customer without a row for the month before comes from ``(none)``; one who drops out of the series is
    not reported as leaving it, which ``migration_series`` does. Shuffles every row of the series by customer; when
    the purchases are at hand, ``migration_series`` does without."""
    in_order = Window.partitionBy("customer_id").orderBy("as_of")
    return (
        segmented.select(
            "customer_id", "as_of", F.col("segment").alias("to_segment"),
            F.when(F.lag("as_of").over(in_order) == F.add_months("as_of", F.lit(-1)), F.lag("segment").over(in_order))
            .otherwise(NOBODY).alias("from_segment"),
        )
        .where(F.col("as_of") > date_literal(first))
        .groupBy("as_of", "from_segment", "to_segment")
        .agg(F.count("*").alias("customers"))
    )


def _dated_moves(
    purchases: DataFrame, first: str | dt.date, last: str | dt.date, trailing_months: int | None, rules: Sequence[Rule], k: int, own: bool
) -> DataFrame:
    """(as_of, customer_id, from_segment, to_segment) for each month start and customer, and with ``own`` also own_segment.

    A spell knows a customer's totals now and before its start, so all segments can be
    computed in place from the cut values of two dates.
    """
    validate_rules(rules, k)
    table = materialize(spells(purchases, first, last, trailing_months), "spells")
    cuts = rank_cuts(unfold(table, first), k, by=["as_of"], indicators=("r", "f"))

    starts = F.col("no") == F.col("from_no")
    now = ("last_purchase", "frequency", "monetary")
    dated = (
        table.select("*", F.explode(F.sequence("from_no", F.col("to_no") - 1)).alias("no"))
        .where("no > 0 AND (frequency > 0 OR (no = from_no AND prev_frequency > 0))")
        .select(
            "customer_id",
            _as_of(first, F.col("no")).alias("as_of"),
            _as_of(first, F.col("no") - 1).alias("previous"),
            *now,
            *[F.when(starts, F.col(f"prev_{c}")).otherwise(F.col(c)).alias(f"was_{c}") for c in now],
        )
    )

    def segment_at(df: DataFrame, date: str, prefix: str, name: str, cuts_of: str | None = None) -> DataFrame:
        """The segment by totals as of ``date``, under the cuts of that date or of another."""
        recency = f"date_diff({date}, {prefix}last_purchase)"
        frequency = f"{prefix}frequency"
        limits = comparable(cuts).select(F.col("as_of").alias(cuts_of or date), "r_cuts", "f_cuts")
        scored = df.join(F.broadcast(limits), cuts_of or date, "left")  # one row a month
        scored = scored.withColumns(
            {
                "r_score": F.expr(score_sql("r", recency, [f"r_cuts[{j}]" for j in range(k - 1)])),
                "f_score": F.expr(score_sql("f", frequency, [f"f_cuts[{j}]" for j in range(k - 1)])),
            }
        )
        known = F.when(F.col(frequency) > 0, segment_of(rules, k)).otherwise(NOBODY)
        return scored.select(*df.columns, known.alias(name))

    moved = segment_at(segment_at(dated, "previous", "was_", "from_segment"), "as_of", "", "to_segment")
    if own:
        # Nobody was there before the first customers came, so nothing but their own purchases has moved them.
        moved = segment_at(moved, "as_of", "", "own_segment", "previous").withColumn("own_segment", F.coalesce("own_segment", "to_segment"))
    return moved


def migration_series(
    purchases: DataFrame,
    first: str | dt.date,
    last: str | dt.date,
    trailing_months: int | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    k: int = 5,
) -> DataFrame:
    """Moves between segments from each month start to the next.

    Nothing larger than the (from, to) counts is shuffled after the spells themselves.
    """
    moved = _dated_moves(purchases, first, last, trailing_months, rules, k, own=False)
    return moved.groupBy("as_of", "from_segment", "to_segment").agg(F.count("*").alias("customers"))


def migration_decomposed(
    purchases: DataFrame,
    first: str | dt.date,
    last: str | dt.date,
    trailing_months: int | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    k: int = 5,
) -> DataFrame:
    """The same moves in two steps: ``from_segment`` to ``own_segment`` by a customer's own behaviour, and on to
    ``to_segment`` because all others changed.

    Scores are relative, so a customer can change segment without doing anything. ``own_segment`` is where the
    later indicators would be under the cut values of the earlier date. Summed over it, the result is
    ``migration_series``. The purchases are read and reduced once, as there.
    """
    moved = _dated_moves(purchases, first, last, trailing_months, rules, k, own=True)
    return moved.groupBy("as_of", "from_segment", "own_segment", "to_segment").agg(F.count("*").alias("customers"))


def segment_flows(decomposed: DataFrame) -> DataFrame:
    """For each month start and segment: customers before, the net change by own behaviour and by the others', customers after.

    ``before + own_change + population_change = after``; those who were or are in no segment are under ``(none)``.
    """
    def part(segment: str, before: int, own: int, population: int, after: int):
        names = ("before", "own_change", "population_change", "after")
        return F.struct(F.col(segment).alias("segment"), *[(F.col("customers") * n).alias(name) for name, n in zip(names, (before, own, population, after))])

    parts = F.array(part("from_segment", 1, -1, 0, 0), part("own_segment", 0, 1, -1, 0), part("to_segment", 0, 0, 1, 1))
    rows = decomposed.select("as_of", F.explode(parts).alias("part")).select("as_of", "part.*")
    return rows.groupBy("as_of", "segment").agg(*[F.sum(c).alias(c) for c in ("before", "own_change", "population_change", "after")])


def why_moved(decomposed: DataFrame) -> DataFrame:
    """For each month start: customers who stayed, and who moved by their own behaviour, by the others', or by both.

    ``offset`` are those whom their own behaviour would have moved, but the others' change kept in place."""
    stayed = F.col("from_segment") == F.col("to_segment")
    own = F.col("from_segment") != F.col("own_segment")
    others = F.col("own_segment") != F.col("to_segment")
    cases = {
        "stayed": stayed & ~own, "offset": stayed & own, "by_own": ~stayed & own & ~others, "by_population": ~stayed & ~own, "by_both": ~stayed & own & others,
    }
    return decomposed.groupBy("as_of").agg(*[F.sum(F.when(case, F.col("customers")).otherwise(0)).alias(name) for name, case in cases.items()])

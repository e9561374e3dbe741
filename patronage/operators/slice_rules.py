"""Segment rules on raw indicators, a set for each slice, proven and applied in Spark.

A rule covers a rectangle of recency days and purchase counts; an open end is NULL. A slice's rules must cover every pair
exactly once. Rules are a table like any other, however many slices there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rules that are broadcast: some hundred kilobytes. More are joined by a shuffle on the slice.
FEW_RULES = 10_000
#: Stands for an open end.
LOWEST, HIGHEST = 0, (1 << 62)
BOUNDS = {"r_lo": LOWEST, "r_hi": HIGHEST, "f_lo": LOWEST, "f_hi": HIGHEST}


def closed(rules: DataFrame) -> DataFrame:
    """Rules (slice, segment, r_lo, r_hi, f_lo, f_hi) with numbers for open ends; bounds belong to the rule."""
    return rules.select("slice", "segment", *[F.coalesce(F.col(c).cast("bigint"), F.lit(end)).alias(c) for c, end in BOUNDS.items()])


def rule_faults(rules: DataFrame) -> DataFrame:
    """(slice, r_from, f_from, fault): where a slice's rules leave a gap or overlap, empty if they are total and disjoint.

    The bounds of recency cut a slice into strips in which the same rules apply; in each strip, rules in order of frequency must follow
    each other without gap or overlap, from the lowest to the highest. Windows hold the rules of one slice and strip.
    """
    table = closed(rules)
    wrong = table.where("r_lo > r_hi OR f_lo > f_hi").select("slice", F.col("r_lo").alias("r_from"), F.col("f_lo").alias("f_from"), F.lit("empty rule").alias("fault"))
    edges = F.array(F.lit(LOWEST), F.col("r_lo"), F.col("r_hi") + 1)
    starts = table.select("slice", F.explode(edges).alias("r_from")).where(F.col("r_from").between(LOWEST, HIGHEST)).distinct()
    inside = (table["r_lo"] <= F.col("r_from")) & (table["r_hi"] >= F.col("r_from")) & (table["f_lo"] <= table["f_hi"])
    strips = starts.alias("s").join(table, F.col("s.slice").eqNullSafe(table["slice"]) & inside, "left")
    strips = strips.select("s.slice", "r_from", "f_lo", "f_hi")
    # "reached" is the highest count that any rule before covers, so an overlap with a longer rule further back is seen too
    before = Window.partitionBy("slice", "r_from").orderBy("f_lo", "f_hi").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("slice", "r_from").orderBy("f_lo", "f_hi")
    expected = F.coalesce(F.max("f_hi").over(before) + 1, F.lit(LOWEST))
    seen = strips.withColumn("expected", expected).withColumn("final", F.lead("f_lo").over(after).isNull()).withColumn("reached", F.greatest("f_hi", F.col("expected") - 1))
    fault = F.when(F.col("f_lo").isNull() | (F.col("f_lo") > F.col("expected")), "gap").when(F.col("f_lo") < F.col("expected"), "overlap")
    inner = seen.select("slice", "r_from", F.least(F.coalesce("f_lo", "expected"), "expected").alias("f_from"), fault.alias("fault")).where("fault IS NOT NULL")
    open_top = seen.where(F.col("final") & (F.col("reached") < HIGHEST)).select("slice", "r_from", (F.col("reached") + 1).alias("f_from"), F.lit("gap").alias("fault"))
    return wrong.unionAll(inner).unionAll(open_top).distinct()


def assign_by_slice(base: DataFrame, rules: DataFrame, slice: str) -> DataFrame:
    """Add ``segment`` by the rules of each customer's slice; NULL for a slice without rules.

    Rules are checked first. They are counted, too: up to ``FEW_RULES`` are broadcast, and a slice with a third of the customers
    stays where it is; beyond, rules and customers meet by slice, where Spark splits large slices.
    """
    faults = rule_faults(rules).limit(5).collect()
    if faults:
        raise ValueError(f"rules are not total and disjoint: {[tuple(row) for row in faults]}")
    table = closed(rules).withColumnRenamed("slice", "rule_slice")
    table = F.broadcast(table) if rules.limit(FEW_RULES + 1).count() <= FEW_RULES else table
    fits = (
        base[slice].eqNullSafe(F.col("rule_slice"))
        & base["recency_days"].between(F.col("r_lo"), F.col("r_hi"))
        & base["frequency"].between(F.col("f_lo"), F.col("f_hi"))
    )
    return base.join(table, fits, "left").select(*base.columns, "segment")

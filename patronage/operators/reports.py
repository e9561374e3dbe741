"""Result tables for a dashboard: one small table per question, plus customer lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.columns import count_if, share
from patronage.operators.order_stats import around, exact_cuts, running_totals, spread

MONEY_SUM = "decimal(38,2)"
UNKNOWN = "(unknown)"


def _money_sum(column: str | Column) -> Column:
    return F.sum(column).cast(MONEY_SUM)


def _revenue_share() -> Column:
    """A summary row's part of the revenue of all summary rows."""
    return share(F.col("revenue"), F.sum("revenue").over(Window.partitionBy()).cast(MONEY_SUM))


def segment_summary(segments: DataFrame) -> DataFrame:
    """Size, revenue and shares of each segment. The shares run over the summary rows."""
    everyone = Window.partitionBy()
    return (
        segments.groupBy("segment")
        .agg(
            F.count("*").alias("customers"),
            _money_sum("monetary").alias("revenue"),
            F.min("monetary").alias("min_monetary"),
            F.max("monetary").alias("max_monetary"),
            F.sum("frequency").alias("purchases"),
            F.min("recency_days").alias("min_recency"),
            F.max("recency_days").alias("max_recency"),
        )
        .withColumn(
            "customer_share", F.col("customers").cast("double") / F.sum("customers").over(everyone)
        )
        .withColumn("revenue_share", _revenue_share())
    )


def tier_rollup(segments: DataFrame) -> DataFrame:
    """Customers and revenue by tier and segment with subtotals and the grand total.

    Customers are counted once; the rollup only multiplies the counts.
    """
    fine = segments.groupBy("value_tier", "segment").agg(F.count("*").alias("n"), F.sum("monetary").alias("m"))
    return fine.rollup("value_tier", "segment").agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("customers"),
        _money_sum("m").alias("revenue"),
    )


def rf_matrix(scored: DataFrame, k: int = 5) -> DataFrame:
    """Customers in each (R, F) cell, one row per R score (also without customers) and one column per F score."""
    levels = list(range(1, k + 1))
    counted = scored.groupBy("r_score").pivot("f_score", levels).agg(F.count(F.lit(1)))
    rows = scored.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("r_score"))
    return rows.join(counted, "r_score", "left").select(
        "r_score", *[F.coalesce(F.col(str(f)), F.lit(0)).alias(f"f{f}") for f in levels]
    )


def value_classes(base: DataFrame, a_percent: int = 80, b_percent: int = 95) -> DataFrame:
    """ABC classes: A while the customers strictly ahead hold under 80% of revenue, B under
    95%, C after that. Customers with equal revenue always share a class.

    With revenue summed from the bottom, class A starts at the first value whose running
    total exceeds the other 20%: a weighted order statistic. Totals are whole cents and
    the bounds whole percents, so "exceeds" is "reaches 0.0001 more". A customer whose
    refunds outweigh the purchases adds nothing to the total.
    """
    weighed = base.select("monetary", F.greatest("monetary", F.lit(0)).alias("weight"))
    targets = {
        j: f"total * {100 - percent} / 100 + 0.0001BD" for j, percent in ((1, a_percent), (2, b_percent))
    }
    cuts = exact_cuts(weighed, (), "monetary", targets, spread(), weight="weight").agg(
        F.max(F.when(F.col("j") == 1, F.col("cut"))).alias("a_from"),
        F.max(F.when(F.col("j") == 2, F.col("cut"))).alias("b_from"),
    )
    value = F.col("monetary")
    a_from, b_from = (F.lit(cut).cast(MONEY_SUM) for cut in cuts.first())
    abc = F.when(value >= a_from, "A").when(value >= b_from, "B").otherwise("C")
    return base.select("customer_id", "monetary", abc.alias("abc_class"))


def class_summary(classes: DataFrame) -> DataFrame:
    return (
        classes.groupBy("abc_class")
        .agg(F.count("*").alias("customers"), _money_sum("monetary").alias("revenue"))
        .withColumn("revenue_share", _revenue_share())
    )


def pareto(base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The concentration curve: for each distinct revenue value, how many customers have
    it, the rank they share, and the revenue of everyone ahead. With ``by``, a curve for each group."""
    return running_totals(base, "monetary", "monetary", by).select(
        *by,
        "monetary",
        F.col("n_rows").alias("customers"),
        (F.col("rows_above") + 1).alias("revenue_rank"),
        F.col("weight_above").cast(MONEY_SUM).alias("revenue_above"),
        (F.col("weight_above") + F.col("weight")).cast(MONEY_SUM).alias("revenue_through"),
    )


def with_region(base: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """``base`` with each customer's ``r_name``; what the tables do not tell is ``(unknown)``. Spark chooses the joins by size."""
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select("n_nationkey", "r_name")
    lives = customer.select(F.col("c_custkey").alias("customer_id"), "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    named = base.join(lives.select("customer_id", "r_name"), "customer_id", "left")
    return named.withColumn("r_name", F.coalesce("r_name", F.lit(UNKNOWN)))


def top_share(base: DataFrame, percents: Sequence[int] = (1, 5, 10, 20, 50)) -> DataFrame:
    """Revenue held by the best 1%, 5%, ... of customers (their number rounded up).

    The value at the boundary is found exactly; customers above it count in full and
    those on it fill the remaining places, so no tie-break is needed.
    """
    targets = {p: f"total - ({p} * total + 99) div 100 + 1" for p in percents}
    cuts = exact_cuts(base, (), "monetary", targets, around([1 - p / 100 for p in percents])).collect()  # one row a percentage
    value = F.col("monetary")
    sums = [
        F.struct(
            F.lit(row["j"]).alias("top_percent"),
            F.lit(row["cut"]).cast(MONEY_SUM).alias("cut"),
            count_if(value > F.lit(row["cut"])).alias("n_above"),
            _money_sum(F.when(value > F.lit(row["cut"]), value).otherwise(0)).alias("above"),
        )
        for row in cuts
    ]
    found = base.agg(F.count("*").alias("customers_total"), _money_sum("monetary").alias("revenue_total"), F.array(*sums).alias("tops"))
    if not cuts:
        found = found.withColumn("tops", F.expr(f"CAST(array() AS array<struct<top_percent:int,cut:{MONEY_SUM},n_above:bigint,above:{MONEY_SUM}>>)"))
    ahead = found.select("customers_total", "revenue_total", F.inline("tops")).withColumn(
        "customers", F.expr("(top_percent * customers_total + 99) div 100")
    )
    on_cut = ((F.col("customers") - F.col("n_above")).cast("decimal(19,0)") * F.col("cut")).cast(MONEY_SUM)
    return ahead.withColumn("revenue", (F.col("above") + on_cut).cast(MONEY_SUM)).select(
        "top_percent",
        "customers",
        "revenue",
        share(F.col("revenue"), F.col("revenue_total")).alias("revenue_share"),
    )


def _named(fine: DataFrame, nation: DataFrame, region: DataFrame, *labels: str) -> DataFrame:
    """Summary rows with the names of their nation and region; a missing label is ``(unknown)``."""
    named = fine.join(nation, fine.c_nationkey == nation.n_nationkey, "left").join(
        region, nation.n_regionkey == region.r_regionkey, "left"
    )
    return named.withColumns({label: F.coalesce(label, F.lit(UNKNOWN)) for label in labels})


def by_attribute(
    segments: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Segments sliced by region and market segment, with all subtotals.

    What the customer, nation and region tables do not tell is ``(unknown)``, so the grand
    total is that of all customers. Customers are first counted per (nation, market segment, segment); names and the cube
    are then applied to those few rows, so the cube does not multiply customers. Spark
    chooses how to join the dimension tables from their actual size.
    """
    fine = (
        segments.join(customer, segments.customer_id == customer.c_custkey, "left")
        .groupBy("c_nationkey", "c_mktsegment", "segment")
        .agg(F.count("*").alias("n"), F.sum("monetary").alias("m"))
    )
    return _named(fine, nation, region, "r_name", "c_mktsegment").cube("r_name", "c_mktsegment", "segment").agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("customers"),
        _money_sum("m").alias("revenue"),
    )


def by_nation(segments: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Two slices in one table, by (region, segment) and by (nation, segment)."""
    fine = (
        segments.join(customer, segments.customer_id == customer.c_custkey, "left")
        .groupBy("c_nationkey", "segment")
        .agg(F.count("*").alias("n"), F.sum("monetary").alias("m"))
    )
    named = _named(fine, nation, region, "r_name", "n_name")
    region_name, nation_name, segment = F.col("r_name"), F.col("n_name"), F.col("segment")
    return named.groupingSets(
        [[region_name, segment], [nation_name, segment]], region_name, nation_name, segment
    ).agg(
        F.grouping("r_name").cast("int").alias("is_nation"),
        F.sum("n").alias("customers"),
        _money_sum("m").alias("revenue"),
    )


def top_customers(segments: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best customers of each segment; each task keeps ``n`` rows before the shuffle."""
    best = Window.partitionBy("segment").orderBy(F.desc("monetary"), "customer_id")
    return (
        segments.select("segment", "customer_id", "monetary", "frequency", "recency_days")
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= n)
    )



"""Segments found from the data: k-means on log-scaled, standardised indicators.

``fit_clusters`` runs in whole numbers, so it gives the same clusters on every run and every number of partitions;
``cluster_customers`` is the library's k-means.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators.order_stats import around, exact_cuts
from patronage.session import materialize


def cluster_customers(base: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Add a ``cluster`` number. All three fits run distributed over the customers."""
    scaled = base.select(
        *base.columns,
        F.log1p(F.col("recency_days").cast("double")).alias("log_r"),
        F.log1p(F.col("frequency").cast("double")).alias("log_f"),
        F.log1p(F.greatest(F.col("monetary").cast("double"), F.lit(0.0))).alias("log_m"),
    )
    stages = [
        VectorAssembler(inputCols=["log_r", "log_f", "log_m"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"),
    ]
    return Pipeline(stages=stages).fit(scaled).transform(scaled).select(*base.columns, "cluster")


#: Fixed point: logarithms are counted in millionths, standardised values in thousandths.
LOG_STEPS, UNIT_STEPS = 1_000_000, 1_000
PLACES = ("good_r", "good_f", "good_m")


def _rounded(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def standardised(base: DataFrame) -> DataFrame:
    """``base`` with good_r, good_f and good_m: logarithms of the indicators in thousandths of a standard deviation
    from the mean, more being better. An indicator that is the same for all is 0. Written once, for the rounds to read."""
    def log(name: str) -> Column:
        return _rounded(F.log(F.greatest(F.col(name).cast("double"), F.lit(0.0)) + 1.0) * LOG_STEPS)

    logs = base.select("*", (-log("recency_days")).alias("good_r"), log("frequency").alias("good_f"), log("monetary").alias("good_m"))
    logs = materialize(logs, "logs")
    whole = lambda c: c.cast("decimal(38,0)")
    sums = [F.sum(whole(F.col(c))).alias(c) for c in PLACES] + [F.sum(whole(F.col(c) * F.col(c))).alias(f"{c}_2") for c in PLACES]
    row = logs.agg(F.count("*").alias("n"), *sums).first()
    scaled = {}
    for c in PLACES:
        spread = row["n"] * int(row[f"{c}_2"] or 0) - int(row[c] or 0) ** 2  # n times the standard deviation, squared
        away = F.col(c) * row["n"] - int(row[c] or 0)
        scaled[c] = _rounded(away.cast("double") * float(UNIT_STEPS) / F.lit(math.sqrt(float(spread)))) if spread else F.lit(0).cast("bigint")
    return materialize(logs.withColumns(scaled), "standardised")


def first_centres(points: DataFrame, k: int) -> list[list[int]]:
    """Centres at exact quantiles of each place: the middles of k parts of equal size, from the worst to the best."""
    targets = {j: f"({2 * j + 1} * total + {2 * k - 1}) div {2 * k}" for j in range(k)}
    stacked = points.selectExpr("stack(3, " + ", ".join(f"'{c}', {c}" for c in PLACES) + ") AS (place, good)")
    found = exact_cuts(stacked, ["place"], "good", targets, around([(2 * j + 1) / (2 * k) for j in range(k)])).collect()  # 3 k rows
    cut = {(row["place"], row["j"]): int(row["cut"]) for row in found}
    return [[cut[c, j] for c in PLACES] for j in range(k)] if cut else []


def _nearest(centres: Sequence[Sequence[int]]) -> Column:
    """The number of the nearest centre; the smaller one if several are as near."""
    def apart(centre: Sequence[int]) -> Column:
        return functools.reduce(operator.add, [(F.col(c) - x) * (F.col(c) - x) for c, x in zip(PLACES, centre)])

    return F.array_min(F.array(*[F.struct(apart(centre).alias("d"), F.lit(i).alias("cluster")) for i, centre in enumerate(centres)]))["cluster"]


def fit_centres(points: DataFrame, k: int = 5, rounds: int = 10) -> list[list[int]]:
    """Lloyd's rounds over standardised customers: each centre moves to the floored mean of those nearest to it.

    A round sums up before its shuffle and sends k rows; a centre that nobody is nearest to stays. Ends early when nothing moves.
    """
    centres = first_centres(points, k)
    for _ in range(rounds if centres else 0):
        sums = points.groupBy(_nearest(centres).alias("cluster")).agg(F.count("*").alias("n"), *[F.sum(F.col(c)).alias(c) for c in PLACES]).collect()
        moved = [list(centre) for centre in centres]
        for row in sums:
            moved[row["cluster"]] = [row[c] // row["n"] for c in PLACES]
        if moved == centres:
            break
        centres = moved
    return centres


def fit_clusters(base: DataFrame, k: int = 5, rounds: int = 10) -> DataFrame:
    """Add a ``cluster`` number, from 0; the same on every run. No customers, no rows."""
    points = standardised(base)
    centres = fit_centres(points, k, rounds)
    number = _nearest(centres) if centres else F.lit(0)
    return points.select(*base.columns, number.alias("cluster"))


def nearest_centre(base: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Add the number of the nearest of some kept centres, so that clusters stay comparable
    between dates. A centre is (days, purchases, revenue); distances are between logarithms,
    and the first of equally near centres wins."""
    place = [F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in ("recency_days", "frequency", "monetary")]
    apart = [
        F.struct(sum((p - math.log1p(x)) * (p - math.log1p(x)) for p, x in zip(place, centre)).alias("d"), F.lit(i).alias("cluster"))
        for i, centre in enumerate(centres)
    ]
    return base.withColumn("cluster", F.array_min(F.array(*apart))["cluster"])


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Size, revenue and average indicators of each cluster."""
    return clustered.groupBy("cluster").agg(
        F.count("*").alias("customers"),
        F.sum("monetary").cast("decimal(38,2)").alias("revenue"),
        F.avg(F.col("recency_days").cast("double")).alias("mean_recency"),
        F.avg(F.col("frequency").cast("double")).alias("mean_frequency"),
    )

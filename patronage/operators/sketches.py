"""Cut values from mergeable quantile sketches, kept by date.

A sketch of some ten kilobytes stands for the values of one indicator at one date. Sketches of
any dates can be merged, so cut values for a quarter, a year or all time take no customer's row
again; a new month adds one row. They are approximate: see ``rank_error``. Exact cuts are in ``scoring``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.operators.scoring import CUT, VALUES
from patronage.sources.sinks import read_snapshots, write_snapshot

#: Size of a sketch: values it keeps in its smallest compactor. Must be the same for all that are merged.
ACCURACY = 800
#: Sketches of days and counts are of whole numbers, those of money of doubles, which hold cents up to 90 trillion.
KINDS = {"r": "bigint", "f": "bigint", "m": "double"}


def rank_error(accuracy: int = ACCURACY) -> float:
    """How far, as a share of all values, the rank of a sketched quantile may be off.

    Twice the published error of the sketch at 99% confidence, which is about five standard deviations.
    """
    return 2 * 2.296 / accuracy**0.9723


def sketched(base: DataFrame, by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """One row for each group: its customers, and a sketch of each indicator.

    Sketches are combined before the shuffle, so a group of any size sends one per task. NULL is a group; a NULL value is
    left out of its sketch.
    """
    sketches = [getattr(F, f"kll_sketch_agg_{KINDS[i]}")(F.col(VALUES[i]).cast(KINDS[i]), accuracy).alias(f"{i}_sketch") for i in KINDS]
    return base.groupBy(*by).agg(F.count("*").alias("customers"), *sketches)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of larger groups from those of smaller ones. Reads sketches only."""
    parts = [getattr(F, f"kll_merge_agg_{KINDS[i]}")(f"{i}_sketch").alias(f"{i}_sketch") for i in KINDS]
    return sketches.groupBy(*by).agg(F.sum("customers").alias("customers"), *parts)


def sketched_cuts(sketches: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """A cut table (see ``scoring``) from a table of sketches: the k-quantiles of each indicator, to be kept and applied."""
    places = F.array(*[F.lit(j / k) for j in range(1, k)])

    def cuts(i: str):
        found = getattr(F, f"kll_sketch_get_quantile_{KINDS[i]}")(f"{i}_sketch", places)
        return found.cast(f"array<{CUT.simpleString()}>").alias(f"{i}_cuts")

    return sketches.select(*by, *[cuts(i) for i in KINDS])


def keep_sketches(series: DataFrame, path: str, accuracy: int = ACCURACY) -> None:
    """Write the sketches of each ``as_of`` of a series; a date that is written again replaces itself."""
    write_snapshot(sketched(series, ["as_of"], accuracy), path)


def window_cuts(spark: SparkSession, path: str, first: str | dt.date, last: str | dt.date, k: int = 5) -> DataFrame:
    """Cuts over all customers of all kept dates from ``first`` to ``last``, as one cut table without groups."""
    kept = read_snapshots(spark, path).where(F.col("as_of").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return sketched_cuts(merged(kept).where("customers > 0"), k)


def rank_of_cuts(series: DataFrame, cuts: DataFrame, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """(by..., indicator, cut_no, customers, off): how far the rank of each cut in ``series`` is from where it belongs, counted exactly.

    ``off`` is a share of the customers, 0 where the cut's value takes up its place. Cuts are a few numbers for each group.
    """
    each = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(f"{i}_cuts").alias("cuts")) for i in KINDS])
    named = cuts.select(*by, F.explode(each).alias("e")).select(*by, "e.indicator", F.posexplode("e.cuts").alias("place", "cut"))
    value = F.coalesce(*[F.when(F.col("indicator") == i, F.col(VALUES[i]).cast(CUT)) for i in KINDS])
    joined = series.join(F.broadcast(named), list(by)) if by else series.crossJoin(F.broadcast(named))
    counted = joined.groupBy(*by, "indicator", "place").agg(
        F.count("*").alias("customers"), F.sum((value < F.col("cut")).cast("bigint")).alias("below"), F.sum((value <= F.col("cut")).cast("bigint")).alias("through")
    )
    target = F.col("customers") * (F.col("place") + 1) / k
    off = F.greatest(F.col("below") - target, target - F.col("through"), F.lit(0.0)) / F.col("customers")
    return counted.select(*by, "indicator", (F.col("place") + 1).alias("cut_no"), "customers", off.cast("double").alias("off"))

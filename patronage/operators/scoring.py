"""Scores from 1 (worst) to k (best) for recency, frequency and monetary value.

Every scorer works in two steps: find the cut values (the only distributed work, and its
result is a few numbers per group), then compare each customer with them in a plain
projection. A cut table has one row per group (one row if there are none):

    by..., r_cuts ARRAY, f_cuts ARRAY, m_cuts ARRAY      elements DECIMAL(38,6)

A customer gains a point for each recency cut that ``recency_days`` does not exceed, and
for each frequency or monetary cut that the customer's value exceeds. Cut tables can be
kept and applied to later data, which keeps scores comparable between dates.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.columns import TOTAL_MONEY
from patronage.operators.order_stats import around, exact_cuts, few_groups, spread
from patronage.session import materialize, small_table

INDICATORS = ("r", "f", "m")

CUT = T.DecimalType(38, 6)
VALUES = {"r": "recency_days", "f": "frequency", "m": "monetary"}


#: Over the long layout, the value of which more is better. Days and counts stay whole
#: numbers until the few rows near a cut are compared exactly.
BEST = f"coalesce(money, CAST(whole AS {TOTAL_MONEY}))"
ABOUT_BEST = "coalesce(CAST(money AS DOUBLE), CAST(whole AS DOUBLE))"


def _as_cut(value: Decimal | int | float | str) -> Decimal:
    with localcontext() as exact:
        exact.prec = 60
        return Decimal(str(value)).quantize(Decimal("0.000001"), ROUND_HALF_UP)


def _long(base: DataFrame, by: Sequence[str], indicators: Sequence[str], *extra: str) -> DataFrame:
    """One row per customer and indicator, holding a whole number or money."""
    no_money, no_number = f"CAST(NULL AS {TOTAL_MONEY})", "CAST(NULL AS BIGINT)"
    rows = {
        "r": f"'r', -recency_days, {no_money}",
        "f": f"'f', frequency, {no_money}",
        "m": f"'m', {no_number}, CAST(monetary AS {TOTAL_MONEY})",
    }
    stacked = f"stack({len(indicators)}, {', '.join(rows[i] for i in indicators)}) AS (indicator, whole, money)"
    return base.selectExpr(*by, *extra, stacked)


def _search(
    base: DataFrame, by: Sequence[str], indicators: Sequence[str], k: int, targets: Mapping[int, str]
) -> DataFrame:
    """Look for the values at ``targets``, which lie near the k-quantiles."""
    near = around([j / k for j in range(1, k)])
    return exact_cuts(
        _long(base, by, indicators), [*by, "indicator"], BEST, targets, near, approx=ABOUT_BEST
    )


def _cut_table(found: DataFrame, by: Sequence[str], indicators: Sequence[str], cut: Callable[[str], Column]) -> DataFrame:
    """Lay out what a search found as a cut table: one row per group, written once.

    ``cut`` is the cut of one indicator from the columns of ``found``, in the order of ``j``;
    NULL for rows that make none. Nothing comes to the driver, however many groups there are.
    """
    def cuts(i: str) -> Column:
        row = F.when(F.col("indicator") == i, F.struct("j", cut(i).alias("cut")))
        return F.transform(F.sort_array(F.collect_list(row)), lambda x: x["cut"]).alias(f"{i}_cuts")

    table = found.groupBy(*by).agg(*[cuts(i) for i in indicators])
    return materialize(table.where(F.size(f"{indicators[0]}_cuts") > 0), "cuts")


def rank_cuts(
    base: DataFrame, k: int = 5, by: Sequence[str] = (), indicators: Sequence[str] = INDICATORS
) -> DataFrame:
    """Cuts that reproduce ``1 + k * (rank - 1) div n`` exactly.

    ``rank - 1`` counts the strictly worse customers. A customer reaches score ``j + 1``
    when at least ``j * n / k`` customers are strictly worse, that is when the customer
    is better than the customer at position ``ceil(j * n / k)`` from the bottom.
    """
    targets = {j: f"({j} * total + {k - 1}) div {k}" for j in range(1, k)}
    found = _search(base, by, indicators, k, targets)

    def cut(i: str) -> Column:
        # Better than -d means fewer days than d; days are whole, so at most d - 1.
        return (-F.col("cut") - 1 if i == "r" else F.col("cut")).cast(CUT)

    return _cut_table(found, by, indicators, cut)


def fit_cutpoints(base: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of the three indicators, to be kept and applied later.

    The quantile ``j / k`` lies at row ``j * (n - 1) / k`` counted from zero; its two
    neighbours are found exactly and the fraction between them in decimals.
    """
    base = base.withColumn("recency_days", -F.col("recency_days"))  # quantiles of the days themselves
    place = "{j} * (total - 1) div {k}"
    lower = {j: place.format(j=j, k=k) + " + 1" for j in range(1, k)}
    upper = {j + k: f"least({place.format(j=j, k=k)} + 2, total)" for j in range(1, k)}
    found = _search(base, by, INDICATORS, k, {**lower, **upper})

    lows = found.where(F.col("j") < k)
    highs = found.where(F.col("j") >= k).select(
        *[F.col(c).alias(f"high_{c}") for c in by], F.col("indicator").alias("high_indicator"), (F.col("j") - k).alias("high_j"), F.col("cut").alias("high")
    )
    same = (F.col("indicator") == F.col("high_indicator")) & (F.col("j") == F.col("high_j"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"high_{c}"))
    pairs = lows.join(highs, same)
    part = (F.col("j") * (F.col("total") - 1) % k).cast("decimal(5,0)")
    step = (F.col("high") - F.col("cut")).cast("decimal(30,2)") * part / F.lit(k).cast("decimal(5,0)")
    return _cut_table(pairs, by, INDICATORS, lambda i: (F.col("cut").cast(CUT) + step.cast(CUT)).cast(CUT))


def fixed_cuts(base: DataFrame, r: Sequence, f: Sequence, m: Sequence) -> DataFrame:
    """A cut table from numbers set by the business."""
    schema = T.StructType([T.StructField(f"{i}_cuts", T.ArrayType(CUT)) for i in INDICATORS])
    exact = [[_as_cut(c) for c in cuts] for cuts in (r, f, m)]
    return small_table(base.sparkSession, [exact], schema)


def comparable(cuts: DataFrame) -> DataFrame:
    """A cut table in the types of the indicators.

    Whole numbers and cents pass a cut exactly when they pass the cut rounded down, so
    customers are compared without converting each of their values to a wider type.
    """
    steps = {
        "r_cuts": "CAST(floor(c) AS BIGINT)",
        "f_cuts": "CAST(floor(c) AS BIGINT)",
        "m_cuts": f"CAST(floor(c, 2) AS {TOTAL_MONEY})",
    }
    return cuts.selectExpr(
        *[f"transform({c}, c -> {steps[c]}) AS {c}" if c in steps else c for c in cuts.columns]
    )


def score_sql(indicator: str, value: str, cuts: Sequence[str]) -> str:
    """One point, and one more for each cut passed, as SQL."""
    passes = "<=" if indicator == "r" else ">"
    return " + ".join(["1", *[f"CAST({value} {passes} {cut} AS INT)" for cut in cuts]])


def apply_cutpoints(
    base: DataFrame,
    cuts: DataFrame,
    k: int = 5,
    by: Sequence[str] = (),
    indicators: Sequence[str] = INDICATORS,
) -> DataFrame:
    """Add the score of each indicator: one comparison per cut, no shuffle of customers.

    Without groups the cuts become constants of a plain projection, and there must be one row of
    them (or none); with groups their table is broadcast if it is small, else joined by a
    shuffle. Customers of a group without cuts keep their row and get no score.
    """
    cuts = comparable(cuts)
    if by:
        cut = {i: [f"{i}_cuts[{j}]" for j in range(k - 1)] for i in indicators}
        theirs = cuts.select(*[F.col(c).alias(f"cut_{c}") for c in by], *[f"{i}_cuts" for i in indicators])
        theirs = F.broadcast(theirs) if few_groups(cuts, by) else theirs
        same = [base[c].eqNullSafe(F.col(f"cut_{c}")) for c in by]
        base_with_cuts = base.join(theirs, functools.reduce(operator.and_, same), "left")
    else:
        found = [row.asDict() for row in cuts.limit(2).collect()] or [{}]  # no row if the cuts were fitted to nobody
        if len(found) > 1:
            raise ValueError("a cut table without groups must have one row")
        unknown = ["CAST(NULL AS BIGINT)"]
        cut = {
            i: [f"{c}BD" if i == "m" else f"{c}L" for c in found[0].get(f"{i}_cuts", ())] or unknown
            for i in indicators
        }
        base_with_cuts = base
    scores = [f"{score_sql(i, VALUES[i], cut[i])} AS {i}_score" for i in indicators]
    return base_with_cuts.selectExpr(*base.columns, *scores)


def score_rank(
    base: DataFrame, k: int = 5, by: Sequence[str] = (), indicators: Sequence[str] = INDICATORS
) -> DataFrame:
    """The default score: equal behaviour always gets an equal score."""
    return apply_cutpoints(base, rank_cuts(base, k, by, indicators), k, by, indicators)


def score_fitted(base: DataFrame, k: int = 5) -> DataFrame:
    """Score by the data's own interpolated quantiles."""
    return apply_cutpoints(base, fit_cutpoints(base, k), k)


def score_fixed(base: DataFrame, r: Sequence, f: Sequence, m: Sequence) -> DataFrame:
    """Score by cut values set by the business, the same number for each indicator."""
    if not len(r) == len(f) == len(m):
        raise ValueError("give the same number of cuts for r, f and m")
    return apply_cutpoints(base, fixed_cuts(base, r, f, m), len(r) + 1)


def score_ntile(base: DataFrame, k: int = 5) -> DataFrame:
    """Groups of equal size, as NTILE over (value, customer_id) would form them.

    The boundary after group ``j`` is found as a value, and among the customers who share
    that value (possibly a third of them) as a customer id.
    """
    ends = {j: f"{j} * (total div {k}) + least({j}, total % {k})" for j in range(1, k)}
    at_value = _search(base, (), INDICATORS, k, ends).select(
        "indicator", F.col("j").alias("boundary"), "cut", (F.col("position") - F.col("below")).alias("place")
    )
    at_value = materialize(at_value, "boundaries")  # at most 3 * (k - 1) rows, also broadcast below
    by_customer = _long(base, (), INDICATORS, "customer_id").withColumn("cut", F.expr(BEST))
    tied = by_customer.join(F.broadcast(at_value), ["indicator", "cut"])
    at_id = exact_cuts(tied, ["indicator", "boundary", "place"], "customer_id", {1: "place"}, spread())
    ids = at_id.select("indicator", "boundary", F.col("cut").alias("id"))
    ends_at = F.broadcast(ids).join(F.broadcast(at_value), ["indicator", "boundary"])
    pairs = ends_at.select("indicator", F.col("boundary").alias("j"), F.struct("cut", "id").alias("cut"))
    found = _cut_table(pairs, (), INDICATORS, lambda i: F.col("cut")).collect()  # one row, or none
    values = found[0].asDict(recursive=True) if found else {}

    def score(i: str) -> str:
        value = "(-recency_days)" if i == "r" else VALUES[i]
        points = []
        for end in values.get(f"{i}_cuts", []):
            cut = f"{end['cut']}BD" if i == "m" else f"{int(end['cut'])}L"
            points.append(f"CAST({value} > {cut} OR ({value} = {cut} AND customer_id > {end['id']}L) AS INT)")
        return " + ".join(["1", *points])

    return base.selectExpr(*base.columns, *[f"{score(i)} AS {i}_score" for i in INDICATORS])


def _histogram_cuts(counts: DataFrame, value: Column, by: Sequence[str], indicator: str, k: int) -> DataFrame:
    """The cuts of ``rank_cuts`` for an indicator with few distinct values, from a table of (by..., value, n).

    Windows run over distinct days, or numbers of purchases, however many customers share one.
    """
    in_order = Window.partitionBy(*by).orderBy("good")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.groupBy(*by, value.alias("good")).agg(F.sum("n").alias("n"))
    summed = rows.select(*by, "good", F.sum("n").over(so_far).alias("through"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    reached = [F.min(F.when(F.col("through") * k >= F.col("total") * j, F.col("good"))) for j in range(1, k)]
    cuts = [(-cut - 1 if indicator == "r" else cut).cast(CUT) for cut in reached]
    return materialize(summed.groupBy(*by).agg(F.array(*cuts).alias(f"{indicator}_cuts")), "cuts")


def score_nested(base: DataFrame, k: int = 5) -> DataFrame:
    """Frequency scored within each recency score, monetary value within both.

    One pass counts customers by days and purchases; both cuts follow from these counts. Only money takes a search.
    """
    counts = materialize(base.groupBy("recency_days", "frequency").agg(F.count("*").alias("n")), "days-and-purchases")
    r_cuts = _histogram_cuts(counts, -F.col("recency_days"), (), "r", k)
    counts_by_r = apply_cutpoints(counts, r_cuts, k, indicators=["r"])
    f_cuts = _histogram_cuts(counts_by_r, F.col("frequency"), ["r_score"], "f", k)
    by_r = apply_cutpoints(base, r_cuts, k, indicators=["r"])
    by_rf = apply_cutpoints(by_r, f_cuts, k, by=["r_score"], indicators=["f"])
    return score_rank(by_rf, k, by=["r_score", "f_score"], indicators=["m"])

"""Cuts from merged sketches lie as near to exact ones as promised, and merging reads no customers."""

import io
import random
from contextlib import redirect_stdout

import builders as b
import pytest
from pyspark.sql import functions as F

from patronage.operators import scoring, sketches
from patronage.session import materialize, scratch_path
from patronage.sources.sinks import read_snapshots


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = [b.base_row(c, rng.randint(1, 900), 1 + int(rng.paretovariate(1)), round(rng.lognormvariate(4, 2), 2)) for c in range(20_000)]
    rows += [b.base_row(20_000 + c, 7, 3, "50.00") for c in range(10_000)]  # a third alike
    base = spark.createDataFrame(rows, b.BASE)
    return materialize(base.withColumn("as_of", F.expr("make_date(2024, CAST(1 + customer_id % 12 AS INT), 1)")), "series")


def test_merged_cuts_are_as_near_as_promised(spark, series):
    path = scratch_path(spark, "sketches")
    sketches.keep_sketches(series, path)
    for first, last in (("2024-01-01", "2024-12-01"), ("2024-03-01", "2024-05-01"), ("2024-07-01", "2024-07-01")):
        cuts = sketches.window_cuts(spark, path, first, last)
        inside = series.where(f"as_of BETWEEN DATE '{first}' AND DATE '{last}'")
        found = sketches.rank_of_cuts(inside, cuts).collect()
        assert len(found) == 12 and {r.customers for r in found} == {inside.count()}
        assert max(r.off for r in found) <= sketches.rank_error()


def test_a_wrong_cut_is_seen(spark, series):
    cuts = scoring.fixed_cuts(series, [1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4])
    assert max(r.off for r in sketches.rank_of_cuts(series, cuts).collect()) > 0.1
    exact = scoring.fit_cutpoints(series)
    assert max(r.off for r in sketches.rank_of_cuts(series, exact).collect()) < 1e-3


def test_small_groups_are_exact(spark):
    """A sketch that keeps every value knows them all."""
    base = b.base(spark, [(c, c, c, c) for c in range(1, 101)])
    cuts = sketches.sketched_cuts(sketches.sketched(base)).first()
    assert [int(x) for x in cuts.f_cuts] == [20, 40, 60, 80]
    scored = scoring.apply_cutpoints(base, sketches.sketched_cuts(sketches.sketched(base)))
    counts = {r.m_score: r["count"] for r in scored.groupBy("m_score").count().collect()}
    assert counts == dict.fromkeys(range(1, 6), 20)


def test_a_date_replaces_itself_and_no_customers_are_read_for_a_window(spark, series):
    path = scratch_path(spark, "sketches")
    sketches.keep_sketches(series, path)
    sketches.keep_sketches(series.where("as_of = DATE '2024-02-01'"), path)
    kept = read_snapshots(spark, path)
    assert kept.count() == 12 and kept.agg(F.sum("customers")).first()[0] == series.count()
    text = io.StringIO()
    with redirect_stdout(text):
        sketches.window_cuts(spark, path, "2024-01-01", "2024-06-01").explain()
    assert text.getvalue().count("FileScan") == 1 and "PartitionFilters: [isnotnull(as_of" in text.getvalue()


def test_nobody(spark):
    path = scratch_path(spark, "sketches")
    series = b.base(spark, [(1, 1, 1, 1)]).withColumn("as_of", F.to_date(F.lit("2024-01-01")))
    sketches.keep_sketches(series, path)
    assert sketches.window_cuts(spark, path, "2025-01-01", "2025-02-01").count() == 0
    scored = scoring.apply_cutpoints(b.base(spark, []), sketches.window_cuts(spark, path, "2025-01-01", "2025-02-01"))
    assert scored.count() == 0

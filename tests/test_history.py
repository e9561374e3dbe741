import random

import builders as b
import pytest

from patronage.catalog import FIRST_MONTH, LAST_MONTH
from patronage.operators import history
from patronage.operators.hygiene import clean_purchases
from patronage.operators.indicators import rfm_base
from patronage.plans.segmentation import segment_customers
from patronage.session import materialize, scratch_path
from patronage.sources.purchases import purchases_from_orders
from patronage.sources.sinks import read_snapshots, write_snapshot


@pytest.mark.parametrize("as_of, customers", [("1996-03-01", 1249), ("1999-01-01", 1491), ("2001-08-01", 1500)])
def test_snapshot_equals_its_own_date(spark, testdata, as_of, customers):
    purchases = purchases_from_orders(spark, f"{testdata}/sf0.01")
    found = history.snapshots(purchases, FIRST_MONTH, LAST_MONTH).where(f"as_of = DATE '{as_of}'").drop("as_of")
    expected = rfm_base(clean_purchases(purchases, as_of), as_of)
    assert found.count() == customers
    assert found.exceptAll(expected).count() == 0


def random_purchases(spark, seed=5, n=400):
    rng = random.Random(seed)
    return b.purchases(spark, [
        (rng.randint(1, 25), t, f"2023-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T10:00", rng.randint(1, 99))
        for t in range(n)
    ])


@pytest.mark.parametrize("months", [1, 3, 24])
def test_trailing_snapshot_equals_its_window(spark, months):
    purchases = random_purchases(spark, n=60)
    found = history.snapshots(purchases, "2023-03-01", "2023-12-01", trailing_months=months)
    for month in (3, 7, 12):
        as_of = f"2023-{month:02d}-01"
        first = month - months
        start = f"{2023 + (first - 1) // 12}-{(first - 1) % 12 + 1:02d}-01"
        expected = rfm_base(clean_purchases(purchases, as_of, start), as_of)
        at = found.where(f"as_of = DATE '{as_of}'").drop("as_of")
        assert at.exceptAll(expected).count() == 0 and expected.exceptAll(at).count() == 0


@pytest.mark.parametrize("trailing", [None, 2])
def test_monthly_moves_equal_pairwise_moves(spark, trailing):
    purchases = random_purchases(spark, n=80)
    found = history.migration_series(purchases, "2023-06-01", "2023-08-01", trailing).where("as_of = DATE '2023-08-01'")
    sides = [
        segment_customers(purchases, as_of, start if trailing else None)
        for as_of, start in (("2023-07-01", "2023-05-01"), ("2023-08-01", "2023-06-01"))
    ]
    expected = history.migration(*sides)
    assert sorted(map(tuple, found.drop("as_of").collect())) == sorted(map(tuple, expected.collect()))


def test_bad_month_range(spark):
    with pytest.raises(ValueError, match="month starts"):
        history.snapshots(random_purchases(spark), "2023-01-02", "2023-03-01")


def test_writing_a_date_twice_keeps_one_copy(spark):
    path = scratch_path(spark, "test-snapshots")
    for as_of in ("2023-06-01", "2023-07-01", "2023-07-01"):
        write_snapshot(materialize(segment_customers(random_purchases(spark), as_of)), path, as_of)
    stored = read_snapshots(spark, path)
    assert {str(r.as_of): r["count"] for r in stored.groupBy("as_of").count().collect()} == {
        "2023-06-01": 25, "2023-07-01": 25,
    }
    one = read_snapshots(spark, path, "2023-07-01")
    assert "PartitionFilters: [isnotnull(as_of" in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("trailing", [None, 2])
def test_own_and_population_moves_add_up(spark, trailing):
    purchases = random_purchases(spark, n=120)
    span = ("2023-04-01", "2023-10-01", trailing)
    moves = materialize(history.migration_decomposed(purchases, *span), "moves")
    series = history.migration_series(purchases, *span)
    summed = moves.groupBy("as_of", "from_segment", "to_segment").agg({"customers": "sum"})
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, series.collect()))

    flows = history.segment_flows(moves).collect()
    assert all(r.before + r.own_change + r.population_change == r.after for r in flows)
    for month in {r.as_of for r in flows}:
        assert sum(r.own_change for r in flows if r.as_of == month) == sum(r.population_change for r in flows if r.as_of == month) == 0
    stayed = moves.where("from_segment = to_segment AND own_segment = from_segment").groupBy("as_of").agg({"customers": "sum"})
    assert {r.as_of: r.stayed for r in history.why_moved(moves).collect() if r.stayed} == dict(map(tuple, stayed.collect()))


def test_who_does_nothing_is_moved_by_the_others_only(spark):
    """The one who bought most, long ago, is overtaken by all others within a month."""
    rows = [(1, n, f"2023-01-{n + 1:02d}", 10) for n in range(5)]
    rows += [(c, 100 * c + n, f"2023-03-{c + n:02d}", 10) for c in range(2, 11) for n in range(2)]
    rows += [(c, 100 * c + 10 + n, f"2023-05-{c + n:02d}", 10) for c in range(2, 11) for n in range(9)]
    purchases = b.purchases(spark, rows)
    moves = history.migration_decomposed(purchases, "2023-05-01", "2023-06-01")
    ours = {(r.from_segment, r.own_segment, r.to_segment) for r in moves.collect()}
    assert ("cannot_lose", "cannot_lose", "hibernating") in ours
    assert history.why_moved(moves).first().by_population >= 1

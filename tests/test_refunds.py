"""Refunds against the sales they belong to, and against a plain Python version."""

import random
from decimal import Decimal

import builders as b
import pytest

from patronage.operators.hygiene import clean_purchases, dedup
from patronage.operators.indicators import rfm_base
from patronage.operators.refunds import settle_refunds


def told(df):
    return sorted(tuple(row) for row in df.collect())


def money(rows, as_of=b.AS_OF, **options):
    return {r.customer_id: r.monetary for r in rfm_base(clean_purchases(rows, as_of, **options), as_of).collect()}


@pytest.mark.parametrize("options", [{"net": True}, {"settled": True}])
def test_several_partial_refunds_of_one_sale(spark, options):
    rows = b.purchases(spark, [(1, 7, "2024-01-01", 100), (1, 7, "2024-01-02", -30), (1, 7, "2024-01-03", -20), (1, 7, "2024-01-03", -20)])
    assert money(rows, **options) == {1: Decimal("50.00")}
    assert dedup(rows).count() == 3


def test_refunds_beyond_their_sale(spark):
    rows = b.purchases(spark, [(1, 7, "2024-01-01", 100), (1, 7, "2024-01-02", -70), (1, 7, "2024-01-03", -50), (1, 7, "2024-01-04", -5)])
    settled, rejects = settle_refunds(rows)
    assert [str(r.amount) for r in settled.orderBy("ts").collect()] == ["100.00", "-70.00", "-30.00"]
    assert [(str(r.amount), r.reason) for r in rejects.orderBy("ts").collect()] == [("-20.00", "refund beyond sale"), ("-5.00", "refund beyond sale")]
    assert money(rows, settled=True) == {1: Decimal("0.00")} and money(rows, net=True) == {1: Decimal("-25.00")}


def test_refunds_without_a_fitting_sale(spark):
    rows = b.purchases(spark, [
        (1, 7, "2024-01-05", 100), (1, 7, "2024-01-02", -10), (2, 7, "2024-01-06", -10), (1, 8, "2024-01-06", -10), (1, 7, "2024-01-05", -1),
    ])
    settled, rejects = settle_refunds(rows)
    assert {(r.txn_id, r.customer_id, r.reason) for r in rejects.collect()} == {
        (7, 1, "refund before sale"), (7, 2, "refund by another customer"), (8, 1, "refund without sale"),
    }
    assert sorted(str(r.amount) for r in settled.collect()) == ["-1.00", "100.00"]


def test_a_sale_of_nothing_takes_no_refund(spark):
    settled, rejects = settle_refunds(b.purchases(spark, [(1, 1, "2024-01-01", 0), (1, 1, "2024-01-02", -1)]))
    assert settled.count() == 1 and [r.reason for r in rejects.collect()] == ["refund beyond sale"]
    empty = settle_refunds(b.purchases(spark, []))
    assert [df.count() for df in empty] == [0, 0] and empty[0].columns == ["customer_id", "txn_id", "ts", "amount"]


def brute(rows):
    sales = {}
    for c, t, ts, a in rows:
        if a >= 0:
            sales[t] = min(sales.get(t, (ts, c, a)), (ts, c, a))
    settled, rejects, left = [(c, t, ts, a) for t, (ts, c, a) in sales.items()], [], {t: a for t, (_, _, a) in sales.items()}
    for ts, c, a, t in sorted({(ts, c, a, t) for c, t, ts, a in rows if a < 0}):
        if t not in sales:
            rejects.append((c, t, ts, a, "refund without sale"))
        elif sales[t][1] != c:
            rejects.append((c, t, ts, a, "refund by another customer"))
        elif ts < sales[t][0]:
            rejects.append((c, t, ts, a, "refund before sale"))
        else:
            part = min(-a, left[t])
            left[t] -= part
            settled += [(c, t, ts, -part)] * (part > 0)
            rejects += [(c, t, ts, a + part, "refund beyond sale")] * (a + part < 0)
    return sorted(settled), sorted(rejects)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    made = [
        (rng.randint(1, 2), rng.randint(1, 12), f"2024-01-{rng.randint(1, 20):02d}", Decimal(rng.choice([40, 0, 25, -10, -10, -15, -7.5]))) for _ in range(150)
    ]
    df = b.purchases(spark, made).repartition(4)
    plain = [tuple(row) for row in df.collect()]
    settled, rejects = settle_refunds(df)
    assert (told(settled), told(rejects)) == brute(plain)
    total = lambda rows: sum(row[3] for row in rows if row[3] < 0)
    assert total(told(settled)) + total(told(rejects)) == sum(a for _, _, _, a in {row for row in plain if row[3] < 0})


def test_purchases_are_read_once(spark, tmp_path):
    """Tasks would hold a sort or a hash table for each further time."""
    rows = [(1, 7, "2024-01-01", 100), (1, 7, "2024-01-02", -70), (1, 7, "2024-01-03", -50), (2, 8, "2024-01-03", -5)]
    b.purchases(spark, rows).write.parquet(f"{tmp_path}/rows")
    for told_of in settle_refunds(spark.read.parquet(f"{tmp_path}/rows")):
        plan = told_of._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan and "partial_min" in plan
        assert plan.count("Exchange") == 2


def test_rows_without_a_transaction_and_repeated_sales(spark):
    rows = b.purchases(spark, [
        (1, None, "2024-01-01", 100), (1, None, "2024-01-02", -10), (3, 7, "2024-01-02", 5), (2, 7, "2024-01-01", 30), (2, 7, "2024-01-01", 30),
        (2, 7, "2024-01-01", 20), (2, 7, "2024-01-03", -25), (2, 7, "2024-01-03", -25), (3, 7, "2024-01-03", -1), (1, 7, "2024-01-05", None),
    ])
    settled, rejects = settle_refunds(rows)
    assert sorted((r.customer_id, r.txn_id or 0, str(r.amount)) for r in settled.collect()) == [(1, 0, "100.00"), (2, 7, "-20.00"), (2, 7, "20.00")]
    assert sorted((r.customer_id, r.txn_id or 0, str(r.amount), r.reason) for r in rejects.collect()) == [
        (1, 0, "-10.00", "refund without sale"), (2, 7, "-5.00", "refund beyond sale"), (3, 7, "-1.00", "refund by another customer"),
    ]

import datetime as dt
from decimal import Decimal

import builders as b

from patronage.operators.hygiene import clean_purchases, dedup, split_valid
from patronage.operators.indicators import non_buyers, purchase_gaps, purchase_rate, rfm_base, with_non_buyers
from patronage.operators.segments import assign_segments
from patronage.operators.scoring import score_rank
from patronage.sources.purchases import purchases_from


def test_rejects_name_their_reason(spark):
    rows = b.purchases(spark, [
        (None, 1, "2024-01-01", 5), (1, None, "2024-01-01", 5), (1, 2, None, 5), (1, 3, "2024-01-01", None),
        (1, 4, "2024-01-01", -1), (1, 5, "2024-01-01", 0),
    ])
    valid, rejects = split_valid(rows)
    assert [r.txn_id for r in valid.collect()] == [5]
    assert sorted(r.reason for r in rejects.collect()) == [
        "missing amount", "missing customer", "missing time", "missing transaction", "negative amount",
    ]
    assert split_valid(rows, net=True)[0].count() == 2


def test_unusable_amounts_are_rejected_not_fatal(spark):
    rows = spark.createDataFrame(
        [(1, 1, "2024-01-01 00:00:00", "12.345"), (1, 2, "2024-01-01 00:00:00", "abc"), (1, 3, "2024-01-01 00:00:00", "1e40")],
        "c bigint, t bigint, ts string, a string",
    )
    valid, rejects = split_valid(purchases_from(rows, "c", "t", "ts", "a"))
    assert [r.amount for r in valid.collect()] == [Decimal("12.35")]
    assert {r.reason for r in rejects.collect()} == {"missing amount"}


def test_dedup_keeps_the_same_row_always(spark):
    rows = [(2, 7, "2024-01-02", 5), (3, 7, "2024-01-01", 9), (1, 7, "2024-01-01", 9), (1, 7, "2024-01-01", 4), (1, 8, "2024-01-01", 1)]
    for order in (rows, rows[::-1]):
        kept = {r.txn_id: (r.customer_id, r.amount) for r in dedup(b.purchases(spark, order).repartition(5)).collect()}
        assert kept == {7: (1, Decimal("4.00")), 8: (1, Decimal("1.00"))}


def test_window_bounds_and_repeats_across_them(spark):
    rows = b.purchases(spark, [
        (1, 1, "2024-01-01", 1), (1, 2, "2023-12-31T23:59:59.999999", 1), (1, 3, "2024-02-01", 1),
        (1, 4, "2024-01-31T23:59:59.999999", 1),
        (1, 5, "2023-12-01", 1), (1, 5, "2024-01-15", 1),  # bought before the window, repeated inside it
        (1, 6, "2024-01-20", 1), (1, 6, "2024-02-20", 1),  # repeated after it
    ])
    kept = clean_purchases(rows, "2024-02-01", "2024-01-01")
    assert sorted(r.txn_id for r in kept.collect()) == [1, 4, 6]


def test_last_microsecond_is_one_day_ago(spark):
    rows = b.purchases(spark, [(1, 1, "2024-01-31T23:59:59.999999", 1), (1, 2, "2024-01-31", 1)])
    row = rfm_base(clean_purchases(rows, "2024-02-01"), "2024-02-01").first()
    assert (row.recency_days, row.frequency, row.last_purchase) == (1, 2, dt.date(2024, 1, 31))


def test_huge_amounts_sum_exactly(spark):
    top = "9999999999999999.99"
    rows = b.purchases(spark, [(1, t, "2024-01-01", top) for t in range(50)])
    assert rfm_base(rows, "2024-02-01").first().monetary == Decimal(top) * 50


def test_refunds_lower_revenue_only(spark):
    rows = b.purchases(spark, [(1, 1, "2024-01-01", 10), (1, 2, "2024-01-05", -4), (2, 3, "2024-01-01", -4)])
    found = rfm_base(clean_purchases(rows, "2024-02-01", net=True), "2024-02-01").collect()
    assert [(r.customer_id, r.last_purchase, r.frequency, r.monetary) for r in found] == [
        (1, dt.date(2024, 1, 1), 1, Decimal("6.00"))
    ]


def test_empty_input_keeps_the_schema(spark):
    found = rfm_base(clean_purchases(b.purchases(spark, []), "2024-02-01"), "2024-02-01")
    assert found.count() == 0
    assert found.dtypes == [
        ("customer_id", "bigint"), ("last_purchase", "date"), ("recency_days", "bigint"),
        ("frequency", "bigint"), ("monetary", "decimal(38,2)"),
    ]


def test_customers_without_purchases(spark):
    people = b.base(spark, [(1, 1, 1, "5"), (2, 2, 2, "6")])
    customers = spark.range(1, 5).withColumnRenamed("id", "customer_id")
    found = {r.customer_id: r for r in with_non_buyers(customers, assign_segments(score_rank(people))).collect()}
    assert len(found) == 4
    assert (found[3].segment, found[3].frequency, found[3].monetary, found[3].r_score) == ("never_purchased", 0, 0, None)
    assert sorted(r.customer_id for r in non_buyers(customers, people).collect()) == [3, 4]


def test_gaps_and_rate(spark):
    rows = b.purchases(spark, [
        (1, 1, "2024-01-01", 1), (1, 2, "2024-01-01T12:00", 1), (1, 3, "2024-01-11", 1), (1, 4, "2024-01-12", 1),
        (2, 5, "2024-01-01", 1),
    ])
    gaps = {r.customer_id: tuple(r)[1:] for r in purchase_gaps(rows).collect()}
    assert gaps == {1: (11, 2, 1, 10), 2: (0, 0, None, None)}
    rate = {r.customer_id: r.purchases_per_day for r in purchase_rate(rows, "2024-01-21").collect()}
    assert rate == {1: 4 / 20, 2: 1 / 20}


def test_refunds_survive_deduplication(spark):
    rows = [(1, 7, "2024-01-01", 100), (1, 7, "2024-01-02", -100), (1, 8, "2024-01-03", 50), (1, 7, "2024-01-02", -100)]
    cleaned = clean_purchases(b.purchases(spark, rows), b.AS_OF, net=True)
    row = rfm_base(cleaned, b.AS_OF).first()
    assert (row.frequency, row.monetary) == (2, Decimal("50.00"))
    assert purchase_rate(cleaned, b.AS_OF).first().frequency == 2
    assert purchase_gaps(cleaned).first().n_gaps == 1


def test_refunds_add_up_to_the_kept_lines(spark, sf_dir):
    from patronage.catalog import AS_OF, QUERIES
    from patronage.sources.purchases import purchases_from_lines

    net = QUERIES["rfm_base_net"](spark, sf_dir).agg({"monetary": "sum", "frequency": "sum"}).first()
    kept = purchases_from_lines(spark, sf_dir, returned=False).agg({"amount": "sum"}).first()[0]
    late = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(f"l_shipdate >= '{AS_OF}' AND l_returnflag = 'R'").count()
    assert late or net["sum(monetary)"] == kept
    assert net["sum(frequency)"] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_broken_ids_and_times_are_rejects(spark):
    rows = spark.createDataFrame(
        [("x", "1", "2024-01-01", "1"), ("1", "1.x", "2024-01-01", "1"), ("1", "2", "2024-13-01", "1"), ("1", "3", "2024-01-01", "1")],
        "c string, t string, ts string, a string",
    )
    valid, rejects = split_valid(purchases_from(rows, "c", "t", "ts", "a"))
    assert valid.count() == 1
    assert sorted(r.reason for r in rejects.collect()) == ["missing customer", "missing time", "missing transaction"]


def test_buyers_without_a_customer_row_are_kept(spark):
    base = rfm_base(b.purchases(spark, [(1, 1, "2024-01-01", 5), (9, 2, "2024-01-01", 5)]), b.AS_OF)
    everyone = with_non_buyers(spark.createDataFrame([(1,), (2,)], "customer_id bigint"), assign_segments(score_rank(base)))
    assert sorted(r.customer_id for r in everyone.collect()) == [1, 2, 9]

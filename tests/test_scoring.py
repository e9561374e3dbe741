"""Scores against brute force on many small random populations at once."""

import random

import builders as b
import pytest

from patronage.operators import scoring
from patronage.operators.order_stats import exact_cuts, spread

K = (2, 3, 5, 10)


def population(seed):
    """From one to forty customers; some populations are nearly all ties."""
    rng = random.Random(seed)
    n, distinct = rng.choice([1, 2, 3, 4, 7, 20, 40]), rng.choice([1, 2, 5, 1000])
    return [
        (c, rng.randint(1, distinct), rng.randint(1, distinct), f"{rng.randint(0, distinct * 100) / 100:.2f}")
        for c in rng.sample(range(10**6), n)
    ]


@pytest.fixture(scope="module")
def populations():
    return {g: population(g) for g in range(40)}


@pytest.fixture(scope="module")
def grouped(spark, populations):
    rows = [(g, *b.base_row(*row)) for g, people in populations.items() for row in people]
    return spark.createDataFrame(rows, b.GROUPED)


def scores_of(df, i, *key):
    return {tuple(row[c] for c in (*key, "customer_id")): row[f"{i}_score"] for row in df.collect()}


@pytest.mark.parametrize("k", K)
def test_rank_score_is_its_definition(grouped, populations, k):
    scored = scoring.score_rank(grouped, k, by=["g"]).cache()
    for i in scoring.INDICATORS:
        found = scores_of(scored, i, "g")
        for g, people in populations.items():
            for customer, score in b.rank_scores(b.goodness(people, i), k).items():
                assert found[g, customer] == score, (k, i, g, customer)
    scored.unpersist()


@pytest.mark.parametrize("k", K)
def test_fitted_score_interpolates(grouped, populations, k):
    cuts = scoring.fit_cutpoints(grouped, k, by=["g"])
    scored = scoring.apply_cutpoints(grouped, cuts, k, by=["g"]).cache()
    for i in scoring.INDICATORS:
        found = scores_of(scored, i, "g")
        for g, people in populations.items():
            for customer, score in b.quantile_scores(b.goodness(people, i), k, i).items():
                assert found[g, customer] == score, (k, i, g, customer)
    scored.unpersist()


@pytest.mark.parametrize("seed", [0, 3, 11, 17])
def test_ntile_score_splits_ties_by_customer(spark, seed):
    people = population(seed)
    scored = scoring.score_ntile(b.base(spark, people), 5)
    for i in scoring.INDICATORS:
        expected = {(c,): s for c, s in b.ntile_scores(b.goodness(people, i), 5).items()}
        assert scores_of(scored, i) == expected


def test_more_purchases_never_score_lower(spark):
    people = population(6)
    customer = people[0][0]
    before = scores_of(scoring.score_rank(b.base(spark, people)), "f")
    people[0] = (customer, people[0][1], people[0][2] + 3, people[0][3])
    after = scores_of(scoring.score_rank(b.base(spark, people)), "f")
    assert after[customer,] >= before[customer,]


def test_order_and_partitions_do_not_matter(spark, grouped):
    expected = sorted(scoring.score_rank(grouped, by=["g"]).collect())
    for shape in (grouped.repartition(1), grouped.repartition(13, "monetary")):
        assert sorted(scoring.score_rank(shape, by=["g"]).collect()) == expected


def test_empty_single_and_identical(spark):
    empty = scoring.score_rank(b.base(spark, []))
    assert empty.count() == 0 and "m_score" in empty.columns
    for people in ([(1, 5, 2, "9.99")], [(c, 5, 2, "9.99") for c in range(30)]):
        for row in scoring.score_rank(b.base(spark, people)).collect():
            assert (row.r_score, row.f_score, row.m_score) == (1, 1, 1)


def test_values_beyond_double_precision_stay_exact(spark):
    """Amounts that round to the same double still get their own ranks."""
    whole = 10**30
    people = [(c, 1, 1, f"{whole}.{c:02d}") for c in range(100)]
    found = scores_of(scoring.score_rank(b.base(spark, people)), "m")
    assert found == {(c,): 1 + 5 * c // 100 for c in range(100)}


def test_bad_fences_cost_time_not_exactness(spark):
    """Whatever intervals the search starts from, the cuts are the same."""
    rows = spark.range(1, 1001).selectExpr("cast(id * id % 997 as decimal(38,2)) AS v")
    values = sorted(i * i % 997 for i in range(1, 1001))
    targets = {j: f"{j} * total div 4" for j in range(1, 4)}
    for fences in ([0.5], [0.01], spread()):
        found = {row.j: int(row.cut) for row in exact_cuts(rows, (), "v", targets, fences).collect()}
        assert found == {j: values[j * 250 - 1] for j in range(1, 4)}


def test_fixed_cuts(spark):
    people = [(1, 10, 1, "5"), (2, 11, 2, "10"), (3, 50, 9, "10.01")]
    scored = scoring.score_fixed(b.base(spark, people), r=[30, 10], f=[1, 5], m=[5, 10])
    assert [tuple(r) for r in scored.select("customer_id", "r_score", "f_score", "m_score").orderBy("customer_id").collect()] == [
        (1, 3, 1, 1), (2, 2, 2, 2), (3, 1, 3, 3),
    ]
    with pytest.raises(ValueError, match="same number"):
        scoring.score_fixed(b.base(spark, people), r=[1], f=[1, 2], m=[1, 2])


def test_kept_cuts_score_new_customers(spark):
    from patronage.session import materialize

    kept = materialize(scoring.fit_cutpoints(b.base(spark, [(c, c + 1, c + 1, f"{c}.00") for c in range(11)])), "cuts")
    late = scoring.apply_cutpoints(b.base(spark, [(50, 3, 8, "8.01"), (51, 99, 99, "8.00")]), kept)
    assert scores_of(late, "m") == {(50,): 5, (51,): 4}
    assert scores_of(late, "r") == {(50,): 5, (51,): 1}


def test_customers_without_cuts_are_kept(spark, grouped):
    cuts = scoring.rank_cuts(grouped.where("g < 5"), by=["g"])
    scored = scoring.apply_cutpoints(grouped, cuts, by=["g"])
    assert scored.count() == grouped.count()
    assert scored.where("g >= 5 AND r_score IS NOT NULL").count() == 0
    nobody = scoring.rank_cuts(b.base(spark, []))
    assert [r.m_score for r in scoring.apply_cutpoints(b.base(spark, [(1, 1, 1, "1")]), nobody).collect()] == [None]


def test_many_groups(spark):
    """Far more groups than are broadcast; each is scored by itself, the NULL group too."""
    people = spark.range(60_000).selectExpr(
        "CASE WHEN id < 59997 THEN id DIV 3 END AS g", "id AS customer_id", "DATE '2024-01-01' AS last_purchase",
        "id % 3 AS recency_days", "1 + id % 3 AS frequency", "CAST(id % 3 AS DECIMAL(38,2)) AS monetary",
    )
    scored = scoring.score_rank(people, 3, by=["g"])
    assert scored.count() == 60_000
    wrong = scored.where("f_score <> 1 + customer_id % 3 OR r_score <> 3 - customer_id % 3 OR m_score <> f_score OR f_score IS NULL")
    assert wrong.count() == 0


def test_null_group_is_scored(spark):
    rows = [(None if c % 2 else 1, *b.base_row(c, c + 1, c + 1, c)) for c in range(10)]
    scored = scoring.score_rank(spark.createDataFrame(rows, b.GROUPED), by=["g"])
    assert {(r.g, r.f_score) for r in scored.collect()} == {(g, s) for g in (None, 1) for s in range(1, 6)}


def test_cut_table_of_several_rows_needs_groups(spark):
    people = b.base(spark, population(6))
    two = scoring.fit_cutpoints(people).union(scoring.fit_cutpoints(people))
    with pytest.raises(ValueError, match="one row"):
        scoring.apply_cutpoints(people, two)

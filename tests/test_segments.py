import builders as b
import pytest

from patronage.operators.reports import rf_matrix, segment_summary, top_share, value_classes
from patronage.operators.scoring import score_rank
from patronage.operators.segments import DEFAULT_RULES, Rule, assign_segments, attach_strategies, rules_from, validate_rules

THREE = [Rule("good", 2, 3, 1, 3), Rule("poor", 1, 1, 1, 3)]


def people(spark, n=60):
    return b.base(spark, [(c, 1 + c * 7 % 50, 1 + c % 9, f"{c * 13 % 101}.50") for c in range(n)])


def test_default_rules_cover_each_cell_once():
    validate_rules(DEFAULT_RULES)


@pytest.mark.parametrize("rules, message", [
    (DEFAULT_RULES[1:], "no rule covers"),
    ([*DEFAULT_RULES, Rule("extra", 1, 1, 1, 1)], "claimed by"),
    ([*DEFAULT_RULES, Rule("extra", 6, 6, 1, 1)], "outside"),
])
def test_bad_rules_are_refused(rules, message):
    with pytest.raises(ValueError, match=message):
        validate_rules(rules)


def test_rules_may_be_a_table_and_have_another_scale(spark):
    table = spark.createDataFrame(THREE, "segment string, r_lo int, r_hi int, f_lo int, f_hi int")
    assert sorted(rules_from(table, 3)) == sorted(THREE)
    found = assign_segments(score_rank(people(spark), 3), table, 3)
    for row in found.collect():
        assert row.segment == ("poor" if row.r_score == 1 else "good")
        assert row.value_tier == {1: "low", 2: "mid", 3: "high"}[row.m_score]
        assert row.rfm_code == f"{row.r_score}{row.f_score}{row.m_score}"


def test_every_customer_gets_a_segment(spark):
    found = assign_segments(score_rank(people(spark)))
    assert found.where("segment IS NULL").count() == 0
    summary = segment_summary(found).collect()
    assert sum(row.customers for row in summary) == 60
    assert abs(sum(row.revenue_share for row in summary) - 1) < 1e-12
    cells = rf_matrix(found).collect()
    assert sum(sum(row[f"f{f}"] for f in range(1, 6)) for row in cells) == 60


def test_strategies_are_looked_up_and_checked(spark):
    found = assign_segments(score_rank(people(spark)))
    plan = spark.createDataFrame([("champions", "high", "call")], "segment string, value_tier string, action string")
    rows = attach_strategies(found, plan).collect()
    assert len(rows) == 60
    for row in rows:
        assert row.action == ("call" if (row.segment, row.value_tier) == ("champions", "high") else None)
    with pytest.raises(ValueError, match="more than once"):
        attach_strategies(found, plan.unionAll(plan))


def test_classes_at_exact_boundaries(spark):
    """80 + 15 + 5: the second customer starts exactly at 80%, the third at 95%."""
    rows = b.base(spark, [(1, 1, 1, "80.00"), (2, 1, 1, "15.00"), (3, 1, 1, "5.00")])
    assert {r.customer_id: r.abc_class for r in value_classes(rows).collect()} == {1: "A", 2: "B", 3: "C"}


def test_classes_with_negative_and_zero_revenue(spark):
    rows = b.base(spark, [(1, 1, 1, "100.00"), (2, 1, 1, "-60.00"), (3, 1, 1, "0.00")])
    assert {r.customer_id: r.abc_class for r in value_classes(rows).collect()} == {1: "A", 2: "C", 3: "C"}
    nothing = b.base(spark, [(1, 1, 1, "0.00"), (2, 1, 1, "0.00")])
    assert {r.abc_class for r in value_classes(nothing).collect()} == {"C"}


def test_top_share_splits_a_tie_without_naming_customers(spark):
    rows = b.base(spark, [(c, 1, 1, "10.00") for c in range(9)] + [(9, 1, 1, "50.00")])
    found = {r.top_percent: (r.customers, int(r.revenue)) for r in top_share(rows, [10, 50]).collect()}
    assert found == {10: (1, 50), 50: (5, 90)}

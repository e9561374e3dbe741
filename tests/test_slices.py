"""Rules per slice, distinct buyers, and snapshots that are compared without moving customers."""

import contextlib
import io
import random

import builders as b
import pytest

from patronage.operators import distinct_buyers as buyers
from patronage.operators import history, slice_rules
from patronage.session import scratch_path
from patronage.sources.sinks import write_bucketed

RULES = "slice string, segment string, r_lo bigint, r_hi bigint, f_lo bigint, f_hi bigint"
GOOD = [("x", "a", None, 10, None, 3), ("x", "b", None, 10, 4, None), ("x", "c", 11, None, None, None)]


def faults(spark, rules):
    return sorted(map(tuple, slice_rules.rule_faults(spark.createDataFrame(rules, RULES)).collect()))


def test_total_and_disjoint_rules_have_no_faults(spark):
    assert faults(spark, GOOD) == [] and faults(spark, [("y", "all", None, None, None, None), (None, "all", 0, None, 0, None)]) == []


def test_gaps_and_overlaps_are_told(spark):
    assert faults(spark, GOOD[:2]) == [("x", 11, 0, "gap")]
    assert faults(spark, [GOOD[0], GOOD[2]]) == [("x", 0, 4, "gap")]
    assert faults(spark, [*GOOD, ("x", "d", 5, 7, 2, 9)]) == [("x", 5, 2, "overlap"), ("x", 5, 4, "overlap")]
    assert ("x", 0, 0, "gap") in faults(spark, [("x", "a", 3, None, None, None)])
    assert faults(spark, [*GOOD, ("x", "e", 9, 8, None, None)]) == [("x", 9, 0, "empty rule")]


@pytest.mark.parametrize("seed", range(3))
def test_faults_against_every_cell(spark, seed):
    """Random rules over a small grid: faults exist exactly where a cell is covered not once."""
    rng, rules, bad = random.Random(seed), [], set()
    for n in range(25):
        mine = [("g%d" % n, "s%d" % k, *sorted(rng.choices(range(4), k=2)), *sorted(rng.choices(range(4), k=2))) for k in range(rng.randint(1, 4))]
        if n % 3 == 0:
            cut, other = rng.randint(0, 3), rng.randint(0, 3)
            mine = [("g%d" % n, "l", None, cut, None, None), ("g%d" % n, "h", cut + 1, None, None, other), ("g%d" % n, "t", cut + 1, None, other + 1, None)]
        rules += mine
        inside = lambda x, lo, hi: (lo is None or x >= lo) and (hi is None or x <= hi)
        if any(sum(inside(r, m[2], m[3]) and inside(f, m[4], m[5]) for m in mine) != 1 for r in range(7) for f in range(7)):
            bad.add("g%d" % n)
    assert {row[0] for row in faults(spark, rules)} == bad and len(bad) < 25


def test_rules_are_checked_and_applied_by_slice(spark, monkeypatch):
    base = b.base(spark, [(1, 5, 3, 1), (2, 10, 4, 1), (3, 11, 1, 1), (4, 5, 3, 1)]).selectExpr("*", "CASE WHEN customer_id < 4 THEN 'x' END AS place")
    rules = spark.createDataFrame([*GOOD, (None, "nowhere", None, None, None, None)], RULES)
    for few in (10_000, 1):
        monkeypatch.setattr(slice_rules, "FEW_RULES", few)
        assert {r.customer_id: r.segment for r in slice_rules.assign_by_slice(base, rules, "place").collect()} == {1: "a", 2: "b", 3: "c", 4: "nowhere"}
    with pytest.raises(ValueError, match="gap"):
        slice_rules.assign_by_slice(base, rules.where("segment <> 'c'"), "place")


def test_distinct_buyers_at_every_level(spark):
    rng = random.Random(2)
    made = [(rng.choice([1, 2, 3, 32_768, 32_769, 10**12, -5, None]), t, f"2024-{rng.randint(1, 3):02d}-05", rng.choice([5, -5, 0])) for t in range(120)]
    rows = b.purchases(spark, made).selectExpr("*", "month(ts) AS month", "CASE WHEN txn_id % 3 > 0 THEN 'p' END AS place")
    bitmaps = buyers.buyer_bitmaps(rows, ["month", "place"])
    found = {(r.month, r.place, r.level): r.customers for r in buyers.distinct_buyers(bitmaps, ["month", "place"]).collect()}
    bought = rows.where("amount >= 0")
    for (month, place, level), n in found.items():
        part = bought
        if not level & 2:
            part = part.where("month IS NULL" if month is None else f"month = {month}")
        if not level & 1:
            part = part.where("place IS NULL" if place is None else f"place = '{place}'")
        assert n == part.where("customer_id IS NOT NULL").select("customer_id").distinct().count()
    assert len(found) == 6 + 3 + 2 + 1
    assert {r.level for r in buyers.distinct_buyers(bitmaps, ["month", "place"], [["month"]]).collect()} == {1}


def test_bucketed_snapshots_are_compared_without_a_shuffle_of_customers(spark):
    names = []
    for day, shift in (("a", 0), ("b", 1)):
        rows = spark.range(100 * shift, 5000).selectExpr("id AS customer_id", f"CASE WHEN id % 3 = {shift} THEN 'new' ELSE 'loyal' END AS segment")
        names.append(f"bucketed_{day}")
        write_bucketed(rows, names[-1], scratch_path(spark, "bucketed"), 4)
    moved = history.migration(*[spark.table(name) for name in names])
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        moved.explain()
    assert "Exchange hashpartitioning(customer_id" not in text.getvalue() and text.getvalue().count("Bucketed: true") == 2
    assert text.getvalue().count("Exchange") == 1  # the counts of moves
    assert sum(r.customers for r in moved.collect()) == 5000

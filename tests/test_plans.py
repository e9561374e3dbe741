"""Guards on the physical plans: what must stay true for large inputs."""

import contextlib
import io
import re

import pytest

from patronage import catalog
from patronage.operators import hygiene, indicators, reports, scoring
from patronage.sources.purchases import purchases_from_orders


def plan(df, mode: str = "simple") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode=mode)
    return text.getvalue()


@pytest.fixture(scope="module")
def base(spark, sf_dir):
    return catalog._base(spark, sf_dir)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    cleaned = hygiene.clean_purchases(purchases_from_orders(spark, sf_dir, ["F"]), catalog.AS_OF)
    text = plan(indicators.rfm_base(cleaned, catalog.AS_OF), "formatted")
    assert "LessThan(o_orderdate,2001-08-02T00:00)" in text and "EqualTo(o_orderstatus,F)" in text
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == [
        "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice",
    ]


def test_indicators_take_one_combined_shuffle(spark, sf_dir):
    cleaned = hygiene.clean_purchases(purchases_from_orders(spark, sf_dir), catalog.AS_OF, unique=True)
    text = plan(indicators.rfm_base(cleaned, catalog.AS_OF))
    assert text.count("Exchange") == 1 and "partial_sum" in text and "partial_count" in text


def test_dedup_is_combined_before_the_shuffle(spark, sf_dir):
    text = plan(hygiene.dedup(purchases_from_orders(spark, sf_dir)))
    assert text.count("Exchange") == 1 and "partial_min" in text


def test_scoring_moves_no_customers(base):
    text = plan(scoring.score_rank(base))
    assert "Exchange hash" not in text and "SinglePartition" not in text and "Window" not in text


def test_cut_search_never_gathers_rows_in_one_task(base):
    text = plan(scoring._search(base, (), scoring.INDICATORS, 2, {1: "total div 2"}))
    assert "SinglePartition" not in text
    assert "partial_percentile_approx" in text and "partial_sum" in text
    # the values shuffled last come straight from a join with the wanted intervals
    lines = text.splitlines()
    aggregate = next(n for n, line in enumerate(lines) if "partial_sum" in line)
    assert "BroadcastHashJoin" in "".join(lines[aggregate + 1 : aggregate + 3])


def test_single_partition_only_above_totals(base):
    """Where a single task is used, it reads interval totals or partly aggregated rows."""
    for df in (reports.pareto(base), reports.value_classes(base), reports.top_share(base)):
        lines = plan(df).splitlines()
        for number, line in enumerate(lines):
            if "SinglePartition" in line:
                below = next(row for row in lines[number + 1 :] if "Project" not in row)
                assert "HashAggregate" in below, below


def test_top_customers_limits_before_the_shuffle(base):
    segments = catalog.segments.assign_segments(scoring.score_rank(base))
    text = plan(reports.top_customers(segments, 3))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


@pytest.mark.parametrize("name", ["customer_segments", "rf_matrix", "concentration", "monthly_snapshots", "by_attribute"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_concentration_reads_the_base_once(base, monkeypatch):
    """Distinct values are written by one pass; the curve reads those."""
    path = base.inputFiles()[0].rsplit("/", 1)[0]
    assert path not in plan(reports.pareto(base), "formatted")


def test_grouped_concentration_has_no_window_over_a_whole_group(spark, sf_dir):
    text = plan(catalog.QUERIES["concentration_by_month"](spark, sf_dir))
    for line in text.splitlines():
        if "Window [" in line and "n_here" in line:
            assert "slot" in line.split("],")[1]
    assert "SinglePartition" not in text

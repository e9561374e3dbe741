"""Known totals of the test tables."""

from decimal import Decimal

import pytest

from patronage.catalog import AS_OF
from patronage.operators.reports import segment_summary
from patronage.plans.segmentation import segment_customers
from patronage.session import materialize
from patronage.sources.purchases import purchases_from_orders, table

GOLDEN = {
    "0.01": {
        "champions": (124, "425689501.56"),
        "loyal": (211, "736795308.92"),
        "potential_loyal": (273, "652103454.44"),
        "new": (31, "45441208.82"),
        "promising": (47, "74971907.15"),
        "need_attention": (72, "185736290.09"),
        "about_to_sleep": (142, "269147277.29"),
        "at_risk": (204, "577232987.90"),
        "cannot_lose": (48, "180314096.92"),
        "hibernating": (348, "611007586.97"),
    },
    "0.1": {
        "champions": (1210, "4237199265.70"),
        "loyal": (2080, "7199053914.56"),
        "potential_loyal": (2790, "6703769932.23"),
        "new": (399, "600536016.09"),
        "promising": (502, "766587093.95"),
        "need_attention": (766, "2000606126.34"),
        "about_to_sleep": (1233, "2324565070.51"),
        "at_risk": (2111, "5874706321.62"),
        "cannot_lose": (462, "1761070366.41"),
        "hibernating": (3446, "6055297151.15"),
    },
}
SCORES = {
    "0.01": {
        "r_score": [303, 297, 301, 305, 294],
        "f_score": [331, 361, 347, 253, 208],
        "m_score": [300, 300, 300, 300, 300],
    },
    "0.1": {
        "r_score": [3000, 3019, 3012, 2972, 2996],
        "f_score": [3237, 3652, 3599, 2463, 2048],
        "m_score": [3000, 3000, 3000, 3000, 2999],
    },
}


@pytest.mark.parametrize("sf", sorted(GOLDEN))
def test_segments_and_scores(spark, testdata, sf):
    directory = f"{testdata}/sf{sf}"
    segments = materialize(segment_customers(purchases_from_orders(spark, directory), AS_OF))
    found = {row.segment: (row.customers, str(row.revenue)) for row in segment_summary(segments).collect()}
    assert found == GOLDEN[sf]
    for score, counts in SCORES[sf].items():
        assert [row["count"] for row in segments.groupBy(score).count().orderBy(score).collect()] == counts
    whole = table(spark, directory, "orders").selectExpr("sum(cast(o_totalprice as decimal(18,2)))").first()[0]
    assert sum(Decimal(revenue) for _, revenue in found.values()) == whole


def test_one_customer_never_ordered(spark, testdata):
    from patronage.catalog import _customers
    from patronage.operators.indicators import non_buyers

    directory = f"{testdata}/sf0.1"
    assert non_buyers(_customers(spark, directory), purchases_from_orders(spark, directory)).count() == 1

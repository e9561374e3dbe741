"""Clusters against plain Python, and on odd populations."""

import math
import random

import builders as b
import pytest

from patronage.operators import clustering


def brute(rows, k, rounds=10):
    """customer -> cluster, from (customer, recency, frequency, monetary)."""
    log = lambda v: math.floor(math.log(1 + max(float(v), 0.0)) * 1e6 + 0.5)
    logs = [(-log(r), log(f), log(m)) for _, r, f, m in rows]
    n, points = len(rows), []
    for column in zip(*logs):
        spread = n * sum(x * x for x in column) - sum(column) ** 2
        points.append([math.floor((x * n - sum(column)) * 1000.0 / math.sqrt(float(spread)) + 0.5) if spread else 0 for x in column])
    centres = [[sorted(column)[-(-(2 * j + 1) * n // (2 * k)) - 1] for column in points] for j in range(k)]
    points = list(zip(*points))
    nearest = lambda p: min(range(k), key=lambda c: (sum((x - y) ** 2 for x, y in zip(p, centres[c])), c))
    for _ in range(rounds):
        groups = {}
        for p in points:
            groups.setdefault(nearest(p), []).append(p)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else centre for c, centre in enumerate(centres)]
    return {row[0]: nearest(p) for row, p in zip(rows, points)}


@pytest.mark.parametrize("seed, k", [(1, 5), (2, 3), (3, 1)])
def test_equals_plain_python(spark, seed, k):
    rng = random.Random(seed)
    rows = [(c, rng.choice([3, 30, 300]) + rng.randint(0, 9), rng.randint(1, 9) * rng.choice([1, 5]), round(rng.lognormvariate(5, 2), 2)) for c in range(300)]
    rows += [(300 + c, 7, 2, "10.00") for c in range(150)]  # a third alike
    expected = brute(rows, k)
    for parts in (1, 7):
        found = clustering.fit_clusters(b.base(spark, rows).repartition(parts), k)
        assert {r.customer_id: r.cluster for r in found.collect()} == expected


def test_odd_populations(spark):
    assert clustering.fit_clusters(b.base(spark, [])).count() == 0
    alike = b.base(spark, [(c, 5, 5, 5) for c in range(9)])
    assert {r.cluster for r in clustering.fit_clusters(alike).collect()} == {0}
    few = [(1, 5, 5, "-3.00"), (2, 1, 9, "100.00")]
    assert {r.customer_id: r.cluster for r in clustering.fit_clusters(b.base(spark, few), 5).collect()} == brute(few, 5)

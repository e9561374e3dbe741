"""Centroid clustering against plain Python, against SQL, and on odd vectors."""

import hashlib
import math

import compare
import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from patronage.llm import centroids, queries

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])
MOST = 1 << 62


def whole(vector, size):
    good = vector is not None and len(vector) == size and all(x is not None and math.isfinite(x) for x in vector)
    return [math.floor(min(max(1024 * x, -float(MOST)), float(MOST))) for x in vector] if good else None


def brute(rows, size, k=8, rounds=10):
    """[(id, vector, cluster, distance, inertia of the cluster, inertia, centroid)] by comparing all distances."""
    kept = [(id, whole(v, size)) for id, v in rows]
    kept = [(id, v) for id, v in kept if v]
    order = sorted(kept, key=lambda row: (row[0] is None, "" if row[0] is None else hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1]))
    centres = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (apart(v, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else centre for c, centre in enumerate(centres)]
    found = [(id, v, c := nearest(v), min(apart(v, centres[c]), (1 << 63) - 1)) for id, v in kept]
    sums = {c: sum(row[3] for row in found if row[2] == c) for c in range(len(centres))}
    top = (1 << 63) - 1
    return [(*row, min(sums[row[2]], top), min(sum(sums.values()), top), centres[row[2]]) for row in found]


def ours(df, **options):
    return [tuple(row) for row in centroids.cluster_vectors(df, **options).collect()]


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_distances(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i) if i % 7 else None, [float(x) for x in rng.integers(-3, 4, 3) / (1024 if seed % 2 else 1)]) for i in rng.integers(0, 60, 80)]
    df = spark.createDataFrame([(*row, "clash") for row in rows], VECTORS).repartition(3)
    assert in_order(ours(df, size=3)) == in_order(brute(rows, 3))


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, None), (2, []), (3, [0.0]), (4, [0.0, nan]), (5, [inf, 0.0]), (6, [None, 0.0]), (7, [0.0, 0.0, 0.0]), (8, [-0.0005, 0.9999]),
        (8, [-0.0005, 0.9999]), (None, [1.0, 1.0]), (None, None), (9, [1e300, -1e300]), (10, [2e5, -2e5]), (11, [1e9, 0.0]), (12, [1e12, 3.0]),
    ]
    df = spark.createDataFrame([(*row, None) for row in rows], VECTORS)
    found = ours(df, size=2)
    assert in_order(found) == in_order(brute(rows, 2))
    assert [row[1] for row in found if row[0] == 8] == [[-1, 1023]] * 2
    assert ours(df.where("vec_id < 4"), size=2) == [] and ours(df.limit(0), size=2) == []


def test_tournament_keeps_the_smaller_number_on_ties():
    points = [[0, 0], [2, 0], [2, 0], [0, 2], [2, 2]]
    tournament = centroids.Tournament(points)
    x = np.array([[1, 1], [2, 0], [1, 0], [2, 1], [9, 9]])
    champion, distance = tournament.play(x)
    assert champion.tolist() == [0, 1, 0, 1, 4] and distance.tolist() == [2, 0, 1, 1, 98]


def test_large_integers_are_exact():
    a, b = [1 << 40, 3], [(1 << 40) + 2, 3]
    champion, distance = centroids.Tournament([a, b]).play(np.array([[(1 << 40) + 1, 3], [(1 << 40) + 2, 4], [-(1 << 62), 0]]))
    assert champion.tolist() == [0, 1, 0] and distance.tolist() == [1, 1, (1 << 63) - 1]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    name = "op11_centroid_clustering"
    assert compare.difference(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name]) is None

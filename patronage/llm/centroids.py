"""Centroid clustering of integer vectors, with a bisector tournament for the nearest centroid.

For centroids ``i < j``, a vector ``x`` is nearer to ``j`` exactly if ``normal . x > threshold``
with ``normal = 2 (c_j - c_i)`` and ``threshold = |c_j|^2 - |c_i|^2``. Both are integers and are worked out once
a round for every pair. A vector starts with centroid 0 as its champion and meets the others in
order: k - 1 sign tests leave the nearest one, and a zero keeps the smaller number. Only the
distance to the winner is worked out.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.session import materialize, small_table

#: Integers beyond this are set to it. Far beyond what a squared distance can hold in a long.
MOST = 1 << 62
LONG_MAX = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id: str, vector: str, size: int, scale: int) -> DataFrame:
    """(id, vector) of the rows that have exactly ``size`` finite components, as ``floor(scale * x)``."""
    x = lambda c: c.cast("double")
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")), F.lit(False)))
    scaled = F.transform(vector, lambda c: F.floor(F.greatest(F.least(x(c) * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("bigint"))
    # The length is judged first: forall() over a list without components is true, over a null list null.
    return vectors.where((F.size(vector) == size) & finite).select(F.col(id).alias("id"), scaled.alias("vector"))


def first_centroids(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``salt:id``; all of them, if there are fewer.

    Null ids come last; equal ids are ordered by their components.
    """
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.select(rank.alias("rank"), "vector").orderBy(F.col("rank").asc_nulls_last(), "vector").limit(k)
    return [list(row["vector"]) for row in rows.collect()]  # k rows


class Tournament:
    """The bisectors of every pair of centroids, in plain 64-bit integers where they are exact and in
    Python's integers elsewhere."""

    def __init__(self, centroids: list[list[int]]) -> None:
        points = np.array(centroids, dtype=object)
        squares = (points * points).sum(axis=1)
        self.points = points
        self.normals = 2 * (points[None, :, :] - points[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]
        #: Up to this, sums of products of components fit in 62 bits.
        self.limit = int(((1 << 59) // points.shape[1]) ** 0.5)
        self.plain = max(abs(x) for x in points.flat) <= self.limit
        if self.plain:
            self.own = [a.astype(np.int64) for a in (self.points, self.normals, self.thresholds)]

    def play(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every row and its squared distance, at most the largest long."""
        points, normals, thresholds = self.points, self.normals, self.thresholds
        if self.plain and np.abs(x).max(initial=0) <= self.limit:
            points, normals, thresholds = self.own
        else:
            x = x.astype(object)
        champion = np.zeros(len(x), dtype=np.int64)
        for challenger in range(1, len(points)):
            side = (normals[champion, challenger] * x).sum(axis=1) - thresholds[champion, challenger]
            champion[(side > 0).astype(bool)] = challenger
        apart = x - points[champion]
        distance = (apart * apart).sum(axis=1)
        return champion, np.minimum(distance, LONG_MAX).astype(np.int64)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["vector"].flatten().to_numpy().reshape(batch.num_rows, -1)


def moved_centroids(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floored mean of the vectors nearest to it; one without vectors stays.

    A task adds up its vectors and sends a number for each centroid and component, so a vector
    that repeats without end costs no more than others, and the driver gets k x size sums.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        count = np.zeros(len(centroids), dtype=np.int64)
        total = np.zeros_like(tournament.points)
        for batch in batches:
            x = matrix(batch)
            champion, _ = tournament.play(x)
            if np.abs(x).max(initial=0) > LONG_MAX // max(len(x), 1):
                x = x.astype(object)
            for cluster in np.unique(champion):
                own = x[champion == cluster]
                count[cluster] += len(own)
                total[cluster] += own.sum(axis=0).astype(object)
        for cluster in np.flatnonzero(count):
            row = [Decimal(int(s)) for s in total[cluster]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(cluster)] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()),
                    pa.array(row, pa.decimal128(38, 0)), pa.array([int(count[cluster])] * len(row), pa.int64()),
                ],
                ["cluster", "component", "total", "n"],
            )

    found = kept.select("vector").mapInArrow(sums, "cluster int, component int, total decimal(38,0), n bigint")
    following = [list(c) for c in centroids]
    for row in found.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        following[row["cluster"]][row["component"]] = int(row["total"]) // row["n"]
    return following


def assigned(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, vector, cluster, distance) of every vector."""
    names = kept.columns

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        for batch in batches:
            champion, distance = tournament.play(matrix(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(champion.astype(np.int32)), pa.array(distance)], [*names, "cluster", "distance"])

    return kept.mapInArrow(play, T.StructType([*kept.schema, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3"
) -> DataFrame:
    """k-means in integers: (id, vector, cluster, distance, cluster_inertia, inertia, centroid), a row for each kept vector.

    Vectors are kept that have exactly ``size`` components, none of them null, NaN or infinite, and become
    ``floor(scale * x)``. A null vector is not kept; a null id is an id like any other that is chosen as a
    centroid last. Repeated rows count each. Fewer than ``k`` vectors make as many centroids; a
    centroid without vectors stays where it is and no row shows it. Ties go to the smaller centroid number. An
    empty table gives no rows. Other columns, whatever their names, are left out. Distances and
    inertias that no long can hold are the largest long; integers beyond 2^62 count as that.

    The integer vectors are written once and read by every round. Rounds move k x size sums; when a round
    moves nothing the rest would not either, and is skipped.
    """
    kept = materialize(integer_vectors(vectors, id, vector, size, scale), "vectors")
    centroids = first_centroids(kept, k, salt)
    for _ in range(rounds if centroids else 0):
        following = moved_centroids(kept, centroids)
        if following == centroids:
            break
        centroids = following
    found = materialize(assigned(kept, centroids), "clusters") if centroids else kept.selectExpr("*", "0 AS cluster", "0L AS distance")
    sums = {row["cluster"]: int(row["total"]) for row in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(sums.values()), LONG_MAX)
    rows = [(c, min(total, LONG_MAX), whole, centroids[c]) for c, total in sorted(sums.items())]  # at most k
    totals = small_table(
        vectors.sparkSession, rows,
        T.StructType([
            T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
            T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.LongType())),
        ]),
    )
    return found.join(F.broadcast(totals), "cluster").select("id", "vector", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

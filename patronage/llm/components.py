"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its least node.

    Alternates two steps until neither changes a link: each node hands its larger neighbours over
    to its least neighbour, then its smaller ones. Links only ever point to lower nodes, and
    the number of rounds grows with the logarithm of the graph's size. Each round is written to
    the shared folder, so a lost executor costs one round at most, and neither links nor
    components come to the driver.
    """
    a, b = F.col("a"), F.col("b")
    links = links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    links, state = written(links)
    while state[0]:
        following, new = written(smaller_to_least(larger_to_least(links)))
        links, old, state = following, state, new
        if new == old:
            break
    ends = links.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(ends)


def written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and what changes if one of them does."""
    links = materialize(links, "links")
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(38,0)"))).first()
    return links, tuple(row)


def larger_to_least(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def smaller_to_least(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    smaller = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return smaller.union(least).distinct()

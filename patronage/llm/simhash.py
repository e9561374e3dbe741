"""SimHash near-duplicates: fingerprints within a few bits, found with BK-trees.

A BK-tree keeps the children of a node by their Hamming distance to it; a search for everything
within ``r`` bits of a fingerprint at distance ``d`` from a node follows only the edges ``d - r`` to
``d + r``. Distinct fingerprints are dealt to shard trees by blocks of bits: cut into ``r + 1`` blocks,
two fingerprints within ``r`` bits agree on one block at least, so they meet in the tree of that
block's value. A shard that would hold too many is divided by blocks of its remaining bits, until
so few bits remain that the size of a tree is bounded by their number.

The trees grow with the corpus, so they are not broadcast: each fingerprint goes to the ``r + 1``
trees that may hold a neighbour, and is added and searched for there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from patronage.llm.components import connected_components
from patronage.session import materialize, small_table

BITS = 64
ALL_BITS = (1 << BITS) - 1
#: Most fingerprints in a shard tree.
TREE_NODES = 2048
#: Bytes of a text, and shingles, that are handled at once.
TEXT_BYTES, SHINGLE_ROWS = 1 << 22, 1 << 16
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def word_slices(text: bytes, shingle_words: int) -> Iterator[list[bytes]]:
    """The words of a text in slices that overlap by a shingle less one word."""
    start, carried = 0, []
    while True:
        cut = WHITE.search(text, start + TEXT_BYTES) if len(text) - start > TEXT_BYTES else None
        words = carried + text[start : cut.start() if cut else len(text)].split()
        if cut is None:
            yield words
            return
        if len(words) >= shingle_words:
            yield words
            carried = words[len(words) - shingle_words + 1 :]
        else:
            carried = words
        start = cut.end()


def shingle_hashes(text: bytes, shingle_words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of lower-cased words; of all words if there are fewer."""
    first = True
    for words in word_slices(text.lower(), shingle_words):
        if len(words) < shingle_words:  # the whole text, or a rest that was already counted
            if words and first:
                yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = len(words) - shingle_words + 1
        for at in range(0, last, SHINGLE_ROWS):
            upto = min(last, at + SHINGLE_ROWS)
            spans = zip(starts[at:upto].tolist(), ends[at + shingle_words - 1 : upto + shingle_words - 1].tolist())
            yield np.fromiter((xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in spans), dtype=np.uint64, count=upto - at)
        first = False


def simhash(text: bytes | None, shingle_words: int) -> int:
    """The fingerprint as a signed 64-bit number: a bit is 1 if set in over half the hashes."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text or b"", shingle_words):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(text: Column, shingle_words: int = 3) -> Column:
    """The SimHash of each text as a long. A null text, and one without words, has fingerprint zero."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([simhash(None if x is None else x.encode(), shingle_words) for x in batch.to_pylist()], pa.int64())

    return of(text)


class BKTree:
    """Fingerprints by Hamming distance: each node has its children by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)
            if at == new:
                return

    def within(self, value: int, radius: int) -> list[int]:
        """The nodes at most ``radius`` bits from ``value``."""
        found, waiting = [], [0] if self.values else []
        while waiting:
            at = waiting.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) > 2 * radius + 1:
                waiting += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
            else:
                waiting += [child for e, child in children.items() if d - radius <= e <= d + radius]
        return found


def tree_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what is within ``radius`` in one shard: every neighbour pair is found, and
    those that already hang together are not told again."""
    tree, group = BKTree(), list(range(len(members)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    links = []
    for i, value in enumerate(members):
        for j in tree.within(value & ALL_BITS, radius):
            a, b = root(i), root(j)
            if a != b:
                group[max(a, b)] = min(a, b)
                links.append((members[i], members[j]))
        tree.add(value & ALL_BITS)
    return links


def blocks(mask: int, count: int) -> list[int]:
    """The bits that ``mask`` leaves, in ``count`` blocks of nearly equal size, each joined to ``mask``."""
    left = [bit for bit in range(BITS) if not mask >> bit & 1]
    return [mask | sum(1 << int(bit) for bit in part) for part in np.array_split(left, count)]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def near_links(values: DataFrame, radius: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) that connect every two of the distinct fingerprints ``value`` at most ``radius`` bits apart.

    A pair is linked directly, or by a chain of links that are all within ``radius``.
    """
    spark = values.sparkSession
    schema = StructType([StructField("mask", LongType()), StructField("child", LongType())])
    pair = "array<struct<a:bigint,b:bigint>>"

    @F.arrow_udf(pair)
    def links(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            yield pa.array([[{"a": a, "b": b} for a, b in tree_links(sorted(members), radius)] for members in batch.to_pylist()], kind)

    first = [signed(mask) for mask in blocks(0, radius + 1)]
    keyed, found, masks = values.select("value", F.explode(F.lit(first)).alias("mask")), [], first
    while masks:
        keyed = keyed.withColumn("shard", F.col("value").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "shard").agg(F.count("*").alias("n")).where("n > 1")
        dealt = keyed.join(sizes, ["mask", "shard"])
        trees = dealt.where(F.col("n") <= tree_nodes).groupBy("mask", "shard").agg(F.collect_list("value").alias("members"))
        found.append(trees.select(F.explode(links("members")).alias("link")).select("link.a", "link.b"))
        members = materialize(dealt.where(F.col("n") > tree_nodes).select("value", "mask").distinct(), "large-shards")
        masks = [row["mask"] for row in members.select("mask").distinct().collect()]  # at most (radius + 1) ** level
        children = [(mask, signed(child)) for mask in masks for child in blocks(mask & ALL_BITS, radius + 1)]
        divided = members.join(F.broadcast(small_table(spark, children, schema)), "mask")
        keyed = divided.select("value", F.col("child").alias("mask"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: id, key, value (its fingerprint), component_id, kept.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; a component is what
    hangs together by links, named by its smallest non-null id (null if it has none). ``key`` is the
    hash of the text. ``kept`` marks one document of each component: the one of the smallest id
    (null last), then key; rows equal in id and text are all marked, being one document. Null and
    empty texts have fingerprint zero and are linked like any others.
    """
    prints = materialize(
        docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("key"), fingerprints(F.col(text), shingle_words).alias("value")), "simhash"
    )
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first")
    distinct = materialize(prints.groupBy("value").agg(first), "simhash-values")
    parts = connected_components(near_links(distinct, radius))
    labelled = distinct.join(parts.withColumnRenamed("node", "value"), "value", "left").withColumn("component", F.coalesce("component", "value"))
    least = labelled.groupBy("component").agg(F.min("first").alias("least"))
    classes = labelled.join(least, "component").select("value", "least")
    return prints.join(classes, "value").select(
        "id", "key", "value", F.col("least.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """One document of each group of near duplicates, with all its columns; of rows equal in id and text one."""
    found = near_duplicates(docs, id, text, shingle_words, radius).where("kept").select("id", "key").distinct()
    of = Window.partitionBy(id, "key__").orderBy(id)
    single = docs.withColumn("key__", F.xxhash64(text)).withColumn("rank__", F.row_number().over(of)).where("rank__ = 1")
    same = single[id].eqNullSafe(found["id"]) & (single["key__"] == found["key"])
    return single.join(found, same, "left_semi").select(*docs.columns)

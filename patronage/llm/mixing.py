"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by hash) and laid end to end, as often as its target asks
for; the stream is cut into blocks of equally many words. The schedule has one slot for each
block of the mix. Slot ``i`` draws the ``i``-th van der Corput point, the bits of ``i`` mirrored,
which is mapped through the cumulative weights (in slots) to a source; the k-th slot of a source
takes the k-th block of its stream. Any stretch of the schedule holds the sources nearly in the
proportions of the whole.

Only DataFrame functions. Running sums and ranks are taken in two steps, within pieces of bounded
size and over the pieces' totals, so no source is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.session import materialize

#: Words in a block. A source's last block may be shorter.
BLOCK_WORDS = 64
#: How often a document may be taken at most.
MOST_PASSES = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Slots of the schedule that are ranked together, per source.
SPAN = 4096
#: A source's documents are shuffled into so many pieces (a power of two), each summed up by itself.
PIECE_BITS = 12
WORD = "[^\\x20\\x09-\\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id: str, text: str) -> Column:
    """Where a document stands in its source's stream."""
    return F.xxhash64(F.col(id), F.col(text))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """Each source's target from (source, source_size), one row a source.

    Sources in the order of their names (null last) weigh ``weights``, repeating, and share the
    sum of all sizes. A target stops at ``most_passes`` times its source's size; what is above is
    shared by the others by weight, until none is above. That is one level, above which no
    source is filled: sources by size for their weight are full as long as the level over the
    rest is higher than theirs.

    The windows here see one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fullness = Window.orderBy("room", "source_no")
    earlier = by_fullness.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    factors = F.array(*(F.lit(float(w)) for w in weights))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    return (
        sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(factors, F.pmod("source_no", F.lit(len(weights))).cast("int") + 1))
        .withColumn("most", most_passes * F.col("source_size"))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") < F.col("room"), F.col("level"))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double")))
        .withColumn("mix_words", F.least(F.round("target").cast("long"), F.col("most")))
        .select("source", "source_no", "source_size", "target", "mix_words")
    )


def mirrored(value: Column, bits: int) -> Column:
    """The van der Corput point of a number, as an integer: its ``bits`` bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(value), bits, "0")), 2, 10).cast("long")


def schedule(spark: SparkSession, shares: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots as (slot, source_no, block): at ``slot``, the mix takes that block of that source.

    ``shares`` has source_no and mix_words. Slot numbers leave gaps, since the number of points
    is rounded up to a power of two.
    """
    every = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    needs = materialize(
        shares.withColumn("blocks", F.ceil(F.col("mix_words") / block_words))
        .withColumn("start", F.coalesce(F.sum("blocks").over(every), F.lit(0)))
        .select("source_no", "blocks", "start"),
        "shares",
    )
    total = needs.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    bits = max(1, (total - 1).bit_length()) if total else 1
    spans = needs.where("blocks > 0").select(
        "source_no", (F.col("start") + F.col("blocks")).alias("end"),
        F.explode(F.sequence("start", F.col("start") + F.col("blocks") - 1, F.lit(SPAN).cast("long"))).alias("first"),
    )
    parts = max(1, -(-total // (32 * SPAN)))
    points = spans.repartition(parts, "source_no", "first").select(
        "source_no", F.explode(F.sequence("first", F.least(F.col("first") + SPAN, "end") - 1)).alias("point")
    )
    slots = points.select("source_no", mirrored(F.col("point"), bits).alias("slot")).withColumn("span", F.floor(F.col("slot") / SPAN))
    totals = slots.groupBy("source_no", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_no", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source_no", "span").orderBy("slot"))
    # Spark takes what was exploded for as small as its source, so the joins say not to broadcast it
    return slots.withColumn("rank", rank).hint("merge").join(totals, ["source_no", "span"]).select(
        "slot", "source_no", (F.col("before") + F.col("rank") - 1).alias("block")
    )


def laid_out(units: DataFrame) -> DataFrame:
    """``units`` with ``offset``, the words of the same source that stand before it."""
    piece = F.shiftright("key", 64 - PIECE_BITS)
    units = units.withColumn("piece", piece)
    totals = units.groupBy("source_no", "piece").agg(F.sum("words").alias("n"))
    before = Window.partitionBy("source_no").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_no", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_no", "piece").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        units.withColumn("within", F.coalesce(F.sum("words").over(within), F.lit(0)))
        .join(totals, ["source_no", "piece"])
        .withColumn("offset", F.col("before") + F.col("within"))
        .drop("before", "within", "piece")
    )


def takings(units: DataFrame, slots: DataFrame, block_words: int, most_passes: int) -> DataFrame:
    """What the slots take of each unit: (source_no, key, id, taken, first_slot)."""
    begin, words, size, mix = F.col("begin"), F.col("words"), F.col("source_size"), F.col("mix_words")
    passes = units.select(
        "source_no", "key", "id", words, mix,
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(most_passes - 1)), lambda p: F.col("offset") + p * size)).alias("begin"),
    ).where(begin < mix)
    shares = (
        passes.withColumn("end", F.least(begin + words, mix))
        .withColumn("block", F.explode(F.sequence(F.floor(begin / block_words), F.floor((F.col("end") - 1) / block_words))))
        .withColumn("part", F.least(F.col("end"), (F.col("block") + 1) * block_words) - F.greatest(begin, F.col("block") * block_words))
    )
    return (
        shares.select("source_no", "block", "key", "id", "part")
        .join(slots.hint("merge"), ["source_no", "block"])
        .groupBy("source_no", "key", "id").agg(F.sum("part").alias("unit_taken"), F.min("slot").alias("first_slot"))
    )


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, most_passes: int = MOST_PASSES, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """What the mix takes of each document: id, key, source, size, source_size, target, taken, first_slot, source_no.

    ``size`` is the number of words in the text (null or empty: 0), ``target`` the words its source
    should give, ``taken`` the words of the document that the mix takes, repeats counted: at most
    ``most_passes`` times its size. A source's taken words are its target, rounded. ``first_slot``
    tells where the schedule comes to the document first (null if it doesn't).

    Null sources are a source of their own, the last one. Rows equal in id, source and text share
    what is taken of them evenly, rounded down. A table without words, or without rows, takes
    nothing. ``key`` is where the document stands in the shuffle; with id and source it finds the row again.
    """  # noqa: E501
    spark = docs.sparkSession
    rows = materialize(
        docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), shuffle_key(id, text).alias("key")),
        "sized",
    )
    shares = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_passes), "targets")
    equal = rows.groupBy("source", "key", "id").agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    units = equal.alias("e").join(shares.alias("s"), F.expr("e.source <=> s.source")).select(
        "e.*", "source_no", "source_size", "target", "mix_words", (F.col("copies") * F.col("size")).alias("words")
    )
    placed = laid_out(units.where("words > 0"))
    taken = takings(placed, schedule(spark, shares, block_words), block_words, most_passes)
    u, t = units.alias("u"), taken.alias("t")
    found = u.join(t, F.expr("u.source_no = t.source_no and u.key = t.key and u.id <=> t.id"), "left")
    per_unit = found.select(
        "u.source", "u.source_no", "u.key", "u.id", "source_size", "target", "first_slot",
        F.floor(F.coalesce("unit_taken", F.lit(0)) / F.col("copies")).alias("taken"),
    )
    r, p = rows.alias("r"), per_unit.alias("p")
    same_row = F.expr("r.key <=> p.key and r.source <=> p.source and r.id <=> p.id")
    return r.join(p, same_row).select(
        F.col("r.id").alias(id), F.col("r.key").alias("key"), F.col("r.source").alias(source), F.col("r.size").alias("size"),
        "source_size", "target", "taken", "first_slot", "source_no",
    )


def blend(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", most_passes: int = MOST_PASSES, **options
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document a whole number of times; documents that are not taken are gone.

    What ``mix`` takes is rounded down to whole documents. What a source lacks then, less than one of its documents, is
    made up by others of its documents, in the order of the shuffle, as long as they fit, and by one more if that
    comes closer to the target. No document is taken more than ``most_passes`` times. Rows equal in id, source and
    text are taken together.
    """
    found = mix(docs, id, text, source, most_passes=most_passes, **options).where("size > 0")
    equal = found.groupBy(F.col("key"), F.col(id).alias("id"), F.col(source).alias("source")).agg(
        F.max("source_no").alias("source_no"), F.max("size").alias("size"), F.max("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("copies")
    )
    units = materialize(
        equal.select("key", "id", "source", "source_no", "target", (F.col("copies") * F.col("size")).alias("words"), F.floor(F.col("taken") / F.col("size")).alias("times")), "units"
    )
    rooms = units.groupBy("source_no").agg((F.round(F.max("target")) - F.sum(F.col("times") * F.col("words"))).cast("long").alias("room"))
    rest = materialize(units.where(F.col("times") < most_passes).join(rooms, "source_no").select("source_no", "key", "id", "words", "room"), "rest")
    placed = laid_out(rest.where("words <= room")).where("offset + words <= room").select("source_no", "key", "id", "words")
    placed = materialize(placed, "made-up")
    made_up = placed.groupBy("source_no").agg(F.sum("words").alias("made_up"))
    r, p, u = rest.alias("r"), placed.alias("p"), units.alias("u")
    others = r.join(p, F.expr("r.source_no = p.source_no and r.key = p.key and r.id <=> p.id"), "left_anti").join(made_up, "source_no", "left")
    others = others.withColumn("lack", F.col("room") - F.coalesce("made_up", F.lit(0))).withColumn("miss", F.abs(F.col("lack") - F.col("words")))
    last = others.where("miss < lack").groupBy("source_no").agg(F.min(F.struct("miss", "key", "id")).alias("last")).select("source_no", "last.key", "last.id")
    more = placed.select("source_no", "key", "id").unionByName(last).withColumn("more", F.lit(1)).alias("m")
    counted = u.join(more, F.expr("u.source_no = m.source_no and u.key = m.key and u.id <=> m.id"), "left")
    times = (F.col("times") + F.coalesce("more", F.lit(0))).cast("int")
    taken = counted.select(F.col("u.id").alias("id__"), F.col("u.source").alias("source__"), F.col("u.key").alias("key__"), times.alias("times__")).where("times__ > 0")
    same = shuffle_key(id, text).eqNullSafe(F.col("key__")) & F.col(id).eqNullSafe(F.col("id__")) & F.col(source).eqNullSafe(F.col("source__"))
    joined = docs.join(taken, same)
    return joined.withColumn("time__", F.explode(F.sequence(F.lit(1), "times__"))).select(*docs.columns)

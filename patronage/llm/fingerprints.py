"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows
the document's, the sketch of a union is the union of the sketches, and the containment of a
short document in a long one is estimated as well as that of equals. How much a short text's likeness can be
off follows from the number of its shingles: see ``likeness``.

Only DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Hashes have so many bits, and those below 2 ** (HASH_BITS - FRACTION_BITS) are kept: one in two.
HASH_BITS, FRACTION_BITS = 48, 1
WHITE = " \t\n\x0b\x0c\r"
#: Documents in a range of ids that is brought in order together, about.
RANGE_ROWS = 1024
#: Quantiles of the ids that ranges are made from (a square), and their accuracy.
QUANTILES, ACCURACY = 1024, 20_000


def word_hashes(text: Column) -> Column:
    """The hash of every word; none for a null or blank text."""
    bare = F.btrim(text, F.lit(WHITE))
    words = F.when(bare != "", F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.xxhash64(w))


def digest(hashes: Column) -> Column:
    """One hash of the whole sequence of words, which tells equal texts with few shingles apart from others."""
    return F.xxhash64(hashes)


def shingles(hashes: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The hash of every shingle. A document of fewer words than a shingle is one shingle; one without words has none."""
    last = F.greatest(F.size(hashes) - (shingle_words - 1), F.lit(1))
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(hashes, i, shingle_words)), 64 - HASH_BITS))


def kept_of(every: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The distinct ones of shingle hashes below the fraction, ascending."""
    return F.sort_array(F.array_distinct(F.filter(every, lambda h: h < (1 << (HASH_BITS - fraction_bits)))))


def sketch(hashes: Column, shingle_words: int = SHINGLE_WORDS, fraction_bits: int = FRACTION_BITS) -> Column:
    """The kept hashes of a document's distinct shingles, ascending."""
    return kept_of(shingles(hashes, shingle_words), fraction_bits)


def written(mark: Column, kept: Column) -> Column:
    """A fingerprint as a string: the digest, then each kept hash in 12 hexadecimal digits."""
    digits = F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0"))
    return F.concat(F.lpad(F.lower(F.hex(mark)), 16, "0"), F.lit(":"), F.array_join(digits, ""))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column) -> Column:
    """How much of the smaller document's shingles the larger one holds, estimated; null without a kept hash in either."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, shared(a, b) / smaller)


def likeness(mark_a: Column, a: Column, mark_b: Column, b: Column) -> Column:
    """Containment, 0 to 1: 1 for equal sequences of words, 0 where a sketch is empty otherwise.

    From a text of ``n`` distinct shingles, a containment ``c`` is estimated with a standard error of about ``sqrt(c (1 - c) / n)``,
    since one hash in two is kept. A text of n shingles has an empty sketch with a chance of ``2 ** -n``.
    """
    return F.when(mark_a == mark_b, F.lit(1.0)).otherwise(F.coalesce(containment(a, b), F.lit(0.0)))


def merged(sketches: DataFrame, by: list[str], kept: str = "sketch") -> DataFrame:
    """The sketch of each group's documents taken together, as rows (by..., hash).

    Rows and not an array, since the sketch of a group grows with it.
    """
    return sketches.select(*by, F.explode(kept).alias("hash")).distinct()


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with digest, sketch and fingerprint; equal texts have equal ones. A null text counts
    as empty. Columns of these names already in ``docs`` are replaced."""
    hashes = "word_hashes__"
    return (
        docs.withColumn(hashes, word_hashes(F.col(text)))
        .withColumn("digest", digest(F.col(hashes)))
        .withColumn("sketch", sketch(F.col(hashes)))
        .withColumn("fingerprint", written(F.col("digest"), F.col("sketch")))
        .drop(hashes)
    )


def in_ranges(docs: DataFrame, id: str, carried: list[str], range_rows: int | None = None) -> DataFrame:
    """``docs`` with ``tie__`` and ``range__``: numbers that grow with the id, then the tie, each for about ``range_rows`` rows.

    Approximate quantiles of the ids make intervals of about equal numbers of rows, however the ids are spread; each is divided evenly
    by id, and ids that fill intervals of their own by the tie, a hash of what is carried. Null ids come below all others, divided
    by the tie as well.
    """
    places = ",".join(str(i / QUANTILES) for i in range(1, QUANTILES))
    n, low, high, bounds = docs.agg(F.count("*"), F.min(id), F.max(id), F.expr(f"percentile_approx({id}, array({places}), {ACCURACY})")).first()
    edges = [low, *bounds, high] if bounds else [0, *[0] * (QUANTILES - 1), 0]
    parts = max(1, -(-n // (QUANTILES * (range_rows or RANGE_ROWS))))
    times = [edges[1:-1].count(edge) for edge in edges]

    def constants(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    step, wanted = math.isqrt(QUANTILES), F.col(id)
    upper, inner = constants(edges[step:-1:step]), constants(edges[1:])
    coarse = F.size(F.filter(upper, lambda edge: edge < wanted)) * step
    slot = coarse + F.size(F.filter(F.slice(inner, coarse + 1, step - 1), lambda edge: edge < wanted))
    rows = docs.withColumn("tie__", F.xxhash64(*carried)).withColumn("slot__", slot)
    lo, hi, many = (F.get(constants(values), F.col("slot__")) for values in (edges, edges[1:], times[1:]))
    exact = lambda c: c.cast("decimal(20,0)")
    along = F.floor((exact(wanted) - exact(lo)) * parts / F.nullif(exact(hi) - exact(lo), F.lit(0).cast("decimal(20,0)")))
    share = F.shiftright("tie__", 32) + F.lit(1 << 31)  # of 2 ** 32, in the order of the tie
    alone = F.lit(parts) + F.shiftright(share * F.least(many * parts, F.lit(1 << 30)), 32)
    part = F.when((wanted == hi) & (many > 1), alone).otherwise(F.least(F.coalesce(along, F.lit(0)).cast("long"), F.lit(parts - 1)))
    nulls = F.shiftright("tie__", 52).cast("long") - 2049
    return rows.withColumn("range__", F.when(wanted.isNull(), nulls).otherwise(F.col("slot__").cast("long") * ((QUANTILES + 2) * parts) + part)).drop("slot__")


def with_next(docs: DataFrame, id: str, carried: list[str], range_rows: int | None = None) -> DataFrame:
    """``docs`` with ``next``, a struct of the ``carried`` columns of the next row by descending id;
    after the last row, of the first.

    Null ids come last; rows of equal id are ordered by the hash of what is carried. Ranges of ids of
    about ``range_rows`` rows are ordered by themselves. Each range gets a copy of the row that
    follows it, the first one of the range below, so everything carried moves once.
    """
    rows = in_ranges(docs, id, carried, range_rows)
    order = [F.col(id).desc_nulls_last(), F.col("tie__").desc()]
    numbers = rows.select("range__").distinct()
    above = F.coalesce(F.lag("range__").over(Window.orderBy(F.desc("range__"))), F.min("range__").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    numbers = numbers.select("range__", above.alias("above__"))
    firsts = rows.withColumn("rank__", F.row_number().over(Window.partitionBy("range__").orderBy(*order))).where("rank__ = 1").drop("rank__")
    guests = firsts.join(numbers, "range__").withColumn("range__", F.col("above__")).drop("above__")
    every = rows.withColumn("guest__", F.lit(False)).unionByName(guests.withColumn("guest__", F.lit(True)))
    following = F.lead(F.struct(*carried)).over(Window.partitionBy("range__").orderBy("guest__", *order))
    return every.withColumn("next", following).where("not guest__").drop("guest__", "range__", "tie__")


def edited_likeness(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts and of edited texts, and how alike they are.

    A text is edited by replacing the last half of its characters by as many from the start of the
    next document's text (by descending id, after the last the first), or by all that it has. A
    null text counts as empty, and so does its edit. The only row of a table is followed by itself.
    """
    texts = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = with_next(texts, "id", ["text"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    printed = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    for name, of in (("own", F.col("text")), ("edited", F.col("edited")), ("next", F.col("next.text"))):
        hashes = F.col(f"{name}_hashes")
        printed = printed.withColumn(f"{name}_hashes", word_hashes(of)).withColumn(f"{name}_digest", digest(hashes)).withColumn(f"{name}_sketch", sketch(hashes))
    parts = {name: [F.col(f"{name}_{part}") for part in ("digest", "sketch")] for name in ("own", "edited", "next")}
    return printed.select(
        F.col("id").alias(id), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own_digest"), F.col("own_sketch")).alias("fingerprint"),
        written(F.col("edited_digest"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(*parts["own"], *parts["edited"]).alias("near_edited"),
        likeness(*parts["own"], *parts["next"]).alias("near_next"),
    )

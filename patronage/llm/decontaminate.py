"""Benchmark decontamination by templates.

Words are brought into a canonical form: lower case without punctuation around them, and numbers,
names and units replaced by placeholders of their type. Windows of consecutive canonical words,
templates, of a benchmark are joined with those of the documents by hash, and so are windows of the
words themselves without case and punctuation. A window of equal words makes a document a verbatim copy,
whatever its capitals and sentences. Where a document matches templates of an item along one alignment,
what fills the placeholders is compared: other fillers make it the same question with other parameters,
if each filler of the item always stands for the same filler of the document and the other way round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.words import run_hashes, split_words
from patronage.session import materialize

#: Words in a template or literal window; shorter items are one each, below the second number a literal one only.
TEMPLATE_WORDS, SHORTEST_ITEM = 10, 5
#: Scripts without spaces: each letter counts as a word, and items mostly of them have windows of so many.
UNSPACED, UNSPACED_WORDS = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", 20
#: Words that must match literally where parameters differ (all that the whole item has, if fewer), and the least share in a template.
LITERAL_WORDS, LITERAL_SHARE = 8, 0.5
#: Templates that are broadcast at once: 16 MB. Larger benchmarks take several passes over the documents.
BLOCK_TEMPLATES = 2_000_000
#: Bytes of text, and distinct words remembered, in a task.
BLOCK_BYTES, KNOWN_WORDS = 1 << 21, 200_000
# Words that count as units.
UNITS = frozenset("""
mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs
ml cl l liter liters litre litres gallon gallons cup cups
second seconds minute minutes hour hours day days week weeks month months year years
dollar dollars cent cents euro euros usd eur percent degree degrees
""".split())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER = re.compile(r"\d+(?:[.,:/\-]\d+)*")
#: Punctuation inside a word that a copy may lack.
INNER = re.compile(r"[!-/:-@\[-`{-~\u2010-\u201f]+")
MEASURE = re.compile(r"\d+(?:[.,]\d+)*([^\W\d_]+)")
SENTENCE_END = re.compile(r"[.!?:][\"')\]]*$")
NUM, UNIT, NAME, MEASURED = "<num>", "<unit>", "<name>", "<num><unit>"


def canonical(word: str) -> tuple[str, str, bool]:
    """A word's form at the start of a sentence, its form elsewhere, and whether a sentence ends with it.

    Capital letters make a name only where a sentence does not begin. What is all punctuation has
    no form.
    """
    ends = bool(SENTENCE_END.search(word))
    core = EDGE.sub("", word)
    if not core:
        return "", "", ends
    low = core.lower()
    measure = MEASURE.fullmatch(low)
    if NUMBER.fullmatch(core):
        form = NUM
    elif low in UNITS:
        form = UNIT
    elif measure and measure[1] in UNITS:
        form = MEASURED
    else:
        return low, NAME if core[0].isupper() else low, ends
    return form, form, ends


def bare(word: str) -> str:
    """A word without case and punctuation; numbers keep what stands between their digits."""
    core = EDGE.sub("", word).casefold()
    return core if NUMBER.fullmatch(core) else INNER.sub("", core)


def spaced(texts: pa.Array) -> pa.Array:
    """Texts with spaces around each letter of scripts that have none."""
    if not pc.any(pc.match_substring_regex(texts, UNSPACED)).as_py():
        return texts
    return pc.replace_substring_regex(texts, UNSPACED, r" \1 ")


class Read(NamedTuple):
    """Of all words with a form: hashes of their canonical and bare forms, whether placeholders, whether at a
    sentence's start, and the words; and where texts begin."""

    hashes: np.ndarray
    bare: np.ndarray
    slots: np.ndarray
    starts: np.ndarray
    words: pa.Array
    begins: np.ndarray


class Canonical:
    """Canonical words of many texts, with what was learned about words kept for the next call."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int, int]] = {}

    def word(self, word: str) -> tuple[int, int, int, int]:
        """Hashes of both forms and of the bare word, and flags: 1 no form, 2 placeholder at a start, 4 elsewhere, 8 ends a sentence."""
        first, other, ends = canonical(word)
        flags = (not first) + 2 * first.startswith("<") + 4 * other.startswith("<") + 8 * ends
        least = first.casefold() if first.isalnum() else bare(word)  # without inner punctuation, the same by a shorter way
        one = xxhash.xxh3_64_intdigest(first)
        return one, one if other == first else xxhash.xxh3_64_intdigest(other), one if least == first else xxhash.xxh3_64_intdigest(least), flags

    def __call__(self, texts: pa.Array, opened: bool = False) -> Read:
        """The words of texts; ``opened`` texts are taken as if they went on a sentence."""
        words, begins = split_words(spaced(texts))
        coded = words.dictionary_encode()
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known, rows = self.known, []
        for word in coded.dictionary.to_pylist():
            row = known.get(word)
            if row is None:
                known[word] = row = self.word(word)
            rows.append(row)
        table = np.array(rows, dtype=np.uint64).reshape(-1, 4)
        codes = coded.indices.to_numpy()
        flags = table[codes, 3].astype(np.uint8)
        starts = np.zeros(len(words), dtype=bool)
        starts[1:] = flags[:-1] & 8 > 0
        starts[begins[:-1][begins[:-1] < len(words)]] = not opened
        formed = flags & 1 == 0
        hashes = np.where(starts, table[codes, 0], table[codes, 1])
        slots = np.where(starts, flags & 2, flags & 4) > 0
        upto = np.concatenate(([0], np.cumsum(formed)))
        return Read(hashes[formed], table[codes, 2][formed], slots[formed], starts[formed], words.filter(pa.array(formed)), upto[begins])


def templates(hashes: np.ndarray, slots: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where templates of ``length`` words begin that are literal enough, and their hashes."""
    at = np.arange(max(0, len(hashes) - length + 1))
    ends = np.repeat(begins[1:], np.diff(begins))
    filled = np.concatenate(([0], np.cumsum(slots)))
    literal = length - (filled[length:] - filled[: len(at)]) if len(at) else at
    keep = (ends[: len(at)] - at >= length) & (literal >= LITERAL_SHARE * length)
    return at[keep], run_hashes(hashes, length)[keep] ^ np.uint64(length)


def found_rows(at: np.ndarray, code: np.ndarray, length: int, literal: bool, read: Read) -> dict[str, list]:
    """One row a template: which text, where, its canonical or bare words, and its placeholders' fillers with their places."""
    rows: dict[str, list] = {"text_no": [], "at": [], "length": [], "literals": [], "code": [], "template": [], "fillers": []}
    upto = np.concatenate(([0], np.cumsum(~read.slots)))
    literals = (upto[read.begins[1:]] - upto[read.begins[:-1]]).tolist()
    slots, starts, words, begins = read.slots, read.starts, read.words, read.begins
    for i, c in zip(at.tolist(), code.tolist()):
        text_no = int(np.searchsorted(begins, i, side="right")) - 1
        own = words.slice(i, length).to_pylist()
        forms = [bare(w) if literal else canonical(w)[0 if s else 1] for w, s in zip(own, starts[i : i + length].tolist())]
        rows["text_no"].append(text_no)
        rows["at"].append(i - int(begins[text_no]))
        rows["length"].append(length)
        rows["literals"].append(literals[text_no])
        rows["code"].append(c - (1 << 64) if c >> 63 else c)
        rows["template"].append(" ".join(forms))
        rows["fillers"].append([{"at": i - int(begins[text_no]) + k, "value": EDGE.sub("", w).lower()} for k, w in enumerate(own) if slots[i + k]])
    return rows


FOUND = "id bigint, key bigint, at int, length int, literal boolean, literals int, code bigint, template string, fillers array<struct<at:int,value:string>>"
FILLERS = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())]))


def blocks_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``BLOCK_BYTES`` of text."""
    sizes = pc.binary_length(batch["text"].fill_null("")).to_numpy()
    group = np.cumsum(sizes) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def rows_of(batch: pa.RecordBatch, read: Read, at: np.ndarray, code: np.ndarray, size: int, literal: bool) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(at), 10_000):
        rows = found_rows(at[start : start + 10_000], code[start : start + 10_000], size, literal, read)
        text_no = pa.array(rows["text_no"])
        yield pa.RecordBatch.from_arrays(
            [
                batch["id"].take(text_no), batch["key"].take(text_no), pa.array(rows["at"], pa.int32()), pa.array(rows["length"], pa.int32()),
                pa.array([literal] * len(text_no)), pa.array(rows["literals"], pa.int32()), pa.array(rows["code"], pa.int64()), pa.array(rows["template"]), pa.array(rows["fillers"], FILLERS),
            ],
            ["id", "key", "at", "length", "literal", "literals", "code", "template", "fillers"],
        )


def windows(read: Read, size: int, literal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``size`` bare words, or templates, begin, and their hashes."""
    if literal:
        return templates(read.bare, np.zeros(len(read.bare), dtype=bool), read.begins, size)
    return templates(read.hashes, read.slots, read.begins, size)


def window_sizes(read: Read) -> np.ndarray:
    """Words in the windows of each item."""
    single = pc.and_(pc.equal(pc.utf8_length(read.words), 1), pc.match_substring_regex(read.words, UNSPACED))
    upto = np.concatenate(([0], np.cumsum(single.to_numpy(zero_copy_only=False))))
    lengths, unspaced = np.diff(read.begins), np.diff(upto[read.begins])
    return np.minimum(lengths, np.where(2 * unspaced > lengths, UNSPACED_WORDS, TEMPLATE_WORDS))


def of_items(batches: Iterator[pa.RecordBatch], short_items: bool) -> Iterator[pa.RecordBatch]:
    """Templates and literal windows of (id, key, text) rows of a benchmark.

    Items of one window that have no template have a literal window with ``short_items`` only.

    A template that begins with an item's first word comes in both forms of that word, as it may stand
    inside a sentence elsewhere.
    """
    canon = Canonical()
    for whole in batches:
        for batch in blocks_of(whole):
            for opened in (False, True):
                read = canon(batch["text"], opened)
                lengths, own_size = np.diff(read.begins), window_sizes(read)
                for size in sorted({int(n) for n in own_size if n}):
                    for literal in (False,) if opened else (False, True):
                        at, code = windows(read, size, literal)
                        item = np.searchsorted(read.begins, at, side="right") - 1
                        own = own_size[item] == size
                        if opened:
                            own &= (at == read.begins[item]) & read.slots[at]
                        if not literal:
                            own &= size >= SHORTEST_ITEM
                            typed_items = item[own]
                        elif not short_items:
                            own &= (lengths[item] >= TEMPLATE_WORDS) | np.isin(item, typed_items)
                        yield from rows_of(batch, read, at[own], code[own], size, literal)


class Wanted:
    """Sorted hashes, behind a table of their first bits that turns most others away."""

    def __init__(self, codes: np.ndarray) -> None:
        bits = min(26, len(codes).bit_length() + 4)
        self.codes, self.shift = codes, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[codes >> self.shift] = True

    def places(self, code: np.ndarray) -> np.ndarray:
        """Where ``code`` is one of the hashes."""
        at = np.flatnonzero(self.seen[code >> self.shift])
        found = np.searchsorted(self.codes, code[at])
        return at[self.codes[np.minimum(found, len(self.codes) - 1)] == code[at]]


def matching(batches: Iterator[pa.RecordBatch], wanted: dict[tuple[bool, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Those templates and literal windows of (id, key, text) rows that are in ``wanted``, sorted hashes by kind and length."""
    canon, kinds = Canonical(), {kind: Wanted(codes) for kind, codes in sorted(wanted.items())}
    for whole in batches:
        for batch in blocks_of(whole):
            read = canon(batch["text"])
            filled = np.concatenate(([0], np.cumsum(read.slots)))
            for (literal, size), codes in kinds.items():
                code = run_hashes(read.bare if literal else read.hashes, size) ^ np.uint64(size)
                at = codes.places(code)
                keep = read.begins[np.searchsorted(read.begins, at, side="right")] - at >= size
                if not literal:
                    keep &= size - (filled[at + size] - filled[at]) >= LITERAL_SHARE * size
                yield from rows_of(batch, read, at[keep], code[at[keep]], size, literal)


def keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def benchmark_templates(benchmark: DataFrame, id: str = "item_id", text: str = "text", short_items: bool = False) -> DataFrame:
    """The templates and literal windows of a benchmark: (item_id, item_literals, item_at, length, literal, code, template, item_fillers).

    Equal items are one, named by the smallest id. A null or empty item has none and is never found. An
    item of fewer than ``SHORTEST_ITEM`` words, and one of fewer than ``TEMPLATE_WORDS`` that is mostly
    placeholders, has none unless ``short_items``: then it is found wherever a text has just its words.
    """
    single = keyed(benchmark, id, text).where("text is not null").groupBy("key", "text").agg(F.min("id").alias("id"))
    found = single.select("id", "key", "text").mapInArrow(lambda batches: of_items(batches, short_items), FOUND)
    return found.select(F.col("id").alias("item_id"), F.col("literals").alias("item_literals"), F.col("at").alias("item_at"), "length", "literal", "code", "template", F.col("fillers").alias("item_fillers"))


def candidates(docs: DataFrame, items: DataFrame) -> Iterator[DataFrame]:
    """Templates of the documents that also are the benchmark's, in one frame for each block of those."""
    spark = docs.sparkSession
    codes = items.select("literal", "length", "code").distinct()
    blocks = max(1, -(-codes.count() // BLOCK_TEMPLATES))
    for block in range(blocks):
        rows = codes.where(F.pmod(F.col("code"), F.lit(blocks)) == block).toArrow()  # about BLOCK_TEMPLATES rows
        literal, lengths = rows["literal"].to_numpy(zero_copy_only=False).astype(bool), rows["length"].to_numpy()
        values = rows["code"].to_numpy().astype(np.int64).view(np.uint64)
        kinds = sorted(set(zip(literal.tolist(), lengths.tolist())))
        sent = spark.sparkContext.broadcast({(k, n): np.sort(values[(literal == k) & (lengths == n)]) for k, n in kinds})
        yield docs.mapInArrow(lambda batches, sent=sent: matching(batches, sent.value), FOUND)


def covered(starts: Column, length: Column) -> Column:
    """Words covered by runs of ``length`` at the ascending ``starts``."""
    steps = F.transform(F.sequence(F.lit(1), F.size(starts)), lambda i: F.when(i == F.size(starts), length).otherwise(
        F.least(length, F.get(starts, i) - F.get(starts, i - 1))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def distinct_size(values: Column) -> Column:
    return F.size(F.array_distinct(values))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", short_items: bool = False
) -> DataFrame:
    """Documents that hold benchmark items: one row for each document and item found in it, as (id, key,
    item_id, kind, literal_words, matched_words, fillers, at).

    ``kind`` is ``verbatim`` or ``reparameterised``; ``at`` is where the best alignment starts, in words of
    the document (those that are all punctuation not counted, and each letter of a script without spaces
    counted as one). Short items, and those of mostly placeholders, are looked for with ``short_items``, as
    they are; without, a benchmark's one-word answers do not mark every document with that word. ``key`` is the hash of the document's text,
    for documents of equal or null id. Null and empty texts hold nothing; an empty table on either
    side gives no row.
    """
    items = materialize(benchmark_templates(benchmark, item_id, item_text, short_items), "templates")
    frames = list(candidates(keyed(docs, id, text), items))
    found = frames[0]
    for more in frames[1:]:
        found = found.unionAll(more)
    pairs = found.join(items, ["literal", "length", "code", "template"])
    slots = F.when(F.col("literal"), F.transform("item_fillers", lambda s: F.struct(
        (s["at"] + F.col("shift")).alias("at"), s["value"].alias("ours"), s["value"].alias("theirs")))
    ).otherwise(F.arrays_zip(F.col("fillers.at").alias("at"), F.col("fillers.value").alias("ours"), F.col("item_fillers.value").alias("theirs")))
    aligned = (
        pairs.withColumn("shift", F.col("at") - F.col("item_at")).withColumn("slots", slots)
        .groupBy("id", "key", "item_id", "shift", "length")
        .agg(F.sort_array(F.collect_set("at")).alias("starts"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.max("literal").alias("exact"), F.min("item_literals").alias("item_literals"))
        .withColumn("matched_words", covered(F.col("starts"), F.col("length")))
        .withColumn("literal_words", F.col("matched_words") - distinct_size(F.col("slots.at")))
        .withColumn("mapping", F.array_distinct(F.transform("slots", lambda s: F.struct(s["ours"], s["theirs"]))))
        .withColumn("consistent", (F.size("mapping") == distinct_size(F.col("slots.ours"))) & (F.size("mapping") == distinct_size(F.col("slots.theirs"))))
        .where(F.col("exact") | F.col("consistent") & (F.col("literal_words") >= F.least(F.lit(LITERAL_WORDS), F.col("item_literals"))))
    )
    best = F.max_by(
        F.struct(F.when(F.col("exact"), "verbatim").otherwise("reparameterised").alias("kind"), "literal_words", "matched_words", F.col("slots").alias("fillers"), F.get("starts", F.lit(0)).alias("at")),
        F.struct("exact", "matched_words", -F.col("shift")),
    )
    return aligned.groupBy("id", "key", "item_id").agg(best.alias("best")).select(F.col("id").alias(id), "key", "item_id", "best.*")


def whole_parts(docs: DataFrame, text: str) -> Column:
    """The lines and sentences of a text."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return F.flatten(F.transform(lines, lambda line: F.concat(F.array(line), F.split(line, r"(?<=[.!?:][\"')\]]{0,1})[ \t]+"))))


def folded(text: Column) -> Column:
    """A text without case, and with one space for what is no letter and no digit."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def clean(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", short_items: bool = False, item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    With ``short_items``, an item of fewer than ``SHORTEST_ITEM`` words says something about a document only where a
    line or a sentence of it is the item, but for case and punctuation; elsewhere its words are anybody's, and the document stays.
    Longer items count wherever they are found. Nulls and empty texts hold nothing; ids may repeat or be
    null, since documents are told apart by id and text.
    """
    found = leaks(docs, benchmark, id, text, item_id, item_text, short_items).select(F.col(id).alias("found_id"), F.col("key").alias("found_key"), "item_id", "matched_words")
    found = materialize(found, "leaks")  # read several times below
    gone = found.where(F.col("matched_words") >= SHORTEST_ITEM).select("found_id", "found_key").distinct()
    marked = docs.withColumn("key__", F.xxhash64(text))
    short = found.where(F.col("matched_words") < SHORTEST_ITEM)
    if short_items and not short.isEmpty():
        # an item is named by the smallest of its ids, and so is found under that
        items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), folded(F.col(item_text)).alias("item"))
        wanted = materialize(short.join(items, "item_id").groupBy("found_id", "found_key").agg(F.collect_set("item").alias("items")), "short-items")
        holding = marked.select(id, text, "key__")
        holding = holding.join(wanted, same_key(holding, id))
        alone = holding.where(F.arrays_overlap(F.transform(whole_parts(holding, text), folded), "items"))
        gone = gone.unionAll(alone.select("found_id", "found_key")).distinct()
    return marked.join(gone, same_key(marked, id), "left_anti").select(*docs.columns)


def same_key(docs: DataFrame, id: str) -> Column:
    return docs[id].eqNullSafe(F.col("found_id")) & (docs["key__"] == F.col("found_key"))

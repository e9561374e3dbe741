"""Token counts by a two-tier lookup inside map tasks.

A text is cut in front of every space that a visible character follows. The byte-level
pre-tokenizer always cuts there too, so token counts of the pieces add up to the count of
the text. Tier one is a broadcast table of the lengths of frequent pieces, tier two a bounded
cache in each worker for all others, filled by the library. No piece is shuffled; finding the
frequent ones moves a bounded summary from each task.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space, and what follows for certain is no white space.
CUT = re.compile(r" (?=[!-~\w])")
#: A space that need not be a cut.
UNSURE = re.compile(r" (?![!-~\w])")
#: Characters of text handled at once, so that the pieces of long texts fit in memory.
BLOCK_CHARS = 1 << 20


def pieces(text: str) -> list[str]:
    """The pieces of a text. The first carries a space in front as its mark; the others have
    lost the space they begin with."""
    found = CUT.split(text) if UNSURE.search(text) else text.split(" ")
    found[0] = " " + found[0]
    return found


def spoken(piece: str) -> str:
    """The characters that a piece stands for."""
    return piece[1:] if piece.startswith(" ") else " " + piece


def slices(text: str) -> Iterator[list[str]]:
    """The pieces of a text, of about ``BLOCK_CHARS`` characters at a time."""
    start, first = 0, True
    while True:
        cut = CUT.search(text, start + BLOCK_CHARS) if len(text) - start > BLOCK_CHARS else None
        found = pieces(text[start : cut.start() if cut else len(text)])
        if not first:
            found[0] = found[0][1:]
        yield found
        if cut is None:
            return
        start, first = cut.end(), False


class Known(dict):
    """Token counts by piece. Those looked up in vain count as nothing and are noted in ``missed``."""

    def __init__(self, held: dict[str, int]) -> None:
        super().__init__(held)
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.missed.append(piece)
        return 0


class PieceLengths:
    """Token counts of pieces: the frequent ones as sent, others cached as they occur."""

    def __init__(self, path: str, frequent: dict[str, int], cache_entries: int) -> None:
        self.path, self.frequent, self.cache_entries = path, frequent, cache_entries
        self.known = Known({})
        self.library = None

    def load(self):
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
            self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        return self.library

    def lengths(self, found: list[str]) -> list[int]:
        # the fast form keeps no offsets, which nothing here asks for
        return list(map(len, self.load().encode_batch_fast(found, add_special_tokens=False)))

    def counts(self, texts: list[str | None]) -> list[int]:
        self.load()
        totals, waiting, size = [0] * len(texts), [], 0
        for at, text in enumerate(texts):
            if not text:
                continue
            if any(token in text for token in self.special):
                totals[at] = self.lengths([text])[0]
                continue
            for found in slices(text):
                waiting.append((at, found))
                size += sum(map(len, found))
                if size >= BLOCK_CHARS:
                    self.settle(waiting, totals)
                    waiting, size = [], 0
        self.settle(waiting, totals)
        return totals

    def settle(self, waiting: list[tuple[int, list[str]]], totals: list[int]) -> None:
        if not self.known or len(self.known) > len(self.frequent) + self.cache_entries:
            self.known = Known(self.frequent)
        missed = []
        for at, found in waiting:
            totals[at] += sum(map(self.known.__getitem__, found))
            missed.append((at, self.known.missed))
            self.known.missed = []
        new = list(set().union(*(found for _, found in missed)))
        self.known.update(zip(new, self.lengths([spoken(piece) for piece in new])))
        for at, found in missed:
            totals[at] += sum(map(self.known.__getitem__, found))


def frequent_pieces(docs: DataFrame, text: str = "text", entries: int = 32_768, per_task: int = 8_192) -> DataFrame:
    """The most frequent pieces of all texts as (piece, n).

    Each task sends its own ``per_task`` most frequent pieces, so counts of pieces near the
    end of the table are low estimates; they only decide which tier a piece is looked up in.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                for found in slices(value.as_py() or ""):
                    seen.update(found)
                if len(seen) > 40 * per_task:
                    seen = Counter(dict(seen.most_common(20 * per_task)))
        top = [(piece, n) for piece, n in seen.most_common(per_task) if n > 1 and len(piece) < 64]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    return (
        docs.select(text).mapInArrow(summary, "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(entries)
    )


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", table_entries: int = 32_768, cache_entries: int = 300_000
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit, for a byte-level BPE file of the tokenizers library.

    ``tokenizer`` is a path that every worker can read. A null text counts as empty: no bytes,
    no tokens. Texts that contain a special token's string go to the library whole. Columns of
    these names already in ``docs`` are replaced. Repeated rows are counted each.
    """
    names = [row["piece"] for row in frequent_pieces(docs, text, table_entries).collect()]  # at most table_entries
    lengths = PieceLengths(tokenizer, {}, cache_entries).lengths([spoken(name) for name in names])
    # A plain dict, which workers can read without this package; each worker puts its own table with its cache beside it.
    sent = docs.sparkSession.sparkContext.broadcast({"frequent": dict(zip(names, lengths))})

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = sent.value
        if "table" not in held:
            held["table"] = PieceLengths(tokenizer, held["frequent"], cache_entries)
        for batch in batches:
            found: list[int] = []
            for start in range(0, len(batch), 64):
                found += held["table"].counts(batch.slice(start, 64).to_pylist())
            yield pa.array(found, pa.int64())

    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", tokens(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )

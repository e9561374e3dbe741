"""Substring dedup with fixed-block anchors.

Every text is cut into blocks of half a window that do not overlap; these are the index. Any
repeat of a whole window holds one of the earlier text's blocks, so it is found by probing the index
with every run of that many words. Where a probe hits, the anchor is extended to the windows around
it, which are compared by a hash of all their words; windows that start earlier elsewhere are
removed, and neighbours join into maximal repeats.

The work is dealt twice. Documents form chunks of a few megabytes. A chunk sends each distinct probe
once, four bytes long, to the bucket of its hash, and each bucket answers with a bit for each probe:
the hash is that of a block, and occurs more than once. Then the windows around hits go the same way.
So a passage that thousands of documents share costs a bucket one entry for each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.words import OTHER_BASE, run_hashes, split_words, whole_runs, word_hashes

WINDOW_WORDS = 20
#: Bytes of text in a chunk and behind a bucket; both set the memory a task needs.
CHUNK_BYTES, BUCKET_BYTES = 3 << 20, 8 << 20
MESSAGE = "bucket bigint, chunk bigint, step int, body binary, marks binary, ranks binary"
ANSWER = "chunk bigint, step int, bucket bigint, bits binary"


class Chunk:
    """The documents of a chunk in their order, their words, and the hashes of all runs."""

    def __init__(self, table: pa.Table, window: int, buckets: int) -> None:
        table = table.sort_by([("late", "ascending"), ("rank", "ascending"), ("text", "ascending")])
        self.table, self.window, self.block, self.buckets = table, window, (window + 1) // 2, buckets
        self.words, self.begins = split_words(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))
        self.hashes = word_hashes(self.words)
        self.doc = np.repeat(np.arange(table.num_rows), np.diff(self.begins))
        self.at = np.arange(len(self.hashes)) - self.begins[:-1][self.doc]

    def bucket(self, code: np.ndarray) -> np.ndarray:
        return ((code >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct probes (bucket and 32 bits of hash), which probe each run is, which are blocks, which occur again."""
        self.runs = whole_runs(self.begins, self.block)
        code = run_hashes(self.hashes, self.block)[self.runs]
        values, of, counts = np.unique((self.bucket(code) << np.uint64(32)) | (code & np.uint64(0xFFFFFFFF)), return_inverse=True, return_counts=True)
        blocks = np.zeros(len(values), dtype=bool)
        blocks[of[self.at[self.runs] % self.block == 0]] = True
        return values, of, blocks, counts > 1

    def candidates(self, hits: np.ndarray) -> None:
        """The distinct windows around hits (a flag for each run), with the first occurrence of each."""
        here = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        here[self.runs + 1] = hits
        upto = np.cumsum(here)
        starts = whole_runs(self.begins, self.window)
        self.starts = starts = starts[upto[starts + self.window - self.block + 1] > upto[starts]]
        code = run_hashes(self.hashes, self.window)[starts]
        more = run_hashes(self.hashes, self.window, OTHER_BASE)[starts].astype(np.uint32)
        rank, late = self.table["rank"].to_numpy(), self.table["late"].to_numpy()
        docs = self.table.num_rows
        other = np.ones(docs, dtype=bool)
        other[1:] = (rank[1:] != rank[:-1]) | (late[1:] != late[:-1])
        order = np.cumsum(other)[self.doc[starts]]  # equal for rows of the same document
        by = np.lexsort((self.at[starts], order, more, code))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (code[by][1:] != code[by][:-1]) | (more[by][1:] != more[by][:-1])
        group = np.cumsum(new) - 1
        first = by[new]
        self.of = np.empty(len(by), dtype=np.int64)
        self.of[by] = group
        lead = first[self.of]
        self.repeated = (order != order[lead]) | (self.at[starts] != self.at[starts][lead])
        self.code, self.more = code[first], more[first]
        self.rank, self.late = rank[self.doc[starts[first]]], late[self.doc[starts[first]]]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """For each word, whether a window that starts earlier elsewhere covers it; ``earlier``: a flag for each distinct window."""
        gone = self.starts[self.repeated | earlier[self.of]]
        edges = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + self.window, -1)
        return np.cumsum(edges[:-1]) > 0


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(body: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, dtype=np.uint8), count=count).astype(bool)


def parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in an ascending array."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def messages(rows: list[tuple]) -> pa.Table:
    kinds = [("bucket", pa.int64()), ("chunk", pa.int64()), ("step", pa.int32()), ("body", pa.binary()), ("marks", pa.binary()), ("ranks", pa.binary())]
    return pa.Table.from_arrays([pa.array([row[i] for row in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def answers(rows: list[tuple]) -> pa.Table:
    kinds = [("chunk", pa.int64()), ("step", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())]
    return pa.Table.from_arrays([pa.array([row[i] for row in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def ask_blocks(table: pa.Table, window: int, buckets: int) -> pa.Table:
    """A chunk's probes, dealt to buckets."""
    values, _, blocks, again = Chunk(table, window, buckets).probes()
    number = table["chunk"][0].as_py()
    bucket = values >> np.uint64(32)
    return messages([
        (b, number, 1, values[s].astype(np.uint32).tobytes(), bits(blocks[s]) + bits(again[s]), b"") for b, s in parts(bucket)
    ])


def answer_blocks(table: pa.Table) -> pa.Table:
    """For each probe of each chunk, whether its hash is a block's and occurs more than once."""
    rows = table.to_pylist()
    bodies = [np.frombuffer(row["body"], dtype=np.uint32) for row in rows]
    value = np.concatenate(bodies)
    marks = [np.unpackbits(np.frombuffer(row["marks"], dtype=np.uint8)) for row in rows]
    halves = [len(m) // 2 for m in marks]
    block = np.concatenate([m[: len(body)] for m, body in zip(marks, bodies)])
    again = np.concatenate([m[h : h + len(body)] for m, h, body in zip(marks, halves, bodies)])
    distinct, of, counts = np.unique(value, return_inverse=True, return_counts=True)
    hit = (np.bincount(of, weights=block, minlength=len(distinct)) > 0) & ((counts > 1) | (np.bincount(of, weights=again, minlength=len(distinct)) > 0))
    ends = np.cumsum([len(body) for body in bodies])
    found = np.split(hit[of], ends[:-1])
    return answers([(row["chunk"], 1, row["bucket"], bits(own)) for row, own in zip(rows, found)])


def probed(table: pa.Table, replies: list[dict], window: int, buckets: int) -> Chunk:
    """A chunk with its candidate windows, from the answers to its probes."""
    chunk = Chunk(table, window, buckets)
    values, of, _, _ = chunk.probes()
    hit = collected(values >> np.uint64(32), {row["bucket"]: row["bits"] for row in replies if row["step"] == 1})
    chunk.candidates(hit[of])
    return chunk


def collected(bucket: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
    """The answers to values that were asked in the order of their buckets."""
    found = np.zeros(len(bucket), dtype=bool)
    for b, s in parts(bucket):
        found[s] = flags(replies[b], s.stop - s.start)
    return found


def ask_windows(table: pa.Table, replies: list[dict], window: int, buckets: int) -> pa.Table:
    chunk = probed(table, replies, window, buckets)
    number = table["chunk"][0].as_py()
    return messages([
        (b, number, 2, chunk.code[s].tobytes(), chunk.more[s].tobytes(), chunk.rank[s].astype(np.int64).tobytes() + chunk.late[s].astype(np.uint8).tobytes())
        for b, s in parts(chunk.bucket(chunk.code))
    ])


def answer_windows(table: pa.Table) -> pa.Table:
    """For each window of each chunk, whether a document that comes earlier has it in another chunk."""
    rows = table.to_pylist()
    code = np.concatenate([np.frombuffer(row["body"], dtype=np.uint64) for row in rows])
    more = np.concatenate([np.frombuffer(row["marks"], dtype=np.uint32) for row in rows])
    sizes = [len(row["body"]) // 8 for row in rows]
    rank = np.concatenate([np.frombuffer(row["ranks"][: 8 * n], dtype=np.int64) for row, n in zip(rows, sizes)])
    late = np.concatenate([np.frombuffer(row["ranks"][8 * n :], dtype=np.uint8) for row, n in zip(rows, sizes)])
    by = np.lexsort((rank, late, more, code))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (code[by][1:] != code[by][:-1]) | (more[by][1:] != more[by][:-1])
    lead = by[new][np.cumsum(new) - 1]
    earlier = np.empty(len(by), dtype=bool)
    earlier[by] = (rank[by] != rank[lead]) | (late[by] != late[lead])
    found = np.split(earlier, np.cumsum(sizes)[:-1])
    return answers([(row["chunk"], 2, row["bucket"], bits(own)) for row, own in zip(rows, found)])


RESULT = "id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,stop:bigint>>"


def cut(table: pa.Table, replies: list[dict], window: int, buckets: int) -> pa.Table:
    """The documents of a chunk without what was removed."""
    chunk = probed(table, replies, window, buckets)
    earlier = collected(chunk.bucket(chunk.code), {row["bucket"]: row["bits"] for row in replies if row["step"] == 2})
    gone = chunk.removed(earlier)
    upto = np.concatenate(([0], np.cumsum(gone)))
    n_removed = upto[chunk.begins[1:]] - upto[chunk.begins[:-1]]
    n_words = np.diff(chunk.begins)
    kept_begins = np.concatenate(([0], np.cumsum(n_words - n_removed)))
    kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept_begins, pa.int64()), chunk.words.filter(pa.array(~gone))), " ")
    inside = np.zeros(len(gone) + 1, dtype=bool)
    inside[:-1] = gone
    fresh = np.zeros(len(gone) + 1, dtype=bool)  # a span ends with its document
    fresh[chunk.begins] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (fresh | ~before))
    stops = np.flatnonzero(before & (fresh | ~inside))
    doc = chunk.doc[starts]
    spans = pa.StructArray.from_arrays([pa.array(chunk.at[starts], pa.int64()), pa.array(chunk.at[starts] + stops - starts, pa.int64())], ["start", "stop"])
    span_begins = np.searchsorted(doc, np.arange(len(n_words) + 1))
    return pa.Table.from_arrays(
        [
            chunk.table["id"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept.cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(span_begins, pa.int32()), spans),
        ],
        ["id", "n_words", "n_removed", "kept", "spans"],
    )


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Each document without the words of windows that start earlier elsewhere: id, n_words, n_removed, kept, spans.

    A window is ``window`` consecutive words of one document. It is earlier than an equal one if its
    id is smaller, or if the ids are equal and it starts at a smaller word; so rows of equal id
    are judged as one document, and equal rows keep the same words. Rows of null id come after all
    others, by the hash of their text. Windows are judged on the input, not on what is left. ``kept``
    are the remaining words joined by one space; ``spans`` the maximal removed runs as word positions,
    the last one excluded. A null text has no words. An empty table gives an empty result.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    chunks, buckets = math.ceil((total + 1) / CHUNK_BYTES), math.ceil((total + 1) / BUCKET_BYTES)
    rows = docs.select(
        F.col(id).cast("long").alias("id"),
        F.coalesce(F.col(id).cast("long"), F.xxhash64(text)).alias("rank"),
        F.col(id).isNull().cast("tinyint").alias("late"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("chunk", F.pmod(F.xxhash64("late", "rank"), F.lit(chunks)).cast("long"))

    def ask(table: pa.Table) -> pa.Table:
        return ask_blocks(table, window, buckets)

    def ask_again(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        return ask_windows(table, replies.to_pylist(), window, buckets) if table.num_rows else messages([])

    def finish(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        return cut(table, replies.to_pylist(), window, buckets) if table.num_rows else None

    by_chunk = rows.groupBy("chunk")
    hits = by_chunk.applyInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(answer_blocks, ANSWER)
    earlier = (
        by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(ask_again, MESSAGE).groupBy("bucket").applyInArrow(answer_windows, ANSWER)
    )
    return by_chunk.cogroup(hits.unionAll(earlier).groupBy("chunk")).applyInArrow(finish, RESULT)

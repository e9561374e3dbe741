"""Conversation structure repair: the cheapest edits that make roles alternate.

Rows are dealt by conversation and sorted by turn, and a task streams through them. For every state that
the repaired roles can be in, it carries the cheapest way there: the cost, the order among the other
ways, and a running hash of the repaired text. A row's faults and role decide what becomes of
all of them at once, so each step is looked up in a small table that fills itself. A byte for each state
and row tells how it was reached; the bytes of giant conversations are spilled, and are read
backwards when a conversation ends.

States are what the roles so far look like: nothing, ``s``, ending in ``u``, ending in ``a``. From each of them
at most one of ``u`` and ``a`` may follow, so edits decide the repaired roles.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user's or assistant's turn, whichever may follow.
NEXT = (USER, USER, ASSISTANT, USER)
SAYS = {USER: "user", ASSISTANT: "assistant"}
#: Costs of the edits; KEEP_TRUNCATED comes on top for a truncated row that stays.
DELETE, INSERT, REROLE, KEEP_TRUNCATED = 2, 5, 1, 5
#: More insertions in a row lead nowhere that fewer do not.
INSERTIONS = 2
#: A way so much dearer than the cheapest is never the cheapest again: from any state, two
#: insertions and a deletion lead to where another one can.
HOPELESS = 4 * INSERT
#: Bytes of backpointers of a conversation that stay in memory.
SPOOLED = 1 << 22
#: Characters that stand between words, and those that end a sentence.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, rows bigint"
)


class Way(NamedTuple):
    """How one state was reached by a row: from which state, by how many insertions and which edit."""

    before: int
    insertions: int
    edit: str

    @property
    def letters(self) -> str:
        return "I" * self.insertions + self.edit

    @property
    def code(self) -> int:
        """One byte: the state before, the insertions, the edit."""
        return self.before | self.insertions << 2 | "DKR".index(self.edit) << 4


def decoded(code: int) -> Way:
    return Way(code & 3, code >> 2 & 3, "DKR"[code >> 4])


def after_insertions(state: int, insertions: int) -> int:
    for _ in range(insertions):
        state = NEXT[state]
    return state


def after_keeping(state: int, initial: str) -> int | None:
    """The state after a kept role, or None where it may not follow."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return NEXT[state] if NEXT[state] == {"u": USER, "a": ASSISTANT}.get(initial) else None


class Step(NamedTuple):
    """What a kind of row makes of the ways so far."""

    dearer: int  # what the cheapest way costs more
    costs: tuple[int | None, ...]  # above the cheapest, for each state
    order: tuple[int, ...]  # for each state, its place among the ways in ASCII order of their edits
    ways: tuple[Way | None, ...]
    codes: bytes


START = ((0, None, None, None), (0, 0, 0, 0))


def step(costs: tuple, order: tuple, initial: str, must_go: bool, truncated: bool) -> Step:
    """The cheapest way to each state through one more row; of equally cheap ones the first in ASCII order.

    Ways that have used up the same rows and end with one never continue each other, so the order of
    two of them is that of the states they come from, and from the same state that of their letters.
    """
    best: list = [None] * 4
    extra = KEEP_TRUNCATED if truncated else 0
    for before, cost in enumerate(costs):
        if cost is None:
            continue
        for insertions in range(INSERTIONS + 1):
            here = after_insertions(before, insertions)
            options = [("D", here, DELETE)]
            if not must_go:
                options += [("K", after_keeping(here, initial), extra), ("R", NEXT[here], REROLE + extra)]
            for edit, state, price in options:
                if state is not None:
                    way = Way(before, insertions, edit)
                    key = (cost + insertions * INSERT + price, order[before], way.letters)
                    if best[state] is None or key < best[state][0]:
                        best[state] = (key, way)
    least = min(found[0][0] for found in best if found)
    best = [found if found and found[0][0] - least <= HOPELESS else None for found in best]
    ranked = sorted((found[0][1:], state) for state, found in enumerate(best) if found)
    places = {state: place for place, (_, state) in enumerate(ranked)}
    return Step(
        least, tuple(found[0][0] - least if found else None for found in best), tuple(places.get(state, 0) for state in range(4)),
        tuple(found[1] if found else None for found in best), bytes(found[1].code if found else 255 for found in best),
    )


class Steps(dict):
    """Every step met so far, by what it starts from and the kind of row."""

    def __missing__(self, key: tuple) -> Step:
        self[key] = found = step(*key)
        return found


class Repair:
    """One conversation as its rows come in. Memory does not grow with it, but for a hash a state."""

    def __init__(self, conv_id: int | None, steps: Steps) -> None:
        self.conv_id, self.steps = conv_id, steps
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct_turns = 0
        self.first_turn = self.last_turn = self.last_initial = None
        self.cost, (self.costs, self.order) = 0, START
        self.texts = [(hashlib.sha256(), False), None, None, None]  # a hash, and whether it has read anything
        self.back, self.spilled = bytearray(), None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        self.rows += 1
        if turn is not None:
            self.distinct_turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        initial = role[:1]
        self.illegal += self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au")
        self.last_initial = initial
        bare = text.rstrip(WHITE)
        blank, truncated = not bare, False
        if blank:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif bare[-1] not in ENDS:
            self.truncated += 1
            truncated = True
        found = self.steps[self.costs, self.order, initial if initial in ("s", "u", "a") else "", blank or repeated, truncated]
        self.cost += found.dearer
        self.costs, self.order = found.costs, found.order
        self.back += found.codes
        if len(self.back) >= SPOOLED:
            self.spill()
        self.texts = [None if way is None else self.extended(state, way, role, text) for state, way in enumerate(found.ways)]

    def extended(self, state: int, way: Way, role: str, text: str) -> tuple:
        before = self.texts[way.before]
        if way.edit == "D" and not way.insertions:
            return before
        here, lines = way.before, []
        for _ in range(way.insertions):
            here = NEXT[here]
            lines.append(f"{SAYS[here]}:")
        if way.edit != "D":
            lines.append(f"{role if way.edit == 'K' else SAYS[state]}:{text}")
        return told(before, lines)

    def spill(self) -> None:
        """Put the backpointers so far into a file without a name, which goes with the task."""
        if self.spilled is None:
            self.spilled = tempfile.TemporaryFile(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None)
        self.spilled.write(self.back)
        self.back = bytearray()

    def codes_backwards(self) -> Iterator[bytes]:
        """The backpointers of each row, the last row first."""
        yield from (bytes(self.back[at : at + 4]) for at in range(len(self.back) - 4, -1, -4))
        if self.spilled is not None:
            end = self.spilled.tell()
            while end:
                start = max(0, end - SPOOLED)
                self.spilled.seek(start)
                part = self.spilled.read(end - start)
                yield from (part[at : at + 4] for at in range(len(part) - 4, -1, -4))
                end = start
            self.spilled.close()

    def report(self) -> tuple:
        """The row of the conversation, when its last row has come."""
        ends = []
        for state, cost in enumerate(self.costs):
            for insertions in range(INSERTIONS + 1) if cost is not None else ():
                if after_insertions(state, insertions) in (NOTHING, ASSISTANT):
                    ends.append((cost + insertions * INSERT, self.order[state], "I" * insertions, state, insertions))
        cost, _, letters, state, insertions = min(ends)
        here, lines = state, []
        for _ in range(insertions):
            here = NEXT[here]
            lines.append(f"{SAYS[here]}:")
        text = told(self.texts[state], lines)[0].hexdigest()
        audit = [letters]
        for codes in self.codes_backwards():
            way = decoded(codes[state])
            audit.append(way.letters)
            state = way.before
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.distinct_turns, (1 << 63) - 1)
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost, "".join(reversed(audit)), text, self.rows
        )


def told(before: tuple, lines: list[str]) -> tuple:
    """A hash that has read more lines."""
    if not lines:
        return before
    digest = before[0].copy()
    digest.update((("\n" if before[1] else "") + "\n".join(lines)).encode())
    return digest, True


def repair_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reports from sorted rows. A conversation may go on in the next batch, and so does its repair."""
    steps, now, key = Steps(), None, None
    columns = [c.split()[0] for c in REPORT.split(", ")]
    for batch in batches:
        done = []
        for conv, known, turn, timed, role, text, repeated, gone in batch.itertuples(index=False, name=None):
            if now is None or key != (conv, known):
                if now is not None:
                    done.append(now.report())
                key, now = (conv, known), Repair(int(conv) if known else None, steps)
            if not gone:
                now.add(int(turn) if timed else None, role, text, repeated)
        if done:
            yield reports(done, columns)
    if now is not None:
        yield reports([now.report()], columns)


def reports(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=columns)
    return found.astype({"conv_id": "Int64"})


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage, and ``gone`` for those that are dropped.

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count as one space, in the
    key too. Dropped rows stay, marked, so that their conversations are known.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(spaced("text"), ENDS, "")).otherwise(spaced("text"))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(fate == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), (fate == 0).alias("gone"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repeated_rows(rows: DataFrame) -> Column:
    """Whether a row's role and text were seen earlier in its conversation. Runs on the partitioning
    by conversation; windows spill, so a text that repeats without end does not have to fit in memory."""
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return F.row_number().over(seen) > 1


def repair(rows: DataFrame) -> DataFrame:
    """A report for each conversation of (conv_id, turn, role, text, gone): see ``REPORT``.

    ``rows`` are the rows that are there, by turn, nulls first, then role and text. The faults of a row: blank (only
    white space), else repeated (role and text seen earlier in the conversation), else truncated (its
    last visible character does not end a sentence). Edits: D deletes, which blank and repeated rows need, K keeps,
    R makes a row the user's or assistant's, I inserts an empty turn. The repaired initials are ``(s?(ua)+)?``; of
    the cheapest edits the first in ASCII order are taken. A role that is not empty is told by its first
    character; an empty one cannot be kept. Nulls: a null id is a conversation of its own, null turns come first and
    are no gaps; roles and texts must not be null (``damage`` sees to it). A conversation whose rows are
    all gone, or none, is reported with zeros. An empty table gives no rows. Other columns are left out.

    A giant conversation is read by one task, as a stream: its rows are sorted by Spark, which spills, and the
    task holds four hashes and up to 4 MB of backpointers; only its audit, a character a row, is one value.
    """
    table = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id")
    marked = table.withColumn("repeated", repeated_rows(table))
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    plain = ordered.select(
        F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("conv"), F.col("conv_id").isNotNull().alias("known"),
        F.coalesce("turn", F.lit(0)).cast("bigint").alias("at"), F.col("turn").isNotNull().alias("timed"), "role", "text", "repeated", "gone",
    )
    return plain.mapInPandas(repair_stream, REPORT)

"""Conversation repair against plain Python, which tries every sequence of edits in order of cost."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import types as T

from patronage.llm import conversations, queries

ROWS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("gone", T.StringType()),
])
SHAPE = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """conv_id -> its rows after damage, in order."""
    spaced = lambda x: " " if x is None else x
    found = {}
    for conv, turn, role, text, *_ in rows:
        own = found.setdefault(conv, [])
        role, text = spaced(role), spaced(text)
        fate = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for own in found.values():
        own.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode()))
    return found


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """(cost, audit, repaired lines) by a search over edits, cheapest first, then first in ASCII order."""
    heap, tie = [(0, "", 0, ())], itertools.count()
    heap = [(0, "", next(tie), 0, ())]
    done = set()
    while heap:
        cost, audit, _, at, lines = heapq.heappop(heap)
        initials = "".join(line.split(":")[0][:1] for line in lines)
        if at == len(rows) and SHAPE.fullmatch(initials):
            return cost, audit, lines
        if (at, initials) in done or not re.fullmatch("s?(ua)*u?", initials):
            continue
        done.add((at, initials))
        steps = [("I", 5, at, f"{role}:") for role in ("user", "assistant") if len(initials) <= len(rows) + 3]
        if at < len(rows):
            _, role, text = rows[at]
            stays = 5 if found[at] == "truncated" else 0
            steps.append(("D", 2, at + 1, None))
            if found[at] not in ("blank", "duplicate"):
                if role:
                    steps.append(("K", stays, at + 1, f"{role}:{text}"))
                steps += [("R", 1 + stays, at + 1, f"{to}:{text}") for to in ("user", "assistant")]
        for letter, price, to, line in steps:
            heapq.heappush(heap, (cost + price, audit + letter, next(tie), to, lines if line is None else (*lines, line)))


def brute(rows):
    report = {}
    for conv, own in damaged(rows).items():
        found, turns = faults(own), [turn for turn, _, _ in own if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, found)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        report[conv] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return report


def ours(df):
    rows = conversations.repair(conversations.damage(df)).collect()
    assert len({row.conv_id for row in rows}) == len(rows)
    return {row.conv_id: tuple(row)[1:9] for row in rows}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_search_over_all_edits(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "Über", "usher"] if seed else ["user", "assistant", "system"]
    texts = ["Yes.", "No", "No ", "", " \n", None, "Why?", "Why? \t", "a.b", "é", "!"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 6)):
            at = rng.choice([turn, turn, turn, turn + 3, None, 0])
            rows.append((None if conv == 5 else conv, at, rng.choice(roles), rng.choice(texts), "clash"))
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    found, expected = ours(df), brute(rows)
    assert found.keys() == expected.keys()
    assert {c: (found[c], expected[c]) for c in found if found[c] != expected[c]} == {}


def test_query_equals_the_search_on_the_whole_table(spark, sf_dir):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_conversation_repair(spark, sf_dir).collect()
    assert {row.conv_id: tuple(row)[1:] for row in found} == brute(rows)
    assert found[0].asDict().keys() == {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"}


def test_odd_tables(spark):
    gone = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows = [(gone, 0, "user", "Hi.", None), (None, None, None, None, None), (None, None, None, None, None), (7, -(1 << 63), "user", "a.", None), (7, (1 << 63) - 1, "user", "b.", None)]
    found = ours(spark.createDataFrame(rows, ROWS))
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", conversations.EMPTY_SHA)
    assert found[None][1] >= 2 and found[7][0] == (1 << 63) - 1
    assert ours(spark.createDataFrame([], ROWS)) == {}


def frames(rows, size):
    names = ["conv", "known", "at", "timed", "role", "text", "repeated", "gone"]
    return (pd.DataFrame(rows[i : i + size], columns=names) for i in range(0, len(rows), size))


def test_batches_and_spilling_change_nothing(monkeypatch):
    """A conversation over many batches, with its backpointers in a file, gets the same report."""
    rng = random.Random(3)
    rows = []
    for conv in range(3):
        for turn in range([3, 3000, 40][conv]):
            rows.append((conv, True, turn, True, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", "Why?"]), rng.random() < 0.1, rng.random() < 0.1))
    whole = pd.concat(conversations.repair_stream(frames(rows, len(rows))))
    monkeypatch.setattr(conversations, "SPOOLED", 64)
    parts = pd.concat(conversations.repair_stream(frames(rows, 7)))
    assert whole.values.tolist() == parts.values.tolist()
    assert len(whole["audit"][1]) >= sum(not row[-1] for row in rows if row[0] == 1)


def test_memory_of_a_giant_conversation_is_bounded(monkeypatch):
    """Backpointers leave memory, however long a conversation is, and the number of distinct steps stays small."""
    monkeypatch.setattr(conversations, "SPOOLED", 1 << 10)
    steps = conversations.Steps()
    repair = conversations.Repair(1, steps)
    rng = random.Random(1)
    for turn in range(20_000):
        repair.add(turn, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", " "]), rng.random() < 0.2)
        assert len(repair.back) < 1 << 10
    assert len(steps) < 2000
    report = repair.report()
    assert len(report[7]) >= 20_000 and report[-1] == 20_000

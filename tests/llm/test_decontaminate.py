"""Benchmark items in documents: planted copies, re-parameterised ones, and near misses."""

import re

import pytest
from texts import words

from patronage.llm import decontaminate

ITEM = "Tom has 5 apples and then buys 7 more apples from Anna for 3 dollars so how many apples does Tom have now"


@pytest.fixture
def bench(spark):
    def build(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")

    return build


def kinds(docs, benchmark):
    return sorted(((row.doc_id, row.item_id, row.kind) for row in decontaminate.leaks(docs, benchmark).collect()), key=str)


def test_verbatim_and_other_parameters(make, bench):
    other = ITEM.replace("Tom", "Kim").replace("5", "12").replace("7", "8").replace("dollars", "euros")
    docs = make([
        (1, f"Some words before. {ITEM} and after."), (2, f"well, {other}!"), (3, ITEM.upper().lower()),
        (4, "Nothing of the kind is in here, just some words about apples and how many there are now in total."),
    ])
    found = kinds(docs, bench(ITEM))
    assert found[:2] == [(1, 0, "verbatim"), (2, 0, "reparameterised")]
    assert 4 not in {id for id, _, _ in found}


def test_inconsistent_fillers_are_no_leak(make, bench):
    item = "start with the sum of 4 and take the rest of 4 away from the pile of 4 stones"
    good, bad = item.replace("4", "9"), "start with the sum of 1 and take the rest of 2 away from the pile of 3 stones"
    assert kinds(make([(1, good), (2, bad)]), bench(item)) == [(1, 0, "reparameterised")]


def test_short_and_odd_items(make, bench, odd):
    items = bench(None, "", "one two", "1 2 3 4 5 6", "alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta")
    docs = make([(1, "so alpha beta gamma, delta epsilon zeta it is"), (2, "one two 1 2 3 4 5 6"), (None, "Alpha beta gamma delta epsilon zeta"), (5, None)])
    assert sorted(kinds(docs, items), key=str) == sorted([(1, 4, "verbatim"), (None, 4, "verbatim")], key=str)
    assert kinds(odd, bench(ITEM)) == []
    assert kinds(odd.withColumnRenamed("lang", "code").withColumnRenamed("source", "template"), bench(ITEM)) == []
    assert kinds(make([]), bench(ITEM)) == [] and kinds(odd, bench()) == []


def test_whole_table_equals_search_of_all_windows(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet")
    benchmark = spark.read.parquet(f"{testdata}/sf0.01/benchmark.parquet")
    bare = lambda text: [w for w in (decontaminate.EDGE.sub("", w).lower() for w in words(text)) if w]
    windows = {}
    for row in benchmark.collect():
        own = bare(row.text)
        for i in range(len(own) - 9):
            windows.setdefault(tuple(own[i : i + 10]), row.item_id)
    expected = set()
    for row in docs.collect():
        own = bare(row.text)
        expected |= {(row.doc_id, windows[w]) for i in range(len(own) - 9) if (w := tuple(own[i : i + 10])) in windows}
    assert {(row.doc_id, row.item_id) for row in decontaminate.leaks(docs, benchmark).collect()} == expected
    kept = {row.doc_id for row in decontaminate.clean(docs, benchmark).select("doc_id").collect()}
    assert kept == {row.doc_id for row in docs.collect()} - {id for id, _ in expected}


def test_blocks_of_templates(make, bench, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_TEMPLATES", 2)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)
    docs = make([(i, f"{'x ' * i} {ITEM}") for i in range(5)])
    assert kinds(docs, bench(ITEM)) == [(i, 0, "verbatim") for i in range(5)]


def test_canonical_words():
    assert decontaminate.canonical("(3.5,") == ("<num>", "<num>", False)
    assert decontaminate.canonical("Hours.") == ("<unit>", "<unit>", True)
    assert decontaminate.canonical("12km") == ("<num><unit>", "<num><unit>", False)
    assert decontaminate.canonical("Anna") == ("anna", "<name>", False)
    assert decontaminate.canonical("--") == ("", "", False)


def test_copies_in_other_case_punctuation_and_position(make, bench):
    short = "What is the capital of France?"
    bare = ITEM.replace("has 5", "has, 5")
    docs = make([
        (1, ITEM.upper()), (2, f"before it {ITEM.title()} and after"), (3, "so they asked " + short + " again"), (4, short.upper()),
        (5, "so they asked What is the capital of Spain again"), (6, "".join(c for c in "Well then. " + bare if c.isalnum() or c == " ")),
    ])
    assert kinds(docs, bench(ITEM.replace("has 5", "has, 5").replace("so how", "so. How"), short)) == [
        (1, 0, "verbatim"), (2, 0, "verbatim"), (3, 1, "verbatim"), (4, 1, "verbatim"), (5, 1, "reparameterised"), (6, 0, "verbatim"),
    ]


def test_a_stock_frame_is_no_leak(make, bench):
    item = "The old house by the river was bought by Anna Bell on 3 May 1990 for 500 dollars from Tom Hill and sold again"
    frame = "yesterday something was bought by Kim Park on 7 June 2004 for 80 euros because everyone agreed"
    other = item.replace("Anna Bell", "Kim Park").replace("3 May 1990", "7 June 2004").replace("500", "80")
    assert kinds(make([(1, frame), (2, other)]), bench(item)) == [(2, 0, "reparameterised")]
    assert kinds(make([(1, "how many days are in 3 weeks")]), bench("how many days are in 5 weeks")) == [(1, 0, "reparameterised")]


def test_exact_copies_of_short_unspaced_and_placeholder_items(make, bench):
    items = bench("one two", "1 2 3 4 5 6", "小明有五个苹果,又买了七个苹果,现在一共有多少个苹果?", "Anna Bell Tom Hill Kim Park", "12 34 56 78 90 11 22 33 44 55 66 77", "?!")
    docs = make([
        (1, "well, One two it is"), (2, "so 1 2 3 4 5 6 and"), (3, "今天学习。小明有五个苹果,又买了七个苹果,现在一共有多少个苹果?请回答。"), (4, "here anna bell tom hill kim park"),
        (5, "row 12 34 56 78 90 11 22 33 44 55 66 77"), (6, "one and two, 1 2 3 4 5, 小明有三个梨, Anna Bell, 12 34 56 78 90"), (7, "?! ..."),
    ])
    found = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(docs, items, short_items=True).collect())
    assert found == [(1, 0, "verbatim"), (2, 1, "verbatim"), (3, 2, "verbatim"), (4, 3, "verbatim"), (5, 4, "verbatim")]
    # two words in the midst of others are anybody's
    assert {r.doc_id for r in decontaminate.clean(docs, items, short_items=True).collect()} == {1, 6, 7}


def test_short_items_remove_only_documents_with_a_line_or_sentence_of_them(make, bench, spark, testdata):
    items = bench("the", "Two plus two?", "Yes")
    docs = make([
        (1, "the cat and the dog"), (2, "first\n The. \nlast"), (3, "Well. Two plus two? Four."), (4, "so two plus two make four"), (5, "YES"), (None, "He said yes"),
        (7, None), (7, "it is (two plus two)"), (7, "(Two plus two?)"), (8, "Yesterday. the"), (9, "Yesterday"),
    ])
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.clean(docs, items, short_items=True).collect()) == [
        (0, "He said yes"), (1, "the cat and the dog"), (4, "so two plus two make four"), (7, ""), (7, "it is (two plus two)"), (9, "Yesterday"),
    ]
    table = spark.read.parquet(f"{testdata}/sf0.001/documents.parquet")
    fold = lambda part: re.sub(r"[\W_]+", " ", part.lower()).strip()
    alone = {r.doc_id for r in table.collect() if any(fold(p) == "the" for line in r.text.split("\n") for p in [line, *re.split(r"(?<=[.!?:])[ \t]+", line)])}
    kept = {r.doc_id for r in decontaminate.clean(table, bench("the"), short_items=True).collect()}
    assert kept == {r.doc_id for r in table.collect()} - alone and len(kept) > 150

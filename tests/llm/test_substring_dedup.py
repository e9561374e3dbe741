"""Repeated windows against a search of all windows."""

import random

import pytest
from texts import words

from patronage.llm import substring_dedup


def brute(rows, window):
    """(id, n_words, n_removed, kept) by comparing every window with every other; ids are not null."""
    texts = [(id, words(text)) for id, text in rows]
    first = {}
    for id, found in texts:
        for i in range(len(found) - window + 1):
            run = tuple(found[i : i + window])
            first[run] = min(first.get(run, (id, i)), (id, i))
    result = []
    for id, found in texts:
        gone = set()
        for i in range(len(found) - window + 1):
            if first[tuple(found[i : i + window])] < (id, i):
                gone.update(range(i, i + window))
        result.append((id, len(found), len(gone), " ".join(w for k, w in enumerate(found) if k not in gone)))
    return sorted(result)


def ours(docs, window):
    rows = substring_dedup.remove_repeats(docs, window=window).collect()
    for row in rows:
        assert sum(s.stop - s.start for s in row.spans) == row.n_removed
        assert all(a.stop < b.start for a, b in zip(row.spans, row.spans[1:]))
    return sorted(((row.id, row.n_words, row.n_removed, row.kept) for row in rows), key=str)


@pytest.fixture
def many_chunks(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 60)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 80)


@pytest.mark.parametrize("window", [1, 2, 3, 4, 7])
def test_equals_all_windows(make, many_chunks, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 16))) for _ in range(12)]
    rows = [(rng.choice([i, i, i, 3]), rng.choice(texts)) for i in range(40)]
    assert ours(make(rows), window) == sorted(brute(rows, window), key=str)


def test_whole_table_equals_all_windows(sample, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 100_000)
    rows = [(row.doc_id, row.text) for row in sample.collect()]
    assert ours(sample, 20) == sorted(brute(rows, 20), key=str)


def test_null_ids_come_last(make):
    found = ours(make([(None, "p q r s"), (5, "p q r s"), (None, None)]), 3)
    assert found == sorted([(5, 4, 0, "p q r s"), (None, 4, 4, ""), (None, 0, 0, "")], key=str)


def test_equal_rows_keep_the_same_words(make):
    assert ours(make([(1, "p q r s"), (1, "p q r s"), (2, "q r s")]), 3) == [(1, 4, 0, "p q r s"), (1, 4, 0, "p q r s"), (2, 3, 3, "")]


def test_odd_rows(odd, many_chunks):
    assert substring_dedup.remove_repeats(odd).count() == odd.count()


def test_empty_table(make):
    assert ours(make([]), 20) == []


def test_clashing_columns(odd):
    named = odd.withColumnRenamed("lang", "chunk").withColumnRenamed("source", "rank")
    assert substring_dedup.remove_repeats(named).count() == odd.count()

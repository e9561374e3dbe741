"""Token counts against the library on whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from patronage.llm import queries, token_counts

BITS = [" ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "\xa0", "\r\n", "\x0b", "\u2003", "a", "word", "'s", "'ll", "é", "1", "23", "²", "Ⅷ", "😀", "漢", "\u0301", "\u200b", "-", "...", "_", "<|endoftext|>", "<|"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("block", [3, 50, 1 << 20])
def test_pieces_add_up(library, monkeypatch, block):
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", block)
    rng = random.Random(block)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 16))) for _ in range(2000)]
    table = token_counts.PieceLengths(queries.tokenizer_path(), {}, 20)
    assert table.counts(texts) == [count(library, t) for t in texts]


def test_whole_table(sample, library):
    found = token_counts.count_tokens(sample, queries.tokenizer_path(), 300).collect()
    assert len(found) == sample.count()
    for row in found:
        assert (row.n_bytes, row.n_tokens) == (len(row.text.encode()), count(library, row.text))
        assert row.over_limit == (row.n_tokens > 300)


def test_odd_rows(odd, library):
    for row in token_counts.count_tokens(odd.withColumnRenamed("lang", "n_tokens"), queries.tokenizer_path()).collect():
        assert (row.n_bytes, row.n_tokens) == (len((row.text or "").encode()), count(library, row.text))


def test_empty_table(make):
    assert token_counts.count_tokens(make([]), queries.tokenizer_path()).collect() == []


def test_frequent_pieces_are_counted_over_all_texts(make):
    docs = make([(i, "red green red") for i in range(50)])
    found = {row.piece: row.n for row in token_counts.frequent_pieces(docs).collect()}
    assert found == {" red": 50, "green": 50, "red": 50}


def test_each_new_piece_goes_to_the_library_once(library, monkeypatch):
    """One lookup tells known pieces from new ones, and the library keeps no offsets for them."""
    table, asked = token_counts.PieceLengths(queries.tokenizer_path(), {"green": 1}, 20), []
    lengths = table.lengths
    monkeypatch.setattr(table, "lengths", lambda found: asked.append(sorted(found)) or lengths(found))
    texts = ["red green blue green blue", "blue red", None, "blue"]
    assert table.counts(texts) == [count(library, t) for t in texts]
    assert asked == [[" blue", " red", "blue", "red"]]
    assert table.counts(texts) == [count(library, t) for t in texts] and asked[1:] in ([], [[]])
    known = token_counts.Known({"green": 1})
    assert sum(map(known.__getitem__, ["green", "red", "red"])) == 1 and known.missed == ["red", "red"] and "red" not in known

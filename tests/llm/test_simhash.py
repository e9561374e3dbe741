"""Fingerprints and groups against all pairs."""

import random

import pytest
import xxhash
from texts import words

from patronage.llm import simhash
from patronage.llm.components import connected_components


def slow_fingerprint(text, k=3):
    found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(text)]
    shingles = [" ".join(found[i : i + k]) for i in range(len(found) - k + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """For each value, the set it hangs together with."""
    left, result = set(values), {}
    while left:
        part, waiting = set(), [next(iter(left))]
        while waiting:
            v = waiting.pop()
            if v in part:
                continue
            part.add(v)
            waiting += [w for w in left if (v ^ w).bit_count() <= radius and w not in part]
        left -= part
        result |= dict.fromkeys(part, frozenset(part))
    return result


def test_fingerprints(sample, odd):
    for docs in (sample, odd):
        found = simhash.near_duplicates(docs).select("value", "id", "key").collect()
        expected = sorted(simhash.signed(slow_fingerprint(row.text)) for row in docs.collect())
        assert sorted(row.value for row in found) == expected


@pytest.mark.parametrize("size", [1, 7, 40])
def test_slices_do_not_change_the_fingerprint(monkeypatch, size):
    texts = [" ".join(random.Random(s).choices("abcdef", k=s)) for s in range(30)] + ["  a  ", "a\x0bb\x0cc\x85d e"]
    monkeypatch.setattr(simhash, "TEXT_BYTES", size)
    monkeypatch.setattr(simhash, "SHINGLE_ROWS", 3)
    for text in texts:
        assert simhash.simhash(text.encode(), 3) == simhash.signed(slow_fingerprint(text))


def test_tree_finds_everything_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(8) for _ in range(200)]
    tree = simhash.BKTree()
    for value in values:
        tree.add(value)
    for value in values[:50]:
        for radius in range(4):
            found = sorted(tree.values[i] for i in tree.within(value, radius))
            assert found == sorted(v for v in values if (v ^ value).bit_count() <= radius)


@pytest.mark.parametrize("tree_nodes", [16, 2048])
def test_links_join_what_is_near(spark, tree_nodes):
    """Small shards are divided again and again without losing a link."""
    rng = random.Random(tree_nodes)
    centres = [rng.getrandbits(64) for _ in range(5)]
    values = {simhash.signed(rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3)))) for _ in range(150)}
    frame = spark.createDataFrame([(v,) for v in values], "value long")
    found = connected_components(simhash.near_links(frame, 2, tree_nodes)).collect()
    parts = {}
    for row in found:
        parts.setdefault(row.component, set()).add(row.node)
    expected = {g for g in groups({v & (2**64 - 1) for v in values}, 2).values() if len(g) > 1}
    assert {frozenset(v & (2**64 - 1) for v in part) for part in parts.values()} == expected


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (300, 299)], "a long, b long")
    found = {row.node: row.component for row in connected_components(links).collect()}
    assert found == dict.fromkeys(range(101), 0) | {299: 299, 300: 299}


def test_whole_table_equals_all_pairs(sample):
    rows = {row.doc_id: slow_fingerprint(row.text) for row in sample.collect()}
    of = groups(rows.values(), 2)
    smallest = {}
    for id, value in rows.items():
        smallest[of[value]] = min(id, smallest.get(of[value], id))
    found = {row.id: row.component_id for row in simhash.near_duplicates(sample).collect()}
    assert found == {id: smallest[of[value]] for id, value in rows.items()}
    assert sorted(row.doc_id for row in simhash.keep_one(sample).collect()) == sorted(set(found.values()))


def test_null_ids_and_repeated_rows(make):
    docs = make([(None, "a b c"), (None, "a b c"), (4, None), (2, ""), (7, "z"), (7, "z"), (None, "q r s t")])
    found = {(row.id, row.component_id, row.kept) for row in simhash.near_duplicates(docs).collect()}
    assert found == {(None, None, True), (4, 2, False), (2, 2, True), (7, 7, True)}
    kept = sorted((row.doc_id, row.text) for row in simhash.keep_one(docs).collect() if row.doc_id is not None)
    assert kept == [(2, ""), (7, "z")]
    assert simhash.keep_one(docs).count() == 4


def test_empty_table_and_clashing_columns(make, odd):
    assert simhash.near_duplicates(make([])).collect() == []
    named = odd.withColumnRenamed("lang", "value").withColumnRenamed("source", "key")
    assert simhash.keep_one(named).columns == named.columns
    assert simhash.near_duplicates(named).count() == odd.count()

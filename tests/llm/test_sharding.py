"""The lookup table against a slow filling, and what happens when shards change."""

import numpy as np
import pytest

from patronage.llm import sharding


def slow_table(names, size):
    owner, turn = {}, 0
    orders = {n: [(sharding.preference(n, size)[0] + j * sharding.preference(n, size)[1]) % size for j in range(size)] for n in names}
    while len(owner) < size:
        name = sorted(names)[turn % len(names)]
        slot = next(s for s in orders[name] if s not in owner)
        owner[slot] = name
        turn += 1
    return [owner[s] for s in range(size)]


def test_table_equals_slow_filling():
    for names in (["a"], ["b", "a", "c"], [f"s{i}" for i in range(10)]):
        assert [names[i] for i in sharding.fill_table(names, 101)] == slow_table(names, 101)


def test_shares_are_even_and_few_slots_move():
    names = [f"shard-{i}" for i in range(20)]
    table = sharding.fill_table(names)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    less = sharding.fill_table(names[:-1])
    moved = (table != less) & (table != 19)
    assert moved.mean() < 0.1


def test_every_document_is_placed_by_its_slot(sample):
    names = ["x", "y", "z"]
    table = sharding.fill_table(names)
    found = sharding.place(sample, names).collect()
    assert len(found) == sample.count()
    assert all(row.shard == table[row.slot] and row.shard_name == names[row.shard] for row in found)
    again = sharding.place(sample.repartition(7), names).collect()
    assert {(r.doc_id, r.shard) for r in found} == {(r.doc_id, r.shard) for r in again}


def test_null_keys_spread_and_clashing_columns(make, odd):
    many = make([(None, f"text {i}") for i in range(300)])
    assert len({row.shard for row in sharding.place(many, ["a", "b", "c"]).collect()}) == 3
    named = odd.withColumnRenamed("lang", "shard").withColumnRenamed("source", "slot")
    assert sharding.place(named, ["a", "b"]).count() == odd.count()
    assert sharding.place(make([]), ["a"]).collect() == []


def test_wrong_tables_are_refused():
    for names, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 3)):
        with pytest.raises(ValueError):
            sharding.fill_table(names, size)

"""A state table stays small over many batches, survives failures at any point, and ends where a batch job would."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql.types import StructType

from patronage.session import scratch_path, small_table
from patronage.streaming import state, state_table
from patronage.streaming import purchases as stream

CHANGED = "customer_id bigint, last_ts timestamp_ntz, frequency bigint, monetary decimal(38,2)"


@pytest.fixture(scope="module")
def utc(spark):
    session = stream.utc_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "1")
    return session


def row(customer, n):
    return (customer, dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), n, Decimal(10 * n))


def frame(utc, rows):
    return small_table(utc, rows, StructType.fromDDL(CHANGED)).coalesce(1)


def rows_of(table, through=None):
    return sorted((r.customer_id, r.frequency) for r in table.read(through).collect())


def files(path):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)


def test_two_hundred_batches_leave_bounded_files(utc):
    """Whatever the number of batches: twice ``every`` slots, two snapshots, two pointers."""
    path, rng, expected, most = scratch_path(utc, "state"), random.Random(1), {}, 0
    table = state.state_table(utc, path, every=25)
    for batch in range(200):
        changed = {rng.randint(1, 40): batch + 1 for _ in range(3)}
        expected |= changed
        table.merge(frame(utc, [row(c, n) for c, n in changed.items()]), batch)
        if batch in (80, 199):
            assert rows_of(table) == sorted(expected.items())
            most = most or files(path)
    assert files(path) <= most + 2 and files(path) <= 50 + 2 + 2
    assert state_table.published(utc, f"{path}/snapshot") == 199


def test_replays_and_failures_change_nothing(utc, monkeypatch):
    path = scratch_path(utc, "state")
    table = state.state_table(utc, path, every=2)
    batches = [[row(1, 1), row(2, 1)], [row(2, 2)], [row(3, 3)], [row(1, 4)], [row(4, 5)]]
    merge = lambda n: table.merge(frame(utc, batches[n]), n)
    assert rows_of(table) == []
    for n in range(5):
        merge(n)
        before = rows_of(table)
        merge(n)
        assert rows_of(table) == before
    assert before == [(1, 4), (2, 2), (3, 3), (4, 5)]
    assert rows_of(table, through=3) == [(1, 4), (2, 2), (3, 3)]
    with pytest.raises(ValueError, match="older than the snapshot"):
        table.read(through=2)

    # a snapshot that is written but never pointed at is not read, and the batch can run again
    batches.append([row(5, 6)])

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        real = state_table.put
        broken.setattr(state_table, "put", lambda rows, to, *more: fails() if to.endswith("pointer") else real(rows, to, *more))
        with pytest.raises(OSError):
            merge(5)
    assert state_table.published(utc, f"{path}/snapshot") == 3
    assert rows_of(table) == [*before, (5, 6)]
    merge(5)
    assert state_table.published(utc, f"{path}/snapshot") == 5 and rows_of(table) == [*before, (5, 6)]


def test_another_number_of_slots_loses_nothing(utc):
    path = scratch_path(utc, "state")
    for n in range(47):
        table = state.state_table(utc, path, every=20 if n < 45 else 3)
        if n > 30:
            table.merge(frame(utc, [row(n, n)]), n)
    assert rows_of(table) == [(n, n) for n in range(31, 47)]


def test_empty_batches(utc):
    path = scratch_path(utc, "state")
    table = state.state_table(utc, path, every=2)
    for n in range(5):
        table.merge(utc.createDataFrame([row(1, 1)] if n == 1 else [], CHANGED), n)
    assert rows_of(table) == [(1, 1)]

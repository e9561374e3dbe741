"""A history kept month by month equals one made at once."""

import random

import builders as b
import pytest

from patronage.operators import history, kept_history
from patronage.session import scratch_path


def purchases(spark, seed=7, n=150):
    rng = random.Random(seed)
    return b.purchases(spark, [
        (rng.randint(1, 20), t, f"{rng.choice([2022, 2023])}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T10:00", rng.choice([rng.randint(1, 99), -3]))
        for t in range(n)
    ])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_months_added_one_by_one_equal_all_at_once(spark):
    bought = purchases(spark)
    kept = kept_history.KeptHistory(spark, scratch_path(spark, "kept"), "2022-11-01")
    assert kept.last() is None and kept.snapshots().count() == 0
    for months in range(8):
        day = kept_history.month_after(kept.first, months)
        kept.add_month(bought, day)
        if months in (0, 3, 7):
            assert rows(kept.snapshots()) == rows(history.snapshots(bought, "2022-11-01", day))
    before = rows(kept.snapshots())
    kept.add_month(bought, day)  # again: nothing happens
    assert rows(kept.snapshots()) == before and kept.last() == 7
    for wrong in ("2023-08-01", "2023-05-01", "2023-07-02"):
        with pytest.raises(ValueError, match="the next snapshot is that of 2023-07-01"):
            kept.add_month(bought, wrong)


def test_a_month_that_fails_halfway_changes_nothing(spark, monkeypatch):
    bought = purchases(spark, seed=8, n=60)
    kept = kept_history.KeptHistory(spark, scratch_path(spark, "kept"), "2023-01-01")
    kept.add_month(bought, "2023-01-01")
    before = rows(kept.snapshots())

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(kept_history, "publish", fails)
        with pytest.raises(OSError):
            kept.add_month(bought, "2023-02-01")
    assert rows(kept.snapshots()) == before
    kept.add_month(bought, "2023-02-01")
    assert rows(kept.snapshots()) == rows(history.snapshots(bought, "2023-01-01", "2023-02-01"))


def test_a_quiet_month_and_a_bad_start(spark):
    kept = kept_history.KeptHistory(spark, scratch_path(spark, "kept"), "2023-01-01")
    nobody = b.purchases(spark, [])
    for day in ("2023-01-01", "2023-02-01"):
        kept.add_month(nobody, day)
    one = b.purchases(spark, [(1, 1, "2023-02-03", 5)])
    kept.add_month(one, "2023-03-01")
    kept.add_month(nobody, "2023-04-01")
    assert [str(r.as_of) for r in kept.snapshots().orderBy("as_of").collect()] == ["2023-03-01", "2023-04-01"]
    with pytest.raises(ValueError, match="month start"):
        kept_history.KeptHistory(spark, "x", "2023-01-02")

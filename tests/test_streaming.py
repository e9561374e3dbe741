"""Streams over several files must end where a batch over all of them ends."""

import datetime as dt
from decimal import Decimal

import pytest

from patronage.operators.hygiene import clean_purchases
from patronage.operators.indicators import rfm_base
from patronage.plans.segmentation import segment_customers
from patronage.session import scratch_path
from patronage.sources.purchases import purchases_from_events, table
from patronage import catalog
from patronage.streaming import purchases as stream
from patronage.streaming import refunds, state

AS_OF = "2024-01-31"
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="module")
def utc(spark):
    return stream.utc_session(spark)


@pytest.fixture(scope="module")
def folder(spark, testdata):
    """The events in time order as four files, the second of them arriving twice."""
    path = scratch_path(spark, "events")
    events = table(spark, f"{testdata}/sf0.01", "events")
    for low in (0, 2500, 5000, 7500):
        part = events.where(f"event_id >= {low} AND event_id < {low + 2500}").coalesce(1)
        part.write.mode("append").parquet(path)
        if low == 2500:
            part.write.mode("append").parquet(path)
    return path


def run_state(utc, purchases):
    log = scratch_path(utc, "log")
    state.keep_state(stream.running_indicators(purchases), log, scratch_path(utc, "progress")).awaitTermination()
    return log


@pytest.mark.parametrize("repeat_within", [None, "10 days"])
def test_state_equals_batch(spark, utc, folder, testdata, repeat_within):
    purchases = stream.once_each(stream.purchase_stream(utc, folder, files_per_batch=1), repeat_within)
    log = run_state(utc, purchases)
    found = state.state_as_base(state.latest_state(utc, log), AS_OF)
    expected = rfm_base(clean_purchases(purchases_from_events(spark, f"{testdata}/sf0.01"), AS_OF), AS_OF)
    assert sorted(found.collect()) == sorted(expected.collect())
    assert utc.read.parquet(log).select("batch_id").distinct().count() >= 4

    compacted = scratch_path(utc, "compacted")
    state.compact(utc, log, 100, compacted)
    assert sorted(state.latest_state(utc, compacted).collect()) == sorted(state.latest_state(utc, log).collect())
    assert utc.read.parquet(compacted).count() == expected.count()


def test_replayed_batch_changes_nothing(utc):
    log = scratch_path(utc, "replay")
    schema = "customer_id bigint, last_ts timestamp_ntz, frequency bigint, monetary decimal(38,2)"
    first = utc.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, Decimal(5)), (2, dt.datetime(2024, 1, 1), 1, Decimal(7))], schema)
    second = utc.createDataFrame([(1, dt.datetime(2024, 1, 3), 2, Decimal(9))], schema)
    state.write_batch(first, 0, log)
    state.write_batch(second, 1, log)
    before = sorted(state.latest_state(utc, log).collect())
    state.write_batch(second, 1, log)
    assert sorted(state.latest_state(utc, log).collect()) == before
    assert [r.frequency for r in before] == [2, 1]
    assert [r.frequency for r in sorted(state.latest_state(utc, log, through=0).collect())] == [1, 1]


def test_segments_after_each_batch(spark, utc, folder, testdata):
    purchases = stream.once_each(stream.purchase_stream(utc, folder, files_per_batch=1), None)
    found = scratch_path(utc, "found")
    state.keep_segments(
        stream.running_indicators(purchases), AS_OF, scratch_path(utc, "state"), found, scratch_path(utc, "progress")
    ).awaitTermination()
    expected = segment_customers(purchases_from_events(spark, f"{testdata}/sf0.01"), AS_OF)
    assert sorted(state.latest_segments(utc, found).drop("batch_id").collect()) == sorted(expected.collect())


def test_late_events_count_for_the_state_but_not_for_closed_periods(utc):
    path = scratch_path(utc, "late")
    def arrive(*rows):
        made = [(e, dt.datetime.fromisoformat(ts), 1, "purchase", 10.0, None) for e, ts in rows]
        utc.createDataFrame(made, EVENT).coalesce(1).write.mode("append").parquet(path)

    arrive((1, "2024-01-01T00:00"), (2, "2024-01-20T00:00"))
    arrive((3, "2024-01-21T00:00"), (2, "2024-01-20T00:00"))  # a repeat
    arrive((4, "2024-01-02T00:00"), (5, "2024-02-20T00:00"))  # a purchase reported weeks late
    read = lambda: stream.purchase_stream(utc, path, files_per_batch=1)
    row = state.latest_state(utc, run_state(utc, stream.once_each(read(), None))).first()
    assert (row.frequency, row.monetary) == (5, Decimal("50.00"))

    weekly = stream.purchases_per_period(stream.once_each(read(), "1 day"), lateness=None)
    closed = {r.period_start.date(): r.purchases for r in stream.drain(weekly, "closed").collect()}
    assert closed == {dt.date(2023, 12, 28): 1, dt.date(2024, 1, 18): 2}


def test_sessions_split_at_the_gap(utc):
    path = scratch_path(utc, "sessions")
    times = ["2024-01-01T00:00", "2024-01-01T11:00", "2024-01-02T00:00", "2024-02-01T00:00"]
    made = [(e, dt.datetime.fromisoformat(ts), 1, "purchase", 10.0, None) for e, ts in enumerate(times)]
    utc.createDataFrame(made, EVENT).coalesce(1).write.parquet(path)
    found = stream.drain(stream.buying_sessions(stream.purchase_stream(utc, path)), "found").orderBy("session_start").collect()
    assert [(r.purchases, r.session_end.isoformat()) for r in found] == [(2, "2024-01-01T23:00:00"), (1, "2024-01-02T12:00:00")]


def test_many_batches_across_the_date(utc):
    """Recency never is negative, and only the last two batches' scores and states are kept."""
    path, found = scratch_path(utc, "many"), scratch_path(utc, "many-found")
    for day in range(4):
        made = [(10 * day + c, dt.datetime(2024, 1, 1 + day, 12), c, "purchase", 1.0 + c, None) for c in range(1, 4)]
        utc.createDataFrame(made, EVENT).coalesce(1).write.mode("append").parquet(path)
    purchases = stream.once_each(stream.purchase_stream(utc, path, files_per_batch=1), "2 days")
    kept = scratch_path(utc, "many-state")
    state.keep_segments(stream.running_indicators(purchases), "2024-01-03", kept, found, scratch_path(utc, "many-progress")).awaitTermination()
    last = state.latest_segments(utc, found)
    assert last.where("recency_days < 0").count() == 0
    assert sorted((r.customer_id, r.frequency, r.recency_days) for r in last.collect()) == [(1, 4, 1), (2, 4, 1), (3, 4, 1)]
    assert sorted(tuple(r)[:3] for r in state.state_table(utc, kept, every=1).read().collect()) == [(c, dt.datetime(2024, 1, 4, 12), 4) for c in (1, 2, 3)]
    batches = {r.batch_id for side in (0, 1) for r in utc.read.parquet(f"{found}/side-{side}").select("batch_id").distinct().collect()}
    assert len(batches) == 2


def test_scores_before_any_batch(utc):
    with pytest.raises(ValueError, match="no batch"):
        state.latest_segments(utc, scratch_path(utc, "nothing"))


def test_refunds_find_their_sales_in_any_order(utc):
    """A refund may come before its sale, after it, twice, in several parts, beyond it, or without one."""
    path = scratch_path(utc, "refunds")
    def arrive(*rows):
        made = [(e, dt.datetime.fromisoformat(ts), user, "purchase", value, None) for e, ts, user, value in rows]
        utc.createDataFrame(made, EVENT).coalesce(1).write.mode("append").parquet(path)

    arrive((1, "2024-01-01T00:00", 1, 100.0), (2, "2024-01-03T00:00", 2, -5.0))
    arrive((2, "2024-01-02T00:00", 2, 50.0), (1, "2024-01-03T00:00", 1, -30.0))
    arrive((1, "2024-01-03T12:00", 1, -20.0), (1, "2024-01-03T12:00", 1, -20.0), (7, "2024-01-03T00:00", 1, -9.0), (1, "2024-01-04T00:00", 2, -8.0))
    arrive((1, "2024-01-05T00:00", 1, -70.0), (8, "2024-02-01T00:00", 3, 10.0))
    arrive((9, "2024-03-01T00:00", 3, 10.0), (8, "2024-02-25T00:00", 3, -1.0), (9, "2024-02-28T12:00", 3, -2.0))
    matched = stream.drain(refunds.match_refunds(stream.purchase_stream(utc, path, files_per_batch=1, net=True), "20 days"), "matched")
    told = lambda df: sorted((r.txn_id, r.customer_id, str(r.amount)) for r in df.collect())
    assert told(refunds.accepted_refunds(matched)) == [(1, 1, "-20.00"), (1, 1, "-30.00"), (1, 1, "-50.00"), (2, 2, "-5.00")]
    late = refunds.late_refunds(matched)
    # the one of 28 February still waits for its sale, which came too early for it
    assert {(r.txn_id, r.customer_id, str(r.amount), r.reason) for r in late.collect()} >= {
        (1, 1, "-20.00", "refund beyond sale"), (7, 1, "-9.00", "refund without sale"), (1, 2, "-8.00", "refund without sale"),
        (8, 3, "-1.00", "refund without sale"),
    }


def test_net_stream_equals_batch_over_many_files(spark, utc, folder, testdata):
    events = purchases_from_events(spark, f"{testdata}/sf0.01")
    rows = catalog.with_refunds(events)
    expected = rfm_base(clean_purchases(rows, "2024-03-01", settled=True), "2024-03-01")
    incoming = catalog.with_refunds(stream.purchase_stream(utc, folder, files_per_batch=1))
    matched = stream.drain(refunds.match_refunds(incoming, repeat_within="40 days"), "matched")
    log = run_state(utc, stream.once_each(stream.purchase_stream(utc, folder, files_per_batch=1), None))
    found = refunds.net_base(state.latest_state(utc, log), matched, "2024-03-01")
    assert sorted(found.collect()) == sorted(expected.collect())

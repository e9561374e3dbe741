"""Reports keep every customer, sinks replace what they say they replace."""

import builders as b

from patronage.operators import history, reports, scoring, segments
from patronage.session import scratch_path
from patronage.sources import sinks

PEOPLE = [(c, 10 * c + 1, c % 4 + 1, 5 * c) for c in range(12)]


def some_segments(spark):
    return segments.assign_segments(scoring.score_rank(b.base(spark, PEOPLE)))


def test_slices_add_up_to_everyone(spark):
    found = some_segments(spark)
    customer = spark.createDataFrame([(c, c % 3, None if c == 5 else "M") for c in range(4, 9)], "c_custkey bigint, c_nationkey int, c_mktsegment string")
    nation = spark.createDataFrame([(0, "N0", 0), (1, "N1", 7)], "n_nationkey int, n_name string, n_regionkey int")
    region = spark.createDataFrame([(0, "R0")], "r_regionkey int, r_name string")
    total = reports.segment_summary(found).agg({"customers": "sum", "revenue": "sum"}).first()
    cube = reports.by_attribute(found, customer, nation, region).where("level = 7").first()
    assert (cube.customers, cube.revenue) == (total["sum(customers)"], total["sum(revenue)"])
    nations = reports.by_nation(found, customer, nation, region).where("is_nation = 1").agg({"customers": "sum"}).first()[0]
    assert nations == len(PEOPLE)


def test_matrix_has_every_row(spark):
    same = scoring.score_rank(b.base(spark, [(c, 5, 1, 1) for c in range(5)]))
    found = {r.r_score: [r[f"f{i}"] for i in range(1, 6)] for r in reports.rf_matrix(same).collect()}
    assert found == {1: [5, 0, 0, 0, 0]} | {r: [0] * 5 for r in range(2, 6)}


def test_top_share_of_nobody_and_in_one_pass(spark):
    assert reports.top_share(b.base(spark, [])).collect() == []
    found = {r.top_percent: (r.customers, int(r.revenue)) for r in reports.top_share(b.base(spark, PEOPLE), [10, 50]).collect()}
    assert found == {10: (2, 105), 50: (6, 255)}


def test_classes_of_nobody(spark):
    assert reports.value_classes(b.base(spark, [])).collect() == []


def test_strategies_named_twice_are_refused_whatever_their_number(spark):
    found = some_segments(spark)
    many = spark.createDataFrame([(f"s{i}", "high", "x") for i in range(2000)] + [("champions", "high", "y")], segments.STRATEGY_SCHEMA)
    assert segments.attach_strategies(found, many).count() == len(PEOPLE)


def test_rewriting_a_date_with_nothing_empties_it(spark):
    path = scratch_path(spark, "dates")
    found = some_segments(spark)
    sinks.write_snapshot(found, path, "2024-01-01")
    sinks.write_snapshot(found, path, "2024-02-01")
    sinks.write_snapshot(found.limit(0), path, "2024-01-01")
    assert [str(r.as_of) for r in sinks.read_snapshots(spark, path).select("as_of").distinct().collect()] == ["2024-02-01"]


def test_many_dates_make_few_files(spark):
    import glob

    path = scratch_path(spark, "files")
    dated = some_segments(spark).crossJoin(spark.range(30).selectExpr("date_add(DATE '2024-01-01', CAST(id AS INT)) AS as_of")).repartition(16)
    sinks.write_snapshot(dated, path)
    assert len(glob.glob(f"{path}/as_of=*/*.parquet")) == 30


def test_lag_needs_the_month_before(spark):
    rows = [(1, "2024-01-01", "a"), (1, "2024-02-01", "b"), (1, "2024-04-01", "c")]
    series = spark.createDataFrame(rows, "customer_id bigint, as_of string, segment string").selectExpr("customer_id", "CAST(as_of AS DATE) AS as_of", "segment")
    found = {(str(r.as_of), r.from_segment, r.to_segment) for r in history.migration_by_lag(series, "2024-01-01").collect()}
    assert found == {("2024-02-01", "a", "b"), ("2024-04-01", "(none)", "c")}

"""The named queries: each reads whole tables from a folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.columns import average_order_value, rfm_total
from patronage.operators import clustering, history, hygiene, indicators, kept_history, refunds, reports, scoring, segments, sketches, slice_rules
from patronage.operators import distinct_buyers as buyers
from patronage.plans.dashboard import dashboard_tables
from patronage.plans.segmentation import customer_base, segment_customers
from patronage.session import materialize, scratch_path
from patronage.sources import purchases as source
from patronage.sources import sinks
from patronage.streaming import purchases as stream
from patronage.streaming import refunds as stream_refunds
from patronage.streaming import state

AS_OF = "2001-08-02"  # the day after the last order
EVENTS_AS_OF = "2024-01-31"
EARLIER = "2001-05-01"
FIRST_MONTH, LAST_MONTH = "1996-01-01", "2001-08-01"
KEPT_FIRST = "2000-08-01"
FIXED_CUTS = {"r": [390, 220, 123, 54], "f": [7, 9, 11, 13], "m": [1500000, 2000000, 2500000, 3000000]}
#: Days, purchases and revenue of clusters that are kept.
CENTRES = [(30, 14, 3500000), (60, 9, 2200000), (300, 11, 2800000), (400, 6, 1400000)]

Query = Callable[[SparkSession, str], DataFrame]


def _orders(spark: SparkSession, directory: str) -> DataFrame:
    return source.purchases_from_orders(spark, directory)


def _seen_orders(spark: SparkSession, directory: str, as_of: str) -> DataFrame:
    """Valid orders before a date. The order key is the table's primary key, so ids cannot repeat."""
    return hygiene.clean_purchases(_orders(spark, directory), as_of, unique=True)


def _seen_events(spark: SparkSession, directory: str) -> DataFrame:
    return hygiene.clean_purchases(source.purchases_from_events(spark, directory), EVENTS_AS_OF)


def _base(spark: SparkSession, directory: str) -> DataFrame:
    return customer_base(_orders(spark, directory), AS_OF, unique=True)


def _segments(spark: SparkSession, directory: str, as_of: str = AS_OF) -> DataFrame:
    return segment_customers(_orders(spark, directory), as_of, unique=True)


def _customers(spark: SparkSession, directory: str) -> DataFrame:
    return source.table(spark, directory, "customer").select(F.col("c_custkey").alias("customer_id"))


def _shipments(spark: SparkSession, directory: str) -> DataFrame:
    """Order lines seen as purchases from suppliers: the order key repeats line by line."""
    lines = source.table(spark, directory, "lineitem")
    return source.purchases_from(lines, "l_suppkey", "l_orderkey", "l_shipdate", "l_extendedprice")


# Sources and hygiene


def purchases_orders(spark, directory):
    return _orders(spark, directory)


def purchases_by_status(spark, directory):
    return source.purchases_from_orders(spark, directory, ["F", "O"])


def purchases_events(spark, directory):
    return source.purchases_from_events(spark, directory)


def purchases_net_of_returns(spark, directory):
    return source.purchases_from_lines(spark, directory, returned=False)


def validity_summary(spark, directory):
    return hygiene.reject_summary(source.purchases_and_refunds(spark, directory))


def rejected_rows(spark, directory):
    return hygiene.split_valid(source.purchases_and_refunds(spark, directory))[1]


def rejected_text(spark, directory):
    """Orders as a text file might hold them, some with a broken id, time or amount."""
    key = F.col("o_orderkey")

    def broken(column: str, every: int, text: str | None):
        return F.when(key % every == 0, F.lit(text)).otherwise(F.col(column).cast("string"))

    day = F.when(key % 7 == 0, F.lit("2001-13-45")).otherwise(F.col("o_orderdate").cast("date").cast("string"))
    typed = source.purchases_from(
        source.table(spark, directory, "orders"), broken("o_custkey", 3, "unknown"), broken("o_orderkey", 5, "x17"), day,
        broken("o_totalprice", 11, "n/a"),
    )
    return hygiene.split_valid(typed)[1].groupBy("reason").agg(F.count("*").alias("n_rows"), F.sum("amount").cast("decimal(38,2)").alias("amount"))


def dedup_shipments(spark, directory):
    return hygiene.dedup(hygiene.split_valid(_shipments(spark, directory))[0])


def observation_window(spark, directory):
    return hygiene.observe(_orders(spark, directory), "2000-01-01", "1999-01-01")


# Indicators


def rfm_base(spark, directory):
    return indicators.rfm_base(_seen_orders(spark, directory, AS_OF), AS_OF)


def rfm_base_window(spark, directory):
    cleaned = hygiene.clean_purchases(_shipments(spark, directory), "2001-01-01", "2000-01-01")
    return indicators.rfm_base(cleaned, "2001-01-01")


def rfm_base_events(spark, directory):
    return indicators.rfm_base(_seen_events(spark, directory), EVENTS_AS_OF)


def rfm_base_net(spark, directory):
    lines = source.purchases_and_refunds(spark, directory)
    return indicators.rfm_base(hygiene.clean_purchases(lines, AS_OF, net=True), AS_OF)


def _line_refunds(spark: SparkSession, directory: str) -> DataFrame:
    valid = hygiene.split_valid(source.purchases_and_line_refunds(spark, directory), net=True)[0]
    return hygiene.observe(valid, AS_OF)


def settled_purchases(spark, directory):
    """Orders and the returned lines that they cover."""
    return refunds.settle_refunds(_line_refunds(spark, directory))[0]


def rejected_refunds(spark, directory):
    return refunds.settle_refunds(_line_refunds(spark, directory))[1]


def rfm_base_settled(spark, directory):
    lines = source.purchases_and_line_refunds(spark, directory)
    return indicators.rfm_base(hygiene.clean_purchases(lines, AS_OF, settled=True), AS_OF)


def rfm_base_line_refunds(spark, directory):
    """Every returned line counts, also where they exceed their order."""
    lines = source.purchases_and_line_refunds(spark, directory)
    return indicators.rfm_base(hygiene.clean_purchases(lines, AS_OF, net=True), AS_OF)


def net_revenue(spark, directory):
    billed = source.purchases_from_lines(spark, directory, returned=False)
    return indicators.rfm_base(hygiene.clean_purchases(billed, AS_OF, unique=True), AS_OF)


def non_buyers(spark, directory):
    return indicators.non_buyers(_customers(spark, directory), _seen_events(spark, directory))


def all_customers(spark, directory):
    return indicators.with_non_buyers(_customers(spark, directory), event_segments(spark, directory))


def average_order_values(spark, directory):
    return rfm_base(spark, directory).select(
        "customer_id", "monetary", "frequency", average_order_value().alias("average_order_value")
    )


def purchase_rate(spark, directory):
    return indicators.purchase_rate(_seen_orders(spark, directory, AS_OF), AS_OF)


def purchase_gaps(spark, directory):
    return indicators.purchase_gaps(_seen_orders(spark, directory, AS_OF))


# Scores and segments


def score_rank(spark, directory):
    return scoring.score_rank(_base(spark, directory))


def score_rank_ten(spark, directory):
    return scoring.score_rank(_base(spark, directory), 10)


def score_ntile(spark, directory):
    return scoring.score_ntile(_base(spark, directory))


def score_fitted(spark, directory):
    return scoring.score_fitted(_base(spark, directory))


def fitted_cutpoints(spark, directory):
    cuts = scoring.fit_cutpoints(_base(spark, directory))
    return cuts.select(
        F.posexplode(F.arrays_zip("r_cuts", "f_cuts", "m_cuts")).alias("place", "c")
    ).select((F.col("place") + 1).alias("cut_no"), "c.r_cuts", "c.f_cuts", "c.m_cuts")


def score_kept_cutpoints(spark, directory):
    """Cuts fitted at an earlier date, applied later: scores stay comparable."""
    cuts = scoring.fit_cutpoints(customer_base(_orders(spark, directory), EARLIER, unique=True))
    return scoring.apply_cutpoints(rfm_base(spark, directory), cuts)


def sketched_cuts(spark, directory):
    """Cuts of each year from monthly sketches, and whether their ranks are as near as promised."""
    series = materialize(monthly_snapshots(spark, directory), "series")
    path = scratch_path(spark, "sketches")
    sketches.keep_sketches(series, path)
    yearly = sketches.merged(sinks.read_snapshots(spark, path).withColumn("year", F.year("as_of")), ["year"])
    cuts = materialize(sketches.sketched_cuts(yearly, by=["year"]), "cuts")
    found = sketches.rank_of_cuts(series.withColumn("year", F.year("as_of")), cuts, ["year"])
    return found.select("year", "indicator", "cut_no", "customers", (F.col("off") <= sketches.rank_error()).alias("within_error"))


def score_fixed(spark, directory):
    return scoring.score_fixed(rfm_base(spark, directory), **FIXED_CUTS)


def score_nested(spark, directory):
    return scoring.score_nested(_base(spark, directory))


def score_relative(spark, directory):
    """Scores of how often per day and how much on average, instead of counts and totals."""
    found = indicators.relative_base(_seen_orders(spark, directory, AS_OF), AS_OF)
    return scoring.score_rank(materialize(found, "base"))


def score_totals(spark, directory):
    return _segments(spark, directory).select(
        "customer_id", "rfm_code", rfm_total(3, 2, 1).alias("rfm_total")
    )


def customer_segments(spark, directory):
    return _segments(spark, directory)


def event_segments(spark, directory):
    return segment_customers(source.purchases_from_events(spark, directory), EVENTS_AS_OF)


def strategies(spark, directory):
    found = segments.attach_strategies(_segments(spark, directory))
    return found.select("customer_id", "segment", "value_tier", "action")


# Reports


def segment_summary(spark, directory):
    return reports.segment_summary(_segments(spark, directory))


def tier_rollup(spark, directory):
    return reports.tier_rollup(_segments(spark, directory))


def rf_matrix(spark, directory):
    return reports.rf_matrix(scoring.score_rank(_base(spark, directory), indicators=("r", "f")))


def value_classes(spark, directory):
    return reports.value_classes(_base(spark, directory))


def class_summary(spark, directory):
    return reports.class_summary(reports.value_classes(_base(spark, directory)))


def concentration(spark, directory):
    return reports.pareto(_base(spark, directory))


def concentration_by_region(spark, directory):
    return reports.pareto(reports.with_region(_base(spark, directory), *_dimensions(spark, directory)), ["r_name"])


def concentration_by_month(spark, directory):
    return reports.pareto(monthly_snapshots(spark, directory), ["as_of"])


def top_share(spark, directory):
    return reports.top_share(_base(spark, directory))


def _dimensions(spark, directory):
    return [source.table(spark, directory, name) for name in ("customer", "nation", "region")]


def by_attribute(spark, directory):
    return reports.by_attribute(_segments(spark, directory), *_dimensions(spark, directory))


def by_nation(spark, directory):
    return reports.by_nation(_segments(spark, directory), *_dimensions(spark, directory))


def top_customers(spark, directory):
    return reports.top_customers(_segments(spark, directory), 10)


def _published(name: str) -> Query:
    """Publish a dashboard table and read it back as a dashboard would."""
    def query(spark: SparkSession, directory: str) -> DataFrame:
        tables = dashboard_tables(_orders(spark, directory), AS_OF, unique=True)
        written = sinks.publish({name: tables[name]}, scratch_path(spark, "dashboard"))
        return spark.read.parquet(written[name])

    return query


# History


def monthly_snapshots(spark, directory):
    cleaned = _seen_orders(spark, directory, LAST_MONTH)
    return history.snapshots(cleaned, FIRST_MONTH, LAST_MONTH)


def trailing_snapshots(spark, directory):
    cleaned = _seen_orders(spark, directory, LAST_MONTH)
    return history.snapshots(cleaned, FIRST_MONTH, LAST_MONTH, trailing_months=12)


def segment_series(spark, directory):
    cleaned = _seen_orders(spark, directory, LAST_MONTH)
    spells = materialize(history.spells(cleaned, FIRST_MONTH, LAST_MONTH), "spells")
    return history.segment_series(history.unfold(spells, FIRST_MONTH))


def migration(spark, directory):
    return history.migration_between(_seen_orders(spark, directory, AS_OF), EARLIER, AS_OF)


def monthly_migration(spark, directory):
    cleaned = _seen_orders(spark, directory, LAST_MONTH)
    return history.migration_series(cleaned, FIRST_MONTH, LAST_MONTH)


def migration_decomposed(spark, directory):
    """Moves by own behaviour and by the change of all others."""
    cleaned = _seen_orders(spark, directory, LAST_MONTH)
    return history.migration_decomposed(cleaned, FIRST_MONTH, LAST_MONTH)


def trailing_decomposed(spark, directory):
    cleaned = _seen_orders(spark, directory, LAST_MONTH)
    return history.migration_decomposed(cleaned, FIRST_MONTH, LAST_MONTH, trailing_months=12)


def segment_flows(spark, directory):
    return history.segment_flows(materialize(migration_decomposed(spark, directory), "moves"))


def why_moved(spark, directory):
    return history.why_moved(migration_decomposed(spark, directory))


def trailing_migration(spark, directory):
    cleaned = _seen_orders(spark, directory, LAST_MONTH)
    return history.migration_series(cleaned, FIRST_MONTH, LAST_MONTH, trailing_months=12)


def migration_from_series(spark, directory):
    return history.migration_by_lag(segment_series(spark, directory), FIRST_MONTH)


def stored_snapshots(spark, directory):
    """Two dates written, the second one twice; each is stored once."""
    path = scratch_path(spark, "snapshots")
    for as_of in (EARLIER, AS_OF, AS_OF):
        sinks.write_snapshot(_segments(spark, directory, as_of), path, as_of)
    return sinks.read_snapshots(spark, path)


def kept_snapshots(spark, directory):
    """A history of one year, to which its months are added one by one."""
    kept = kept_history.KeptHistory(spark, scratch_path(spark, "kept-history"), KEPT_FIRST)
    purchases = _orders(spark, directory)
    for months in range(13):
        day = kept_history.month_after(kept.first, months)
        kept.add_month(hygiene.clean_purchases(purchases, day, unique=True), day)
    return kept.snapshots()


def bucketed_migration(spark, directory):
    """Moves between two stored snapshots that are dealt by customer alike."""
    tables = []
    for day in (EARLIER, AS_OF):
        path = scratch_path(spark, "bucketed")
        tables.append(f"patronage_{path.rsplit('-', 1)[1]}")
        sinks.write_bucketed(_segments(spark, directory, day), tables[-1], path, 8)
    return history.migration(*[spark.table(name) for name in tables])


def _buyers(spark: SparkSession, directory: str) -> DataFrame:
    named = reports.with_region(_seen_orders(spark, directory, AS_OF), *_dimensions(spark, directory))
    return named.withColumn("quarter", F.date_trunc("quarter", F.col("ts").cast("timestamp")).cast("date")).withColumn("large", F.col("amount") >= 200000)


def distinct_buyers(spark, directory):
    """Buyers by quarter, region and size of purchase, at every level."""
    by = ["quarter", "r_name", "large"]
    bitmaps = materialize(buyers.buyer_bitmaps(_buyers(spark, directory), by), "bitmaps")
    return buyers.distinct_buyers(bitmaps, by)


def _slice_rules(spark: SparkSession, directory: str) -> DataFrame:
    """A rule set for each region; where its bounds lie follows from the region's number."""
    regions = source.table(spark, directory, "region").select(F.col("r_name").alias("slice"), F.col("r_regionkey").cast("bigint").alias("k"))
    rule = lambda name, *bounds: F.struct(F.lit(name).alias("segment"), *[F.expr(b).cast("bigint").alias(c) for b, c in zip(bounds, slice_rules.BOUNDS)])
    rules = F.array(
        rule("active", "NULL", "60 + 30 * k", "8 + k", "NULL"), rule("recent", "NULL", "60 + 30 * k", "NULL", "7 + k"),
        rule("lapsed", "61 + 30 * k", "NULL", "NULL", "3"), rule("fading", "61 + 30 * k", "400", "4", "NULL"), rule("lost", "401", "NULL", "4", "NULL"),
    )
    return regions.select("slice", F.explode(rules).alias("rule")).select("slice", "rule.*")


def segments_by_region(spark, directory):
    """Segments by rules on days and purchases, other ones in each region."""
    base = reports.with_region(_base(spark, directory), *_dimensions(spark, directory))
    return slice_rules.assign_by_slice(base, _slice_rules(spark, directory), "r_name").select("customer_id", "r_name", "recency_days", "frequency", "segment")


# Streams


def _event_stream(spark, directory):
    return stream.purchase_stream(stream.utc_session(spark), f"{directory}/events.parquet*")


def _drained_state(purchases):
    spark = purchases.sparkSession
    log = scratch_path(spark, "state")
    running = stream.running_indicators(purchases)
    state.keep_state(running, log, scratch_path(spark, "state-progress")).awaitTermination()
    return state.latest_state(spark, log)


def stream_indicators(spark, directory):
    return _drained_state(stream.once_each(_event_stream(spark, directory), "40 days"))


def stream_repeats(spark, directory):
    """Every event arrives twice and counts once."""
    first = _event_stream(spark, directory)
    again = stream.purchase_stream(first.sparkSession, f"{directory}/events.parquet*")
    return _drained_state(stream.once_each(first.unionByName(again), "40 days"))


def stream_segments(spark, directory):
    purchases = stream.once_each(_event_stream(spark, directory), "40 days")
    session = purchases.sparkSession
    found = scratch_path(session, "stream-segments")
    state.keep_segments(
        stream.running_indicators(purchases), EVENTS_AS_OF, scratch_path(session, "state"), found,
        scratch_path(session, "state-progress"),
    ).awaitTermination()
    return state.latest_segments(session, found).drop("batch_id")


def with_refunds(purchases):
    """Purchases and refunds made from them: some of a part, some of more than is left, some under an id without a sale.
    Fits a batch and a stream."""
    def refund(every: int, days: int, percent: int, txn: str = "txn_id"):
        part = (F.col("amount") * F.lit(-percent) / 100).cast("decimal(18,2)")
        made = F.struct("customer_id", F.expr(txn).cast("bigint").alias("txn_id"), F.expr(f"ts + INTERVAL {days} DAYS").alias("ts"), part.alias("amount"))
        return F.when(F.col("txn_id") % every == 0, made)

    own = F.struct("customer_id", "txn_id", "ts", "amount")
    rows = F.array(own, refund(4, 1, 30), refund(8, 2, 50), refund(16, 3, 40), refund(50, 2, 10, "-txn_id - 1"))
    return purchases.select(F.explode(F.array_compact(rows)).alias("row")).select("row.*").where("amount <> 0 OR txn_id >= 0")


def rfm_base_net_events(spark, directory):
    """The batch answer of ``stream_net``."""
    rows = with_refunds(source.purchases_from_events(spark, directory))
    return indicators.rfm_base(hygiene.clean_purchases(rows, EVENTS_AS_OF, settled=True), EVENTS_AS_OF)


def stream_net(spark, directory):
    """Indicators of a stream of purchases and refunds."""
    incoming = _event_stream(spark, directory).where(F.col("ts") < F.lit(EVENTS_AS_OF).cast("timestamp"))
    session = incoming.sparkSession
    matched = stream.drain(stream_refunds.match_refunds(with_refunds(incoming).where(F.col("ts") < F.lit(EVENTS_AS_OF).cast("timestamp"))), "refunds")
    table = state.state_table(session, scratch_path(session, "net-state"))
    running = stream.running_indicators(stream.once_each(incoming, "40 days"))
    table.follow(running, scratch_path(session, "net-progress")).awaitTermination()
    return stream_refunds.net_base(table.read(), matched, EVENTS_AS_OF)


def stream_state_table(spark, directory):
    """Running indicators in a table of bounded size; every event arrives twice."""
    first = _event_stream(spark, directory)
    again = stream.purchase_stream(first.sparkSession, f"{directory}/events.parquet*")
    running = stream.running_indicators(stream.once_each(first.unionByName(again), "40 days"))
    table = state.state_table(first.sparkSession, scratch_path(spark, "state-table"), every=2)
    table.follow(running, scratch_path(spark, "state-progress")).awaitTermination()
    return table.read()


def stream_weekly(spark, directory):
    return stream.drain(stream.purchases_per_period(_event_stream(spark, directory)), "weekly")


def stream_sliding(spark, directory):
    return stream.drain(stream.purchases_per_period(_event_stream(spark, directory), "7 days", "1 day"), "sliding")


def stream_sessions(spark, directory):
    return stream.drain(stream.buying_sessions(_event_stream(spark, directory)), "sessions")


# Clusters


def clusters(spark, directory):
    return clustering.fit_clusters(_base(spark, directory))


def kept_clusters(spark, directory):
    return clustering.nearest_centre(rfm_base(spark, directory), CENTRES).select("customer_id", "cluster")


def cluster_profile(spark, directory):
    return clustering.cluster_profile(clustering.nearest_centre(rfm_base(spark, directory), CENTRES))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        purchases_orders, purchases_by_status, purchases_events, purchases_net_of_returns,
        validity_summary, rejected_rows, rejected_text, dedup_shipments, observation_window,
        rfm_base, rfm_base_window, rfm_base_events, rfm_base_net, rfm_base_line_refunds, settled_purchases, rejected_refunds,
        rfm_base_settled, rfm_base_net_events, net_revenue,
        non_buyers, all_customers, average_order_values, purchase_rate, purchase_gaps,
        score_rank, score_rank_ten, score_ntile, score_fitted, fitted_cutpoints, score_kept_cutpoints, sketched_cuts,
        score_fixed, score_nested, score_relative, score_totals, customer_segments, event_segments, strategies,
        segment_summary, tier_rollup, rf_matrix, value_classes, class_summary, concentration, concentration_by_region,
        concentration_by_month, top_share,
        by_attribute, by_nation, top_customers,
        monthly_snapshots, trailing_snapshots, segment_series, migration, monthly_migration,
        trailing_migration, migration_from_series, stored_snapshots,
        migration_decomposed, trailing_decomposed, segment_flows, why_moved, kept_snapshots, bucketed_migration,
        distinct_buyers, segments_by_region,
        stream_indicators, stream_repeats, stream_state_table, stream_net, stream_segments, stream_weekly, stream_sliding, stream_sessions,
        clusters, kept_clusters, cluster_profile,
    )
}
#: Every dashboard table, published and read back.
PUBLISHED = {
    "published_customers": "customers", "published_summary": "segment_summary", "published_rollup": "tier_rollup",
    "published_matrix": "rf_matrix", "published_classes": "class_summary", "published_concentration": "concentration",
    "published_top_share": "top_share", "published_top_customers": "top_customers",
}
QUERIES |= {query: _published(table) for query, table in PUBLISHED.items()}

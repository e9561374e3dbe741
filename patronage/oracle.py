"""Independent answers in plain SQL, written from the definitions: global ranks, NTILE,
range joins and running sums over all rows, where the operators avoid them."""

from __future__ import annotations

from patronage import catalog as c
from patronage.operators.segments import DEFAULT_RULES, DEFAULT_STRATEGIES

ORDERS = """SELECT o_custkey AS customer_id, o_orderkey AS txn_id, o_orderdate AS ts,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders"""
EVENTS = """SELECT user_id AS customer_id, event_id AS txn_id, ts, CAST(value AS DECIMAL(18,2)) AS amount
    FROM events WHERE event_type = 'purchase'"""
LINES = """SELECT o_custkey AS customer_id, o_orderkey AS txn_id, o_orderdate AS ts,
    CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 0)
         AS DECIMAL(18,2)) AS amount
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag IS DISTINCT FROM 'R'
    GROUP BY o_custkey, o_orderkey, o_orderdate"""
NET = "sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))"
BILLED = f"""SELECT o_custkey, o_orderkey, o_orderdate, CAST(coalesce({NET}, 0) AS DECIMAL(18,2)) AS sold,
    CAST(coalesce({NET} FILTER (l_returnflag IS DISTINCT FROM 'R'), 0) AS DECIMAL(18,2)) AS kept,
    max(l_shipdate) FILTER (l_returnflag = 'R') AS returned_at
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate"""
REFUNDS = f"""SELECT o_custkey AS customer_id, o_orderkey AS txn_id, o_orderdate AS ts, sold AS amount FROM ({BILLED})
    UNION ALL SELECT o_custkey, o_orderkey, returned_at, CAST(kept - sold AS DECIMAL(18,2))
    FROM ({BILLED}) WHERE returned_at IS NOT NULL AND kept < sold"""
LINE_SALES = f"SELECT o_custkey AS customer_id, o_orderkey AS txn_id, o_orderdate AS ts, sold AS amount FROM ({BILLED}) WHERE o_orderdate < DATE '{c.AS_OF}'"
LINE_REFUNDS = f"""SELECT DISTINCT o_custkey AS customer_id, l_orderkey AS txn_id, l_shipdate AS ts, -CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_extendedprice > 0 AND l_shipdate < DATE '{c.AS_OF}'"""
#: Each refund with what its sale had left when it came.
SETTLED = f"""SELECT r.*, s.amount AS whole, s.ts AS sold_at,
    CASE WHEN s.txn_id IS NULL THEN 'refund without sale' WHEN r.ts < s.ts THEN 'refund before sale' END AS reason,
    greatest(s.amount + coalesce(sum(r.amount) FILTER (r.ts >= s.ts) OVER (PARTITION BY r.txn_id ORDER BY r.ts, r.customer_id, r.amount
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room
    FROM ({LINE_REFUNDS}) r LEFT JOIN ({LINE_SALES}) s ON s.txn_id = r.txn_id"""
SETTLED_PURCHASES = f"""{LINE_SALES} UNION ALL SELECT customer_id, txn_id, ts, CAST(-least(-amount, room) AS DECIMAL(18,2)) AS amount
    FROM ({SETTLED}) WHERE reason IS NULL AND room > 0"""
SHIPMENTS = """SELECT l_suppkey AS customer_id, l_orderkey AS txn_id, l_shipdate AS ts,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem"""
FIRST_SHIPMENTS = f"""SELECT customer_id, txn_id, ts, amount FROM ({SHIPMENTS})
    QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY ts, customer_id, amount) = 1"""

SCORES = {
    "r": "recency_days DESC",
    "f": "frequency",
    "m": "monetary",
}


def base(purchases: str = ORDERS, as_of: str = c.AS_OF, start: str | None = None) -> str:
    lower = f" AND ts >= DATE '{start}'" if start else ""
    return f"""SELECT customer_id, CAST(max(ts) AS DATE) AS last_purchase,
    CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '{as_of}') AS BIGINT) AS recency_days,
    count(*) AS frequency, CAST(sum(amount) AS DECIMAL(38,2)) AS monetary
    FROM ({purchases}) WHERE ts < DATE '{as_of}'{lower} GROUP BY customer_id"""


def net_base(purchases: str, as_of: str = c.AS_OF) -> str:
    """Refunds count in the revenue only, and do not make a customer."""
    return f"""SELECT customer_id, CAST(max(ts) FILTER (amount >= 0) AS DATE) AS last_purchase,
        CAST(date_diff('day', CAST(max(ts) FILTER (amount >= 0) AS DATE), DATE '{as_of}') AS BIGINT) AS recency_days,
        count(*) FILTER (amount >= 0) AS frequency, CAST(sum(amount) AS DECIMAL(38,2)) AS monetary
        FROM ({purchases}) WHERE ts < DATE '{as_of}' GROUP BY customer_id HAVING count(*) FILTER (amount >= 0) > 0"""


def ranked(rows: str, k: int = 5, over: str = "") -> str:
    part = f"PARTITION BY {over} " if over else ""
    scores = ", ".join(
        f"CAST(1 + ({k} * (rank() OVER ({part}ORDER BY {order}) - 1)) // count(*) OVER ({part}) AS INTEGER) AS {i}_score"
        for i, order in SCORES.items()
    )
    return f"SELECT *, {scores} FROM ({rows})"


CASES = " ".join(
    f"WHEN r_score BETWEEN {r.r_lo} AND {r.r_hi} AND f_score BETWEEN {r.f_lo} AND {r.f_hi} THEN '{r.segment}'"
    for r in DEFAULT_RULES
)


def segmented(scored: str) -> str:
    return f"""SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_code,
    CASE {CASES} END AS segment,
    CASE WHEN m_score >= 4 THEN 'high' WHEN m_score = 3 THEN 'mid' ELSE 'low' END AS value_tier
    FROM ({scored})"""


SEGMENTS = segmented(ranked(base()))
SUMMARY = f"""SELECT segment, count(*) AS customers, CAST(sum(monetary) AS DECIMAL(38,2)) AS revenue,
    min(monetary) AS min_monetary, max(monetary) AS max_monetary, CAST(sum(frequency) AS BIGINT) AS purchases,
    min(recency_days) AS min_recency, max(recency_days) AS max_recency,
    CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS customer_share,
    CAST(sum(monetary) AS DOUBLE) / CAST(CAST(sum(sum(monetary)) OVER () AS DECIMAL(38,2)) AS DOUBLE) AS revenue_share
    FROM ({SEGMENTS}) GROUP BY segment"""


def quantiles(rows: str) -> str:
    """One row per cut number with the interpolated quantile of each indicator."""
    each = " UNION ALL ".join(
        f"SELECT {j} AS cut_no, "
        + ", ".join(f"quantile_cont(CAST({v} AS DOUBLE), {j / 5}) AS {i}" for i, v in
                    (("r", "recency_days"), ("f", "frequency"), ("m", "monetary")))
        + f" FROM ({rows})"
        for j in range(1, 5)
    )
    return each


def by_cuts(rows: str, cuts: str) -> str:
    """Cuts hold one row per cut number with columns r, f, m."""
    return f"""SELECT b.*,
    CAST(5 - (SELECT count(*) FROM ({cuts}) q WHERE CAST(b.recency_days AS DOUBLE) > q.r) AS INTEGER) AS r_score,
    CAST(1 + (SELECT count(*) FROM ({cuts}) q WHERE CAST(b.frequency AS DOUBLE) > q.f) AS INTEGER) AS f_score,
    CAST(1 + (SELECT count(*) FROM ({cuts}) q WHERE CAST(b.monetary AS DOUBLE) > q.m) AS INTEGER) AS m_score
    FROM ({rows}) b"""


FIXED = " UNION ALL ".join(
    f"SELECT {r} AS r, {f} AS f, {m} AS m"
    for r, f, m in zip(*(c.FIXED_CUTS[i] for i in "rfm"))
)
NTILES = ", ".join(
    f"CAST(ntile(5) OVER (ORDER BY {order}, customer_id) AS INTEGER) AS {i}_score" for i, order in SCORES.items()
)


def nested() -> str:
    def score(i: str, part: str) -> str:
        order = SCORES[i]
        return (f"CAST(1 + (5 * (rank() OVER ({part} ORDER BY {order}) - 1)) // count(*) OVER ({part}) "
                f"AS INTEGER) AS {i}_score")

    by_r = f"SELECT *, {score('r', '')} FROM ({base()})"
    by_rf = f"SELECT *, {score('f', 'PARTITION BY r_score')} FROM ({by_r})"
    return f"SELECT *, {score('m', 'PARTITION BY r_score, f_score')} FROM ({by_rf})"


CLASSES = f"""SELECT customer_id, monetary,
    CASE WHEN ahead * 100 < 80 * whole THEN 'A' WHEN ahead * 100 < 95 * whole THEN 'B' ELSE 'C' END AS abc_class
    FROM (SELECT customer_id, monetary, sum(monetary) OVER () AS whole,
            sum(monetary) OVER (ORDER BY monetary DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              - sum(monetary) OVER (PARTITION BY monetary) AS ahead
          FROM ({base()}))"""

MONTHS = "SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 MONTH)) AS DATE) AS as_of"


def series(first: str, last: str = c.LAST_MONTH, trailing: int | None = None) -> str:
    lower = f" AND ts >= as_of - INTERVAL {trailing} MONTH" if trailing else ""
    return f"""SELECT as_of, customer_id, CAST(max(ts) AS DATE) AS last_purchase,
    CAST(date_diff('day', CAST(max(ts) AS DATE), as_of) AS BIGINT) AS recency_days,
    count(*) AS frequency, CAST(sum(amount) AS DECIMAL(38,2)) AS monetary
    FROM ({MONTHS.format(first=first, last=last)}) JOIN ({ORDERS}) ON ts < as_of{lower}
    GROUP BY as_of, customer_id"""


def series_segments(first: str, trailing: int | None = None) -> str:
    return segmented(ranked(series(first, trailing=trailing), over="as_of"))


def moves(first: str, trailing: int | None = None) -> str:
    return f"""WITH s AS ({series_segments(first, trailing)})
    SELECT CAST(coalesce(a.as_of, b.as_of + INTERVAL 1 MONTH) AS DATE) AS as_of,
      coalesce(b.segment, '(none)') AS from_segment, coalesce(a.segment, '(none)') AS to_segment,
      count(*) AS customers
    FROM (SELECT * FROM s WHERE as_of > DATE '{first}') a
    FULL JOIN (SELECT * FROM s WHERE as_of < DATE '{c.LAST_MONTH}') b
      ON a.customer_id = b.customer_id AND a.as_of = b.as_of + INTERVAL 1 MONTH
    GROUP BY ALL"""


def sliced(group: str, columns: str) -> str:
    labels = ", ".join(f"coalesce({name}, '(unknown)') AS {name}" for name in ("r_name", "n_name", "c_mktsegment"))
    return f"""SELECT {columns}, count(*) AS customers, CAST(sum(monetary) AS DECIMAL(38,2)) AS revenue
    FROM (SELECT segment, monetary, {labels} FROM ({SEGMENTS}) LEFT JOIN customer ON c_custkey = customer_id
    LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey) GROUP BY {group}"""


EARLIER_POPULATION = "(SELECT count(*) FROM s e WHERE e.as_of = CAST(a.as_of - INTERVAL 1 MONTH AS DATE) AND {worse})"


def counterfactual(first: str, trailing: int | None = None) -> str:
    """Moves with the segment that a customer's later indicators have among the customers of the month before: the score counts
    how many of those are strictly worse."""
    worse = {"r": "e.recency_days > a.recency_days", "f": "e.frequency < a.frequency"}
    everyone = EARLIER_POPULATION.format(worse="TRUE")
    scores = ", ".join(f"CAST(least(5, 1 + 5 * {EARLIER_POPULATION.format(worse=w)} // {everyone}) AS INTEGER) AS {i}_score" for i, w in worse.items())
    return f"""WITH s AS MATERIALIZED ({series_segments(first, trailing)}),
    own AS MATERIALIZED (SELECT as_of, customer_id, CASE {CASES} END AS own_segment
        FROM (SELECT a.as_of, a.customer_id, {scores} FROM s a WHERE as_of > DATE '{first}'))
    SELECT CAST(coalesce(a.as_of, b.as_of + INTERVAL 1 MONTH) AS DATE) AS as_of, coalesce(b.segment, '(none)') AS from_segment,
      CASE WHEN a.segment IS NULL THEN '(none)' ELSE coalesce(own_segment, a.segment) END AS own_segment,
      coalesce(a.segment, '(none)') AS to_segment, count(*) AS customers
    FROM (SELECT * FROM s WHERE as_of > DATE '{first}') a
    FULL JOIN (SELECT * FROM s WHERE as_of < DATE '{c.LAST_MONTH}') b
      ON a.customer_id = b.customer_id AND a.as_of = b.as_of + INTERVAL 1 MONTH
    LEFT JOIN own ON own.as_of = a.as_of AND own.customer_id = a.customer_id
    GROUP BY ALL"""


# A stream's watermark is its newest event, to the millisecond, less a day.
WATERMARK = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM ({EVENTS}))"


def periods(slides: int) -> str:
    """Seven-day periods starting every 7 / slides days, counted from the epoch."""
    step = 7 * 86400 // slides
    start = f"make_timestamp((epoch_us(ts) // {step * 10**6} - n) * {step * 10**6})"
    return f"""SELECT period_start, period_start + INTERVAL 7 DAY AS period_end,
    count(*) AS purchases, CAST(sum(amount) AS DECIMAL(38,2)) AS revenue
    FROM (SELECT {start} AS period_start, amount FROM ({EVENTS}), (SELECT unnest(range({slides})) AS n))
    GROUP BY period_start HAVING period_start + INTERVAL 7 DAY <= {WATERMARK}"""


SESSIONS = f"""SELECT customer_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end,
    count(*) AS purchases, CAST(sum(amount) AS DECIMAL(38,2)) AS revenue
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY customer_id ORDER BY ts, txn_id) AS session_no
          FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, txn_id)
                  <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM ({EVENTS})))
    GROUP BY customer_id, session_no HAVING max(ts) + INTERVAL 12 HOUR <= {WATERMARK}"""

STATE = f"""SELECT customer_id, max(ts) AS last_ts, count(*) AS frequency,
    CAST(sum(amount) AS DECIMAL(38,2)) AS monetary FROM ({EVENTS}) GROUP BY customer_id"""

ACTIONS = ", ".join("('" + "', '".join(row) + "')" for row in DEFAULT_STRATEGIES)

ORACLES: dict[str, str] = {
    "purchases_orders": ORDERS,
    "purchases_by_status": f"{ORDERS} WHERE o_orderstatus IN ('F', 'O')",
    "purchases_events": EVENTS,
    "purchases_net_of_returns": LINES,
    "validity_summary": f"""SELECT CASE WHEN amount < 0 THEN 'negative amount' ELSE 'valid' END AS outcome,
        count(*) AS n_rows, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM ({REFUNDS}) GROUP BY 1""",
    "rejected_rows": f"SELECT *, 'negative amount' AS reason FROM ({REFUNDS}) WHERE amount < 0",
    "rejected_text": f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'missing customer' WHEN o_orderkey % 5 = 0 THEN 'missing transaction'
            WHEN o_orderkey % 7 = 0 THEN 'missing time' ELSE 'missing amount' END AS reason, count(*) AS n_rows,
        CAST(sum(CASE WHEN o_orderkey % 11 <> 0 THEN amount END) AS DECIMAL(38,2)) AS amount
        FROM (SELECT txn_id AS o_orderkey, amount FROM ({ORDERS}))
        WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 GROUP BY 1""",
    "dedup_shipments": FIRST_SHIPMENTS,
    "observation_window": f"SELECT * FROM ({ORDERS}) WHERE ts >= DATE '1999-01-01' AND ts < DATE '2000-01-01'",
    "rfm_base": base(),
    "rfm_base_window": base(FIRST_SHIPMENTS, "2001-01-01", "2000-01-01"),
    "rfm_base_events": base(EVENTS, c.EVENTS_AS_OF),
    "rfm_base_net": net_base(REFUNDS),
    "net_revenue": base(LINES),
    "non_buyers": f"""SELECT c_custkey AS customer_id FROM customer
        WHERE c_custkey NOT IN (SELECT customer_id FROM ({EVENTS}) WHERE ts < DATE '{c.EVENTS_AS_OF}')""",
    "all_customers": f"""SELECT coalesce(c_custkey, customer_id) AS customer_id, last_purchase, recency_days,
        coalesce(frequency, 0) AS frequency, CAST(coalesce(monetary, 0) AS DECIMAL(38,2)) AS monetary,
        r_score, f_score, m_score, rfm_code, coalesce(segment, 'never_purchased') AS segment,
        coalesce(value_tier, 'none') AS value_tier
        FROM customer FULL JOIN ({segmented(ranked(base(EVENTS, c.EVENTS_AS_OF)))}) ON customer_id = c_custkey""",
    "average_order_values": f"""SELECT customer_id, monetary, frequency,
        CAST(monetary AS DOUBLE) / frequency AS average_order_value FROM ({base()})""",
    "purchase_rate": f"""SELECT customer_id, CAST(min(ts) AS DATE) AS first_purchase, count(*) AS frequency,
        CAST(date_diff('day', CAST(min(ts) AS DATE), DATE '{c.AS_OF}') AS BIGINT) AS tenure_days,
        CAST(count(*) AS DOUBLE) / date_diff('day', CAST(min(ts) AS DATE), DATE '{c.AS_OF}') AS purchases_per_day
        FROM ({ORDERS}) WHERE ts < DATE '{c.AS_OF}' GROUP BY customer_id""",
    "purchase_gaps": f"""SELECT customer_id, CAST(coalesce(sum(gap), 0) AS BIGINT) AS sum_gap, count(gap) AS n_gaps,
        min(gap) AS shortest_gap, max(gap) AS longest_gap
        FROM (SELECT customer_id,
                CAST(date_diff('day', lag(day) OVER (PARTITION BY customer_id ORDER BY day), day) AS BIGINT) AS gap
              FROM (SELECT DISTINCT customer_id, CAST(ts AS DATE) AS day FROM ({ORDERS}) WHERE ts < DATE '{c.AS_OF}'))
        GROUP BY customer_id""",
    "score_rank": ranked(base()),
    "score_rank_ten": ranked(base(), 10),
    "score_ntile": f"SELECT *, {NTILES} FROM ({base()})",
    "score_fitted": by_cuts(base(), quantiles(base())),
    "fitted_cutpoints": f"""SELECT cut_no, CAST(r AS DECIMAL(38,6)) AS r_cuts, CAST(f AS DECIMAL(38,6)) AS f_cuts,
        CAST(m AS DECIMAL(38,6)) AS m_cuts FROM ({quantiles(base())})""",
    "score_kept_cutpoints": by_cuts(base(), quantiles(base(as_of=c.EARLIER))),
    "score_fixed": by_cuts(base(), FIXED),
    "score_nested": nested(),
    "score_totals": f"""SELECT customer_id, rfm_code, CAST(3 * r_score + 2 * f_score + m_score AS INTEGER) AS rfm_total
        FROM ({SEGMENTS})""",
    "customer_segments": SEGMENTS,
    "event_segments": segmented(ranked(base(EVENTS, c.EVENTS_AS_OF))),
    "strategies": f"""SELECT customer_id, s.segment, s.value_tier, action FROM ({SEGMENTS}) s
        LEFT JOIN (VALUES {ACTIONS}) a(segment, value_tier, action)
        ON a.segment = s.segment AND a.value_tier = s.value_tier""",
    "segment_summary": SUMMARY,
    "tier_rollup": f"""SELECT value_tier, segment, grouping(value_tier, segment) AS level, count(*) AS customers,
        CAST(sum(monetary) AS DECIMAL(38,2)) AS revenue FROM ({SEGMENTS}) GROUP BY ROLLUP (value_tier, segment)""",
    "rf_matrix": "SELECT r_score, "
    + ", ".join(f"count(*) FILTER (f_score = {f}) AS f{f}" for f in range(1, 6))
    + f" FROM (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS r_score) LEFT JOIN ({ranked(base())}) USING (r_score) GROUP BY r_score",
    "value_classes": CLASSES,
    "class_summary": f"""SELECT abc_class, count(*) AS customers, CAST(sum(monetary) AS DECIMAL(38,2)) AS revenue,
        CAST(sum(monetary) AS DOUBLE) / CAST(CAST(sum(sum(monetary)) OVER () AS DECIMAL(38,2)) AS DOUBLE)
          AS revenue_share FROM ({CLASSES}) GROUP BY abc_class""",
    "concentration": f"""SELECT DISTINCT monetary, count(*) OVER (PARTITION BY monetary) AS customers,
        rank() OVER (ORDER BY monetary DESC) AS revenue_rank,
        CAST(sum(monetary) OVER (ORDER BY monetary DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(monetary) OVER (PARTITION BY monetary) AS DECIMAL(38,2)) AS revenue_above,
        CAST(sum(monetary) OVER (ORDER BY monetary DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          AS DECIMAL(38,2)) AS revenue_through FROM ({base()})""",
    "top_share": f"""SELECT p AS top_percent, count(*) AS customers, CAST(sum(monetary) AS DECIMAL(38,2)) AS revenue,
        CAST(sum(monetary) AS DOUBLE) / CAST(any_value(whole) AS DOUBLE) AS revenue_share
        FROM (SELECT unnest([1, 5, 10, 20, 50]) AS p)
        JOIN (SELECT monetary, row_number() OVER (ORDER BY monetary DESC) AS place, count(*) OVER () AS n,
                CAST(sum(monetary) OVER () AS DECIMAL(38,2)) AS whole FROM ({base()}))
          ON place <= (p * n + 99) // 100
        GROUP BY p""",
    "by_attribute": sliced(
        "CUBE (r_name, c_mktsegment, segment)",
        "r_name, c_mktsegment, segment, grouping(r_name, c_mktsegment, segment) AS level",
    ),
    "by_nation": sliced(
        "GROUPING SETS ((r_name, segment), (n_name, segment))",
        "r_name, n_name, segment, CAST(grouping(r_name) AS INTEGER) AS is_nation",
    ),
    "top_customers": f"""SELECT segment, customer_id, monetary, frequency, recency_days,
        CAST(row_number() OVER (PARTITION BY segment ORDER BY monetary DESC, customer_id) AS INTEGER) AS place
        FROM ({SEGMENTS}) QUALIFY place <= 10""",
    "monthly_snapshots": series(c.FIRST_MONTH),
    "trailing_snapshots": series(c.FIRST_MONTH, trailing=12),
    "segment_series": series_segments(c.FIRST_MONTH),
    "migration": f"""SELECT coalesce(a.segment, '(none)') AS from_segment, coalesce(b.segment, '(none)') AS to_segment,
        count(*) AS customers FROM ({segmented(ranked(base(as_of=c.EARLIER)))}) a
        FULL JOIN ({SEGMENTS}) b ON a.customer_id = b.customer_id GROUP BY ALL""",
    "monthly_migration": moves(c.FIRST_MONTH),
    "trailing_migration": moves(c.FIRST_MONTH, 12),
    "migration_from_series": moves(c.FIRST_MONTH),
    "stored_snapshots": f"""SELECT *, DATE '{c.EARLIER}' AS as_of FROM ({segmented(ranked(base(as_of=c.EARLIER)))})
        UNION ALL SELECT *, DATE '{c.AS_OF}' AS as_of FROM ({SEGMENTS})""",
    "stream_indicators": STATE,
    "stream_repeats": STATE,
    "stream_state_table": STATE,
    "stream_segments": segmented(ranked(base(EVENTS, c.EVENTS_AS_OF))),
    "stream_weekly": periods(1),
    "stream_sliding": periods(7),
    "stream_sessions": SESSIONS,
}
ORACLES |= {
    "published_customers": f"""SELECT s.*, action FROM ({SEGMENTS}) s
        LEFT JOIN (VALUES {ACTIONS}) a(segment, value_tier, action)
        ON a.segment = s.segment AND a.value_tier = s.value_tier""",
    "published_summary": SUMMARY,
    "published_rollup": ORACLES["tier_rollup"],
    "published_matrix": ORACLES["rf_matrix"],
    "published_classes": ORACLES["class_summary"],
    "published_concentration": ORACLES["concentration"],
    "published_top_share": ORACLES["top_share"],
    "published_top_customers": ORACLES["top_customers"],
}
RELATIVE = f"""SELECT customer_id, last_purchase, recency_days, frequency * 1000000 // greatest(tenure, 1) AS frequency,
    CAST((CAST(monetary * 100 AS BIGINT) // frequency) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,2)) AS monetary
    FROM (SELECT b.*, CAST(date_diff('day', CAST(first AS DATE), DATE '{c.AS_OF}') AS BIGINT) AS tenure FROM ({base()}) b
          JOIN (SELECT customer_id, min(ts) AS first FROM ({ORDERS}) WHERE ts < DATE '{c.AS_OF}' GROUP BY customer_id) USING (customer_id))"""


def _nearest() -> str:
    """The kept centre at the least distance between logarithms, the first if there are several."""
    apart = " UNION ALL ".join(
        f"SELECT customer_id, recency_days, frequency, monetary, {i} AS cluster, "
        + " + ".join(f"pow(ln(1 + CAST({v} AS DOUBLE)) - ln(1 + CAST({x} AS DOUBLE)), 2)" for v, x in zip(("recency_days", "frequency", "monetary"), centre))
        + f" AS d FROM ({base()})"
        for i, centre in enumerate(c.CENTRES)
    )
    return f"SELECT * FROM ({apart}) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY d, cluster) = 1"


ORACLES |= {
    "score_relative": ranked(RELATIVE),
    "kept_clusters": f"SELECT customer_id, cluster FROM ({_nearest()})",
    "cluster_profile": f"""SELECT cluster, count(*) AS customers, CAST(sum(monetary) AS DECIMAL(38,2)) AS revenue,
        avg(CAST(recency_days AS DOUBLE)) AS mean_recency, avg(CAST(frequency AS DOUBLE)) AS mean_frequency
        FROM ({_nearest()}) GROUP BY cluster""",
}

DECOMPOSED = counterfactual(c.FIRST_MONTH)
ORACLES |= {
    "settled_purchases": SETTLED_PURCHASES,
    "rejected_refunds": f"""SELECT customer_id, txn_id, ts, amount, reason FROM ({SETTLED}) WHERE reason IS NOT NULL
        UNION ALL SELECT customer_id, txn_id, ts, CAST(amount + room AS DECIMAL(18,2)), 'refund beyond sale'
        FROM ({SETTLED}) WHERE reason IS NULL AND -amount > room""",
    "rfm_base_settled": net_base(SETTLED_PURCHASES),
    "rfm_base_line_refunds": net_base(f"{LINE_SALES} UNION ALL {LINE_REFUNDS}"),
    "migration_decomposed": DECOMPOSED,
    "trailing_decomposed": counterfactual(c.FIRST_MONTH, 12),
    "segment_flows": f"""WITH m AS ({DECOMPOSED}),
        ends AS (SELECT as_of, from_segment AS segment, customers AS n, 'from' AS kind FROM m UNION ALL SELECT as_of, own_segment, customers, 'own' FROM m
          UNION ALL SELECT as_of, to_segment, customers, 'to' FROM m),
        sums AS (SELECT as_of, segment, coalesce(sum(n) FILTER (kind = 'from'), 0) AS f, coalesce(sum(n) FILTER (kind = 'own'), 0) AS o,
          coalesce(sum(n) FILTER (kind = 'to'), 0) AS t FROM ends GROUP BY ALL)
        SELECT as_of, segment, CAST(f AS BIGINT) AS before, CAST(o - f AS BIGINT) AS own_change, CAST(t - o AS BIGINT) AS population_change,
          CAST(t AS BIGINT) AS after FROM sums""",
    "why_moved": f"""SELECT as_of, CAST(sum(CASE WHEN from_segment = to_segment AND own_segment = from_segment THEN customers ELSE 0 END) AS BIGINT) AS stayed,
        CAST(sum(CASE WHEN from_segment = to_segment AND own_segment <> from_segment THEN customers ELSE 0 END) AS BIGINT) AS "offset",
        CAST(sum(CASE WHEN from_segment <> to_segment AND own_segment = to_segment THEN customers ELSE 0 END) AS BIGINT) AS by_own,
        CAST(sum(CASE WHEN from_segment <> to_segment AND own_segment = from_segment THEN customers ELSE 0 END) AS BIGINT) AS by_population,
        CAST(sum(CASE WHEN from_segment <> to_segment AND own_segment NOT IN (from_segment, to_segment) THEN customers ELSE 0 END) AS BIGINT) AS by_both
        FROM ({DECOMPOSED}) GROUP BY as_of""",
}
ORACLES |= {
    "sketched_cuts": f"""SELECT CAST(year(as_of) AS INTEGER) AS year, indicator, CAST(cut_no AS INTEGER) AS cut_no, count(*) AS customers, TRUE AS within_error
        FROM ({series(c.FIRST_MONTH)}), (SELECT unnest(['r', 'f', 'm']) AS indicator), (SELECT unnest(range(1, 5)) AS cut_no) GROUP BY ALL""",
}

MADE_REFUNDS = " UNION ALL ".join(
    f"SELECT customer_id, txn_id, ts + INTERVAL {days} DAY AS ts, CAST(amount * CAST(-{percent / 100} AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS amount FROM ({EVENTS}) WHERE txn_id % {every} = 0"
    for every, days, percent in ((4, 1, 30), (8, 2, 50), (16, 3, 40))
)
#: What a sale still covers of each refund, by the totals of those before it.
MADE_SETTLED = f"""SELECT * FROM ({EVENTS}) WHERE ts < DATE '{c.EVENTS_AS_OF}' UNION ALL SELECT customer_id, txn_id, ts, CAST(-least(-amount, room) AS DECIMAL(18,2))
    FROM (SELECT r.*, greatest(s.amount + coalesce(sum(r.amount) OVER (PARTITION BY r.txn_id ORDER BY r.ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room
          FROM ({MADE_REFUNDS}) r JOIN ({EVENTS}) s ON s.txn_id = r.txn_id WHERE r.ts < DATE '{c.EVENTS_AS_OF}')"""
ORACLES |= {
    "rfm_base_net_events": net_base(MADE_SETTLED, c.EVENTS_AS_OF),
    "stream_net": net_base(MADE_SETTLED, c.EVENTS_AS_OF),
}


def curves(rows: str, by: str) -> str:
    """The concentration curve of each group, by windows over whole groups."""
    ahead = f"OVER (PARTITION BY {by} ORDER BY monetary DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT DISTINCT {by}, monetary, count(*) OVER (PARTITION BY {by}, monetary) AS customers,
        rank() OVER (PARTITION BY {by} ORDER BY monetary DESC) AS revenue_rank,
        CAST(sum(monetary) {ahead} - sum(monetary) OVER (PARTITION BY {by}, monetary) AS DECIMAL(38,2)) AS revenue_above,
        CAST(sum(monetary) {ahead} AS DECIMAL(38,2)) AS revenue_through FROM ({rows})"""


def fitted_clusters(k: int = 5, rounds: int = 10) -> str:
    """Lloyd's rounds from the definition: all distances, the least, floored means, one round after the other."""
    places = ("r", "f", "m")
    logs = ", ".join(f"{sign}CAST(floor(ln(1 + greatest(CAST({v} AS DOUBLE), 0)) * 1000000 + 0.5) AS BIGINT) AS l{i}"
                     for i, sign, v in (("r", "-", "recency_days"), ("f", "", "frequency"), ("m", "", "monetary")))
    units = ", ".join(
        f"CAST(floor(CAST(l{i} * (SELECT count(*) FROM logs) - (SELECT CAST(sum(l{i}) AS BIGINT) FROM logs) AS DOUBLE) * 1000.0 / sqrt(CAST("
        f"(SELECT count(*) * sum(CAST(l{i} AS HUGEINT) * l{i}) - sum(l{i}) * sum(l{i}) FROM logs) AS DOUBLE)) + 0.5) AS BIGINT) AS {i}" for i in places)
    quantiles = ", ".join(f"max({i}) FILTER (p{i} = ((2 * j + 1) * n + {2 * k - 1}) // {2 * k}) AS {i}" for i in places)
    ranks = ", ".join(f"row_number() OVER (ORDER BY {i}) AS p{i}" for i in places)
    parts = [
        f"base AS MATERIALIZED ({base()})", f"logs AS MATERIALIZED (SELECT *, {logs} FROM base)", f"points AS MATERIALIZED (SELECT *, {units} FROM logs)",
        f"c0 AS MATERIALIZED (SELECT CAST(j AS INTEGER) AS c, {quantiles} FROM (SELECT *, count(*) OVER () AS n, {ranks} FROM points), (SELECT unnest(range({k})) AS j) GROUP BY j)",
    ]
    away = " + ".join("(p.{0} - q.{0}) * (p.{0} - q.{0})".format(i) for i in places)
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT p.*, c FROM points p, c{n} q QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY {away}, c) = 1)")
        means = ", ".join(f"CAST((sum({i}) - ((sum({i}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS {i}" for i in places)
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT q.c, {', '.join(f'coalesce(t.{i}, q.{i}) AS {i}' for i in places)} FROM c{n} q LEFT JOIN (SELECT c, {means} FROM a{n} GROUP BY c) t USING (c))")
    return f"WITH {', '.join(parts)} SELECT customer_id, last_purchase, recency_days, frequency, monetary, c AS cluster FROM a{rounds}"


ORACLES |= {
    "concentration_by_region": curves(f"""SELECT coalesce(r_name, '(unknown)') AS r_name, monetary FROM ({base()}) LEFT JOIN customer ON c_custkey = customer_id
        LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""", "r_name"),
    "concentration_by_month": curves(series(c.FIRST_MONTH), "as_of"),
    "clusters": fitted_clusters(),
}

REGIONS = f"""({base()}) LEFT JOIN customer ON c_custkey = customer_id LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey"""
ORACLES |= {
    "kept_snapshots": series(c.KEPT_FIRST),
    "bucketed_migration": ORACLES["migration"],
    "distinct_buyers": f"""SELECT quarter, r_name, large, grouping(quarter, r_name, large) AS level, count(DISTINCT customer_id) AS customers
        FROM (SELECT CAST(date_trunc('quarter', ts) AS DATE) AS quarter, coalesce(r_name, '(unknown)') AS r_name, amount >= 200000 AS large, customer_id
              FROM ({ORDERS}) LEFT JOIN customer ON c_custkey = customer_id LEFT JOIN nation ON n_nationkey = c_nationkey
              LEFT JOIN region ON r_regionkey = n_regionkey WHERE ts < DATE '{c.AS_OF}') GROUP BY CUBE (quarter, r_name, large)""",
    "segments_by_region": f"""SELECT customer_id, coalesce(r_name, '(unknown)') AS r_name, recency_days, frequency, CASE
        WHEN recency_days BETWEEN 0 AND 60 + 30 * r_regionkey AND frequency >= 8 + r_regionkey THEN 'active'
        WHEN recency_days BETWEEN 0 AND 60 + 30 * r_regionkey AND frequency BETWEEN 0 AND 7 + r_regionkey THEN 'recent'
        WHEN recency_days >= 61 + 30 * r_regionkey AND frequency BETWEEN 0 AND 3 THEN 'lapsed'
        WHEN recency_days BETWEEN 61 + 30 * r_regionkey AND 400 AND frequency >= 4 THEN 'fading'
        WHEN recency_days >= 401 AND frequency >= 4 THEN 'lost' END AS segment FROM {REGIONS}""",
}

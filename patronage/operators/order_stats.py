"""Exact order statistics without sorting every row in one place.

A score or a revenue class only asks on which side of a few cut values a row lies, so
no row needs its global rank: it is enough to find the cut values themselves.

1. ``percentile_approx`` proposes fences close to the wanted positions.
2. Rows are counted between fences; these totals are exact, however good the fences.
3. Only the intervals that hold a wanted position are broken down value by value, and a
   running total inside each interval finds the cut.

Equal values are merged before any window runs, so a value shared by a third of all rows
costs one row, and intervals shrink with the accuracy of the fences.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from patronage.session import materialize

#: Weights carry two more decimals than money: a position may be a percentage of a total,
#: and Spark would otherwise round it to the scale of the weights when comparing.
WEIGHT_TYPE = "decimal(38,4)"



#: Most groups whose fences and cuts are broadcast: a few megabytes.
FEW_GROUPS = 5_000
#: Evenly spaced fences are counted in two steps of this many intervals each.
STEP = 15


def spread() -> list[float]:
    """225 even intervals, for targets whose rank is not known beforehand."""
    return [i / STEP**2 for i in range(1, STEP**2)]


def few_groups(rows: DataFrame, groups: Sequence[str]) -> bool:
    """Whether a table with a row for each group (or some) is small enough to be broadcast."""
    return rows.select(*groups).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS


def around(positions: Sequence[float], margin: float = 2e-4) -> list[float]:
    """Two fences about each relative position, at twice the error of the estimate."""
    return sorted({min(max(p + side, 0.0), 1.0) for p in positions for side in (-margin, margin)})


def fences_sql(value: str, fence_at: Sequence[float]) -> str:
    return f"percentile_approx({value}, array({', '.join(map(str, fence_at))}), 10000) AS p"


def same_group(left: str, right: str, columns: Sequence[str]) -> str:
    """A join condition under which NULL is a group like any other."""
    return " AND ".join(f"{left}.{c} <=> {right}.{c}" for c in columns)


def slots_sql(rows: str, groups: Sequence[str], n_fences: int, two_steps: bool, few_groups: bool = True) -> str:
    """CTE ``placed``: the rows with their ``slot``, the number of fences strictly below
    ``d``. Equal values always land together.

    Takes the CTEs ``fences`` (an array ``p`` per group) and ``rows``, which must have a
    double ``d`` that is never NULL. Every fence is compared, or (``two_steps``, for the
    fences of ``spread``) the last fence of each step, and then the others of the one step the row falls into,
    found by a second join. Fences are broadcast if there are ``few_groups``. They are plain columns because the code generated
    for array elements is too long for the JVM to compile.
    """
    keys = "".join(f"{g}, " for g in groups)

    def joined(rows: str, fences: str, *more: str) -> str:
        return f"{rows} JOIN {fences} ON {same_group(rows, fences, [*groups, *more])}" if groups or more else f"{rows} CROSS JOIN {fences}"

    def hint(name: str) -> str:
        return f"/*+ BROADCAST({name}) */" if few_groups else ""

    def columns(indexes: Sequence[str | int]) -> str:
        return ", ".join(f"coalesce(p[{i}], 0D) AS f{n}" for n, i in enumerate(indexes))

    def below(n: int) -> str:
        return " + ".join(f"CAST(f{i} < d AS INT)" for i in range(n))

    if not two_steps:
        return f"""
        bounds AS (SELECT {keys} {columns(range(n_fences))} FROM fences),
        placed AS (
            SELECT {hint("bounds")} {below(n_fences)} AS slot, {rows}.* FROM {joined(rows, "bounds")})"""
    return f"""
        coarse AS (SELECT {keys} {columns(range(STEP - 1, n_fences, STEP))} FROM fences),
        fine AS (
            SELECT {keys} step, {columns([f"{STEP} * step + {i}" for i in range(STEP - 1)])}
            FROM fences LATERAL VIEW explode(sequence(0, {STEP - 1})) AS step),
        stepped AS (
            SELECT {hint("coarse")} {below(STEP - 1)} AS step, {rows}.* FROM {joined(rows, "coarse")}),
        placed AS (
            SELECT {hint("fine")} {STEP} * stepped.step + {below(STEP - 1)} AS slot, stepped.*
            FROM {joined("stepped", "fine", "step")})"""


def exact_cuts(
    rows: DataFrame,
    groups: Sequence[str],
    value: str,
    targets: Mapping[int, str],
    fence_at: Sequence[float],
    weight: str | None = None,
    approx: str | None = None,
) -> DataFrame:
    """The smallest value whose running total reaches each wanted position.

    ``targets`` gives, for each cut number ``j``, its position as SQL over the group
    columns and over ``total``, the sum of the weights (or the number of rows) of the
    group. Positions run from just above zero to ``total``. NULL is a group like any other.
    Groups are counted first: fences and targets of up to ``FEW_GROUPS`` groups are
    broadcast, those of more are joined by a shuffle.

    Fences are compared as doubles (``approx``, by default ``value`` cast). Rounding keeps
    the order and equal values together, which is all the counting needs; cuts are found
    among the values themselves.

    Returns ``groups..., j, position, total, cut, below``, where ``below`` is the total of
    all values strictly under ``cut``.
    """
    keys = "".join(f"{g}, " for g in groups)
    few = not groups or few_groups(rows, groups)
    of_placed = "".join(f"placed.{g}, " for g in groups)
    per_group = f"PARTITION BY {', '.join(groups)}" if groups else ""
    measure, kind = (f"CAST({weight} AS {WEIGHT_TYPE})", WEIGHT_TYPE) if weight else ("1L", "BIGINT")
    wanted = ", ".join(f"struct({j} AS j, CAST({p} AS {kind}) AS position)" for j, p in targets.items())
    return rows.sparkSession.sql(
        f"""
        WITH measured AS (
            SELECT {keys} {value} AS v, coalesce({approx or f"CAST({value} AS DOUBLE)"}, 0D) AS d, {measure} AS w
            FROM {{rows}}),
        fences AS (SELECT {keys} {fences_sql("d", fence_at)} FROM measured GROUP BY ALL),
        {slots_sql("measured", groups, len(fence_at), list(fence_at) == spread(), few)},
        slots AS (SELECT {keys} slot, sum(w) AS slot_total FROM placed GROUP BY ALL),
        edges AS (
            SELECT *, sum(slot_total) OVER ({per_group} ORDER BY slot ROWS UNBOUNDED PRECEDING) AS through,
                sum(slot_total) OVER ({per_group}) AS total FROM slots),
        asked AS (
            SELECT {keys} slot, total, through, through - slot_total AS before, inline(array({wanted})) FROM edges),
        wanted AS (
            SELECT {keys} slot, total, before, j, position FROM asked WHERE before < position AND position <= through),
        counted AS (
            SELECT {"/*+ BROADCAST(wanted) */" if few else ""} {of_placed} j, position, total, before, v, sum(w) AS value_total
            FROM placed JOIN wanted ON {same_group("placed", "wanted", [*groups, "slot"])} GROUP BY ALL),
        summed AS (
            SELECT *, before + sum(value_total)
                OVER (PARTITION BY {keys} j, position ORDER BY v ROWS UNBOUNDED PRECEDING) AS through
            FROM counted)
        SELECT {keys} j, position, total, v AS cut, through - value_total AS below FROM summed
        WHERE through - value_total < position AND position <= through
        """,
        rows=rows,
    )


def running_totals(rows: DataFrame, value: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    """For every group and distinct value: rows, weight, and the exact totals of all larger values of the group.

    Rows are reduced to distinct values once, and written; a group's values are spread evenly over intervals of its
    own, however many rows share one, and summed in parallel. Only interval totals meet in one task per group, and are joined back:
    broadcast for up to ``FEW_GROUPS`` groups, else by a shuffle. NULL is a group like any other.
    """
    keys = "".join(f"{g}, " for g in groups)
    counted = materialize(
        rows.sparkSession.sql(f"SELECT {keys} {value} AS v, count(*) AS n, sum({weight}) AS w FROM {{rows}} GROUP BY ALL", rows=rows), "distinct-values"
    )
    few = not groups or few_groups(counted, groups)
    partition = f"PARTITION BY {', '.join(groups)}" if groups else ""
    of_summed = "".join(f"summed.{g}, " for g in groups)
    return rows.sparkSession.sql(
        f"""
        WITH fences AS (SELECT {keys} {fences_sql("CAST(v AS DOUBLE)", spread())} FROM {{counted}} GROUP BY ALL),
        valued AS (SELECT {keys} v, n, w, coalesce(CAST(v AS DOUBLE), 0D) AS d FROM {{counted}}),
        {slots_sql("valued", groups, len(spread()), True, few)},
        slots AS (SELECT {keys} slot, sum(n) AS slot_n, sum(w) AS slot_w FROM placed GROUP BY ALL),
        offsets AS (
            SELECT {keys} slot,
                sum(slot_n) OVER ({partition} ORDER BY slot DESC ROWS UNBOUNDED PRECEDING) - slot_n AS n_ahead,
                sum(slot_w) OVER ({partition} ORDER BY slot DESC ROWS UNBOUNDED PRECEDING) - slot_w AS w_ahead
            FROM slots),
        summed AS (
            SELECT *, sum(n) OVER (PARTITION BY {keys} slot ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS n_here,
                sum(w) OVER (PARTITION BY {keys} slot ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS w_here
            FROM placed)
        SELECT {"/*+ BROADCAST(offsets) */" if few else ""} {of_summed} v AS {value}, n AS n_rows, w AS weight,
            n_ahead + n_here - n AS rows_above, w_ahead + w_here - w AS weight_above
        FROM summed JOIN offsets ON {same_group("summed", "offsets", [*groups, "slot"])}
        """,
        counted=counted,
    )

"""Interval operators: events per user as a level over time, conversations as segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import epoch_double
from ..operators import intervals as iv
from . import fixture as fx
from .catalog import register

DAY, HOUR = 86400.0, 3600.0
KEY = "user_id"
# Seconds: shortest run, guard at each end, shortest cut, chunk length.
MIN_LEN, GUARD, MIN_CUT, WIDTH = 2 * HOUR, 900.0, 4 * HOUR, 2 * DAY
ORIGIN = 1704067200.0  # 2024-01-01 as epoch seconds


def series(spark, d):
    return fx.table(spark, d, "events").select(KEY, "event_id", epoch_double("ts").alias("t"), "value", "event_type")


def width(spark, d):
    """Two days, or less where a user has too many events for that."""
    return iv.chunk_width(series(spark, d), KEY, "t", WIDTH)


EVENTS = "e AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS DOUBLE) / CAST(1e6 AS DOUBLE) AS t, value, event_type FROM events)"


def thresholds(spark, d):
    return iv.adaptive_threshold(series(spark, d), KEY, "value")


THRESHOLD = EVENTS + """,
sorted AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM e WHERE value IS NOT NULL),
th AS (SELECT user_id, any_value(n) AS rows, max(value) FILTER (i = n // 20) AS floor_level,
  max(value) FILTER (i = CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT)) AS peak_level FROM sorted GROUP BY 1),
thr AS (SELECT *, greatest(floor_level + 25, peak_level - 30) AS threshold FROM th)"""
register("adaptive_threshold", thresholds, fx.oracle(THRESHOLD, "SELECT * FROM thr"))


def below_threshold(spark, d, **options):
    levels = series(spark, d).join(thresholds(spark, d).select(KEY, "threshold"), KEY)
    return iv.below_runs(levels, KEY, "t", F.col("value") < F.col("threshold"), tie="event_id", **options)


RUNS = THRESHOLD + """,
marked AS (SELECT user_id, event_id, t, value < threshold AS below,
  lead(t) OVER w AS next_t, coalesce(lag(value < threshold) OVER w, false) AS was FROM e JOIN thr USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
numbered AS (SELECT *, sum(CASE WHEN below AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM marked),
runs AS (SELECT user_id, run, min(t) AS start, arg_max(coalesce(next_t, t), t) AS "end", bool_or(next_t IS NULL) AS open_end
  FROM numbered WHERE below GROUP BY 1, 2)"""
register(
    "below_runs",
    lambda spark, d: below_threshold(spark, d, min_len=MIN_LEN, guard=GUARD, min_cut=MIN_CUT),
    fx.oracle(RUNS, f"""
SELECT user_id, start + {GUARD} AS start, CASE WHEN open_end THEN "end" ELSE "end" - {GUARD} END AS "end", open_end FROM runs
WHERE "end" - start >= {MIN_LEN} AND (open_end OR ("end" - {GUARD}) - (start + {GUARD}) > {MIN_CUT})"""),
)
register(
    "quiet_runs",
    lambda spark, d: below_threshold(spark, d, min_len=60.0, keep_trailing=False).drop("open_end"),
    fx.oracle(RUNS, """SELECT user_id, start, "end" FROM runs WHERE NOT open_end AND "end" - start >= 60"""),
)


def busy(spark, d):
    """Each event keeps its user busy for ten minutes per unit of value."""
    return series(spark, d).select(KEY, F.col("t").alias("start"), (F.col("t") + F.col("value") * F.lit(600.0)).alias("end"))


def merged(spark, d):
    return iv.merge_intervals(busy(spark, d), KEY)


MERGED = EVENTS + """,
b AS (SELECT user_id, t AS start, t + value * CAST(600 AS DOUBLE) AS "end" FROM e),
r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end") AS g FROM r),
merged AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY user_id, g)"""
register("merge_intervals", merged, fx.oracle(MERGED, "SELECT * FROM merged"))


def spans(spark, d):
    return series(spark, d).select(KEY).distinct().select(
        KEY, F.lit(ORIGIN).alias("origin"), F.lit(ORIGIN + 31 * DAY).alias("total")
    )


register(
    "keep_ranges",
    lambda spark, d: iv.keep_ranges(merged(spark, d), spans(spark, d), KEY),
    fx.oracle(MERGED, f"""
, p AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY user_id ORDER BY start), {ORIGIN}) AS prev FROM merged)
SELECT user_id, prev AS start, start AS "end" FROM p WHERE start > prev
UNION ALL SELECT user_id, max("end"), {ORIGIN + 31 * DAY} FROM merged GROUP BY 1"""),
)
register(
    "overlap_fraction",
    lambda spark, d: iv.overlap_fraction(
        series(spark, d).select(KEY, "event_id", (F.col("t") - HOUR).alias("start"), (F.col("t") + F.col("value") * F.lit(120.0)).alias("end")),
        iv.merge_intervals(busy(spark, d).filter(F.col("end") - F.col("start") > 6 * HOUR), KEY), KEY, width(spark, d),
    ).select(KEY, "event_id", "in_drop"),
    fx.oracle(EVENTS, f"""
, b AS (SELECT user_id, t AS start, t + value * CAST(600 AS DOUBLE) AS "end" FROM e WHERE (t + value * CAST(600 AS DOUBLE)) - t > {6 * HOUR}),
r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end") AS g FROM r),
drops AS (SELECT user_id, min(start) AS s, max("end") AS x FROM g GROUP BY user_id, g),
cuts AS (SELECT user_id, event_id, t - {HOUR} AS a, t + value * CAST(120 AS DOUBLE) AS b FROM e)
SELECT c.user_id, event_id, coalesce(bool_or(s IS NOT NULL AND least(b, x) - greatest(a, s) > 0.5 * (b - a)), false) AS in_drop
FROM cuts c LEFT JOIN drops d ON c.user_id = d.user_id AND s < b AND x > a GROUP BY 1, 2"""),
)
SNAP = 3 * HOUR
register(
    "nearest_snap",
    lambda spark, d: iv.nearest_snap(
        series(spark, d).filter(F.col("event_type") == "purchase").select(KEY, "event_id", "t"),
        below_threshold(spark, d, min_len=60.0, keep_trailing=False), KEY, "t", max(width(spark, d), SNAP), SNAP,
    ),
    fx.oracle(RUNS, f"""
, mids AS (SELECT user_id, (start + "end") / CAST(2 AS DOUBLE) AS mid FROM runs WHERE NOT open_end AND "end" - start >= 60),
p AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'purchase')
SELECT p.user_id, event_id, t, coalesce(arg_min(mid, {{'d': abs(mid - t), 'm': mid}}), t) AS snapped
FROM p LEFT JOIN mids m ON p.user_id = m.user_id AND abs(mid - t) < {SNAP} GROUP BY 1, 2, 3"""),
)
ANCHORS = [("opening", "the"), ("second", "in"), ("third", "on"), ("closing", "que")]
HITS = " UNION ALL ".join(
    f"SELECT conv_id, {i} AS i, '{name}' AS anchor, min(turn) AS start FROM conversations WHERE contains(lower(text), '{p}') GROUP BY 1"
    for i, (name, p) in enumerate(ANCHORS)
)
register(
    "anchor_ranges",
    lambda spark, d: iv.anchor_ranges(fx.table(spark, d, "conversations"), "conv_id", "turn", ANCHORS),
    f"""
WITH h AS ({HITS}), t AS (SELECT conv_id, max(turn) + 1 AS total FROM conversations GROUP BY 1),
l AS (SELECT *, lead(start) OVER w AS nxt, coalesce(start >= lag(start) OVER w, true) AS ok FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, anchor, start, coalesce(nxt, total) AS "end", bool_and(ok) OVER (PARTITION BY conv_id) AS in_order,
  count(*) OVER (PARTITION BY conv_id) = {len(ANCHORS)} AS complete FROM l JOIN t USING (conv_id)""",
)

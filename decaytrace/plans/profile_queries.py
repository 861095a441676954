"""Value sets, cardinality and code scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, profile, scoring
from . import fixture as fx
from .catalog import register

FEED, STAGED, MART, SCORED = fx.FEED_CTE, fx.STAGED_CTE, fx.MART_CTE, fx.SCORED_CTE
CODES = ["payment_type", "ratecode_id", "vendor_id", "store_and_fwd_flag"]

register(
    "profile_cardinality",
    lambda spark, d: profile.profile_cardinality(fx.feed(spark, d), "store_and_fwd_flag"),
    fx.oracle(FEED, """
SELECT feed_month, count(DISTINCT store_and_fwd_flag) AS distinct_values, count(*) AS rows,
  round(100.0 * sum(CASE WHEN store_and_fwd_flag IS NULL THEN 1 ELSE 0 END) / count(*), 4) AS null_pct
FROM feed GROUP BY 1"""),
)
register(
    "low_card_gate",
    lambda spark, d: profile.low_card_gate(fx.feed(spark, d), "vendor_id").unionByName(
        profile.low_card_gate(fx.feed(spark, d), "pu_location_id")
    ),
    fx.oracle(FEED, """
, v AS (SELECT feed_month, count(DISTINCT vendor_id) AS a, count(DISTINCT pu_location_id) AS b FROM feed GROUP BY 1)
SELECT 'vendor_id' AS "column", max(a) AS max_distinct, max(a) <= 50 AS is_categorical FROM v
UNION ALL SELECT 'pu_location_id', max(b), max(b) <= 50 FROM v"""),
)
register(
    "value_counts",
    lambda spark, d: profile.value_counts(fx.feed(spark, d), "store_and_fwd_flag"),
    fx.oracle(FEED, """
SELECT feed_month, CAST(store_and_fwd_flag AS VARCHAR) AS value, count(*) AS rows,
  (SELECT max(u) <= 50 FROM (SELECT count(DISTINCT store_and_fwd_flag) AS u FROM feed GROUP BY feed_month)) AS is_categorical
FROM feed GROUP BY 1, 2"""),
)
register(
    "value_sets",
    lambda spark, d: profile.value_sets(fx.feed(spark, d), "pu_location_id"),
    fx.oracle(FEED, """
SELECT DISTINCT feed_month, CAST(pu_location_id AS VARCHAR) AS value,
  (SELECT max(u) <= 50 FROM (SELECT count(DISTINCT pu_location_id) AS u FROM feed GROUP BY feed_month)) AS is_categorical
FROM feed WHERE pu_location_id IS NOT NULL"""),
)
FIRSTS = """
, counts AS (SELECT feed_month, CAST(vendor_id AS VARCHAR) AS value, count(*) AS rows FROM feed GROUP BY 1, 2)
, firsts AS (SELECT value, min(feed_month) AS first_seen, arg_min(rows, feed_month) AS rows_in_first_period,
  (SELECT max(u) <= 50 FROM (SELECT count(DISTINCT value) AS u FROM counts GROUP BY feed_month)) AS is_categorical
  FROM counts WHERE value IS NOT NULL GROUP BY 1)"""
register(
    "new_values",
    lambda spark, d: profile.new_values(fx.feed(spark, d), "vendor_id"),
    fx.oracle(FEED, FIRSTS + "SELECT * FROM firsts WHERE first_seen > (SELECT min(feed_month) FROM feed)"),
)
register(
    "new_values_events",
    lambda spark, d: profile.new_values(
        fx.table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "user_id", "day"
    ),
    """
WITH counts AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS value, count(*) AS rows FROM events GROUP BY 1, 2),
firsts AS (SELECT value, min(day) AS first_seen, arg_min(rows, day) AS rows_in_first_period,
  (SELECT max(u) <= 50 FROM (SELECT count(DISTINCT value) AS u FROM counts GROUP BY day)) AS is_categorical
  FROM counts WHERE value IS NOT NULL GROUP BY 1)
SELECT * FROM firsts WHERE first_seen > (SELECT min(day) FROM counts)""",
)
register(
    "first_period_count",
    lambda spark, d: profile.first_period_count(fx.feed(spark, d), "vendor_id"),
    fx.oracle(FEED, FIRSTS + "SELECT * FROM firsts"),
)
register(
    "known_so_far",
    lambda spark, d: profile.known_so_far(fx.feed(spark, d), "vendor_id"),
    fx.oracle(FEED, FIRSTS + """
, p AS (SELECT feed_month, count(*) FILTER (first_seen = feed_month) AS entered, bool_and(is_categorical) AS is_categorical
  FROM counts JOIN firsts USING (value) GROUP BY 1)
SELECT feed_month, entered, (SELECT count(*) FROM firsts WHERE first_seen <= feed_month) AS known, is_categorical FROM p"""),
)
register(
    "scan_codes",
    lambda spark, d: profile.scan_codes(fx.feed(spark, d), CODES),
    fx.oracle(FEED, ", codes AS (" + " UNION ALL ".join(
        f"SELECT feed_month, '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), 'None') AS code FROM feed" for c in CODES
    ) + """), counts AS (SELECT feed_month, "column", code, count(*) AS rows FROM codes GROUP BY ALL),
firsts AS (SELECT "column", code, min(feed_month) AS first_seen, arg_min(rows, feed_month) AS rows_in_first_period FROM counts GROUP BY ALL)
SELECT * FROM firsts f WHERE first_seen > (SELECT min(g.first_seen) FROM firsts g WHERE g."column" = f."column")"""),
)
register(
    "unseen_categories",
    lambda spark, d: profile.unseen_categories(
        fx.mart(spark, d), features.period_in(fx.mart(spark, d), fx.TRAIN_PERIODS), "vendor_id"
    ),
    fx.oracle(MART, f"""
SELECT vendor_id, count(*) AS rows, min(feed_month) AS first_seen FROM mart
WHERE vendor_id NOT IN (SELECT vendor_id FROM mart WHERE feed_month IN ({fx._in(fx.TRAIN_PERIODS)}))
GROUP BY 1"""),
)
register(
    "load_summary",
    lambda spark, d: profile.load_summary(fx.feed(spark, d), "vendor_id", fx.NEW_CODE),
    fx.oracle(FEED, "SELECT feed_month, count(*) AS rows, count(*) FILTER (vendor_id = 7) AS code_rows FROM feed GROUP BY 1"),
)
register(
    "share_of_feed",
    lambda spark, d: profile.share_of_feed(fx.staged(spark, d), "vendor_id", fx.NEW_CODE, "total_amount"),
    fx.oracle(STAGED, """
SELECT count(*) FILTER (vendor_id = 7) AS code_rows, count(*) AS all_rows,
  round(100.0 * count(*) FILTER (vendor_id = 7) / count(*), 3) AS pct_of_feed,
  round(sum(CASE WHEN vendor_id = 7 THEN total_amount ELSE 0 END), 2) AS code_gross FROM staged"""),
)
register(
    "segment_contrast",
    lambda spark, d: profile.segment_contrast(fx.staged(spark, d), "vendor_id"),
    fx.oracle(STAGED, """
SELECT vendor_id, count(*) AS trips, round(avg(trip_distance), 3) AS avg_miles, round(avg(total_amount), 3) AS avg_total,
  round(avg(fare_amount), 3) AS avg_fare, round(avg(tip_amount), 3) AS avg_tip,
  round(avg(total_amount / nullif(trip_distance, 0)), 3) AS avg_price_per_mile,
  round(avg(date_diff('minute', pickup_at, dropoff_at)), 2) AS avg_minutes
FROM staged GROUP BY 1"""),
)
register(
    "code_counts",
    lambda spark, d: profile.code_counts(features.period_eq(fx.feed(spark, d), "1999"), "vendor_id"),
    fx.oracle(FEED, "SELECT vendor_id, count(*) AS n FROM feed WHERE feed_month = '1999' GROUP BY 1 ORDER BY n DESC, 1"),
)
ALL_COLUMNS = [c for c in features.STAGED_COLUMNS if c not in ("feed_month", "pickup_at", "dropoff_at")]
register(
    "profile_all_columns",
    lambda spark, d: profile.profile_all_columns(fx.feed(spark, d), ALL_COLUMNS),
    fx.oracle(FEED, " UNION ALL ".join(
        f"SELECT feed_month, '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, count(*) AS rows, "
        f"round(100.0 * sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*), 4) AS null_pct FROM feed GROUP BY 1"
        for c in ALL_COLUMNS
    )),
)
register(
    "cardinality_vs_volume",
    lambda spark, d: profile.cardinality_vs_volume(fx.feed(spark, d), "trip_distance"),
    fx.oracle(FEED, """
, p AS (SELECT feed_month, count(DISTINCT trip_distance) AS distinct_values, count(*) AS rows FROM feed GROUP BY 1),
g AS (SELECT *, distinct_values / CAST(lag(distinct_values) OVER (ORDER BY feed_month) AS DOUBLE) AS dg,
  rows / CAST(lag(rows) OVER (ORDER BY feed_month) AS DOUBLE) AS rg FROM p)
SELECT feed_month, distinct_values, rows, round(dg, 6) AS distinct_growth, round(rg, 6) AS row_growth,
  dg > 1 AND dg > rg AS outpaces_rows FROM g"""),
)
register(
    "train_stats",
    lambda spark, d: scoring.train_stats(fx.mart(spark, d), fx.TRAIN_PERIODS, "vendor_id").select(
        "training_rows", F.array_join(F.col("categories").cast("array<string>"), ",").alias("categories")
    ),
    fx.oracle(MART, f"""
SELECT count(*) AS training_rows, (SELECT string_agg(CAST(vendor_id AS VARCHAR), ',' ORDER BY vendor_id)
  FROM (SELECT DISTINCT vendor_id FROM mart WHERE feed_month IN ({fx._in(fx.TRAIN_PERIODS)}))) AS categories
FROM mart WHERE feed_month IN ({fx._in(fx.TRAIN_PERIODS)})"""),
)

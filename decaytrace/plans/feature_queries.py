"""Projections, filters and scalar functions over the fare-shaped feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoding as enc, numbers, text, times
from ..operators import features, scoring
from . import fixture as fx
from .catalog import register

FEED, STAGED, MART, SCORED = fx.FEED_CTE, fx.STAGED_CTE, fx.MART_CTE, fx.SCORED_CTE
STAGED_LIST = ", ".join(features.STAGED_COLUMNS)


def word_sql(word):
    """A whole word whose neighbours are no letter, digit or underscore of any script."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"regexp_matches(text, '(^|{edge}){word}($|{edge})')"


def as_list(x):
    return x if isinstance(x, list) else [x]


def on_feed(name, columns, sql, cte=FEED, source="feed"):
    """A query that computes columns for every row of a view."""
    view = {"feed": fx.feed, "staged": fx.staged, "mart": fx.mart, "scored": fx.scored}[source]
    register(
        name,
        lambda spark, d: view(spark, d).select("trip_id", *as_list(columns())),
        fx.oracle(cte, f"SELECT trip_id, {sql} FROM {source}"),
    )


register("scan_feed", fx.feed, fx.oracle(FEED, f"SELECT trip_id, {STAGED_LIST} FROM feed"))
register(
    "stage_filter",
    lambda spark, d: features.stage_filter(fx.feed(spark, d)).select("trip_id", "vendor_id", "total_amount"),
    fx.oracle(STAGED, "SELECT trip_id, vendor_id, total_amount FROM staged"),
)
register("stage_project", fx.staged, fx.oracle(STAGED, f"SELECT trip_id, {STAGED_LIST}, trip_minutes FROM staged"))
register(
    "mart_features",
    fx.mart,
    fx.oracle(STAGED, fx.MART_SELECT.format(extra="")),
)
on_feed(
    "trip_minutes",
    lambda: times.minutes_between("pickup_at", "dropoff_at").alias("trip_minutes"),
    "date_diff('second', pickup_at, dropoff_at) / CAST(60 AS DOUBLE) AS trip_minutes",
)
on_feed(
    "diff_minutes",
    lambda: times.minute_boundaries("pickup_at", "dropoff_at").alias("diff_minutes"),
    "date_diff('minute', pickup_at, dropoff_at) AS diff_minutes",
)
on_feed(
    "avg_speed",
    lambda: enc.avg_speed("trip_distance", "trip_minutes").alias("avg_speed_mph"),
    "coalesce(trip_distance / nullif(trip_minutes / CAST(60 AS DOUBLE), 0), 0) AS avg_speed_mph",
    STAGED, "staged",
)
on_feed(
    "default_count",
    lambda: enc.default_count("passenger_count").alias("passenger_count"),
    "coalesce(passenger_count, 1) AS passenger_count",
)
on_feed("hour_part", lambda: times.hour_part("pickup_at").alias("pickup_hour"), "extract(hour FROM pickup_at) AS pickup_hour")
on_feed("dow_part", lambda: times.dow_part("pickup_at").alias("pickup_dow"), "extract(dow FROM pickup_at) AS pickup_dow")
on_feed(
    "one_hot_fixed",
    lambda: enc.one_hot_fixed("vendor_id", features.KNOWN_VENDORS),
    ", ".join(f"CASE WHEN vendor_id = {v} THEN 1 ELSE 0 END AS {n}" for n, v in features.KNOWN_VENDORS.items()),
)
on_feed(
    "one_hot_catchall",
    lambda: [
        enc.one_hot_catchall("vendor_id", [1, 2, 6]).alias("is_vendor_unknown"),
        enc.one_hot_catchall("store_and_fwd_flag", ["Y"]).alias("is_flag_unknown"),
        enc.one_hot_catchall("store_and_fwd_flag", ["Y"], nulls_as_unknown=True).alias("is_flag_unknown_or_null"),
    ],
    "CASE WHEN vendor_id NOT IN (1, 2, 6) THEN 1 ELSE 0 END AS is_vendor_unknown, "
    "CASE WHEN store_and_fwd_flag NOT IN ('Y') THEN 1 ELSE 0 END AS is_flag_unknown, "
    "CASE WHEN store_and_fwd_flag NOT IN ('Y') OR store_and_fwd_flag IS NULL THEN 1 ELSE 0 END AS is_flag_unknown_or_null",
)
on_feed(
    "flag_in",
    lambda: enc.flag_in("ratecode_id", features.AIRPORT_RATES).alias("is_airport_rate"),
    "CASE WHEN ratecode_id IN (2, 3) THEN 1 ELSE 0 END AS is_airport_rate",
)
on_feed(
    "flag_eq",
    lambda: enc.flag_eq("payment_type", 1).alias("is_card_payment"),
    "CASE WHEN payment_type = 1 THEN 1 ELSE 0 END AS is_card_payment",
)
on_feed(
    "extra_flag",
    lambda: [
        enc.extra_flag("vendor_id", fx.NEW_CODE).alias("is_new_code"),
        enc.extra_flag("store_and_fwd_flag", "Y").alias("is_stored"),
    ],
    "CAST(coalesce(vendor_id = 7, false) AS INTEGER) AS is_new_code, "
    "CAST(coalesce(store_and_fwd_flag = 'Y', false) AS INTEGER) AS is_stored",
)
register(
    "period_in",
    lambda spark, d: features.period_in(fx.mart(spark, d), fx.TRAIN_PERIODS).select("trip_id", "feed_month"),
    fx.oracle(MART, f"SELECT trip_id, feed_month FROM mart WHERE feed_month IN ({fx._in(fx.TRAIN_PERIODS)})"),
)
register(
    "period_eq",
    lambda spark, d: features.period_eq(fx.mart(spark, d), fx.SCORE_PERIOD).select("trip_id", "feed_month"),
    fx.oracle(MART, f"SELECT trip_id, feed_month FROM mart WHERE feed_month = '{fx.SCORE_PERIOD}'"),
)
register(
    "abs_error",
    lambda spark, d: fx.scored(spark, d).select(
        "trip_id",
        numbers.round_n(scoring.abs_error("predicted_total", "total_amount"), 6).alias("abs_error"),
        numbers.round_n(scoring.abs_error("control_predicted_total", "total_amount"), 6).alias("control_abs_error"),
    ),
    fx.oracle(SCORED, "SELECT trip_id, round(abs_error, 6) AS abs_error, round(control_abs_error, 6) AS control_abs_error FROM scored"),
)
on_feed(
    "price_per_mile",
    lambda: enc.price_per_unit("total_amount", "trip_distance").alias("price_per_mile"),
    "total_amount / nullif(trip_distance, 0) AS price_per_mile",
)
on_feed(
    "to_text",
    lambda: [
        F.col("vendor_id").cast("string").alias("vendor_text"),
        F.concat(F.col("payment_type").cast("string"), F.lit("%")).alias("share_text"),
    ],
    "CAST(vendor_id AS VARCHAR) AS vendor_text, CAST(payment_type AS VARCHAR) || '%' AS share_text",
)
on_feed(
    "round_n",
    lambda: [numbers.round_n("total_amount", n).alias(f"r{n}") for n in (2, 4, 6, 8)],
    ", ".join(f"round(total_amount, {n}) AS r{n}" for n in (2, 4, 6, 8)),
)


# ------------------------------------------------------------------ text columns of other tables

def safe_double_query(spark, d):
    """Text, integer, double and time columns; only castable types give numbers."""
    events = fx.table(spark, d, "events").withColumn("k_text", F.regexp_extract("props", r"[0-9]+", 0)).withColumn(
        "mixed", F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.col("k_text"))
    )
    types = {f.name: f.dataType for f in events.schema}
    return events.select(
        "event_id",
        *[
            numbers.safe_double(c, types[c]).alias(f"{c}_double")
            for c in ("mixed", "user_id", "value", "ts", "event_type")
        ],
    )


register(
    "safe_double",
    safe_double_query,
    """
SELECT event_id,
  TRY_CAST(CASE WHEN event_type = 'view' THEN event_type ELSE regexp_extract(props, '[0-9]+') END AS DOUBLE) AS mixed_double,
  TRY_CAST(user_id AS DOUBLE) AS user_id_double, value AS value_double,
  CAST(NULL AS DOUBLE) AS ts_double, TRY_CAST(event_type AS DOUBLE) AS event_type_double
FROM events""",
)
register(
    "parse_literal",
    lambda spark, d: fx.table(spark, d, "events")
    .withColumn("literal", F.when(F.col("event_type") == "click", F.regexp_extract("props", r"[0-9]+", 0)).otherwise(F.col("event_type")))
    .select("event_id", "literal", numbers.parse_literal("literal").alias("literal_int")),
    """
SELECT event_id, literal, TRY_CAST(CASE WHEN regexp_full_match(literal, '[+-]?[0-9]+') THEN literal END AS BIGINT) AS literal_int
FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN regexp_extract(props, '[0-9]+') ELSE event_type END AS literal FROM events)""",
)

# Entity names made from the keys of the sales tables, one of each known shape plus an unknown one.
URN_SQL = """
CASE p_size % 6
 WHEN 0 THEN 'urn:li:dataset:(urn:li:dataPlatform:dbt,shop.warehouse.main.part_' || p_partkey || ',PROD)'
 WHEN 1 THEN 'urn:li:mlFeature:(sales_features,part_' || p_partkey || ')'
 WHEN 2 THEN 'urn:li:mlFeatureTable:(urn:li:dataPlatform:duckdb,part_' || p_partkey || ')'
 WHEN 3 THEN 'urn:li:mlModel:(urn:li:dataPlatform:duckdb,part_' || p_partkey || ',PROD)'
 WHEN 4 THEN 'urn:li:dataProcessInstance:train_part_' || p_partkey
 ELSE p_name END"""


def named_parts(spark, d):
    return fx.table(spark, d, "part").withColumn("urn", F.expr(URN_SQL))


register(
    "urn_short",
    lambda spark, d: named_parts(spark, d).select("p_partkey", text.urn_short("urn").alias("label")),
    f"""
SELECT p_partkey, CASE
  WHEN urn LIKE 'urn:li:dataset:%' THEN coalesce(string_split(urn, ',')[2], urn)
  WHEN urn LIKE 'urn:li:mlFeature:%' THEN 'mlFeature: ' || string_split(rtrim(urn, ')'), ',')[-1]
  WHEN urn LIKE 'urn:li:mlFeatureTable:%' THEN 'mlFeatureTable: ' || string_split(rtrim(urn, ')'), ',')[-1]
  WHEN urn LIKE 'urn:li:mlModel:%' THEN 'mlModel: ' || coalesce(string_split(rtrim(urn, ')'), ',')[2], urn)
  WHEN urn LIKE 'urn:li:dataProcessInstance:%' THEN 'trainingRun: ' || string_split(urn, ':')[-1]
  ELSE urn END AS label
FROM (SELECT p_partkey, {URN_SQL} AS urn FROM part)""",
)
register(
    "urn_table_key",
    lambda spark, d: named_parts(spark, d).select("p_partkey", text.urn_table_key("urn").alias("table_key")),
    f"""
SELECT p_partkey, coalesce(array_to_string(string_split(string_split(urn, ',')[2], '.')[-2:], '.'), urn) AS table_key
FROM (SELECT p_partkey, {URN_SQL} AS urn FROM part)""",
)
register(
    "props_to_map",
    lambda spark, d: fx.table(spark, d, "part")
    .withColumn(
        "props",
        F.array(
            F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")),
            F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")),
            F.struct(F.col("p_type").alias("key"), F.col("p_name").alias("value")),
            F.struct(F.lit("size").alias("key"), F.lit("last").alias("value")),
        ),
    )
    .select("p_partkey", text.props_to_map("props").alias("m"))
    .select("p_partkey", F.explode("m").alias("key", "value")),
    """
SELECT p_partkey, unnest(['brand', 'size', p_type]) AS key, unnest([p_brand, 'last', p_name]) AS value FROM part""",
)
register(
    "csv_to_array",
    lambda spark, d: fx.table(spark, d, "documents").select(
        "doc_id", F.size(text.csv_to_array("text")).cast("bigint").alias("n_fields"),
        F.get(text.csv_to_array("text"), F.lit(0)).alias("first_field"),
    ),
    """
SELECT doc_id, len(f) AS n_fields, f[1] AS first_field
FROM (SELECT doc_id, list_filter(string_split(text, ','), lambda x: x <> '') AS f FROM documents)""",
)
register(
    "word_match",
    lambda spark, d: fx.table(spark, d, "documents").select(
        "doc_id", text.word_match("text", "the").alias("has_the"), text.word_match("text", "e.g").alias("has_eg"),
        text.word_match("text", "and").alias("has_and"),
    ),
    f"""
SELECT doc_id, {word_sql('the')} AS has_the, {word_sql('e[.]g')} AS has_eg, {word_sql('and')} AS has_and FROM documents""",
)
register(
    "preview_text",
    lambda spark, d: fx.table(spark, d, "documents").select("doc_id", text.preview_text("text").alias("preview")),
    r"""
SELECT doc_id, CASE WHEN length(flat) > 400 THEN substr(flat, 1, 400) || ' ...' ELSE flat END AS preview
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS flat FROM documents)""",
)

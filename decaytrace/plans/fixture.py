"""Fare-shaped views over the sales tables, in Spark and as SQL text for the oracle.

The published feed is derived row by row from the whole of ``orders`` and
``lineitem``. Category 7 appears part-way through history, has zero durations and
a different price level; some rows are impossible and some counts are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import features, monitors, scoring
from ..session import scratch_path
from ..sources import feeds, tables

NEW_CODE = 7
TRAIN_PERIODS = ("1995", "1996", "1997", "1998", "1999")
CONTROL_PERIODS = TRAIN_PERIODS + ("2000",)
SCORE_PERIOD = "2001"
ALL_PERIODS = CONTROL_PERIODS + (SCORE_PERIOD,)
# The period from which the published files carry one more code column.
TRIP_TYPE_SINCE = "1998"
# A period is stale when its latest pickup is more than a leap year after that of the period before.
MAX_GAP_SECONDS = 366 * 86400.0


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its footer is read once per process for the schema."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table, spread over the cores where its files give fewer tasks than that.

    Text work is bound by the processor. A table of many files has tasks enough
    and is read as it lies, without a shuffle.
    """
    df = table(spark, sf_dir, name)
    tasks = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def published_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("qty"), F.min("l_suppkey").alias("supp"))
    )
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    vendor = (
        F.when((F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (key % 61 == 0), NEW_CODE)
        .when(F.col("o_orderstatus") == "F", 1)
        .when(F.col("o_orderstatus") == "O", 2)
        .otherwise(6)
    )
    seconds = (
        F.when(F.col("VendorID") == NEW_CODE, 0).when(key % 499 == 0, -120).otherwise(60 + cust % 3000)
    )
    def plus(ts, secs):
        return ts + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))

    total = F.col("o_totalprice") / F.lit(900.0) * F.when(F.col("VendorID") == NEW_CODE, 0.6).otherwise(1.0)
    return (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("l_orderkey") == key)
        .withColumn("VendorID", vendor.cast("bigint"))
        .withColumn("tpep_pickup_datetime", plus(F.col("o_orderdate"), key % 86400))
        .select(
            key.alias("trip_id"),
            F.date_format("o_orderdate", "yyyy").alias("feed_month"),
            "VendorID",
            "tpep_pickup_datetime",
            plus(F.col("tpep_pickup_datetime"), seconds).alias("tpep_dropoff_datetime"),
            F.when(key % 6 != 0, (key % 6).cast("double")).alias("passenger_count"),
            F.when(key % 211 == 0, 0.0).otherwise(F.col("qty") / F.lit(10.0)).alias("trip_distance"),
            (1 + key % 6).cast("double").alias("RatecodeID"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Y")
            .when(F.col("o_orderpriority") != "5-LOW", "N").alias("store_and_fwd_flag"),
            (cust % 263 + 1).alias("PULocationID"),
            (F.col("supp") % 263 + 1).alias("DOLocationID"),
            (1 + cust % 4).alias("payment_type"),
            F.when(key % 97 == 0, -1.0).otherwise(F.col("o_totalprice") * F.lit(0.0008)).alias("fare_amount"),
            F.when(cust % 4 == 0, total * F.lit(0.1)).otherwise(0.0).alias("tip_amount"),
            total.alias("total_amount"),
        )
    )


def period_files(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    """The published feed as one folder of files per period; early ones lack ``trip_type``."""
    published = published_feed(spark, sf_dir).withColumn("trip_type", (1 + F.col("payment_type") % 2).cast("int"))
    root = scratch_path(spark, "published")
    early = F.coalesce(F.col("feed_month") < TRIP_TYPE_SINCE, F.lit(False))  # rows without a period are published too
    for name, part in {"early": published.filter(early).drop("trip_type"), "late": published.filter(~early)}.items():
        part.hint("rebalance", "feed_month").write.partitionBy("feed_month").parquet(f"{root}/{name}")
    return root, {p: f"{root}/{'early' if p < TRIP_TYPE_SINCE else 'late'}/feed_month={p}" for p in ALL_PERIODS}


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.scan_feed(published_feed(spark, sf_dir), keep=("trip_id", "feed_month"))


def written_feed(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """The feed as ``period_files`` wrote it: several passes over it join and sum up the lines only once."""
    schema = published_feed(spark, sf_dir).schema
    early, late = (spark.read.schema(schema).parquet(f"{root}/{part}") for part in ("early", "late"))
    return feeds.scan_feed(early.unionByName(late), keep=("trip_id", "feed_month"))


def staged(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    return features.stage(feed(spark, sf_dir) if source is None else source, keep=("trip_id",))


def mart(
    spark: SparkSession, sf_dir: str, encoder: features.Encoder = features.Encoder(), source: DataFrame | None = None
) -> DataFrame:
    return features.mart_features(staged(spark, sf_dir, source), encoder, keep=("trip_id",))


def source_layer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """The feed as written, and what its monitors measure besides values: pickups, and each published file's schema."""
    root, paths = period_files(spark, sf_dir)
    schemas = monitors.schema_rows(spark, paths)
    return written_feed(spark, sf_dir, root), {"time": "pickup_at", "max_gap_seconds": MAX_GAP_SECONDS, "schemas": schemas}


def derived_layer(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The mart as a written table, and what its monitors measure besides values; of the feed ``source`` if given."""
    path = scratch_path(spark, "mart")
    rows = tables.write_mart(mart(spark, sf_dir, source=source), path)
    schemas = monitors.schema_rows(spark, {p: f"{path}/feed_month={p}" for p in ALL_PERIODS})
    return rows, {"time": "pickup_at", "max_gap_seconds": MAX_GAP_SECONDS, "schemas": schemas}


def scored(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Both stand-in arms over the scored period, of the mart ``rows`` if given."""
    rows = mart(spark, sf_dir) if rows is None else rows
    flags = list(features.KNOWN_VENDORS)
    arms = {
        "predicted_total": scoring.GroupMeanArm(flags, TRAIN_PERIODS),
        "control_predicted_total": scoring.GroupMeanArm(flags + ["is_new_code"], CONTROL_PERIODS),
    }
    with_flag = rows.withColumn("is_new_code", features.enc.extra_flag("vendor_id", NEW_CODE))
    return scoring.score_arms(with_flag, arms, SCORE_PERIOD, target=features.TARGET).drop("is_new_code")


def served(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The predictions as a written table: what several evidence passes read."""
    return tables.write_predictions(scored(spark, sf_dir, rows), scratch_path(spark, "predictions"))


FEED_CTE = """
lines AS (
  SELECT l_orderkey, sum(l_quantity) AS qty, min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey
), coded AS (
  SELECT o.*, qty, supp,
    CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' AND o_orderkey % 61 = 0 THEN 7
         WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 6 END AS vendor_id
  FROM orders o JOIN lines ON l_orderkey = o_orderkey
), feed AS (
  SELECT o_orderkey AS trip_id, strftime(o_orderdate, '%Y') AS feed_month,
    CAST(vendor_id AS INTEGER) AS vendor_id,
    o_orderdate + to_seconds(o_orderkey % 86400) AS pickup_at,
    o_orderdate + to_seconds(o_orderkey % 86400) + to_seconds(
      CASE WHEN vendor_id = 7 THEN 0 WHEN o_orderkey % 499 = 0 THEN -120 ELSE 60 + o_custkey % 3000 END) AS dropoff_at,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 6 AS DOUBLE) END AS passenger_count,
    CASE WHEN o_orderkey % 211 = 0 THEN CAST(0 AS DOUBLE) ELSE qty / CAST(10 AS DOUBLE) END AS trip_distance,
    CAST(1 + o_orderkey % 6 AS DOUBLE) AS ratecode_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Y' WHEN o_orderpriority <> '5-LOW' THEN 'N' END AS store_and_fwd_flag,
    CAST(o_custkey % 263 + 1 AS INTEGER) AS pu_location_id,
    CAST(supp % 263 + 1 AS INTEGER) AS do_location_id,
    CAST(1 + o_custkey % 4 AS INTEGER) AS payment_type,
    CASE WHEN o_orderkey % 97 = 0 THEN CAST(-1 AS DOUBLE) ELSE o_totalprice * CAST(0.0008 AS DOUBLE) END AS fare_amount,
    CASE WHEN o_custkey % 4 = 0 THEN o_totalprice / CAST(900 AS DOUBLE)
         * CASE WHEN vendor_id = 7 THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * CAST(0.1 AS DOUBLE)
         ELSE CAST(0 AS DOUBLE) END AS tip_amount,
    o_totalprice / CAST(900 AS DOUBLE)
      * CASE WHEN vendor_id = 7 THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS total_amount
  FROM coded
)"""

STAGED_CTE = FEED_CTE + """, staged AS (
  SELECT *, date_diff('second', pickup_at, dropoff_at) / CAST(60 AS DOUBLE) AS trip_minutes
  FROM feed
  WHERE trip_distance BETWEEN 0.1 AND 100 AND total_amount BETWEEN 1 AND 500 AND fare_amount > 0
    AND pickup_at IS NOT NULL AND dropoff_at IS NOT NULL
)"""

MART_SELECT = """
  SELECT trip_id, pickup_at, feed_month, trip_distance, trip_minutes,
    coalesce(trip_distance / nullif(trip_minutes / CAST(60 AS DOUBLE), 0), 0) AS avg_speed_mph,
    coalesce(passenger_count, 1) AS passenger_count,
    extract(hour FROM pickup_at) AS pickup_hour, extract(dow FROM pickup_at) AS pickup_dow,
    pu_location_id, do_location_id,
    CASE WHEN vendor_id = 1 THEN 1 ELSE 0 END AS is_vendor_cmt,
    CASE WHEN vendor_id = 2 THEN 1 ELSE 0 END AS is_vendor_curb,
    CASE WHEN vendor_id = 6 THEN 1 ELSE 0 END AS is_vendor_myle,{extra}
    CASE WHEN ratecode_id IN (2, 3) THEN 1 ELSE 0 END AS is_airport_rate,
    CASE WHEN payment_type = 1 THEN 1 ELSE 0 END AS is_card_payment,
    vendor_id, total_amount
  FROM staged"""

MART_CTE = STAGED_CTE + ", mart AS (" + MART_SELECT.format(extra="") + ")"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SCORED_CTE = MART_CTE + f""", flagged AS (
  SELECT *, CASE WHEN vendor_id = 7 THEN 1 ELSE 0 END AS is_new_code FROM mart
), prod_means AS (
  SELECT is_vendor_cmt, is_vendor_curb, is_vendor_myle, avg(total_amount) AS m FROM flagged
  WHERE feed_month IN ({_in(TRAIN_PERIODS)}) GROUP BY ALL
), ctrl_means AS (
  SELECT is_vendor_cmt, is_vendor_curb, is_vendor_myle, is_new_code, avg(total_amount) AS m FROM flagged
  WHERE feed_month IN ({_in(CONTROL_PERIODS)}) GROUP BY ALL
), predicted AS (
  SELECT f.*,
    coalesce(p.m, (SELECT avg(total_amount) FROM flagged WHERE feed_month IN ({_in(TRAIN_PERIODS)}))) AS predicted_total,
    coalesce(c.m, (SELECT avg(total_amount) FROM flagged WHERE feed_month IN ({_in(CONTROL_PERIODS)}))) AS control_predicted_total
  FROM flagged f LEFT JOIN prod_means p USING (is_vendor_cmt, is_vendor_curb, is_vendor_myle)
  LEFT JOIN ctrl_means c USING (is_vendor_cmt, is_vendor_curb, is_vendor_myle, is_new_code)
  WHERE feed_month = '{SCORE_PERIOD}'
), scored AS (
  SELECT * EXCLUDE (is_new_code), abs(predicted_total - total_amount) AS abs_error,
    abs(control_predicted_total - total_amount) AS control_abs_error FROM predicted
)"""


def oracle(cte: str, body: str) -> str:
    return f"WITH {cte.strip()}\n{body.strip()}"

"""Sources, sinks and catalog, each over the whole derived feed or a given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, monitors, profile, runs
from ..session import scratch_path
from ..sources import feeds, records, registry, tables
from . import fixture as fx
from .catalog import register

FEED, STAGED, MART, SCORED = fx.FEED_CTE, fx.STAGED_CTE, fx.MART_CTE, fx.SCORED_CTE

PER_PERIOD = "SELECT feed_month, count(*) AS rows, CAST(sum(trip_id) AS DECIMAL(38,0)) AS id_sum, round(sum(total_amount), 2) AS total FROM {source} GROUP BY 1"


def per_period(df):
    return df.groupBy("feed_month").agg(
        F.count("*").alias("rows"), F.sum("trip_id").cast("decimal(38,0)").alias("id_sum"),
        (F.round(F.sum("total_amount") * 100.0) / 100.0).alias("total"),
    )


def tagged(spark, d):
    root, _ = fx.period_files(spark, d)
    return feeds.tag_period(spark, root, r"feed_month=([0-9]{4})").select("trip_id", "feed_month")


register("tag_period", tagged, fx.oracle(FEED, "SELECT trip_id, feed_month FROM feed"))
register(
    "union_periods",
    lambda spark, d: per_period(feeds.union_periods(spark, fx.period_files(spark, d)[1], keep=("trip_id",))),
    fx.oracle(FEED, PER_PERIOD.format(source="feed")),
)
TOLERANT = ["trip_type", "payment_type", "store_and_fwd_flag"]
register(
    "scan_tolerant",
    lambda spark, d: profile.code_counts_all(
        feeds.scan_tolerant(spark, fx.period_files(spark, d)[1], TOLERANT), TOLERANT, present="present_columns"
    ),
    fx.oracle(FEED, f"""
, codes AS (
  SELECT feed_month, 'trip_type' AS "column", CAST(1 + payment_type % 2 AS VARCHAR) AS code FROM feed WHERE feed_month >= '{fx.TRIP_TYPE_SINCE}'
  UNION ALL SELECT feed_month, 'payment_type', CAST(payment_type AS VARCHAR) FROM feed
  UNION ALL SELECT feed_month, 'store_and_fwd_flag', coalesce(store_and_fwd_flag, 'None') FROM feed)
SELECT feed_month, "column", code, count(*) AS rows FROM codes GROUP BY ALL"""),
)
register(
    "scan_codes_tolerant",
    lambda spark, d: profile.scan_codes(
        feeds.scan_tolerant(spark, fx.period_files(spark, d)[1], [*TOLERANT, "VendorID"]), [*TOLERANT, "VendorID"], present="present_columns"
    ),
    fx.oracle(FEED, """
, counts AS (SELECT feed_month, CAST(vendor_id AS VARCHAR) AS code, count(*) AS rows FROM feed GROUP BY ALL),
firsts AS (SELECT 'VendorID' AS "column", code, min(feed_month) AS first_seen, arg_min(rows, feed_month) AS rows_in_first_period FROM counts GROUP BY ALL)
SELECT * FROM firsts WHERE first_seen > (SELECT min(first_seen) FROM firsts)"""),
)
register(
    "monitor_schema",
    lambda spark, d: monitors.monitor_schema(monitors.schema_rows(spark, fx.period_files(spark, d)[1])),
    f"SELECT '{fx.TRIP_TYPE_SINCE}' AS feed_month, 'trip_type' AS \"column\", 'added' AS change, CAST(NULL AS VARCHAR) AS before, 'int' AS after",
)
register(
    "write_raw",
    lambda spark, d: per_period(tables.write_raw(fx.feed(spark, d), scratch_path(spark, "raw"))),
    fx.oracle(FEED, PER_PERIOD.format(source="feed")),
)
register(
    "write_mart",
    lambda spark, d: per_period(tables.write_mart(fx.mart(spark, d), scratch_path(spark, "mart"))),
    fx.oracle(MART, PER_PERIOD.format(source="mart")),
)


def written_view(spark, d):
    tables.staging_view(fx.staged(spark, d), "stg_trips")
    return per_period(spark.table("stg_trips"))


register(
    "staging_view", written_view,
    fx.oracle(STAGED, PER_PERIOD.format(source="staged")),
)


def predictions(spark, d):
    """Two scored periods written in turn; the second write leaves the first in place."""
    path = scratch_path(spark, "predictions")
    rows = fx.scored(spark, d).select(
        "trip_id", "pickup_at", "feed_month", "vendor_id", "trip_distance", "trip_minutes", "avg_speed_mph",
        *features.KNOWN_VENDORS, "total_amount", "predicted_total", "abs_error", "control_predicted_total", "control_abs_error",
    )
    tables.write_predictions(rows.withColumn("feed_month", F.lit("2001-trial")), path)
    return per_period(tables.write_predictions(rows, path))


register(
    "write_predictions", predictions,
    fx.oracle(SCORED, "SELECT p AS feed_month, count(*) AS rows, CAST(sum(trip_id) AS DECIMAL(38,0)) AS id_sum, "
              "round(sum(total_amount), 2) AS total FROM scored, (SELECT unnest(['2001', '2001-trial']) AS p) GROUP BY 1"),
)
register(
    "write_json",
    lambda spark, d: per_period(tables.write_json(fx.feed(spark, d), scratch_path(spark, "json"))),
    fx.oracle(FEED, PER_PERIOD.format(source="feed")),
)
register(
    "to_documents",
    lambda spark, d: tables.to_documents(fx.table(spark, d, "nation").join(fx.table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")),
    "SELECT '{\"c_custkey\":' || c_custkey || ',\"n_name\":\"' || n_name || '\",\"c_mktsegment\":\"' || c_mktsegment || '\"}' AS value "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey",
)


# ------------------------------------------------------------------ runs recorded as JSON

def recorded_runs(spark, d):
    """Conversations written as run documents and read back through the run schema."""
    path = scratch_path(spark, "runs")
    runs.as_run_records(fx.table(spark, d, "conversations")).write.json(path)
    return records.read_run_json(spark, path, multi_line=False)


register(
    "read_run_json",
    lambda spark, d: records.trace_steps(recorded_runs(spark, d)).select(
        "run_id", "index", "tool", F.col("arguments")["role"].alias("role"), "elapsed_ms", "result_preview"
    ),
    r"""
SELECT 'run-' || conv_id AS run_id, turn AS index,
  CASE role WHEN 'user' THEN 'profile_column' WHEN 'assistant' THEN 'catalog_search' ELSE 'model_context' END AS tool,
  role, length(text) AS elapsed_ms,
  CASE WHEN length(text) > 400 THEN substr(replace(text, chr(10), ' '), 1, 400) || ' ...' ELSE replace(text, chr(10), ' ') END AS result_preview
FROM conversations""",
)


# ------------------------------------------------------------------ catalogs and names

def part_catalog(spark, d):
    """One catalog document per part: a node whose columns are named by brand and type."""
    column = lambda t, i: F.struct(t.alias("type"), F.lit(i).cast("bigint").alias("index"))
    columns = F.create_map(
        F.col("p_brand"), column(F.lit("VARCHAR"), 1), F.col("p_type"), column(F.lit("BIGINT"), 2),
        F.lit("p_size"), column(F.col("p_size").cast("string"), 3),
    )
    nodes = F.create_map(F.concat(F.lit("model.shop.part_"), F.col("p_partkey")), F.struct(columns.alias("columns")))
    return fx.table(spark, d, "part").select(F.to_json(F.struct(nodes.alias("nodes"))).alias("document"))


register(
    "catalog_columns",
    lambda spark, d: records.catalog_columns(part_catalog(spark, d), "document"),
    """
SELECT 'model.shop.part_' || p_partkey AS node, unnest([p_brand, p_type, 'p_size']) AS "column",
  unnest(['VARCHAR', 'BIGINT', CAST(p_size AS VARCHAR)]) AS type, CAST(unnest([1, 2, 3]) AS BIGINT) AS index FROM part""",
)
REGISTRY = [
    (f"urn:li:dataset:(urn:li:dataPlatform:{platform},{prefix}{t},PROD)", t)
    for platform, prefix in (("dbt", "shop.warehouse."), ("duckdb", "warehouse."))
    for t in ("raw.orders", "raw.lineitem", "main.mart", "serving.predictions")
]
REQUEST_SQL = """
CASE o_orderpriority WHEN '1-URGENT' THEN 'urn:li:dataset:(urn:li:dataPlatform:duckdb,warehouse.raw.orders,PROD)'
 WHEN '2-HIGH' THEN 'main.mart' WHEN '3-MEDIUM' THEN 'line' WHEN '5-LOW' THEN 'predictions,PROD'
 ELSE 'unknown_' || o_orderstatus END"""
register(
    "resolve_dataset",
    lambda spark, d: fx.table(spark, d, "orders").withColumn("request", F.expr(REQUEST_SQL)).select(
        "o_orderkey", "request", registry.resolve_dataset("request", REGISTRY).alias("resolved")
    ),
    f"""
SELECT o_orderkey, request, CASE request WHEN 'urn:li:dataset:(urn:li:dataPlatform:duckdb,warehouse.raw.orders,PROD)' THEN 'raw.orders'
  WHEN 'main.mart' THEN 'main.mart' WHEN 'line' THEN 'raw.lineitem' WHEN 'predictions,PROD' THEN 'serving.predictions' END AS resolved
FROM (SELECT *, {REQUEST_SQL} AS request FROM orders)""",
)
LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
register(
    "list_columns",
    lambda spark, d: registry.list_columns(fx.table(spark, d, "lineitem")),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null_rows FROM lineitem" for c, t in LINE_TYPES.items()),
)
MERGES = [(("of", "the"), "of-the"), (("of", "the", "in"), "of the in"), (("und", "die"), "$und-die"), (("de", "la"), "de-la"), (("in", "the"), "in-the")]
FIXES = {"the": "THE", "die": "DIE", "le": "LE"}


def token_merge_sql():
    """The same replacements as nested regexp_replace calls."""
    x = r"' ' || regexp_replace(trim(text, E' \t\n\r'), '\s+', '  ', 'g') || ' '"
    runs_ = [("  ".join(run), joined) for run, joined in sorted(MERGES, key=lambda m: -len(m[0]))]
    x = f"regexp_replace({x}, ' ({'|'.join(r for r, _ in runs_)}) ', ' ' || chr(2) || '\\1' || chr(3) || ' ', 'gi')"
    for run, joined in runs_:
        target = joined.replace(" ", "' || chr(1) || '")
        x = f"regexp_replace({x}, chr(2) || '{run}' || chr(3), chr(2) || '{target}' || chr(3), 'gi')"
    for wrong, right in FIXES.items():
        x = f"regexp_replace({x}, ' [.,!?]*{wrong}[.,!?]* ', ' {right} ', 'gi')"
    x = f"replace(replace(replace({x}, chr(2), ''), chr(3), ''), chr(1), ' ')"
    return f"SELECT conv_id, turn, trim(regexp_replace({x}, '  +', ' ', 'g')) AS repaired FROM conversations"


register(
    "token_merge",
    lambda spark, d: fx.texts(spark, d, "conversations").select(
        "conv_id", "turn", text.token_merge("text", MERGES, FIXES).alias("repaired")
    ),
    token_merge_sql(),
)

"""Lineage over a metadata graph that is derived from the sales tables.

Every order, customer, supplier, nation and region is a dataset of the graph, and
each part is a model input whose raw columns are the line flags it was seen with.
A nation has two names, one per platform, as a table and its build node do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text
from ..operators import lineage, runs
from . import fixture as fx
from .catalog import register


def urn(name, key, platform="dbt", prefix="shop.warehouse.main."):
    head = f"urn:li:dataset:(urn:li:dataPlatform:{platform},{prefix}{name}_"
    return F.concat(F.lit(head), F.col(key).cast("string"), F.lit(",PROD)"))


def urn_sql(name, key, platform="dbt", prefix="shop.warehouse.main."):
    return f"('urn:li:dataset:(urn:li:dataPlatform:{platform},{prefix}{name}_' || {key} || ',PROD)')"


def edges(spark, d):
    t = lambda name: fx.table(spark, d, name)
    twin = {"platform": "duckdb", "prefix": "warehouse.main."}
    parts = [
        t("orders").select(urn("customer", "o_custkey").alias("src"), urn("order", "o_orderkey").alias("dst")),
        t("lineitem").select(urn("supplier", "l_suppkey").alias("src"), urn("order", "l_orderkey").alias("dst")),
        t("customer").select(urn("nation", "c_nationkey").alias("src"), urn("customer", "c_custkey").alias("dst")),
        t("supplier").select(urn("nation", "s_nationkey", **twin).alias("src"), urn("supplier", "s_suppkey").alias("dst")),
        t("nation").select(urn("region", "n_regionkey").alias("src"), urn("nation", "n_nationkey").alias("dst")),
        t("nation").select(urn("region", "n_regionkey").alias("src"), urn("nation", "n_nationkey", **twin).alias("dst")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def orders(spark, d):
    return fx.table(spark, d, "orders").select(urn("order", "o_orderkey").alias("dataset"))


def regions(spark, d):
    return fx.table(spark, d, "region").select(urn("region", "r_regionkey").alias("dataset"))


TWIN = ("duckdb", "warehouse.main.")
# The SQL walks over whole numbers, the kind of a node times KIND plus its key, and names it in the end.
KIND = 10**10
KINDS = {"order": (1, ()), "customer": (2, ()), "supplier": (3, ()), "nation": (4, ()), "twin": (5, TWIN), "region": (6, ())}


def node(kind, key):
    return f"CAST({KINDS[kind][0] * KIND} + {key} AS BIGINT)"


def name_sql(c):
    cases = " ".join(
        f"WHEN {number} THEN {urn_sql('nation' if kind == 'twin' else kind, f'({c} % {KIND})', *twin)}" for kind, (number, twin) in KINDS.items()
    )
    return f"CASE {c} // {KIND} {cases} END"


LINKS = f"""
links AS MATERIALIZED (
  SELECT DISTINCT {node('customer', 'o_custkey')} AS src, {node('order', 'o_orderkey')} AS dst FROM orders
  UNION ALL SELECT DISTINCT {node('supplier', 'l_suppkey')}, {node('order', 'l_orderkey')} FROM lineitem
  UNION ALL SELECT DISTINCT {node('nation', 'c_nationkey')}, {node('customer', 'c_custkey')} FROM customer
  UNION ALL SELECT DISTINCT {node('twin', 's_nationkey')}, {node('supplier', 's_suppkey')} FROM supplier
  UNION ALL SELECT DISTINCT {node('region', 'n_regionkey')}, {node('nation', 'n_nationkey')} FROM nation
  UNION ALL SELECT DISTINCT {node('region', 'n_regionkey')}, {node('twin', 'n_nationkey')} FROM nation
)"""
EDGES = LINKS + f""", edges AS (SELECT {name_sql('src')} AS src, {name_sql('dst')} AS dst FROM links)"""


def walk_sql(starts, near, far, output):
    """All levels (0 to 3) from ``starts`` moving from column ``near`` to column ``far``."""
    return LINKS + f""", l0 AS MATERIALIZED (SELECT DISTINCT id AS start, id AS spot FROM ({starts})),
l1 AS MATERIALIZED (SELECT DISTINCT start, {far} AS spot FROM l0 JOIN links ON spot = {near}),
l2 AS MATERIALIZED (SELECT DISTINCT start, {far} AS spot FROM l1 JOIN links ON spot = {near}),
l3 AS MATERIALIZED (SELECT DISTINCT start, {far} AS spot FROM l2 JOIN links ON spot = {near}),
seen AS MATERIALIZED (SELECT start, spot, CAST(min(hop) AS INTEGER) AS hop FROM (
  SELECT *, 0 AS hop FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) GROUP BY 1, 2),
visited AS (SELECT {name_sql('start')} AS start, {name_sql('spot')} AS dataset, hop FROM seen),
walk AS (SELECT {name_sql('start')} AS start, hop, {name_sql('spot')} AS dataset, {name_sql(far)} AS {output} FROM seen LEFT JOIN links ON spot = {near})"""


ORDERS_SQL = f"SELECT {node('order', 'o_orderkey')} AS id FROM orders"
REGIONS_SQL = f"SELECT {node('region', 'r_regionkey')} AS id FROM region"
UP = walk_sql(ORDERS_SQL, "dst", "src", "upstream")
DOWN = walk_sql(REGIONS_SQL, "src", "dst", "downstream")

register(
    "lineage_upstream",
    lambda spark, d: lineage.lineage_upstream(edges(spark, d), orders(spark, d)),
    fx.oracle(UP, "SELECT * FROM walk"),
)
register(
    "lineage_downstream",
    lambda spark, d: lineage.lineage_downstream(edges(spark, d), regions(spark, d)),
    fx.oracle(DOWN, "SELECT * FROM walk"),
)
register(
    "lineage_hops",
    lambda spark, d: lineage.lineage_hops(
        lineage.lineage_downstream(edges(spark, d), regions(spark, d), counted=True), "downstream"
    ),
    fx.oracle(DOWN, "SELECT start, hop, dataset, count(downstream) OVER (PARTITION BY start, hop, dataset) AS downstream_count, downstream FROM walk"),
)
KEY = "array_to_string(string_split(string_split({}, ',')[2], '.')[-2:], '.')"
register(
    "hop_dedupe",
    lambda spark, d: lineage.lineage_tables(edges(spark, d), orders(spark, d)),
    fx.oracle(UP, f"""
SELECT start, {KEY.format('dataset')} AS table_key,
  min_by(dataset, {{'hop': hop, 'dataset': dataset}}) AS dataset, max(hop) AS depth, count(DISTINCT dataset) AS siblings
FROM visited GROUP BY 1, 2""").replace("max(hop)", "CAST(max(hop) AS INTEGER)"),
)
register(
    "collapse_siblings",
    lambda spark, d: lineage.collapse_siblings(edges(spark, d)),
    fx.oracle(EDGES, f"SELECT DISTINCT {KEY.format('src')} AS src, {KEY.format('dst')} AS dst FROM edges"),
)
PATHS = LINKS + f""", steps AS MATERIALIZED (
  SELECT a.dst AS p0, a.src AS p1, b.src AS p2, c.src AS p3
  FROM ({ORDERS_SQL}) o JOIN links a ON a.dst = o.id JOIN links b ON b.dst = a.src JOIN links c ON c.dst = b.src
  WHERE c.src IN ({REGIONS_SQL})),
paths AS (SELECT {', '.join(f"{name_sql(f'p{k}')} AS p{k}" for k in range(4))} FROM steps)"""


def paths(spark, d):
    return lineage.lineage_paths_between(edges(spark, d), orders(spark, d), regions(spark, d))


register(
    "lineage_paths_between",
    lambda spark, d: paths(spark, d).withColumn("path", F.array_join("path", ";")),
    fx.oracle(PATHS, "SELECT p0 AS start, p3 AS target, CAST(4 AS INTEGER) AS nodes, p0 || ';' || p1 || ';' || p2 || ';' || p3 AS path FROM paths"),
)
register(
    "lineage_path_counts",
    lambda spark, d: lineage.lineage_path_counts(edges(spark, d), orders(spark, d), regions(spark, d)).withColumns(
        {c: F.col(c).cast("long") for c in ("shortest_paths", "paths")}
    ),
    fx.oracle(PATHS, f"""
SELECT {name_sql('p0')} AS start, {name_sql('p3')} AS target, CAST(3 AS INTEGER) AS hops, shortest_paths, shortest_paths AS paths
FROM (SELECT p0, p3, count(*) AS shortest_paths FROM steps GROUP BY p0, p3)"""),
)
register(
    "lineage_path",
    lambda spark, d: lineage.lineage_path(
        paths(spark, d), F.lit("r_name"), F.lit("is_new_region, avg_total"), F.lit("order_model")
    ).select("start", "path_text"),
    fx.oracle(PATHS, f"""
SELECT p0 AS start, {KEY.format('p3')} || '.r_name -> ' || {KEY.format('p2')} || ' -> ' || {KEY.format('p1')} || ' -> '
  || {KEY.format('p0')} || ' -> is_new_region, avg_total -> order_model' AS path_text FROM paths"""),
)

# ------------------------------------------------------------------ features and models

FEATURE_TABLE, PLATFORM = "sales_features", "duckdb"
FEATURES_DATASET = "urn:li:dataset:(urn:li:dataPlatform:dbt,shop.warehouse.main.part_features,PROD)"
ROOT_DATASET = "urn:li:dataset:(urn:li:dataPlatform:dbt,shop.warehouse.raw.lineitem,PROD)"


def part_features(spark, d):
    return fx.table(spark, d, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("feature"),
        F.lower(F.translate("p_brand", "#", "_")).alias("source_column"),
        F.col("p_name").alias("description"), F.col("p_type").alias("data_type"),
    )


def part_roots(spark, d):
    """Raw line flags a part was seen with, over all lines."""
    return (
        fx.table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").distinct()
        .select(
            F.concat(F.lit("part_"), F.col("l_partkey")).alias("feature"),
            F.concat(F.lit("flag_"), F.col("l_returnflag"), F.col("l_linestatus")).alias("root_column"),
        )
    )


def feature_models(spark, d):
    """Each market segment has a model that consumes the parts it buys."""
    lines = fx.table(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return (
        lines.join(fx.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.concat(F.lit("part_"), F.col("l_partkey")).alias("feature"), F.lower("c_mktsegment").alias("model"))
        .distinct()
    )


def cards(spark, d):
    return (
        fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.lower("c_mktsegment").alias("model"), "o_orderstatus")
        .agg(F.count("*").alias("n"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
        .groupBy("model")
        .agg(
            F.sum("n").alias("training_rows"),
            F.concat_ws(",", F.date_format(F.min("lo"), "yyyy"), F.date_format(F.max("hi"), "yyyy")).alias("training_periods"),
            F.array_join(F.array_sort(F.collect_list("o_orderstatus")), ",").alias("categories"),
        )
        .select("*", F.concat(F.lit("train_"), F.col("model")).alias("run_id"), F.lit("group_mean").alias("algorithm"),
                F.lit("1.0.0").alias("version"), F.lit("0.5").alias("in_sample_mae"))
    )


def root_map(spark, d):
    return lineage.feature_root_map(part_features(spark, d).select("feature", "source_column"), part_roots(spark, d))


def graph(spark, d):
    return lineage.emit_ml_nodes(
        part_features(spark, d), root_map(spark, d), cards(spark, d), feature_models(spark, d),
        FEATURE_TABLE, PLATFORM, FEATURES_DATASET, ROOT_DATASET,
    )


ML = f"""
features AS (SELECT 'part_' || p_partkey AS feature, lower(replace(p_brand, '#', '_')) AS source_column,
  p_name AS description, p_type AS data_type FROM part),
roots AS (SELECT DISTINCT 'part_' || l_partkey AS feature, 'flag_' || l_returnflag || l_linestatus AS root_column
  FROM lineitem),
root_map AS (SELECT feature, source_column, coalesce(root_column, source_column) AS root_column FROM features LEFT JOIN roots USING (feature)),
feature_models AS (SELECT DISTINCT 'part_' || l_partkey AS feature, lower(c_mktsegment) AS model
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
cards AS (SELECT lower(c_mktsegment) AS model, count(*) AS training_rows,
  strftime(min(o_orderdate), '%Y') || ',' || strftime(max(o_orderdate), '%Y') AS training_periods,
  array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS categories
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
named AS (SELECT *, 'urn:li:mlModel:(urn:li:dataPlatform:{PLATFORM},' || model || ',PROD)' AS model_urn,
  'urn:li:mlModelGroup:(urn:li:dataPlatform:{PLATFORM},' || model || ',PROD)' AS group_urn,
  'urn:li:dataProcessInstance:train_' || model AS run_urn FROM cards),
fnodes AS (SELECT 'urn:li:mlFeature:({FEATURE_TABLE},' || feature || ')' AS urn, feature AS name, description, data_type, source_column,
  (SELECT array_to_string(list_sort(list(root_column)), ',') FROM root_map r WHERE r.feature = f.feature) AS root_columns FROM features f),
nodes AS (
  SELECT urn, 'mlFeature' AS type, name FROM fnodes
  UNION ALL SELECT 'urn:li:mlFeatureTable:(urn:li:dataPlatform:{PLATFORM},{FEATURE_TABLE})', 'mlFeatureTable', '{FEATURE_TABLE}'
  UNION ALL SELECT run_urn, 'dataProcessInstance', model || ' training run' FROM named
  UNION ALL SELECT group_urn, 'mlModelGroup', model FROM named
  UNION ALL SELECT model_urn, 'mlModel', model FROM named)"""

register("feature_root_map", root_map, fx.oracle(ML, "SELECT * FROM root_map"))
register(
    "column_impact",
    lambda spark, d: lineage.column_impact(root_map(spark, d), feature_models(spark, d)),
    fx.oracle(ML, "SELECT root_column, feature, model, root_column || ' -> ' || feature || ' -> ' || model AS path FROM root_map JOIN feature_models USING (feature)"),
)
register(
    "emit_ml_nodes",
    lambda spark, d: graph(spark, d)[0].select(
        "urn", "type", "name",
        F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("props"),
    ),
    fx.oracle(ML, f"""
SELECT urn, 'mlFeature' AS type, name, 'data_type=' || data_type || ';description=' || description || ';root_columns=' || root_columns
  || ';root_dataset={ROOT_DATASET};source_column=' || source_column || ';source_dataset={FEATURES_DATASET}' AS props FROM fnodes
UNION ALL SELECT urn, type, name, 'feature_count=' || (SELECT count(*) FROM features) || ';source_dataset={FEATURES_DATASET}' FROM nodes WHERE type = 'mlFeatureTable'
UNION ALL SELECT run_urn, 'dataProcessInstance', model || ' training run', 'algorithm=group_mean;in_sample_mae=0.5;training_periods=' || training_periods || ';training_rows=' || training_rows FROM named
UNION ALL SELECT group_urn, 'mlModelGroup', model, 'members=1' FROM named
UNION ALL SELECT model_urn, 'mlModel', model, 'algorithm=group_mean;categories=' || categories
  || ';feature_table=urn:li:mlFeatureTable:(urn:li:dataPlatform:{PLATFORM},{FEATURE_TABLE});training_periods=' || training_periods || ';version=1.0.0' FROM named"""),
)
register(
    "emit_ml_edges",
    lambda spark, d: graph(spark, d)[1],
    fx.oracle(ML, f"""
SELECT '{FEATURES_DATASET}' AS src, urn AS dst, 'derived_from' AS kind FROM fnodes
UNION ALL SELECT urn, 'urn:li:mlFeatureTable:(urn:li:dataPlatform:{PLATFORM},{FEATURE_TABLE})', 'member_of' FROM fnodes
UNION ALL SELECT 'urn:li:mlFeature:({FEATURE_TABLE},' || feature || ')', model_urn, 'consumed_by' FROM feature_models JOIN named USING (model)
UNION ALL SELECT '{FEATURES_DATASET}', run_urn, 'input_of' FROM named
UNION ALL SELECT run_urn, model_urn, 'trained' FROM named
UNION ALL SELECT model_urn, group_urn, 'member_of' FROM named"""),
)
register(
    "model_context",
    lambda spark, d: lineage.model_context(*graph(spark, d)),
    fx.oracle(ML, """
SELECT model_urn AS urn, model AS name, '1.0.0' AS version, 'group_mean' AS algorithm, training_periods, categories, group_urn AS model_group,
  (SELECT count(*) FROM feature_models f WHERE f.model = n.model) AS features FROM named n"""),
)
register(
    "feature_context",
    lambda spark, d: lineage.feature_context(graph(spark, d)[0]).withColumn("root_columns", F.array_join("root_columns", ";")),
    fx.oracle(ML, f"""
SELECT urn, name, description, data_type, '{FEATURES_DATASET}' AS source_dataset, source_column,
  replace(root_columns, ',', ';') AS root_columns, '{ROOT_DATASET}' AS root_dataset FROM fnodes"""),
)
register(
    "list_models",
    lambda spark, d: lineage.list_models(graph(spark, d)[0]),
    fx.oracle(ML, "SELECT model_urn AS urn, model AS name FROM named"),
)
register(
    "search_nodes",
    lambda spark, d: lineage.search_nodes(graph(spark, d)[0], "mlFeature", "PART_1"),
    fx.oracle(ML, "SELECT * FROM nodes WHERE type = 'mlFeature' AND (contains(lower(name), 'part_1') OR contains(lower(urn), 'part_1'))"),
)
register(
    "search_nodes_page",
    lambda spark, d: lineage.search_nodes(graph(spark, d)[0], text="*", limit=50),
    fx.oracle(ML, "SELECT * FROM nodes ORDER BY urn LIMIT 50"),
)

# ------------------------------------------------------------------ runs

# Published prices per million tokens (input, output).
PRICES = {"gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60)}


def run_tokens(spark, d):
    """One run per conversation, its characters taken as tokens."""
    c = fx.table(spark, d, "conversations")
    size = F.length("text").cast("bigint")
    model = F.when(F.col("conv_id") % 3 == 0, "gpt-4o").when(F.col("conv_id") % 3 == 1, "gpt-4o-mini").otherwise("unlisted")
    return c.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") != "assistant", size).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col("role") == "assistant", size).otherwise(0)).alias("output_tokens"),
    ).withColumn("llm_model", model)


register(
    "run_cost",
    lambda spark, d: lineage.run_cost(run_tokens(spark, d), PRICES).withColumn("cost_usd", F.round(F.col("cost_usd") * 1e9)),
    """
WITH r AS (SELECT conv_id, CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS output_tokens,
  CASE conv_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'unlisted' END AS llm_model FROM conversations GROUP BY 1)
SELECT *, round(1e9 * (input_tokens / 1e6 * CASE llm_model WHEN 'gpt-4o' THEN 2.5 WHEN 'gpt-4o-mini' THEN 0.15 END
  + output_tokens / 1e6 * CASE llm_model WHEN 'gpt-4o' THEN 10.0 WHEN 'gpt-4o-mini' THEN 0.6 END)) AS cost_usd FROM r""",
)
register(
    "run_summary",
    lambda spark, d: runs.run_summary(runs.as_steps(fx.table(spark, d, "conversations")), "catalog_"),
    """
SELECT 'run-' || conv_id AS run_id, count(*) AS tool_calls, count(*) FILTER (role = 'assistant') AS prefixed_calls,
  count(DISTINCT turn) AS turns, CAST(sum(length(text)) AS BIGINT) AS elapsed_ms FROM conversations GROUP BY 1""",
)
register(
    "tool_counts",
    lambda spark, d: runs.tool_counts(runs.as_steps(fx.table(spark, d, "conversations"))),
    """
SELECT 'run-' || conv_id AS run_id, CASE role WHEN 'user' THEN 'profile_column' WHEN 'assistant' THEN 'catalog_search' ELSE 'model_context' END AS tool,
  count(*) AS calls FROM conversations GROUP BY 1, 2""",
)

"""Findings, incidents, claims, diagnosis, boosted-tree arms and the stream."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import attribution, claims, diagnose, features, ledger, scoring
from ..session import materialize
from ..streaming import monitors as streaming
from . import fixture as fx
from .catalog import register
from .evidence_queries import DID_SQL, DRIFT_SQL, FEED_RESHAPED, MART_RESHAPED, stale_sql, zero_sql
from .feature_queries import word_sql

FEED, STAGED, MART, SCORED = fx.FEED_CTE, fx.STAGED_CTE, fx.MART_CTE, fx.SCORED_CTE

# ------------------------------------------------------------------ findings, one per document


def findings(spark, d):
    even = F.col("doc_id") % 2 == 0
    rows = F.col("n_chars")
    return fx.table(spark, d, "documents").select(
        "doc_id",
        F.lit("order_model").alias("model"), F.col("source").alias("dataset"), F.col("lang").alias("column"),
        F.col("text").alias("headline"),
        F.concat(F.lit("seen in "), F.col("source")).alias("change"),
        F.when(even, F.concat(F.lit("via "), F.col("lang"))).alias("mechanism"),
        F.lit("shape did not move").alias("why_missed"), F.lit("encode it").alias("fix"),
        F.array("lang", "source").alias("features"), F.array("lang").alias("proven"),
        F.array("source", "lang").alias("inferred"),
        F.struct(
            rows.alias("affected_rows"), F.lit(0.5).alias("naive_mae_per_row"), (rows * F.lit(0.5)).alias("naive_amount"),
            F.when(even, 0.25).alias("did_mae_per_row"), F.when(even, rows * F.lit(0.25)).alias("did_amount"),
        ).alias("impact"),
    )


NL2 = "chr(10) || chr(10)"
AMOUNT = "n_chars * CASE WHEN doc_id % 2 = 0 AND n_chars <> 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END"
PER_ROW = "CASE WHEN doc_id % 2 = 0 THEN '0.2500' ELSE '0.5000' END"
register(
    "incident_rows",
    lambda spark, d: ledger.incident_rows(findings(spark, d)),
    f"""
SELECT source AS dataset, 'CUSTOM' AS incident_type, 'Semantic drift' AS custom_type, text AS title,
  source || '.' || lang || ' -> order_model: ' || format('{{:,.2f}}', {AMOUNT}) || ' = ' || format('{{:,}}', n_chars) || ' rows x ' || {PER_ROW}
  || {NL2} || '## What changed' || chr(10) || 'seen in ' || source
  || {NL2} || '## How it does damage' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'via ' || lang ELSE '' END
  || {NL2} || '## Silence of the monitors' || chr(10) || 'shape did not move' || {NL2} || '## Remedy' || chr(10) || 'encode it'
  || {NL2} || '## Damaged inputs' || chr(10) || '- ' || lang || chr(10) || '- ' || source || {NL2} || '## Measured' || chr(10) || '- ' || lang
  || {NL2} || '## Concluded' || chr(10) || '- ' || source || chr(10) || '- ' || lang AS description,
  {AMOUNT} AS amount, 'HIGH' AS priority, 'ACTIVE' AS state
FROM documents""",
)
register(
    "finding_document",
    lambda spark, d: ledger.finding_document(findings(spark, d), trace=F.concat_ws(" | ", "doc_id", "column")),
    f"""
SELECT source AS dataset, lang AS "column", 'Root cause: ' || lang AS title,
  '# ' || text || {NL2} || '## Cause' || chr(10) || source || '.' || lang || {NL2} || 'seen in ' || source
  || {NL2} || '## Mechanism' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'via ' || lang ELSE '' END
  || {NL2} || '## Proven' || chr(10) || '- ' || lang || {NL2} || '## Inferred' || chr(10) || '- ' || source || chr(10) || '- ' || lang
  || {NL2} || '## Trace' || chr(10) || doc_id || ' | ' || lang AS content
FROM documents""",
)

# ------------------------------------------------------------------ incident ledger, one row per order


def incidents(spark, d):
    """Earlier orders are the ledger; orders of the scored period are the new incidents."""
    o = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("incident_id"), F.concat(F.lit("customer_"), F.col("o_custkey")).alias("dataset"),
        F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("title"),
        F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("ACTIVE").alias("state"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
    )
    old = o.filter(F.col("year") < fx.SCORE_PERIOD).drop("year")
    return old, o.filter(F.col("year") == fx.SCORE_PERIOD).drop("year").withColumn("state", F.lit("ACTIVE"))


INCIDENTS = f"""
o AS (SELECT o_orderkey AS incident_id, 'customer_' || o_custkey AS dataset, o_orderpriority || ' ' || o_orderkey AS title,
  CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'ACTIVE' END AS state, strftime(o_orderdate, '%Y') AS year FROM orders),
old AS (SELECT * EXCLUDE (year) FROM o WHERE year < '{fx.SCORE_PERIOD}'),
fresh AS (SELECT incident_id, dataset, title, 'ACTIVE' AS state FROM o WHERE year = '{fx.SCORE_PERIOD}'),
superseded AS (SELECT incident_id, dataset, title, CASE WHEN state = 'ACTIVE' AND dataset IN (SELECT dataset FROM fresh) THEN 'RESOLVED' ELSE state END AS state FROM old
  UNION ALL SELECT * FROM fresh)"""
register(
    "supersede_incidents",
    lambda spark, d: ledger.supersede_incidents(*incidents(spark, d)),
    fx.oracle(INCIDENTS, "SELECT * FROM superseded"),
)
register(
    "ledger_state",
    lambda spark, d: ledger.ledger_state(ledger.supersede_incidents(*incidents(spark, d)), by=("dataset",)),
    fx.oracle(INCIDENTS, """
SELECT dataset, count(*) AS total, count(*) FILTER (state = 'ACTIVE') AS active, count(*) FILTER (state = 'RESOLVED') AS resolved
FROM superseded GROUP BY 1"""),
)


def part_catalog(spark, d):
    return fx.table(spark, d, "part").select(
        F.col("p_brand").alias("dataset"), F.concat(F.lit("part_"), F.col("p_partkey")).alias("column"),
        F.col("p_name").alias("description"), "p_size",
    )


LINES_A_TASK = 500_000


def part_notes(spark, d):
    """Parts of size 25 and more are the damaged columns; their suppliers the features."""
    catalog = part_catalog(spark, d)
    damaged = catalog.filter(F.col("p_size") >= 25).select(
        "dataset", "column", F.concat(F.lit("size is "), F.col("p_size"), F.lit(".")).alias("change")
    )
    lines = fx.table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    tasks = max(1, math.ceil(lines.count() / LINES_A_TASK))  # a count of the files' footers
    # numbers are made distinct and joined, names are put together in the end
    pairs = lines.repartition(tasks, "l_partkey").distinct()
    fed = fx.table(spark, d, "part").join(pairs, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_brand").alias("dataset"), F.concat(F.lit("part_"), F.col("l_partkey")).alias("column"),
        F.concat(F.lit("supplier_"), F.col("l_suppkey")).alias("feature"),
    )
    return ledger.annotate_column(catalog.drop("p_size"), damaged, fed, tasks)


NOTES = """
listed AS (SELECT 'part_' || l_partkey AS "column", count(DISTINCT l_suppkey) || ': ' || array_to_string(list_sort(list(DISTINCT 'supplier_' || l_suppkey)), ', ') AS f FROM lineitem GROUP BY 1),
notes AS (SELECT p_brand AS dataset, 'part_' || p_partkey AS "column", p_name || CASE WHEN p_size >= 25 THEN chr(10) || chr(10) || '[decay] size is ' || p_size || '.'
  || coalesce(' Feeds ' || f || '.', '') ELSE '' END AS description FROM part LEFT JOIN listed ON "column" = 'part_' || p_partkey)"""
register("annotate_column", part_notes, fx.oracle(NOTES, "SELECT * FROM notes"))
register(
    "annotated_columns",
    lambda spark, d: ledger.annotated_columns(part_notes(spark, d)),
    fx.oracle(NOTES, """SELECT dataset, "column", contains(description, '[decay]') AS has_finding FROM notes WHERE length(description) > 0"""),
)


def purge(spark, d):
    """Marked incidents resolved, marked documents dropped, notes restored: kept rows of each."""
    old, new = incidents(spark, d)
    resolved = ledger.resolve_marked(old.unionByName(new), "URGENT").select(
        F.lit("incident").alias("kind"), F.col("incident_id").cast("string").alias("id"), F.col("state").alias("value")
    )
    titled = fx.table(spark, d, "documents").withColumn("title", F.get(F.split("text", "\n"), F.lit(0)))
    documents = ledger.drop_marked(titled, "Th").select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("title").alias("value")
    )
    originals = part_catalog(spark, d).drop("p_size")
    notes = ledger.restore_notes(part_notes(spark, d), originals).select(
        F.lit("note").alias("kind"), F.col("column").alias("id"), F.col("description").alias("value")
    )
    return resolved.unionByName(documents).unionByName(notes)


register(
    "purge_marked", purge,
    fx.oracle(INCIDENTS, """
SELECT 'incident' AS kind, CAST(incident_id AS VARCHAR) AS id, CASE WHEN contains(title, 'URGENT') THEN 'RESOLVED' ELSE state END AS value
FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh)
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), string_split(text, chr(10))[1] FROM documents WHERE NOT starts_with(string_split(text, chr(10))[1], 'Th')
UNION ALL SELECT 'note', 'part_' || p_partkey, p_name FROM part"""),
)

# ------------------------------------------------------------------ claims over document texts

SPELLINGS = {
    "english article": ["The ", " the "], "french article": [" le ", " la "], "german article": [" der ", " die "],
    "licence": ["License", "licence", "Copyright"], "never said": ["zzzzqqqq"],
}
BANNED = {
    "doubled the": r"(^|[ .,])the the([ .,]|$)", "address": r"[a-z0-9.]+@[a-z0-9]+\.[a-z]{2,}", "of and": r"(^| )of +(and|the)( |$)",
}
STARTS, PARTS = ("in ", "is "), ("with the", " es ")


def contains_sql(forms):
    return " OR ".join(f"contains(text, '{s}')" for s in forms)


register(
    "claims_cited",
    lambda spark, d: claims.claims_cited(fx.texts(spark, d, "documents"), SPELLINGS),
    " UNION ALL ".join(f"SELECT '{label}' AS label, doc_id FROM documents WHERE {contains_sql(forms)}" for label, forms in SPELLINGS.items()),
)
register(
    "claims_summary",
    lambda spark, d: claims.claims_summary(fx.texts(spark, d, "documents"), SPELLINGS),
    " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) FILTER ({contains_sql(forms)}) AS documents FROM documents" for label, forms in SPELLINGS.items()),
)
register(
    "claims_banned",
    lambda spark, d: claims.claims_banned(fx.texts(spark, d, "documents"), BANNED, STARTS, PARTS),
    r"""
WITH a AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM a),
k AS (SELECT *, lower(trim(line)) AS low FROM l),
ok AS (SELECT * FROM k WHERE NOT (starts_with(low, 'in ') OR starts_with(low, 'is ') OR contains(low, 'with the') OR contains(low, ' es ')))
""" + " UNION ALL ".join(f"SELECT '{label}' AS label, doc_id, line_no FROM ok WHERE regexp_matches(line, '{p}')" for label, p in BANNED.items()),
)
register(
    "claims_arith",
    lambda spark, d: claims.claims_arith(
        fx.table(spark, d, "lineitem").select(
            "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("per_row"),
            F.col("l_quantity").cast("bigint").alias("rows"),
            (F.col("l_extendedprice") + F.when(F.col("l_discount") > 0.05, 2.0).otherwise(0.0)).alias("total"),
        ), "per_row", "rows", "total",
    ).select("l_orderkey", "l_linenumber", "computed", "reconciles"),
    """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity * CAST(l_quantity AS BIGINT), 2) AS computed,
  abs(round(l_extendedprice / l_quantity * CAST(l_quantity AS BIGINT), 2)
    - (l_extendedprice + CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END)) < 1.0 AS reconciles FROM lineitem""",
)
NAMED, ROOT = ["the", "with", "thing", "und"], "in"
LOCATE = ("SELECT doc_id, CAST(" + " + ".join(f"CAST({word_sql(w)} AS INTEGER)" for w in [*NAMED, ROOT])
          + " AS INTEGER) AS score FROM documents")
register(
    "locate_transformation",
    lambda spark, d: claims.locate_transformation(fx.texts(spark, d, "documents"), NAMED, ROOT, "doc_id"),
    f"SELECT * FROM ({LOCATE}) WHERE score > 0",
)
register(
    "best_transformation",
    lambda spark, d: claims.best_transformation(
        claims.locate_transformation(fx.texts(spark, d, "documents"), NAMED, ROOT, "doc_id"), "doc_id"
    ),
    f"SELECT * FROM ({LOCATE}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 1",
)

# ------------------------------------------------------------------ diagnosis and report

CODE_COLUMNS = ["vendor_id", "payment_type", "store_and_fwd_flag"]
ROOTS = [(f, "vendor_id") for f in features.KNOWN_VENDORS] + [
    (f, c) for f, cs in {"avg_speed_mph": ["trip_distance", "pickup_at", "dropoff_at"], "trip_minutes": ["pickup_at", "dropoff_at"]}.items() for c in cs
]


def diagnosis(spark, d):
    roots = spark.createDataFrame(ROOTS, "feature string, root_column string")
    return diagnose.diagnose(fx.feed(spark, d), fx.served(spark, d), CODE_COLUMNS, features.FEATURES, roots)


register(
    "diagnose",
    lambda spark, d: diagnosis(spark, d).select(
        "rank", "column", "code", "first_seen", "rows_in_first_period", "unmapped_category",
        F.array_join("collapsed_inputs", ",").alias("collapsed_inputs"),
        F.array_join("affected_features", ",").alias("affected_features"),
        "affected_rows", "did_amount", "signals", "defines_damage", "confirmed_by_lineage",
    ),
    fx.oracle(SCORED, DRIFT_SQL + DID_SQL + f"""
, counts AS (SELECT feed_month, vendor_id, count(*) AS rows FROM feed GROUP BY ALL),
firsts AS (SELECT vendor_id AS segment, min(feed_month) AS first_seen, arg_min(rows, feed_month) AS rows_in_first_period FROM counts GROUP BY 1),
fresh AS (SELECT * FROM firsts WHERE first_seen > (SELECT min(first_seen) FROM firsts)),
signal AS (SELECT segment, {zero_sql('fam')} AS unmapped, fam,
  list_filter(degenerate, lambda x: NOT list_contains(ref_degenerate, x)) AS only_here FROM flat, ref, fam),
found AS (SELECT fresh.*, coalesce(unmapped, false) AS unmapped, did.did_amount, did.affected_rows,
  list_filter(only_here, lambda x: NOT list_contains(fam, x)) AS collapsed,
  list_sort(list_distinct(list_concat(only_here, CASE WHEN unmapped THEN fam ELSE [] END))) AS affected
  FROM fresh JOIN signal USING (segment) JOIN did USING (segment)),
judged AS (SELECT *, CAST(unmapped AS INTEGER) + CAST(len(collapsed) > 0 AS INTEGER) AS signals FROM found)
SELECT CAST(1 AS INTEGER) AS rank, 'vendor_id' AS "column", CAST(segment AS VARCHAR) AS code, first_seen, rows_in_first_period,
  unmapped AS unmapped_category, array_to_string(list_sort(collapsed), ',') AS collapsed_inputs,
  array_to_string(affected, ',') AS affected_features, affected_rows, did_amount, signals,
  did_amount > 0 AND signals > 0 AS defines_damage,
  CAST(len(list_filter(affected, lambda x: x IN ('is_vendor_cmt', 'is_vendor_curb', 'is_vendor_myle'))) AS BIGINT) AS confirmed_by_lineage
FROM judged"""),
)
register(
    "incidents_from_diagnosis",
    lambda spark, d: ledger.incident_rows(
        diagnose.as_findings(diagnosis(spark, d), "order_model", "raw.orders")
    ).select("dataset", "title", "amount", "state"),
    fx.oracle(SCORED, """
, g AS (SELECT count(*) AS n, round(avg(abs_error) - avg(control_abs_error), 4) AS naive FROM scored WHERE vendor_id = 7),
r AS (SELECT round(avg(abs_error) - avg(control_abs_error), 6) AS lift FROM scored WHERE vendor_id <> 7)
SELECT 'raw.orders' AS dataset, 'vendor_id 7 appeared in ' || (SELECT min(feed_month) FROM feed WHERE vendor_id = 7) AS title,
  round(round(naive - lift, 4) * n, 2) AS amount, 'ACTIVE' AS state FROM g, r"""),
)


def results(spark, d):
    source, measured = fx.source_layer(spark, d)
    derived, options = fx.derived_layer(spark, d, source)
    return diagnose.results_tables(
        source, derived, fx.served(spark, d, derived), "vendor_id", fx.NEW_CODE, "avg_speed_mph",
        ["trip_distance", "trip_minutes", "avg_speed_mph", *features.KNOWN_VENDORS],
        source_options=measured, derived_options=options,
    )


register(
    "results_tables", results,
    fx.oracle(SCORED, """
, vs AS (SELECT feed_month, string_agg(CAST(vendor_id AS VARCHAR), ', ' ORDER BY CAST(vendor_id AS VARCHAR)) AS a FROM (SELECT DISTINCT feed_month, vendor_id FROM feed) GROUP BY 1),
seven AS (SELECT min(feed_month) AS fm FROM feed WHERE vendor_id = 7),
n7 AS (SELECT count(*) AS n FROM feed, seven WHERE vendor_id = 7 AND feed_month = fm),
ms AS (SELECT feed_month, count(*) AS row_volume, 100.0 * sum(CASE WHEN vendor_id IS NULL THEN 1 ELSE 0 END) / count(*) AS np, count(DISTINCT vendor_id) AS u,
  count(*) FILTER (vendor_id = 0) AS z, count(*) FILTER (vendor_id < 0) AS neg FROM feed GROUP BY 1),
md AS (SELECT feed_month, count(*) AS row_volume, 100.0 * sum(CASE WHEN avg_speed_mph IS NULL THEN 1 ELSE 0 END) / count(*) AS np, count(DISTINCT avg_speed_mph) AS u,
  count(*) FILTER (avg_speed_mph = 0) AS z, count(*) FILTER (avg_speed_mph < 0) AS neg FROM mart GROUP BY 1),
both_layers AS (SELECT 's' AS layer, *, CAST(""" + FEED_RESHAPED + """ AS INTEGER) AS reshaped, CAST(""" + stale_sql("feed") + """ AS INTEGER) AS stale FROM ms
  UNION ALL SELECT 'd', *, CAST(""" + MART_RESHAPED + """ AS INTEGER), CAST(""" + stale_sql("mart") + """ AS INTEGER) FROM md),
w AS (SELECT *, max(u) OVER e AS pu, max(z) OVER e AS pz FROM both_layers WINDOW e AS (PARTITION BY layer ORDER BY feed_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT layer, unnest(['freshness', 'volume', 'null_count', 'schema', 'empty_count', 'negative_count', 'unique_count', 'zero_count']) AS monitor,
  unnest([max(stale) = 1, (max(row_volume) - min(row_volume)) / CAST(max(row_volume) AS DOUBLE) > 0.5, max(np) > 1, max(reshaped) = 1, false, max(neg) > 0,
    coalesce(bool_or(u > pu), false), coalesce(bool_or(z > pz), false)]) AS fires FROM w GROUP BY layer),
seg AS (SELECT vendor_id, count(*) AS n, round(avg(abs_error), 4) AS p, round(avg(control_abs_error), 4) AS c, sum(total_amount) AS t,
  round(avg(abs_error) - avg(control_abs_error), 4) AS naive, round(sum(abs_error - control_abs_error), 2) AS na,
  list_filter([CASE WHEN round(stddev_pop(trip_distance), 8) = 0 THEN 'trip_distance' END, CASE WHEN round(stddev_pop(trip_minutes), 8) = 0 THEN 'trip_minutes' END,
    CASE WHEN round(stddev_pop(avg_speed_mph), 8) = 0 THEN 'avg_speed_mph' END, 'is_vendor_cmt', 'is_vendor_curb', 'is_vendor_myle'], lambda x: x IS NOT NULL) AS flat
  FROM scored GROUP BY 1),
lift AS (SELECT round(avg(abs_error) - avg(control_abs_error), 6) AS l FROM scored WHERE vendor_id <> 7)
SELECT 'values' AS section, feed_month AS key, a, CASE WHEN feed_month = fm THEN '7' END AS b, CASE WHEN feed_month = fm THEN CAST(n AS VARCHAR) END AS c, CAST(NULL AS VARCHAR) AS d FROM vs, seven, n7
UNION ALL SELECT 'monitors', monitor, max(CASE WHEN layer = 's' THEN CASE WHEN fires THEN 'FIRES' ELSE 'silent' END END),
  max(CASE WHEN layer = 'd' THEN CASE WHEN fires THEN 'FIRES' ELSE 'silent' END END), NULL, NULL FROM v GROUP BY monitor
UNION ALL SELECT 'zero_share', feed_month, CAST(z AS VARCHAR), format('{:,.4f}', 100.0 * z / row_volume), NULL, NULL FROM md
UNION ALL SELECT 'segments', CAST(vendor_id AS VARCHAR), CAST(n AS VARCHAR), format('{:,.4f}', p), format('{:,.4f}', c), array_to_string(flat, ', ') FROM seg
UNION ALL SELECT 'impact', '7', CAST(n AS VARCHAR), format('{:,.2f}', na), format('{:,.4f}', round(naive - l, 4)), format('{:,.2f}', round(round(naive - l, 4) * n, 2)) FROM seg, lift WHERE vendor_id = 7"""),
)

# ------------------------------------------------------------------ boosted trees (no SQL equivalent)


def boosted(spark, d):
    # each of the 250 trees of an arm costs several jobs: all read one written table
    rows = materialize(fx.mart(spark, d).withColumn("is_new_code", features.enc.extra_flag("vendor_id", fx.NEW_CODE)), "arms")
    arms = {
        "predicted_total": scoring.GbtArm(features.FEATURES, fx.TRAIN_PERIODS),
        "control_predicted_total": scoring.GbtArm([*features.FEATURES, "is_new_code"], fx.CONTROL_PERIODS),
    }
    return rows, scoring.fit_arms(rows, arms, features.TARGET)


def train_arms(spark, d):
    rows, models = boosted(spark, d)
    served = features.period_eq(rows, fx.SCORE_PERIOD)
    return attribution.segment_summary(
        scoring.score_models(served, models, features.TARGET), "vendor_id", list(features.KNOWN_VENDORS)
    )


register("train_arms", train_arms)


def model_card(spark, d):
    rows = fx.mart(spark, d)
    arm = scoring.GroupMeanArm(list(features.KNOWN_VENDORS), fx.TRAIN_PERIODS)
    trained = features.period_in(rows, fx.TRAIN_PERIODS)
    means = scoring.training_cells(trained, {"p": arm}, features.TARGET).select(
        *arm.flags, (F.col("sum__p") / F.col("n__p")).alias("predicted_total")
    )
    card = scoring.model_card(
        trained.join(means, list(arm.flags)), "production", arm.flags, arm.periods, "vendor_id",
        "predicted_total", features.TARGET, "group_mean", {"flags": len(arm.flags)},
    )
    return card.select(
        "variant", F.array_join("features", ",").alias("features"), F.array_join("training_periods", ",").alias("training_periods"),
        "training_rows", F.array_join(F.col("categories_in_training_data").cast("array<string>"), ",").alias("categories"),
        F.col("hyperparameters")["flags"].alias("flags"), "in_sample_mae", "algorithm", "target",
    )


register(
    "model_card", model_card,
    fx.oracle(SCORED, f"""
SELECT 'production' AS variant, 'is_vendor_cmt,is_vendor_curb,is_vendor_myle' AS features, '{','.join(fx.TRAIN_PERIODS)}' AS training_periods,
  count(*) AS training_rows, array_to_string(list_sort(list(DISTINCT vendor_id)), ',') AS categories, '3' AS flags,
  round(avg(abs(m - total_amount)), 6) AS in_sample_mae, 'group_mean' AS algorithm, 'total_amount' AS target
FROM flagged JOIN prod_means USING (is_vendor_cmt, is_vendor_curb, is_vendor_myle) WHERE feed_month IN ({fx._in(fx.TRAIN_PERIODS)})"""),
)

# ------------------------------------------------------------------ stream


def stream(spark, d):
    batch = fx.table(spark, d, "events")
    live = streaming.stream_parquet(spark, d, batch.schema, "events.parquet")
    return streaming.run_available(spark, streaming.stream_monitors(live, "ts", "value", by=("event_type",)), "events")


register(
    "stream_monitors", stream,
    """
WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS row_volume, count(*) FILTER (value IS NULL) AS null_count,
  count(*) FILTER (value = 0) AS zero_count, count(*) FILTER (value < 0) AS negative_count, min(value) AS min_value, max(value) AS max_value,
  round(avg(value), 4) AS avg_value FROM events GROUP BY ALL)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, CAST(window_start AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, * EXCLUDE (window_start) FROM w
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)

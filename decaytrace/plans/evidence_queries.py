"""Monitors, drift, attribution and fix verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution, drift, features, monitors, scoring, verify
from . import fixture as fx
from .catalog import register

FEED, STAGED, MART, SCORED = fx.FEED_CTE, fx.STAGED_CTE, fx.MART_CTE, fx.SCORED_CTE
INPUTS = features.FEATURES
FLAGS = list(features.KNOWN_VENDORS)


def joined(*names):
    """Array columns as comma-joined text, which both engines print alike."""
    return [F.array_join(n, ",").alias(n) for n in names]


# ------------------------------------------------------------------ monitors

def metrics_sql(column, source, number=None):
    n = number or column
    return f"""
SELECT feed_month, count(*) AS row_volume,
  round(100.0 * sum(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END) / count(*), 4) AS null_pct,
  count(DISTINCT {column}) AS unique_count,
  count(*) FILTER ({n} = 0) AS zero_count, count(*) FILTER ({n} < 0) AS negative_count,
  CAST(min({column}) AS VARCHAR) AS min_value, CAST(max({column}) AS VARCHAR) AS max_value
FROM {source} GROUP BY 1"""


register(
    "monitor_metrics",
    lambda spark, d: monitors.monitor_metrics(fx.feed(spark, d), "vendor_id"),
    fx.oracle(FEED, f"SELECT *, CAST(0 AS BIGINT) AS empty_count FROM ({metrics_sql('vendor_id', 'feed')})"),
)
register(
    "monitor_metrics_derived",
    lambda spark, d: monitors.monitor_metrics(fx.mart(spark, d), "avg_speed_mph").drop("min_value", "max_value"),
    fx.oracle(MART, f"SELECT * EXCLUDE (min_value, max_value), CAST(0 AS BIGINT) AS empty_count FROM ({metrics_sql('avg_speed_mph', 'mart')})"),
)
DTYPES = {"vendor_id": "int", "pickup_at": "timestamp_ntz", "passenger_count": "double", "store_and_fwd_flag": "string", "trip_id": "bigint"}
register(
    "monitor_dtype",
    lambda spark, d: monitors.monitor_dtype(fx.feed(spark, d), list(DTYPES)),
    fx.oracle(FEED, " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null_rows FROM feed" for c, t in DTYPES.items()
    )),
)


def exceedance_sql(metric, share):
    return f"""
, m AS ({metrics_sql('avg_speed_mph', 'mart')}),
w AS (SELECT feed_month AS period, first_value({metric}) OVER (ORDER BY feed_month) AS from_value,
  max({metric}) OVER (ORDER BY feed_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max,
  {metric} AS to_value, {share} AS share_of_rows_pct FROM m)
SELECT '{metric}' AS metric, * FROM w WHERE to_value > prior_max ORDER BY period LIMIT 1"""


register(
    "first_exceedance",
    lambda spark, d: monitors.first_exceedance(monitors.monitor_metrics(fx.mart(spark, d), "avg_speed_mph"), "zero_count"),
    fx.oracle(MART, exceedance_sql("zero_count", "round(100.0 * zero_count / row_volume, 4)")),
)
register(
    "first_exceedance_unique",
    lambda spark, d: monitors.first_exceedance(monitors.monitor_metrics(fx.mart(spark, d), "avg_speed_mph"), "unique_count"),
    fx.oracle(MART, exceedance_sql("unique_count", "CAST(NULL AS DOUBLE)")),
)
register(
    "volume_swing",
    lambda spark, d: monitors.volume_swing(fx.feed(spark, d)),
    fx.oracle(FEED, """
SELECT round((max(n) - min(n)) / CAST(max(n) AS DOUBLE) * 100, 2) AS row_volume_swing_pct
FROM (SELECT count(*) AS n FROM feed GROUP BY feed_month)"""),
)


#: Whether the published files of some periods lack a column that those of others have.
FEED_RESHAPED = f"(SELECT count(DISTINCT feed_month >= '{fx.TRIP_TYPE_SINCE}') > 1 FROM feed)"
#: Whether the mart's rows differ in their columns or types.
MART_RESHAPED = "(SELECT count(DISTINCT typeof(mart)) > 1 FROM mart)"


def stale_sql(source):
    return f"""(SELECT coalesce(bool_or(gap > {int(fx.MAX_GAP_SECONDS)}), false) FROM (
  SELECT CAST(floor(epoch(t)) AS BIGINT) - CAST(floor(epoch(lag(t) OVER (ORDER BY feed_month))) AS BIGINT) AS gap
  FROM (SELECT feed_month, max(pickup_at) AS t FROM {source} GROUP BY 1)))"""


def verdicts_sql(column, source, dtype, reshaped):
    return f"""
m AS ({metrics_sql(column, source)}),
w AS (SELECT *, max(unique_count) OVER e AS pu, max(zero_count) OVER e AS pz FROM m
  WINDOW e AS (ORDER BY feed_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT '{column}' AS "column", '{dtype}' AS dtype, (SELECT count(DISTINCT typeof({column})) <= 1 FROM {source}) AS dtype_stable,
  max(null_pct) AS max_null_pct,
  round((max(row_volume) - min(row_volume)) / CAST(max(row_volume) AS DOUBLE) * 100, 2) AS row_volume_swing_pct,
  (max(row_volume) - min(row_volume)) / CAST(max(row_volume) AS DOUBLE) > 0.5 AS volume_fires,
  max(null_pct) > 1.0 AS null_count_fires, {reshaped} AS schema_fires,
  (SELECT count(*) FILTER (trim(CAST({column} AS VARCHAR)) = '') > 0 FROM {source}) AS empty_count_fires,
  max(negative_count) > 0 AS negative_count_fires, {stale_sql(source)} AS freshness_fires,
  coalesce(bool_or(unique_count > pu), false) AS unique_count_fires,
  coalesce(bool_or(zero_count > pz), false) AS zero_count_fires FROM w)"""


def derived_verdicts(spark, d):
    rows, options = fx.derived_layer(spark, d)
    return monitors.monitor_verdicts(rows, "avg_speed_mph", **options)


register(
    "monitor_verdicts", derived_verdicts,
    fx.oracle(MART, ", " + verdicts_sql("avg_speed_mph", "mart", "double", MART_RESHAPED) + " SELECT * FROM v"),
)


def sweep(spark, d):
    source, measured = fx.source_layer(spark, d)
    derived, options = fx.derived_layer(spark, d, source)
    return monitors.monitor_sweep(
        {"source_column": (source, "vendor_id", measured), "derived_feature": (derived, "avg_speed_mph", options)}
    )


def sweep_sql(tail):
    parts = []
    for layer, column, source, dtype, reshaped in (
        ("source_column", "vendor_id", "feed", "int", FEED_RESHAPED), ("derived_feature", "avg_speed_mph", "mart", "double", MART_RESHAPED)
    ):
        v = f"(WITH {verdicts_sql(column, source, dtype, reshaped)} SELECT * FROM v)"
        parts.append(
            f"SELECT '{layer}' AS layer, \"column\", unnest([{', '.join(repr(m) for m in monitors.MONITORS)}]) AS monitor, "
            f"unnest([{', '.join(m + '_fires' for m in monitors.MONITORS)}]) AS fires FROM {v}"
        )
    return fx.oracle(MART, f", sweep AS ({' UNION ALL '.join(parts)}) {tail}")


register("monitor_sweep", sweep, sweep_sql("SELECT * FROM sweep"))
register(
    "monitors_fired",
    lambda spark, d: monitors.monitors_fired(sweep(spark, d)),
    sweep_sql('SELECT layer, "column", count(*) FILTER (fires) AS fired, count(*) AS monitors FROM sweep GROUP BY ALL'),
)
register(
    "in_set",
    lambda spark, d: monitors.in_set(fx.feed(spark, d), "vendor_id", [1, 2, 6]),
    fx.oracle(FEED, """
SELECT feed_month, count(*) AS rows, count(*) FILTER (vendor_id NOT IN (1, 2, 6)) AS outside,
  count(*) FILTER (vendor_id NOT IN (1, 2, 6)) > 0 AS fires FROM feed GROUP BY 1"""),
)
register(
    "monitor_report",
    lambda spark, d: monitors.monitor_report(features.period_eq(fx.feed(spark, d), fx.SCORE_PERIOD), "vendor_id"),
    fx.oracle(FEED, f"""
, s AS (SELECT * FROM feed WHERE feed_month = '{fx.SCORE_PERIOD}')
SELECT 'row volume' AS monitor, CAST(count(*) AS VARCHAR) AS value FROM s
UNION ALL SELECT 'null rate', CAST(round(100.0 * sum(CASE WHEN vendor_id IS NULL THEN 1 ELSE 0 END) / count(*), 4) AS VARCHAR) || '%' FROM s
UNION ALL SELECT 'dtype', 'int'
UNION ALL SELECT 'distinct count', CAST(count(DISTINCT vendor_id) AS VARCHAR) FROM s"""),
)
register(
    "monitor_freshness",
    lambda spark, d: monitors.monitor_freshness(
        fx.table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "ts", "day", 86400.0
    ),
    """
WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, max(ts) AS last_seen FROM events GROUP BY 1),
g AS (SELECT *, CAST(floor(epoch(last_seen)) AS BIGINT) - CAST(floor(epoch(lag(last_seen) OVER (ORDER BY day))) AS BIGINT) AS gap_seconds FROM l)
SELECT *, coalesce(gap_seconds > 86400, false) AS fires FROM g""",
)
register(
    "monitor_empty",
    lambda spark, d: monitors.monitor_empty(
        fx.table(spark, d, "documents").withColumn("first_line", F.get(F.split("text", "\n"), F.lit(0))),
        ["first_line", "source"], "lang",
    ),
    """
WITH t AS (SELECT *, string_split(text, chr(10))[1] AS first_line FROM documents)
SELECT lang, 'first_line' AS "column", count(*) FILTER (trim(first_line) = '') AS empty_count FROM t GROUP BY 1
UNION ALL SELECT lang, 'source', count(*) FILTER (trim(source) = '') FROM t GROUP BY 1""",
)

# ------------------------------------------------------------------ drift

PER_SEGMENT = ", stats AS (SELECT vendor_id AS segment, count(*) AS rows, " + ", ".join(
    [f"round(avg({e}), 4) AS avg__{e}" for e in ("abs_error", "control_abs_error")]
    + [f"round(avg({c}), 4) AS avg__{c}, coalesce(round(stddev_pop({c}), 8), 0) AS sd__{c}, "
       f"min({c}) AS min__{c}, max({c}) AS max__{c}, count({c}) AS n__{c}, count(*) FILTER ({c} NOT IN (0, 1)) AS other__{c}"
       for c in INPUTS]
) + " FROM scored GROUP BY 1)"
SORTED_INPUTS = ", ".join(f"'{c}'" for c in INPUTS)


def list_where(conditions):
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in conditions)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


DRIFT_SQL = PER_SEGMENT + f"""
, flat AS (SELECT *, {list_where([(c, f'sd__{c} = 0') for c in INPUTS])} AS degenerate FROM stats),
ref AS (SELECT segment AS ref_segment, degenerate AS ref_degenerate FROM flat ORDER BY rows DESC, CAST(segment AS VARCHAR) LIMIT 1),
ind AS (SELECT {list_where([(c, f'sum(n__{c}) > 0 AND sum(other__{c}) = 0') for c in INPUTS])} AS ind FROM stats),
fam AS (SELECT {list_where([(c, f'sum(n__{c}) > 0 AND sum(other__{c}) = 0 AND bool_and(min__{c} = max__{c})') for c in INPUTS])} AS fam FROM stats)
"""


def zero_sql(names):
    return f"len({names}) > 0 AND " + " AND ".join(
        f"(NOT list_contains({names}, '{c}') OR coalesce(avg__{c} = 0, false))" for c in INPUTS
    )


register(
    "drift_stats",
    lambda spark, d: drift.drift_stats(fx.scored(spark, d), "vendor_id", INPUTS),
    fx.oracle(SCORED, PER_SEGMENT + " SELECT segment, rows, avg__abs_error, avg__control_abs_error, "
              + ", ".join(f"avg__{c}, sd__{c}" for c in INPUTS) + " FROM stats"),
)
register(
    "degenerate",
    lambda spark, d: drift.segment_stats(fx.scored(spark, d), "vendor_id", INPUTS)
    .select("segment", drift.degenerate(INPUTS).alias("degenerate_in_segment"))
    .select("segment", *joined("degenerate_in_segment")),
    fx.oracle(SCORED, DRIFT_SQL + "SELECT segment, array_to_string(degenerate, ',') AS degenerate_in_segment FROM flat"),
)
register(
    "degenerate_only",
    lambda spark, d: drift.drift_report(fx.scored(spark, d), "vendor_id", INPUTS).select("segment", *joined("degenerate_only")),
    fx.oracle(SCORED, DRIFT_SQL + """
SELECT segment, array_to_string(list_sort(list_filter(degenerate, lambda x: NOT list_contains(ref_degenerate, x))), ',') AS degenerate_only
FROM flat, ref"""),
)
register(
    "indicators",
    lambda spark, d: drift.indicators(drift.segment_stats(fx.scored(spark, d), "vendor_id", INPUTS), INPUTS).select(*joined("indicators")),
    fx.oracle(SCORED, DRIFT_SQL + "SELECT array_to_string(ind, ',') AS indicators FROM ind"),
)
register(
    "reference_segment",
    lambda spark, d: drift.reference_segment(drift.segment_stats(fx.scored(spark, d), "vendor_id", [])),
    fx.oracle(SCORED, DRIFT_SQL + "SELECT ref_segment AS reference_segment FROM ref"),
)
register(
    "all_indicators_zero",
    lambda spark, d: drift.drift_report(fx.scored(spark, d), "vendor_id", ["avg_speed_mph", "trip_minutes", *FLAGS]).select(
        "segment", "all_indicators_zero", "all_family_zero"
    ),
    fx.oracle(SCORED, PER_SEGMENT + " SELECT segment, " + " AND ".join(f"avg__{c} = 0" for c in FLAGS)
              + " AS all_indicators_zero, " + " AND ".join(f"avg__{c} = 0" for c in FLAGS) + " AS all_family_zero FROM stats"),
)
register(
    "drift_report",
    lambda spark, d: drift.drift_report(fx.scored(spark, d), "vendor_id", INPUTS).select(
        "segment", "rows", "avg__abs_error", "avg__control_abs_error",
        *[F.col("feature_means")[c].alias(f"avg__{c}") for c in INPUTS],
        "reference_segment", "all_indicators_zero", "all_family_zero",
        *joined("degenerate_in_segment", "degenerate_only", "indicator_inputs", "family_inputs"),
    ),
    fx.oracle(SCORED, DRIFT_SQL + f"""
SELECT segment, rows, avg__abs_error, avg__control_abs_error, {', '.join(f'avg__{c}' for c in INPUTS)},
  ref_segment AS reference_segment, {zero_sql('ind')} AS all_indicators_zero, {zero_sql('fam')} AS all_family_zero,
  array_to_string(degenerate, ',') AS degenerate_in_segment,
  array_to_string(list_sort(list_filter(degenerate, lambda x: NOT list_contains(ref_degenerate, x))), ',') AS degenerate_only,
  array_to_string(ind, ',') AS indicator_inputs, array_to_string(fam, ',') AS family_inputs
FROM flat, ref, ind, fam"""),
)
LABEL_INPUTS = ["quality", "toxic", "n_chars"]


def labelled(spark, d):
    """Labels meet their documents on doc_id; both sides have one row per document."""
    return fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").drop("text"), "doc_id")


register(
    "drift_stats_labels",
    lambda spark, d: drift.drift_stats(labelled(spark, d), "lang", LABEL_INPUTS, errors=()),
    "SELECT lang AS segment, count(*) AS rows, "
    + ", ".join(f"round(avg({c}), 4) AS avg__{c}, coalesce(round(stddev_pop({c}), 8), 0) AS sd__{c}" for c in LABEL_INPUTS)
    + " FROM labels JOIN documents USING (doc_id) GROUP BY 1",
)

# ------------------------------------------------------------------ attribution

MAES = """round(avg(abs_error), 4) AS production_mae, round(avg(control_abs_error), 4) AS control_mae"""
register(
    "segment_summary",
    lambda spark, d: attribution.segment_summary(fx.scored(spark, d), "vendor_id", FLAGS),
    fx.oracle(SCORED, f"""
SELECT vendor_id, count(*) AS trips, {MAES}, round(avg(abs_error) - avg(control_abs_error), 4) AS attributable_mae,
  round(avg(avg_speed_mph), 3) AS avg_speed_feature, round(avg(is_vendor_cmt + is_vendor_curb + is_vendor_myle), 4) AS flag_sum
FROM scored GROUP BY 1"""),
)
NAIVE = f"""count(*) AS affected_rows, {MAES}, round(avg(abs_error) - avg(control_abs_error), 4) AS attributable_mae_per_row,
  round(sum(abs_error - control_abs_error), 2) AS attributable_amount, round(sum(total_amount), 2) AS gross_amount_exposed"""
register(
    "impact_naive",
    lambda spark, d: attribution.impact_naive(fx.scored(spark, d), "vendor_id", fx.NEW_CODE),
    fx.oracle(SCORED, f"SELECT {NAIVE} FROM scored WHERE vendor_id = 7"),
)
register(
    "attribution_naive",
    lambda spark, d: attribution.attribution_naive(fx.scored(spark, d), "vendor_id", fx.NEW_CODE),
    fx.oracle(SCORED, f"SELECT {NAIVE}, min(pickup_at) AS first_affected_at, max(pickup_at) AS last_affected_at FROM scored WHERE vendor_id = 7"),
)
register(
    "baseline_lift",
    lambda spark, d: attribution.baseline_lift(fx.scored(spark, d), "vendor_id", fx.NEW_CODE),
    fx.oracle(SCORED, "SELECT count(*) AS baseline_rows, round(avg(abs_error) - avg(control_abs_error), 6) AS baseline_control_lift FROM scored WHERE vendor_id <> 7"),
)
DID_SQL = """
, seg AS (SELECT DISTINCT vendor_id AS segment FROM scored WHERE vendor_id IS NOT NULL),
a AS (SELECT segment,
  count(*) FILTER (vendor_id = segment) AS affected_rows,
  round(avg(abs_error) FILTER (vendor_id = segment), 4) AS production_mae,
  round(avg(control_abs_error) FILTER (vendor_id = segment), 4) AS control_mae,
  round(avg(abs_error) FILTER (vendor_id = segment) - avg(control_abs_error) FILTER (vendor_id = segment), 4) AS naive_mae_per_row,
  round(sum(abs_error - control_abs_error) FILTER (vendor_id = segment), 2) AS naive_amount,
  round(sum(total_amount) FILTER (vendor_id = segment), 2) AS gross_amount_exposed,
  count(*) FILTER (vendor_id <> segment) AS baseline_rows,
  coalesce(round(avg(abs_error) FILTER (vendor_id <> segment) - avg(control_abs_error) FILTER (vendor_id <> segment), 6), 0) AS lift,
  count(*) FILTER (vendor_id IS NULL) AS null_segment_rows,
  min(pickup_at) FILTER (vendor_id = segment) AS first_affected_at,
  max(pickup_at) FILTER (vendor_id = segment) AS last_affected_at
  FROM seg CROSS JOIN scored GROUP BY 1),
did AS (SELECT *, round(lift, 4) AS baseline_lift_per_row, round(naive_mae_per_row - lift, 4) AS did_mae_per_row,
  round(round(naive_mae_per_row - lift, 4) * affected_rows, 2) AS did_amount FROM a)"""
register(
    "attribution_did",
    lambda spark, d: attribution.attribution_did(fx.scored(spark, d), "vendor_id", fx.NEW_CODE),
    fx.oracle(SCORED, DID_SQL + """
SELECT affected_rows, naive_mae_per_row, naive_amount, baseline_rows, baseline_lift_per_row, did_mae_per_row, did_amount,
  null_segment_rows, first_affected_at, last_affected_at FROM did WHERE segment = 7"""),
)
register(
    "attribution_all",
    lambda spark, d: attribution.attribution_all(fx.scored(spark, d), "vendor_id"),
    fx.oracle(SCORED, DID_SQL + "SELECT * EXCLUDE (lift) FROM did"),
)
register(
    "signed_net",
    lambda spark, d: attribution.signed_net(fx.scored(spark, d), "vendor_id"),
    fx.oracle(SCORED, """
SELECT vendor_id, count(*) AS rows, round(sum(predicted_total - total_amount), 2) AS production_net,
  round(sum(control_predicted_total - total_amount), 2) AS control_net FROM scored GROUP BY 1"""),
)


def three_arms(spark, d):
    rows = fx.mart(spark, d).withColumn("is_new_code", features.enc.extra_flag("vendor_id", fx.NEW_CODE))
    arms = {
        "predicted_total": scoring.GroupMeanArm(FLAGS, fx.TRAIN_PERIODS),
        "window_predicted_total": scoring.GroupMeanArm(FLAGS, fx.CONTROL_PERIODS),
        "control_predicted_total": scoring.GroupMeanArm([*FLAGS, "is_new_code"], fx.CONTROL_PERIODS),
    }
    return scoring.score_arms(rows, arms, fx.SCORE_PERIOD, features.TARGET)


register(
    "three_arm_attribution",
    lambda spark, d: attribution.three_arm_attribution(
        three_arms(spark, d), "vendor_id",
        {"production": "abs_error", "window": "window_abs_error", "control": "control_abs_error"},
    ),
    fx.oracle(SCORED, f"""
, wm AS (SELECT {', '.join(FLAGS)}, avg(total_amount) AS wmean FROM mart WHERE feed_month IN ({fx._in(fx.CONTROL_PERIODS)}) GROUP BY ALL),
s AS (SELECT scored.*, abs(coalesce(wmean, (SELECT avg(total_amount) FROM mart WHERE feed_month IN ({fx._in(fx.CONTROL_PERIODS)}))) - total_amount) AS window_abs_error
  FROM scored LEFT JOIN wm USING ({', '.join(FLAGS)}))
SELECT vendor_id, count(*) AS rows, round(avg(abs_error), 4) AS production_mae, round(avg(window_abs_error), 4) AS window_mae,
  round(avg(control_abs_error), 4) AS control_mae, round(avg(abs_error) - avg(window_abs_error), 4) AS window_effect,
  round(avg(window_abs_error) - avg(control_abs_error), 4) AS encoder_effect FROM s GROUP BY 1"""),
)
register(
    "train_arms_sql",
    lambda spark, d: scoring.training_cells(
        fx.mart(spark, d).withColumn("is_new_code", features.enc.extra_flag("vendor_id", fx.NEW_CODE)),
        {"prod": scoring.GroupMeanArm(FLAGS, fx.TRAIN_PERIODS), "ctrl": scoring.GroupMeanArm([*FLAGS, "is_new_code"], fx.CONTROL_PERIODS)},
        features.TARGET,
    ).select(*FLAGS, "is_new_code", *[f"n__{a}" for a in ("prod", "ctrl")],
             *[features.enc.price_per_unit(F.round(F.col(f"sum__{a}") * 1e4) / 1e4, F.col(f"n__{a}").cast("double")).alias(f"mean__{a}") for a in ("prod", "ctrl")])
    .select(*FLAGS, "is_new_code", "n__prod", "n__ctrl", *[F.round(F.col(f"mean__{a}") * 1e4).alias(f"mean_e4__{a}") for a in ("prod", "ctrl")]),
    fx.oracle(SCORED, f"""
SELECT {', '.join(FLAGS)}, is_new_code, count(*) FILTER (feed_month IN ({fx._in(fx.TRAIN_PERIODS)})) AS n__prod,
  count(*) FILTER (feed_month IN ({fx._in(fx.CONTROL_PERIODS)})) AS n__ctrl,
  round(1e4 * avg(total_amount) FILTER (feed_month IN ({fx._in(fx.TRAIN_PERIODS)}))) AS mean_e4__prod,
  round(1e4 * avg(total_amount) FILTER (feed_month IN ({fx._in(fx.CONTROL_PERIODS)}))) AS mean_e4__ctrl
FROM flagged GROUP BY ALL"""),
)
register(
    "score_arms",
    lambda spark, d: fx.scored(spark, d).select(
        "trip_id", *[features.enc.F.round(F.col(c) * 1e6).alias(f"{c}_e6") for c in ("predicted_total", "control_predicted_total")]
    ),
    fx.oracle(SCORED, "SELECT trip_id, round(predicted_total * 1e6) AS predicted_total_e6, round(control_predicted_total * 1e6) AS control_predicted_total_e6 FROM scored"),
)
register(
    "mae",
    lambda spark, d: scoring.mae(fx.scored(spark, d), "predicted_total", features.TARGET),
    fx.oracle(SCORED, "SELECT round(avg(abs(predicted_total - total_amount)), 6) AS in_sample_mae FROM scored"),
)

# ------------------------------------------------------------------ fix verification

CATCHALL = features.Encoder(catchall="is_vendor_unknown")
FIXED = STAGED + ", mart AS (" + fx.MART_SELECT.format(extra="") + "), fixed AS (" + fx.MART_SELECT.format(
    extra="\n    CASE WHEN vendor_id NOT IN (1, 2, 6) THEN 1 ELSE 0 END AS is_vendor_unknown,"
) + "), filtered AS (SELECT * FROM mart WHERE vendor_id IN (1, 2, 6))"


def marts(spark, d):
    """Current mart, the accepted fix, and the row-dropping candidate."""
    staged = fx.staged(spark, d)
    current = features.mart_features(staged)
    return current, features.mart_features(staged, CATCHALL), current.filter(F.col("vendor_id").isin(1, 2, 6))


def family_sql(source, inputs):
    per = ", ".join(f"min({c}) AS min__{c}, max({c}) AS max__{c}, count({c}) AS n__{c}, count(*) FILTER ({c} NOT IN (0, 1)) AS other__{c}" for c in inputs)
    names = list_where([(c, f"sum(n__{c}) > 0 AND sum(other__{c}) = 0 AND bool_and(min__{c} = max__{c})") for c in inputs])
    return f"(SELECT {names} AS fam FROM (SELECT {per} FROM {source} GROUP BY vendor_id))"


def active_sql(source, inputs):
    total = " + ".join(f"CASE WHEN list_contains(fam, '{c}') THEN {c} ELSE 0 END" for c in inputs)
    return f"""(SELECT any_value(f.fam) AS indicators, round(coalesce(avg({total}) FILTER (vendor_id = 7), 0), 4) AS mean_active_indicators,
  count(*) FILTER (vendor_id = 7) AS rows, len(any_value(f.fam)) > 0 AND coalesce(avg({total}) FILTER (vendor_id = 7), 0) = 0 AS all_zero
  FROM {source}, {family_sql(source, inputs)} f)"""


FIXED_INPUTS = [*INPUTS, "is_vendor_unknown"]
register(
    "encoding_family",
    lambda spark, d: verify.encoding_family(marts(spark, d)[0], "vendor_id", INPUTS).select(*joined("indicators")),
    fx.oracle(FIXED, f"SELECT array_to_string(fam, ',') AS indicators FROM {family_sql('mart', INPUTS)}"),
)
register(
    "active_indicators",
    lambda spark, d: verify.active_indicators(marts(spark, d)[0], "vendor_id", 7).select(
        *joined("indicators"), "mean_active_indicators", "rows", "all_zero"
    ),
    fx.oracle(FIXED, f"SELECT array_to_string(indicators, ',') AS indicators, mean_active_indicators, rows, all_zero FROM {active_sql('mart', INPUTS)}"),
)


def compare_sql(after):
    return f"""
, b AS (SELECT vendor_id AS segment, count(*) AS before_rows FROM mart GROUP BY 1),
a AS (SELECT vendor_id AS segment, count(*) AS after_rows FROM {after} GROUP BY 1),
cmp AS (SELECT segment, coalesce(before_rows, 0) AS before_rows, coalesce(after_rows, 0) AS after_rows,
  coalesce(after_rows, 0) - coalesce(before_rows, 0) AS difference FROM b FULL JOIN a USING (segment))"""


register(
    "segment_count_compare",
    lambda spark, d: verify.segment_count_compare(marts(spark, d)[0], marts(spark, d)[2], "vendor_id"),
    fx.oracle(FIXED, compare_sql("filtered") + "SELECT * FROM cmp"),
)
register(
    "map_equal",
    lambda spark, d: verify.map_equal(marts(spark, d)[0], marts(spark, d)[1], "vendor_id"),
    fx.oracle(FIXED, compare_sql("fixed") + "SELECT bool_and(difference = 0) AS row_counts_unchanged FROM cmp"),
)
register(
    "rows_destroyed",
    lambda spark, d: verify.rows_destroyed(marts(spark, d)[0], marts(spark, d)[2], "vendor_id"),
    fx.oracle(FIXED, compare_sql("filtered") + "SELECT segment, -difference AS rows_destroyed FROM cmp WHERE difference <> 0"),
)


def gates(spark, d, candidate):
    current, fixed, filtered = marts(spark, d)
    out = verify.verify_fix(current, fixed if candidate == "fixed" else filtered, "vendor_id", 7)
    flat = []
    for side in ("before", "after"):
        flat += [
            F.array_join(f"{side}.indicators", ",").alias(f"{side}_indicators"),
            *[F.col(f"{side}.{f}").alias(f"{side}_{f}") for f in ("mean_active_indicators", "rows", "all_zero")],
        ]
    return out.select("build_ok", *flat, "row_counts_unchanged", "defect_resolved", "passed")


def gates_sql(after, inputs):
    def side(name, src, cols):
        return (f"(SELECT array_to_string(indicators, ',') AS {name}_indicators, mean_active_indicators AS {name}_mean_active_indicators, "
                f"rows AS {name}_rows, all_zero AS {name}_all_zero FROM {active_sql(src, cols)})")

    return fx.oracle(FIXED, compare_sql(after) + f"""
, g AS (SELECT *, true AS build_ok, (SELECT bool_and(difference = 0) FROM cmp) AS row_counts_unchanged
  FROM {side('before', 'mart', INPUTS)}, {side('after', after, inputs)})
SELECT *, before_all_zero AND NOT after_all_zero AS defect_resolved,
  build_ok AND before_all_zero AND NOT after_all_zero AND row_counts_unchanged AS passed FROM g""")


register("verify_fix", lambda spark, d: gates(spark, d, "fixed"), gates_sql("fixed", FIXED_INPUTS))
register("reject_row_dropping", lambda spark, d: gates(spark, d, "filtered"), gates_sql("filtered", INPUTS))

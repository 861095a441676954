"""Published figures, recomputed from hand-sized rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from decaytrace.operators import attribution, claims, drift, features, lineage, monitors, profile, verify

MONTHS = ["2024-06", "2024-09", "2024-12", "2025-03", "2025-06"]
VOLUMES = [3417045, 3465963, 3502209, 3826498, 3907024]


def metrics(spark, name, values):
    return spark.createDataFrame(list(zip(MONTHS, values, VOLUMES)), f"feed_month string, {name} bigint, row_volume bigint")


def test_first_exceedance_of_zero_count(spark):
    out = rows(monitors.first_exceedance(metrics(spark, "zero_count", [43, 33, 255, 21350, 66174]), "zero_count"))
    assert out == [("zero_count", "2024-12", 43, 43, 255, 0.0073)]


def test_first_exceedance_of_unique_count_has_no_share(spark):
    out = rows(monitors.first_exceedance(metrics(spark, "unique_count", [753298, 810336, 823837, 751328, 846897]), "unique_count"))
    assert out == [("unique_count", "2024-09", 753298, 753298, 810336, None)]


def test_first_exceedance_without_change(spark):
    assert rows(monitors.first_exceedance(metrics(spark, "zero_count", [0] * 5), "zero_count")) == []


@pytest.mark.parametrize("volumes, swing", [
    ([3539193, 3633030, 3668371, 4145257, 4322960], 18.13), (VOLUMES, 12.54),
])
def test_volume_swing(spark, volumes, swing):
    per = spark.createDataFrame(list(zip(MONTHS, volumes)), "feed_month string, row_volume bigint")
    assert per.agg(monitors._swing_pct("row_volume")).first()[0] == swing


def test_new_values(spark):
    data = [(m, v) for m in MONTHS for v in (1, 2, 6)] + [("2024-12", 7)] * 230 + [("2025-03", 7)] * 5
    df = spark.createDataFrame(data, "feed_month string, vendor_id int")
    assert rows(profile.new_values(df, "vendor_id")) == [("7", "2024-12", 230, True)]


@pytest.mark.parametrize("naive, lift, n, per_row, amount", [
    (1.4386, 0.073149, 66146, 1.3655, 90322.36), (1.387, 0.0957, 1395, 1.2913, 1801.36),
])
def test_estimate_rounding_order(spark, naive, lift, n, per_row, amount):
    df = spark.createDataFrame([(naive, lift, n)], "naive double, lift double, n bigint")
    assert rows(df.select(*attribution.did_columns(F.col("naive"), F.col("lift"), F.col("n")))) == [(per_row, amount)]


def test_claim_arithmetic(spark):
    df = spark.createDataFrame([(1.3655, 66146, 90322.36), (1.4386, 66146, 90322.36)], "p double, r bigint, t double")
    assert [r[-1] for r in rows(claims.claims_arith(df, "p", "r", "t"))] == [True, False]


def served(spark):
    """Segments 1, 2 and 7; in 7 the speed and minutes collapse and no flag is set."""
    data = []
    for i in range(40):
        v = (1, 2, 2, 7)[i % 4]
        dead = v == 7
        data.append((v, float(i), 0.0 if dead else 5.0 + i, 0.0 if dead else 9.0 + i % 7, int(v == 1), int(v == 2), 0,
                     (i // 4) % 2, 10.0 + i, 3.0 if dead else 1.0, 1.0))
    return spark.createDataFrame(
        data, "vendor_id int, trip_distance double, trip_minutes double, avg_speed_mph double, is_vendor_cmt int, "
              "is_vendor_curb int, is_vendor_myle int, is_card_payment int, total_amount double, abs_error double, control_abs_error double")


def test_drift_flags(spark):
    report = {r["segment"]: r for r in drift.drift_report(served(spark), "vendor_id").collect()}
    seven = report[7]
    assert seven["degenerate_only"] == ["avg_speed_mph", "trip_minutes"]
    assert seven["all_family_zero"] and not report[1]["all_family_zero"]
    # an unrelated flag varies inside the segment, so the test over all binary inputs stays silent
    assert not seven["all_indicators_zero"]
    assert seven["family_inputs"] == ["is_vendor_cmt", "is_vendor_curb", "is_vendor_myle"]
    assert seven["reference_segment"] == 2


def staged(spark):
    return served(spark).drop("abs_error", "control_abs_error")


def test_fix_accepted(spark):
    before = staged(spark)
    after = before.withColumn("is_other", features.enc.one_hot_catchall("vendor_id", [1, 2, 6]))
    gate = verify.verify_fix(before, after, "vendor_id", 7).first()
    assert gate["before"]["mean_active_indicators"] == 0.0 and gate["after"]["mean_active_indicators"] == 1.0
    assert gate["defect_resolved"] and gate["row_counts_unchanged"] and gate["passed"]


def test_row_dropping_fix_rejected(spark):
    before = staged(spark)
    gate = verify.verify_fix(before, before.filter("vendor_id in (1, 2, 6)"), "vendor_id", 7).first()
    assert (gate["defect_resolved"], gate["row_counts_unchanged"], gate["passed"]) == (False, False, False)
    assert rows(verify.rows_destroyed(before, before.filter("vendor_id in (1, 2, 6)"), "vendor_id")) == [(7, 10)]


def test_fix_without_any_encoding_left_is_not_a_fix(spark):
    before = staged(spark)
    after = before.drop("is_vendor_cmt", "is_vendor_curb", "is_vendor_myle")
    assert not verify.verify_fix(before, after, "vendor_id", 7).first()["passed"]


def test_candidate_that_does_not_analyse_fails_the_build_gate(spark):
    gate = verify.verify_transform(staged(spark), lambda s: s, lambda s: s.select("no_such"), "vendor_id", 7).first()
    assert not gate["build_ok"] and not gate["passed"]


def test_run_cost(spark):
    df = spark.createDataFrame([("gpt-4o", 105048, 1591), ("other", 1, 1)], "llm_model string, input_tokens bigint, output_tokens bigint")
    costs = [r["cost_usd"] for r in lineage.run_cost(df, {"gpt-4o": (2.5, 10.0)}).collect()]
    assert round(costs[0], 5) == 0.27853 and costs[1] is None
    assert lineage.run_cost(df, {}, override=(1.0, 0.0)).collect()[1]["cost_usd"] == 1e-6

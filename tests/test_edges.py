"""Traps between SQL dialects, and the odd cases each operator must keep or repair."""

import threading

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from decaytrace.functions import encoding as enc, numbers, text, times
from decaytrace.operators import attribution, boosting, claims, diagnose, drift, ledger, monitors, profile, scoring
from decaytrace.plans import fixture as fx, record_queries
from decaytrace.sources import registry


def test_rounding_ties_follow_the_scaled_double(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (2.675,), (1.115,)], "x double")
    assert [r[0] for r in rows(df.select(numbers.round_n("x", 2)))] == [1.0, 0.28, 2.68, 1.12]


def test_seconds_count_boundaries(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.9' a, timestamp_ntz'2024-01-01 00:00:01.1' b")
    assert rows(df.select(times.seconds_between("a", "b"), times.seconds_between("b", "a"))) == [(1, -1)]
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:59' a, timestamp_ntz'2024-01-01 00:01:01' b")
    assert rows(df.select(times.minute_boundaries("a", "b"))) == [(1,)]


def test_sunday_is_zero(spark):
    assert rows(spark.sql("SELECT timestamp_ntz'2024-06-02 10:00:00' t").select(times.dow_part("t"), times.hour_part("t"))) == [(0, 10)]


def test_zero_duration_gives_zero_speed(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None), (6.0, 30.0), (5.0, -60.0)], "d double, m double")
    assert [r[0] for r in rows(df.select(enc.avg_speed("d", "m")))] == [0.0, 0.0, 12.0, -5.0]


def test_encodings_of_null(spark):
    df = spark.createDataFrame([(None,), (1,), (9,)], "v int")
    out = rows(df.select(
        *enc.one_hot_fixed("v", {"a": 1}), enc.one_hot_catchall("v", [1]), enc.one_hot_catchall("v", [1], True),
        enc.extra_flag("v", 9),
    ))
    assert out == [(0, 0, 1, 0), (1, 0, 0, 0), (0, 1, 1, 1)]


def test_times_are_not_cast_to_epochs(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' t, 'x1' s, '2.5' n, true b")
    types = {f.name: f.dataType for f in df.schema}
    assert rows(df.select(*[numbers.safe_double(c, types[c]) for c in "tsnb"])) == [(None, None, 2.5, 1.0)]


def test_literals(spark):
    df = spark.createDataFrame([(" 7 ",), ("-12",), ("7.0",), ("x",), ("99999999999999999999",)], "s string")
    assert [r[0] for r in rows(df.select(numbers.parse_literal("s")))] == [7, -12, None, None, None]


def test_entity_names(spark):
    df = spark.createDataFrame([
        ("urn:li:dataset:(urn:li:dataPlatform:dbt,a.b.raw.t,PROD)",), ("urn:li:mlFeature:(tbl,f)",),
        ("urn:li:mlModel:(urn:li:dataPlatform:x,m,PROD)",), ("urn:li:dataProcessInstance:run_1",), ("plain",),
    ], "u string")
    assert [r[0] for r in rows(df.select(text.urn_short("u")))] == ["a.b.raw.t", "mlFeature: f", "mlModel: m", "trainingRun: run_1", "plain"]
    assert [r[0] for r in rows(df.select(text.urn_table_key("u")))][0] == "raw.t"
    assert rows(df.select(text.urn_table_key("u")))[-1] == ("plain",)


def test_words_are_matched_whole_and_literally(spark):
    df = spark.createDataFrame([("is_a and x",), ("is_ab",), ("a.b",), ("axb",)], "t string")
    assert [r[0] for r in rows(df.select(text.word_match("t", "is_a")))] == [True, False, False, False]
    assert [r[0] for r in rows(df.select(text.word_match("t", "a.b")))] == [False, False, True, False]


def test_properties_keep_the_last_duplicate(spark):
    df = spark.sql("SELECT array(struct('k' AS key, '1' AS value), struct('k' AS key, '2' AS value)) p, CAST(NULL AS array<struct<key:string,value:string>>) n")
    assert rows(df.select(text.props_to_map("p"), text.props_to_map("n"))) == [({"k": "2"}, {})]


def test_token_merge_scans_left_to_right_longest_first(spark):
    merges = [(("19", "3", "million"), "19.3 million"), (("1", "37"), "$1.37"), (("3", "million"), "3 million")]
    fixes = {"fair": "fare", "million": "MILLION"}
    df = spark.createDataFrame([("about 19 3 million FAIR, at 1 37 1 37 million",), ("",)], "t string")
    assert [r[0] for r in rows(df.select(text.token_merge("t", merges, fixes)))] == [
        "about 19.3 million fare at $1.37 $1.37 MILLION", ""]


def test_returning_value_is_not_new_and_null_is_no_value(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None), ("3", "a"), ("3", "b"), ("1", None)], "feed_month string, v string")
    assert rows(profile.new_values(df, "v")) == [("b", "3", 1, True)]
    assert {(r[0], r[1]) for r in rows(profile.value_sets(df, "v"))} == {("1", "a"), ("3", "a"), ("3", "b")}
    card = {r["feed_month"]: (r["distinct_values"], r["rows"], r["null_pct"]) for r in profile.profile_cardinality(df, "v").collect()}
    assert card == {"1": (1, 2, 50.0), "2": (0, 1, 100.0), "3": (2, 2, 0.0)}


def test_the_gate_is_a_mark_and_drops_nothing(spark):
    df = spark.range(60).selectExpr("if(id < 55, '1', '2') feed_month", "id v")
    assert profile.value_counts(df, "v").filter("not is_categorical").count() == 60
    assert profile.value_sets(df, "v").count() == 60
    assert profile.new_values(df, "v").count() == 5
    assert [tuple(r) for r in profile.known_so_far(df, "v").orderBy("feed_month").collect()] == [("1", 55, 55, False), ("2", 5, 60, False)]


def test_notes_and_originals(spark):
    key = "dataset string, column string, "
    catalog = spark.createDataFrame([("d", "a", "old"), ("d", "b", None), ("d", "c", None)], key + "description string")
    findings = spark.createDataFrame([("d", "a", "one."), ("d", "a", "two."), ("d", "b", "three.")], key + "change string")
    features = spark.createDataFrame([("d", "a", f"f{i}") for i in range(5)], key + "feature string")
    noted = {r["column"]: r["description"] for r in ledger.annotate_column(catalog, findings, features).collect()}
    feeds = " Feeds 5: f0, f1, f2, f3, f4."
    assert noted == {"a": f"old\n\n[decay] one.{feeds}\n\n[decay] two.{feeds}", "b": "[decay] three.", "c": None}
    restored = ledger.restore_notes(ledger.annotate_column(catalog, findings, features), catalog)
    assert sorted(rows(restored), key=str) == sorted(rows(catalog), key=str)


def test_both_estimates_agree_on_missing_errors(spark):
    df = spark.createDataFrame(
        [(7, 4.0, 1.0, 9.0, 1), (7, None, None, 9.0, 1), (1, 2.0, 1.0, 9.0, 2), (1, None, 1.0, 9.0, 2), (None, 1.0, 1.0, 9.0, 2)],
        "s int, abs_error double, control_abs_error double, total_amount double, t int")
    one = attribution.attribution_did(df, "s", 7, time="t").first().asDict()
    every = next(r.asDict() for r in attribution.attribution_all(df, "s", time="t").collect() if r["segment"] == 7)
    assert {k: v for k, v in one.items() if k != "naive_amount"} == {k: every[k] for k in one if k != "naive_amount"}


def test_null_code_is_an_option(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "feed_month string, v string")
    assert rows(profile.scan_codes(df, ["v"])) == [("v", "None", "2", 1)]
    assert rows(profile.scan_codes(df, ["v"], null_as_code=False)) == []


def test_missing_column_is_not_null(spark):
    df = spark.sql("SELECT '1' feed_month, array('a') p, 'x' a, CAST(NULL AS string) b UNION ALL SELECT '2', array('a','b'), 'x', 'y'")
    # b is first present in period 2, so its codes there are the baseline, not new
    assert rows(profile.scan_codes(df, ["a", "b"], present="p")) == []


def test_attribution_without_a_baseline_has_no_lift(spark):
    df = spark.createDataFrame([(7, 4.0, 1.0, 9.0, 1), (None, 2.0, 2.0, 9.0, 2)], "s int, abs_error double, control_abs_error double, total_amount double, t int")
    one = attribution.attribution_did(df, "s", 7, time="t").first()
    assert (one["naive_mae_per_row"], one["did_mae_per_row"], one["baseline_rows"], one["null_segment_rows"]) == (3.0, 3.0, 0, 1)
    everyone = attribution.attribution_all(df, "s", time="t").first()
    assert (everyone["segment"], everyone["did_amount"], everyone["baseline_rows"]) == (7, 3.0, 0)


def test_indicator_rules(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 0.0, nan, None, 2.0, "x"), (2, 1.0, 1.0, None, 0.0, "y")], "s int, a double, b double, c double, d double, e string")
    stats = drift.segment_stats(df, "s", ["a", "b", "c", "d"])
    # NaN is skipped, a column without values is none, 2 is not binary, text is no input
    assert drift.indicators(stats, ["a", "b", "c", "d"]).first()[0] == ["a", "b"]
    assert drift.discover_inputs(df, "s") == ["a", "b", "c", "d"]


def test_empty_and_negative_monitors(spark):
    df = spark.createDataFrame([("1", " ", -1), ("1", "x", 0), ("2", None, 2)], "feed_month string, s string, n int")
    out = {r["feed_month"]: r for r in monitors.monitor_metrics(df, "s").collect()}
    assert (out["1"]["empty_count"], out["2"]["null_pct"]) == (1, 100.0)
    verdict = monitors.monitor_verdicts(df, "n").first()
    assert verdict["negative_count_fires"] and not verdict["zero_count_fires"] and not verdict["freshness_fires"]


def test_every_monitor_fires_where_it_should_and_is_silent_elsewhere(spark, tmp_path):
    def layer(name, rows_of, kind="string"):
        paths = {}
        for period, values, month in rows_of:
            paths[period] = str(tmp_path / name / period)
            rows = [(period, v, f"{month}-{d + 1:02d} 00:00:00") for d, v in enumerate(values)]
            made = spark.createDataFrame(rows, "feed_month string, x string, at string")
            if kind != "string" and period == "3":
                made = made.withColumn("x", F.col("x").cast(kind)).withColumn("extra", F.lit(1))
            made.write.parquet(paths[period])
        read = spark.read.schema("feed_month string, x string, at string").parquet(*[p for k, p in paths.items() if kind == "string" or k != "3"])
        rows = read.select("feed_month", "x", F.col("at").cast("timestamp_ntz").alias("at"))
        return rows, "x", {"time": "at", "max_gap_seconds": 40 * 86400.0, "schemas": monitors.schema_rows(spark, paths)}

    quiet = layer("quiet", [("1", ["1", "2"], "2001-01"), ("2", ["2", "1"], "2001-02"), ("3", ["1", "2"], "2001-03")])
    loud = layer("loud", [("1", ["1", "1", "1", "1", "1"], "2001-01"), ("2", ["0", "-1", "", None], "2001-06"), ("3", ["1"], "2001-07")], "int")
    loud = (loud[0].unionByName(spark.createDataFrame([("3", "7")], "feed_month string, x string").selectExpr("*", "timestamp_ntz'2001-07-01 00:00:00' as at")), *loud[1:])
    fires = {(r.layer, r.monitor): r.fires for r in monitors.monitor_sweep({"quiet": quiet, "loud": loud}).collect()}
    assert {m for layer_, m in fires if layer_ == "loud" and fires[layer_, m]} == set(monitors.MONITORS)
    assert [fires["quiet", m] for m in monitors.MONITORS] == [False] * len(monitors.MONITORS)
    assert monitors.monitor_verdicts(loud[0], "x", **loud[2]).first()["dtype_stable"] is False
    assert monitors.monitor_verdicts(quiet[0], "x", **quiet[2]).first()["dtype_stable"] is True
    unmeasured = monitors.monitor_verdicts(quiet[0], "x").first()
    assert unmeasured["schema_fires"] is None and unmeasured["freshness_fires"] is None and unmeasured["dtype_stable"] is None


def test_schema_changes_between_periods(spark):
    df = spark.createDataFrame(
        [("1", "a", "int"), ("1", "b", "int"), ("2", "a", "bigint"), ("2", "c", "int")], "feed_month string, column string, dtype string")
    out = sorted(rows(monitors.monitor_schema(df)))
    assert out == [("2", "a", "retyped", "int", "bigint"), ("2", "b", "removed", "int", None), ("2", "c", "added", None, "int")]


def test_disavowed_lines_do_not_count(spark):
    text = "fine\nevery alarm was silent\nWe no longer say every alarm was silent\r\nwithdrawn (2.0): every alarm is silent"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    banned = {"absolute": r"[Ee]very alarm (was|is)"}
    assert rows(claims.claims_banned(df, banned, ["we no longer"], ["withdrawn (2.0)"])) == [("absolute", "d", 2)]
    assert sorted(rows(claims.claims_banned(df, banned, [], []))) == [("absolute", "d", n) for n in (2, 3, 4)]


def test_claim_that_no_document_cites_is_reported(spark):
    df = spark.createDataFrame([("a", "90,322 here"), ("b", "none")], "doc_id string, text string")
    assert dict(rows(claims.claims_summary(df, {"amount": ["90,322.36", "90,322"], "lift": ["0.0731"]}))) == {"amount": 1, "lift": 0}
    assert rows(claims.claims_cited(df, {"amount": ["90,322.36", "90,322"], "lift": ["0.0731"]})) == [("amount", "a")]


def test_best_transformation_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("b.sql", "x y"), ("a.sql", "y x"), ("c.sql", "xy")], "path string, text string")
    scores = claims.locate_transformation(df, ["x"], "y")
    assert sorted(rows(scores)) == [("a.sql", 2), ("b.sql", 2)]
    assert rows(claims.best_transformation(scores)) == [("a.sql", 2)]
    assert rows(claims.best_transformation(scores.filter("score > 9"))) == []


def test_unknown_dataset(spark):
    names = [("urn:a.b", "raw.t"), ("urn:c.raw.t2", "raw.t2")]
    df = spark.createDataFrame([("urn:a.b",), ("raw.t2",), ("raw",), ("nope",)], "n string")
    assert [r[0] for r in rows(df.select(registry.resolve_dataset("n", names)))] == ["raw.t", "raw.t2", "raw.t", None]
    try:
        df.select(registry.resolve_dataset("n", names, strict=True)).collect()
        raise AssertionError("expected an error")
    except Exception as exc:  # noqa: BLE001
        assert "unknown dataset: nope" in str(exc)


def test_superseding_leaves_other_datasets_alone(spark):
    old = spark.createDataFrame([("d1", "a", "ACTIVE"), ("d2", "b", "ACTIVE"), ("d1", "c", "RESOLVED")], "dataset string, title string, state string")
    new = spark.createDataFrame([("d1", "n", "ACTIVE"), ("d1", "m", "ACTIVE")], old.schema)
    out = sorted(rows(ledger.supersede_incidents(old, new)))
    assert out == [("d1", "a", "RESOLVED"), ("d1", "c", "RESOLVED"), ("d1", "m", "ACTIVE"), ("d1", "n", "ACTIVE"), ("d2", "b", "ACTIVE")]
    assert rows(ledger.ledger_state(ledger.supersede_incidents(old, new))) == [(5, 3, 2)]


def test_notes_list_all_features(spark):
    cat = spark.createDataFrame([("d", "c", "old"), ("d", "x", "kept")], "dataset string, column string, description string")
    found = spark.createDataFrame([("d", "c", "changed.")], "dataset string, column string, change string")
    feats = spark.createDataFrame([("d", "c", f"f{i}") for i in range(9)], "dataset string, column string, feature string")
    out = dict((r[1], r[2]) for r in rows(ledger.annotate_column(cat, found, feats)))
    assert out == {"c": "old\n\n[decay] changed. Feeds 9: f0, f1, f2, f3, f4, f5, f6, f7, f8.", "x": "kept"}
    assert F is not None


def test_the_report_names_every_value_of_a_period_with_many(spark):
    d = "/root/testdata/sf0.001"
    feed = fx.feed(spark, d).select("feed_month", F.col("vendor_id").cast("int").alias("vendor_id"))
    late = feed.agg(F.max("feed_month")).first()[0]
    wide = feed.unionByName(spark.range(60).select(F.lit(late).alias("feed_month"), (F.col("id") + 1000).cast("int").alias("vendor_id")))
    report = diagnose.results_tables(wide, fx.mart(spark, d), fx.served(spark, d), "vendor_id", fx.NEW_CODE, "avg_speed_mph", ["trip_distance"])
    said = {r["key"]: r for r in report.where("section = 'values'").collect()}
    added = {str(1000 + i) for i in range(60)}
    assert added <= set(said[late]["a"].split(", ")) and added <= set(said[late]["b"].split(", "))
    assert all("values" not in r["a"] for r in said.values())


def test_the_registered_arms_have_the_settings_of_the_reference(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(scoring.GbtArm, "fit", lambda arm, rows, target: seen.append(dict(arm.settings)))
    record_queries.boosted(spark, "/root/testdata/sf0.001")
    assert seen == [scoring.GBT_SETTINGS] * 2 and scoring.GBT_SETTINGS["maxIter"] == 250


def training_rows(spark, n):
    noise = lambda i, m: F.abs(F.hash("id", F.lit(i))) % m
    data = spark.range(0, n, 1, 3).select(
        (noise(0, 1000) / 7).alias("a"), (noise(2, 300) - 100).alias("b"), noise(3, 2).alias("c"),
        noise(4, 24).alias("d"), F.lit(1).alias("e"), noise(5, 2).alias("f"), noise(6, 5).cast("double").alias("g"),
    )
    return data.withColumn("y", F.col("a") * F.col("d") / 50 + F.col("b") / 9 + F.col("c") * F.col("g") * 3)


@pytest.mark.parametrize(("n", "settings"), [
    (2, {"maxIter": 3, "maxDepth": 4, "seed": 42}), (4_000, {"maxIter": 12, "stepSize": 0.3, "maxDepth": 8, "seed": 42}), (24_000, {"maxIter": 4, "maxDepth": 5, "seed": 7}),
])
def test_trees_are_those_of_mllib(spark, monkeypatch, n, settings):
    monkeypatch.setattr(boosting, "KEPT_TREES", 5)
    data, names = training_rows(spark, n), ["a", "b", "c", "d", "e", "f", "g"]
    arm = scoring.GbtArm(names, ["1"], settings, "e")
    ours = arm.fit(data, "y").stages[-1]
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(data)
    theirs = GBTRegressor(labelCol="y", **settings).fit(rows)
    both = theirs.transform(rows).withColumnRenamed("prediction", "p")
    off = F.max(F.abs(F.col("p") - F.col("prediction")))
    assert ours.transform(both).agg(F.count("*"), off < 1e-9).first()[:] == (n, True)
    assert ours.getNumTrees == theirs.getNumTrees and ours.treeWeights == theirs.treeWeights
    assert list(ours.featureImportances) == pytest.approx(list(theirs.featureImportances), abs=0.02)


def test_blocks_come_back_chunk_by_chunk(monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_A_CHUNK", 4)
    codes, left = np.arange(22, dtype=np.uint8).reshape(2, 11), np.arange(11.0)
    block = boosting.Block([np.ascontiguousarray(codes[:, b : b + 4]) for b in (0, 4, 8)], left)
    back = boosting.unpacked(block.packed())
    assert [c.tolist() for c in back.codes] == [c.tolist() for c in block.codes] and back.left.tolist() == left.tolist()


def test_values_that_are_null_or_missing_stop_the_training(spark):
    arm = scoring.GbtArm(["a"], ["1"], {"maxIter": 2, "maxDepth": 2, "seed": 42}, "p")
    with pytest.raises(Exception, match="Null or NaN"):
        arm.fit(spark.createDataFrame([(1.0, "1", 2.0), (2.0, "1", None)], "a double, p string, y double"), "y")
    with pytest.raises(Exception, match="Null, NaN or Infinity"):
        arm.fit(spark.createDataFrame([(1.0, "1", 2.0), (None, "1", 3.0)], "a double, p string, y double"), "y")
    with pytest.raises(ValueError, match="no rows"):
        arm.fit(spark.createDataFrame([(1.0, "2", 2.0)], "a double, p string, y double"), "y")


def test_training_holds_a_row_in_a_few_bytes(spark):
    n, most, done = 40_000, [0], threading.Event()

    def watch():
        while not done.wait(0.02):
            most.append(sum(x.memSize() + x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()))

    rows = training_rows(spark, n).repartition(2)
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        scoring.GbtArm(["a", "b", "c", "d", "e", "f", "g"], ["1"], {"maxIter": 5, "maxDepth": 4, "seed": 42}, "e").fit(rows, "y")
    finally:
        done.set()
        watcher.join()
    assert 0 < max(most) < 50 * n  # objects of a row took more than 100


def test_arms_are_trained_at_the_same_time(spark):
    both = threading.Barrier(2, timeout=60)  # broken if one arm waits for the other to end

    class Meeting(scoring.GbtArm):
        def fit(self, rows, target):
            both.wait()
            return super().fit(rows, target)

    data = spark.range(400).selectExpr("id % 7 as a", "cast(id % 3 as string) as feed_month", "double(id % 7 + id % 2) as y")
    few = {"maxIter": 2, "maxDepth": 2, "seed": 42}
    arms = {"predicted_total": Meeting(["a"], ["0", "1"], few), "control_predicted_total": Meeting(["a"], ["0", "1", "2"], few)}
    models = scoring.fit_arms(data, arms, "y")
    assert [models[n].stages[-1].getNumTrees for n in arms] == [2, 2]
    out = scoring.score_models(data, models, "y")
    assert out.count() == 400 and out.where("predicted_total is null or control_predicted_total is null").isEmpty()


def test_features_are_listed_of_found_columns_only_and_dealt_once(spark):
    cat = spark.createDataFrame([("d", "c", "old"), ("d", "x", "kept")], "dataset string, column string, description string")
    found = spark.createDataFrame([("d", "c", "changed.")], "dataset string, column string, change string")
    feats = spark.range(4000).selectExpr("'d' as dataset", "if(id % 2 = 0, 'c', 'x') as column", "concat('f', id % 8) as feature")
    out = ledger.annotate_column(cat, found, feats, tasks=3)
    assert sorted(rows(out)) == [("d", "c", "old\n\n[decay] changed. Feeds 4: f0, f2, f4, f6."), ("d", "x", "kept")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "3), REPARTITION_BY_NUM" in plan


def test_notes_of_parts_deal_numbers_into_tasks_by_their_lines(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    before = sorted(rows(record_queries.part_notes(spark, d)))
    monkeypatch.setattr(record_queries, "LINES_A_TASK", 1000)
    many = record_queries.part_notes(spark, d)
    tasks = -(-fx.table(spark, d, "lineitem").count() // 1000)
    assert tasks > 1 and f"{tasks}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(many)) == before


def test_the_report_derives_the_feed_once(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    want = sorted(rows(fx.feed(spark, d)), key=str)

    def again(*_):
        raise AssertionError("the feed is derived once more")

    monkeypatch.setattr(fx, "feed", again)
    source, _ = fx.source_layer(spark, d)
    assert "l_orderkey" not in source._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(source), key=str) == want
    assert record_queries.results(spark, d).where("section = 'impact'").count() == 1

from conftest import rows

from decaytrace.operators import claims, runs
from decaytrace.session import materialize, scratch_path, shared_dir
from decaytrace.sources import feeds, records, tables


def test_sql_texts_are_read_whole(spark, tmp_path):
    (tmp_path / "marts").mkdir()
    (tmp_path / "marts" / "fct.sql").write_text("select is_a,\n is_b\nfrom x -- vendor_id")
    (tmp_path / "stg.sql").write_text("select vendor_id from raw")
    (tmp_path / "notes.md").write_text("is_a is_b vendor_id")
    texts = records.read_sql_texts(spark, str(tmp_path))
    assert texts.count() == 2
    best = claims.best_transformation(claims.locate_transformation(texts, ["is_a", "is_b"], "vendor_id")).first()
    assert best["path"].endswith("marts/fct.sql") and best["score"] == 3


def test_run_documents(spark, tmp_path):
    (tmp_path / "run.json").write_text(
        '{"run_id": "r1", "turns": 2, "trace": [\n {"index": 1, "tool": "catalog_search", "arguments": {"q": "x"}, "elapsed_ms": 5},\n'
        ' {"index": 2, "tool": "profile_column", "arguments": {}, "elapsed_ms": 7}]}')
    steps = records.trace_steps(records.read_run_json(spark, str(tmp_path)))
    assert rows(runs.run_summary(steps, "catalog_")) == [("r1", 2, 1, 2, 12)]


def test_long_run_is_split_over_documents(spark):
    turns = spark.range(1200).selectExpr("7 conv_id", "id turn", "'user' role", "'x' text")
    docs = runs.as_run_records(turns)
    assert sorted(len(r["trace"]) for r in docs.collect()) == [200, 500, 500]
    assert [s["index"] for s in docs.collect()[0]["trace"]] == sorted(s["index"] for s in docs.collect()[0]["trace"])


def test_catalog_document(spark):
    doc = '{"nodes": {"model.t": {"columns": {"a": {"type": "INTEGER", "index": 1}, "b": {"type": "VARCHAR", "index": 2}}}}}'
    df = spark.createDataFrame([(doc,)], "d string")
    assert sorted(rows(records.catalog_columns(df, "d"))) == [("model.t", "a", "INTEGER", 1), ("model.t", "b", "VARCHAR", 2)]


def test_period_from_file_name_and_missing_columns(spark, tmp_path):
    spark.sql("SELECT 1 a").write.parquet(str(tmp_path / "m=2024-01"))
    spark.sql("SELECT 2 a, 'x' b").write.parquet(str(tmp_path / "m=2024-02"))
    assert sorted(rows(feeds.tag_period(spark, str(tmp_path), r"m=([0-9-]+)").select("feed_month"))) == [("2024-01",), ("2024-02",)]
    out = feeds.scan_tolerant(spark, {m: str(tmp_path / f"m={m}") for m in ("2024-01", "2024-02")}, ["a", "b", "zzz"])
    assert sorted(rows(out.select("feed_month", "present_columns", "a", "b"))) == [("2024-01", ["a"], 1, None), ("2024-02", ["a", "b"], 2, "x")]


def test_predictions_replace_only_their_period(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.sql("SELECT 1 id, '2024-01' feed_month UNION ALL SELECT 2, '2024-02'")
    tables.write_predictions(one, path)
    out = tables.write_predictions(spark.sql("SELECT 9 id, '2024-02' feed_month"), path)
    assert sorted(rows(out)) == [(1, "2024-01"), (9, "2024-02")]
    assert sorted(rows(tables.write_raw(one.filter("id = 1"), path))) == [(1, "2024-01")]


def test_intermediate_results_go_to_the_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    plan = materialize(spark.range(10).groupBy().count())._jdf.queryExecution().toString()
    assert shared_dir(spark) in plan


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as Fake

    import pytest

    unset = Fake(get=lambda *_: None)
    cluster = Fake(conf=unset, sparkContext=Fake(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)

"""Registered queries against their SQL, and what their plans may not contain.

Set ALL_QUERIES=1 to compare every registered query; by default a sample that
touches each operator module is compared.
"""

import os
import subprocess
import sys

import check
import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "mart_features", "one_hot_catchall", "safe_double", "new_values", "scan_codes", "unseen_categories", "profile_all_columns",
    "monitor_metrics", "monitor_verdicts", "drift_report", "attribution_all", "attribution_did", "three_arm_attribution",
    "verify_fix", "reject_row_dropping", "lineage_upstream", "lineage_paths_between", "emit_ml_nodes", "run_cost", "write_predictions",
    "scan_tolerant", "read_run_json", "token_merge", "incident_rows", "supersede_incidents", "claims_banned", "diagnose",
    "below_runs", "keep_ranges", "nearest_snap", "stream_monitors",
]
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_matches_sql(spark, con, name):
    problems, _ = check.compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert problems == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["mart_features", "profile_all_columns", "below_runs", "column_impact", "claims_cited", "annotate_column"])
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["period_eq"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_entry(spark):
    assert entry_point.entry(spark).count() == 4


def test_only_the_boosted_trees_lack_sql():
    assert {q for q in QUERIES if not q.startswith("op") and q != "pipeline"} - set(ORACLES) == {"train_arms"}


def test_the_rest_works_without_the_text_operators():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['decaytrace.llm'] = None\n"
        "import __spark_entry__ as e; assert 'attribution_all' in e.queries() and 'pipeline' not in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry_point.__file__), timeout=120)

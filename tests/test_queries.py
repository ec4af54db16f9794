"""Registered queries: plans stay in Spark, and a few agree with their SQL end to end."""

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry
from check import canonical
from trailspark.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
COMPARED = ("T12_compute_score", "T13_audit_report", "O1_evaluate_criteria", "B5_bom_hash", "H3_order_hash", "G8_gate_report", "C8_snapshot_diff")

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables not present")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1500


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_python_and_no_products(spark, name):
    run = QUERIES[name](spark, FOLDER)._jdf.queryExecution()
    for word in ("PythonUDF", "MapInPandas", "FlatMapGroups", "ArrowEval", "Join Cross"):
        assert word not in run.analyzed().toString()
    for word in ("NestedLoopJoin", "CartesianProduct"):
        assert word not in run.executedPlan().toString()


@pytest.mark.parametrize("name", COMPARED)
def test_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    ours = canonical(entry.queries()[name](spark, FOLDER).toPandas())
    theirs = canonical(db.sql(entry.oracle_sql()[name]).df())
    assert ours.equals(theirs)

"""Line items dealt out by contract: the same rows, and no exchange beside the deal."""

import datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from trailspark.functions import groups
from trailspark.operators import gates as gt
from trailspark.plans import auditing, ordering, storing  # noqa: F401 (registers)
from trailspark.plans.registry import BUILDERS, QUERIES, cut, plain
from trailspark.session import tune
from trailspark.sources.projection import Projection


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("lines"))
    day = datetime.date(2024, 1, 1)
    lines = [(k, 10 + (k + n) % 7, 1 + (k * n) % 5, n, float(n), 0.0, 0.08, "ANR"[n % 3], "FO"[n % 2], day) for k in range(1, 9) for n in range(1, 6)]
    lines += [lines[0], (None, 11, 2, 1, 1.0, 0.0, 0.0, "A", "F", day)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{out}/lineitem.parquet")
    return out


def _projection(spark, folder, gather):
    p = Projection(tune(spark), folder)
    if gather:
        p.gather()
    return p


@pytest.mark.parametrize("name", ["order_control", "evidence", "attestation_evidence", "poam"])
def test_gathered_tables_are_the_same(spark, folder, name):
    assert rows(getattr(_projection(spark, folder, True), name)) == rows(getattr(_projection(spark, folder, False), name))


def test_united_and_grouped_in_place(spark, folder):
    p = _projection(spark, folder, True)
    both = p.order_control.unionByName(p.addresses.join(p.evidence, ["contract_id", "evidence_id"]).select("contract_id", "control_id"))
    plan = both.distinct()._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_NUM" in plan


def test_backward_map_of_gathered_lines(spark, folder):
    found = [rows(BUILDERS["G8_backward_map"](_projection(spark, folder, g))) for g in (True, False)]
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("paired", [0, 2, 16])
def test_pairs_and_followed_claims_agree(frame, monkeypatch, paired):
    """Contract 1 has 5 modules and 5 controls, 2 has one control, 3 has no module."""
    monkeypatch.setattr(gt, "PAIRED", paired)
    required = [(1, c) for c in range(5)] + [(2, 3), (3, 1), (None, 1)]
    included = [(1, m) for m in range(5)] + [(2, m) for m in range(5)] + [(2, 0), (None, 1)]
    claims = [(m, c) for m in range(5) for c in range(5) if (m * c) % 3 == 1] + [(0, 3), (0, 4), (4, 3)]
    found = gt.included_controls(frame("contract_id int, control_id int", *required), frame("module_id int, control_id int", *claims),
                                 frame("contract_id int, module_id int", *included))
    brute = {(k, m, c) for k, m in included for j, c in required if k is not None and k == j and (m, c) in set(claims)}
    assert rows(found) == sorted(brute, key=lambda r: [(False, str(v)) for v in r])


def _stored(spark, folder):
    p = _projection(spark, folder, True)
    p.store_lines()
    return p


@pytest.mark.parametrize("name", ["order_control", "order_module", "evidence", "attestation_evidence", "poam", "obligation_derive"])
def test_stored_lines_give_the_same(spark, folder, name):
    assert rows(getattr(_stored(spark, folder), name)) == rows(getattr(_projection(spark, folder, False), name))


def test_stored_lines_are_united_and_grouped_in_place(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _stored(spark, folder)
        linked = p.addresses.join(p.evidence, ["contract_id", "evidence_id"]).select("contract_id", "content_hash")
        both = linked.unionByName(p.attestation.selectExpr("contract_id", "att_id AS content_hash")).distinct()
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        whole = _projection(spark, folder, False)
        linked = whole.addresses.join(whole.evidence, ["contract_id", "evidence_id"]).select("contract_id", "content_hash")
        assert rows(both) == rows(linked.unionByName(whole.attestation.selectExpr("contract_id", "att_id AS content_hash")).distinct())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_claimers_are_dealt_once(spark, frame):
    """The claims of a control meet in one exchange, and give the digest that the leaves give."""
    claims = frame("module_id int, control_id int", *[(m, c) for m in range(9) for c in range(4)], (1, None), (0, 0))
    found = gt._claimers(claims)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert rows(found) == rows(gt.group_digest(claims, ["control_id"], F.col("module_id").cast("string"), "modules_digest"))


def test_claims_without_a_module_count_in_the_proof(spark, frame):
    """A control that only a null module claims has a digest, unlike one that nobody claims."""
    required, included = frame("contract_id int, control_id int", (1, 1), (2, 2)), frame("contract_id int, module_id int", (1, 5), (2, 5))
    modules = frame("module_id int, method string", (5, "m"))
    lines = rows(gt.proof_lines(required, frame("module_id int, control_id int", (None, 1)), modules, included))
    assert [line for _, line in lines if line == "forward 2 -"] and not [line for _, line in lines if line == "forward 1 -"]


@pytest.mark.parametrize("listed", [0, 3, 8192])
def test_claiming_modules_of_lists_and_rows_agree(frame, monkeypatch, listed):
    """Module 1 has two records, 2 and 4 no method, 3 and the null one no record."""
    monkeypatch.setattr(gt, "LISTED", listed)
    required = [(1, 1), (1, 2), (1, 2), (2, 3), (3, 9), (4, 1), (4, 4), (None, 1)]
    claims = [(1, 1), (1, 2), (2, 1), (3, 2), (4, 3), (4, 3), (None, 2), (5, 4), (5, 1)]
    modules = [(1, "a"), (1, None), (2, None), (4, None), (5, "b")]
    found = gt.claiming_modules(frame("contract_id int, control_id int", *required), frame("module_id int, control_id int", *claims),
                                frame("module_id int, method string", *modules))
    records = lambda m: [x for k, x in modules if m is not None and k == m] or [None]
    sets = {k: {m for j, c in required for m, d in claims if j == k and c == d} for k, _ in required}
    brute = [(k, sum(len(records(m)) for m in s), sum(x is None for m in s for x in records(m))) for k, s in sets.items() if s]
    assert rows(found) == sorted(brute, key=lambda r: [(v is None, str(v)) for v in r])


def test_controls_bring_claiming_modules_as_lists(spark, frame):
    """The join on the control alone gives a row per required control, not one per claiming module."""
    required = frame("contract_id int, control_id int", *[(k, c) for k in range(5) for c in range(3)])
    claims = frame("module_id int, control_id int", *[(m, c) for m in range(40) for c in range(3)])
    found = gt.claiming_modules(required, claims, frame("module_id int, method string", *[(m, "x") for m in range(40)]))
    assert rows(found) == [(k, 40, 0) for k in range(5)]
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_grow_with_the_lines(spark, folder, monkeypatch):
    monkeypatch.setattr(groups, "TASK_ROWS", 6)
    try:
        p = _stored(spark, folder)
        assert p._lines.rdd.getNumPartitions() == 7 and p.by_contract(p.order_control).rdd.getNumPartitions() == 7
        assert rows(p.evidence) == rows(_projection(spark, folder, False).evidence)
        p = _stored(spark, folder)
        cut(p, "poam")
        plan = p.poam.join(p.attestation, ["contract_id", "control_id"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        assert rows(p.poam) == rows(_projection(spark, folder, False).poam)
    finally:
        groups.deal_for(spark, 0)


@pytest.fixture(scope="module")
def tables(spark, folder):
    """The other tables beside the lines; order 3 comes twice, order 9 has no line."""
    spark.createDataFrame([(k, k % 3, "FOP"[k % 3], "2-HIGH") for k in (1, 2, 3, 3, 4, 5, 6, 7, 8, 9)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, f"part {k}", "type", k % 50) for k in range(10, 18)],
                          "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k, f"supplier {k}", k % 2) for k in range(1, 6)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "AMERICA"), (1, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    return folder


@pytest.mark.parametrize("name", ["B1_bom_rows", "B2_evidence_backing", "T13_audit_report", "H5_graph_hash", "H6_dataset_fingerprint"])
def test_queries_read_stored_lines_and_give_the_same(spark, tables, name):
    found = QUERIES[name](spark, tables)
    assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(plain(BUILDERS[name](_projection(spark, tables, False)))) and rows(found)


def test_facts_read_the_hashes_of_the_documents_from_a_table(spark, tables):
    found = QUERIES["B8_bom_facts"](spark, tables)
    assert "collect_set" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(plain(BUILDERS["B8_bom_facts"](_projection(spark, tables, False))))

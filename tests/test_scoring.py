"""Scores, contradictions and the audit in both directions."""

import pytest
from helpers import rows
from pyspark.sql import functions as F
from trailspark.operators import audit as au

ATT = ("contract_id string, att_id string, control_id string, outcome string, oracle_outcome string, "
       "backed_by string, override_justification string, override_evidence string")


def att(control, outcome="passed", oracle=None, backed=None, why=None, proof=None, contract="K"):
    return (contract, f"ATT-{contract}-{control}", control, outcome, oracle, backed, why, proof)


CONTROL = "control_id string, weight long, poam_eligible boolean, variable_weight boolean, weight_if_partial long"


def control(cid, weight=1, eligible=None, variable=None, partial=None):
    return (cid, weight, eligible, variable, partial)


def score(frame, controls, attestations, required, poam=(), headers=("K",)):
    met = au.met_attestations(frame(ATT, *attestations))
    return {
        r["contract_id"]: r
        for r in au.compute_score(
            frame("contract_id string", *[(h,) for h in headers]),
            frame("contract_id string, control_id string", *[("K", c) for c in required]),
            frame(CONTROL, *controls), met,
            frame("contract_id string, control_id string", *[("K", c) for c in poam]),
        ).collect()
    }


def test_everything_met_is_final(frame):
    r = score(frame, [control("a", 5), control("b", 1)], [att("a"), att("b")], ["a", "b"])["K"]
    assert (r["score"], r["status"], r["valid_submission"], r["unmet"]) == (110, "Final", True, 0)


@pytest.mark.parametrize("unmet, score_, status", [(22, 88, "Conditional"), (23, 87, "Ineligible")])
def test_floor_of_conditional(frame, unmet, score_, status):
    controls = [control(f"c{i}") for i in range(23)]
    signed = [att(f"c{i}") for i in range(unmet, 23)]
    r = score(frame, controls, signed or [att("none")], [f"c{i}" for i in range(23)])["K"]
    assert (r["score"], r["status"]) == (score_, status)


def test_poam_legality(frame):
    controls = [control("heavy", 5, True), control("open", 1, True), control("excluded", 1, False), control("bare", 1)]
    ids = [c[0] for c in controls]
    r = score(frame, controls, [att("other")], ids, poam=ids)["K"]
    assert (r["score"], r["illegal_poam"], r["valid_submission"]) == (102, 3, False)
    assert score(frame, controls, [att("other")], ["open"], poam=["open"])["K"]["valid_submission"]


def test_contradiction_is_deducted_and_voids(frame):
    signed = [att("a", oracle="failed"), att("b", oracle="passed")]
    r = score(frame, [control("a", 5), control("b", 1)], signed, ["a", "b"])["K"]
    assert (r["score"], r["status"], r["valid_submission"], r["contradictions"]) == (105, "Conditional", False, 1)


def test_full_override_clears_a_contradiction(frame):
    full = au.met_attestations(frame(ATT, att("a", oracle="failed", why="w", proof="p")))
    half = au.met_attestations(frame(ATT, att("a", oracle="failed", why="w")))
    assert rows(au.contradictions(full)) == []
    assert rows(au.contradictions(half), "control_id", "oracle_outcome") == [("a", "failed")]
    assert half.first()["justification_only"]


def test_absent_oracle_contradicts_only_when_backed(frame):
    met = au.met_attestations(frame(ATT, att("a", backed="x"), att("b"), att("c", oracle="needsAction", backed="x"),
                                    att("d", "failed", backed="x")))
    assert rows(au.contradictions(met), "control_id", "oracle_outcome") == [("a", "absent")]
    assert rows(au.proven_vs_attested(met), "met_by_machine", "met_by_human_only") == [(0, 3)]


def test_contract_without_scope_is_scored_over_the_catalog(frame):
    controls = [control("a", 5), control("b", 3), control("c", 1), control("d", None)]
    signed = [att("a", contract="E"), att("b", oracle="failed", contract="E"), att("a")]
    r = score(frame, controls, signed, ["a"], headers=("K", "E", "N"))
    assert (r["K"]["score"], r["K"]["controls"]) == (110, 1)
    assert (r["E"]["score"], r["E"]["unmet"], r["E"]["contradictions"]) == (106, 2, 1)
    assert (r["N"]["score"], r["N"]["controls"]) == (101, 3)


def test_met_ids_still_list_contradicted_controls(frame):
    met = au.met_attestations(frame(ATT, att("a", oracle="failed")))
    assert rows(au.met_control_ids(met)) == [("K", "a")]


PAIR = "contract_id string, control_id string"
ADDR = "contract_id string, evidence_id string, control_id string"


def test_forward_reasons(frame):
    got = au.forward_trace(
        frame(PAIR, ("K", "a"), ("K", "b"), ("K", "c"), ("K", "d")),
        frame("module_id string, control_id string", ("m", "b"), ("m", "c"), ("m", "d")),
        frame(ATT, att("d")), frame(ADDR, ("K", "e1", "b")),
    )
    assert rows(got, "control_id", "reason") == [
        ("a", "no-claiming-module"), ("b", "evidence-but-no-attestation"), ("c", "not-attested")]


def test_backward_needs_evidence_of_the_same_control(frame):
    cited = frame("contract_id string, att_id string, evidence_id string",
                  ("K", "ATT-K-a", "e1"), ("K", "ATT-K-a", "e2"), ("L", "ATT-L-a", "e1"))
    signed = frame(ATT, att("a"), att("a", contract="L"))
    addresses = frame(ADDR, ("K", "e1", "a"), ("K", "e2", "b"))
    assert rows(au.backward_trace(signed, cited, addresses), "contract_id", "evidence_id") == [("K", "e2"), ("L", "e1")]
    both = au.bidirectional(frame(PAIR, ("K", "a")), frame("module_id string, control_id string", ("m", "a")),
                            signed, cited, addresses)
    assert rows(both, "contract_id", "forward_passed", "backward_passed", "passed") == [
        ("K", True, False, False), ("L", True, False, False)]


def test_coverage_and_orphans(frame):
    signed = frame(ATT, att("a"), att("b", "needsAction"), att("c", "failed"))
    addresses = frame(ADDR, ("K", "1", "a"), ("K", "2", "b"), ("K", "3", "c"), ("K", "4", "d"))
    assert [r[-1] for r in rows(au.coverage_matrix(addresses, signed), "control_id", "status")] == [
        "covered+passed", "covered+needsAction", "covered+failed", "covered+unattested"]
    evidence = frame("contract_id string, evidence_id string", ("K", "1"), ("K", "9"))
    found = au.orphans(frame(PAIR, ("K", "a"), ("K", "z")), evidence, addresses)
    assert rows(found, "kind", "subject") == [("control-without-evidence", "z"), ("evidence-without-control", "9")]


def test_stored_tables_join_without_exchange(spark):
    import re

    from trailspark.session import durable_buckets, scratch

    with scratch(spark):
        data = lambda n: spark.range(n).selectExpr("id % 50 AS contract_id", "id AS control_id", "id * 2 AS x")
        left, right = (durable_buckets(data(n), "contract_id", "control_id", buckets=4) for n in (3000, 2000))
        pairs = left.hint("merge").join(right.withColumnRenamed("x", "y"), ["contract_id", "control_id"])
        per = pairs.groupBy("contract_id", "control_id").agg(F.sum("y").alias("y"))
        assert "Exchange" not in re.sub(r"\w+BroadcastExchange", "", per._jdf.queryExecution().executedPlan().toString())
        assert per.count() == 2000


def test_scores_of_contracts_with_and_without_scope(frame):
    control = frame("control_id string, weight long, poam_eligible boolean", ("a", 5, False), ("b", 3, True), ("c", 1, True), ("d", None, None))
    hdr = frame("contract_id long", (1,), (2,), (3,), (4,))
    required = frame("contract_id long, control_id string", (1, "a"), (1, "b"), (4, "d"), (9, "c"))
    met = frame("contract_id long, control_id string, att_id string, met boolean, contradicted boolean, oracle_outcome string",
                (1, "a", "x", True, False, "passed"), (1, "c", "y", True, False, None), (2, "a", "z", True, True, "failed"),
                (2, "b", "v", True, False, None), (8, "a", "w", True, False, None))
    poam = frame("contract_id long, control_id string", (1, "b"), (2, "c"), (2, "a"))
    got = rows(au.compute_score(hdr, required, control, met, poam), "contract_id", "score", "controls", "unmet", "illegal_poam", "contradictions")
    # 1: b unmet, planned by an ineligible weight; 2 and 3: whole catalog; 4: nothing scorable; 8: neither known nor scoped; 9: no header.
    assert got == [(1, 107, 2, 1, 1, 0), (2, 104, 3, 2, 1, 1), (3, 101, 3, 3, 0, 0), (9, 109, 1, 1, 0, 0)]

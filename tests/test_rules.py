"""Criteria, freshness, attested references, sign-off log, obligations and gates."""

from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F
from trailspark.functions import vocab
from trailspark.operators import attest as at
from trailspark.operators import gates as gt
from trailspark.operators import obligations as ob
from trailspark.operators import oracles as orc
from trailspark.operators import validate as va

EV = "contract_id string, evidence_id string, summary string, seq int"
ADDR = "contract_id string, evidence_id string, control_id string"


@pytest.mark.parametrize("control, summary, outcome, reason", [
    ("IA.L2-3.5.3", '{"mfa_enforced_privileged": true}', "passed", None),
    ("IA.L2-3.5.3", '{"mfa_enforced_privileged": false}', "failed", None),
    ("IA.L2-3.5.3", '{"mfa_enforced_privileged": "true"}', "failed", None),
    ("IA.L2-3.5.3", '{"mfa_enforced_privileged": null}', "failed", None),
    ("IA.L2-3.5.3", '{"other": 1}', "needsAction", "metric-absent"),
    ("AC.L2-3.1.1", '{"unauthorized_principals": 0}', "passed", None),
    ("AC.L2-3.1.10", '{"idle_session_timeout_minutes": 15}', "passed", None),
    ("AC.L2-3.1.10", '{"idle_session_timeout_minutes": 16}', "failed", None),
    ("IA.L2-3.5.5", '{"identifier_reuse_days": 90}', "passed", None),
    ("SC.L2-3.13.8", '{"tls_minimum_version": "1.3"}', "passed", None),
    ("SC.L2-3.13.8", '{"tls_minimum_version": "1.10"}', "failed", None),
    ("ITAR-120.54", '{"data_region": "US"}', "passed", None),
    ("PS.L2-3.9.1", '{"x": 1}', "needsAction", "no-machine-criterion"),
])
def test_builtin_criteria(spark, frame, control, summary, outcome, reason):
    got = orc.evaluate_criteria(
        frame(EV, ("K", "e", summary, 0)), frame(ADDR, ("K", "e", control)), vocab.criteria(spark))
    assert rows(got, "outcome", "reason") == [(outcome, reason)]


def test_other_comparators(frame):
    rules = frame("control_id string, metric_key string, comparator string, threshold string",
                  ("in", "v", "in", '["a", "b"]'), ("ne", "v", "ne", "3"), ("num", "v", "in", "[1, 2]"))
    facts = frame(EV, ("K", "e1", '{"v": "b"}', 0), ("K", "e2", '{"v": 2}', 1))
    pairs = frame(ADDR, *[("K", e, c) for e in ("e1", "e2") for c in ("in", "ne", "num")])
    got = dict(((r[0], r[1]), r[2]) for r in rows(orc.evaluate_criteria(facts, pairs, rules), "evidence_id", "control_id", "outcome"))
    assert got == {("e1", "in"): "passed", ("e1", "ne"): "passed", ("e1", "num"): "failed",
                   ("e2", "in"): "failed", ("e2", "ne"): "passed", ("e2", "num"): "passed"}


def test_last_evidence_decides(frame):
    results = frame("contract_id string, evidence_id string, control_id string, outcome string, seq int",
                    ("K", "e1", "a", "failed", 1), ("K", "e2", "a", "passed", 0))
    assert rows(orc.control_outcomes_last_wins(results), "outcome") == [("failed",)]


NOW = datetime(2026, 7, 1)


@pytest.mark.parametrize("verified, days, fresh, reason, age", [
    (datetime(2026, 4, 2), 90, True, "fresh", 90),
    (datetime(2026, 4, 1, 23, 59, 59), 90, False, "stale:90d>90d", 90),
    (datetime(2020, 1, 1), 0, True, "event-based", None),
    (datetime(2026, 1, 1), 30, False, "stale:181d>30d", 181),
])
def test_freshness(frame, verified, days, fresh, reason, age):
    refs = frame("reference_id string, last_verified timestamp, freshness_days int", ("r", verified, days))
    assert rows(orc.check_freshness(refs, F.lit(NOW)), "is_fresh", "reason", "age_days") == [(fresh, reason, age)]


REF = ("reference_id string, uri string, freshness_days int, last_verified timestamp, signature string, "
       "signature_verified boolean, resolved_ok boolean")
LOG = ("id string, signer string, signer_role string, signed_at string, covers array<string>, controls_attested array<string>, "
       "outcome string, adequacy string, sufficiency string, sig string, sig_algo string, notes string, "
       "override_justification string, override_evidence string, _file string, _line long")


def record(id_="r1", role="Role_AffirmingOfficial", at_="2026-06-20T12:00:00+00:00", covers=("R",), controls=("C",),
           outcome="passed", adequacy="a", sufficiency="s", sig=None, algo="none", why=None, proof=None, line=1, file="f"):
    return (id_, "N", role, at_, list(covers), list(controls), outcome, adequacy, sufficiency, sig, algo, "", why, proof, file, line)


GOOD = ("R", "file://documents/x.md", 365, datetime(2026, 6, 15), "sig", True, True)


def swap(base, **changes):
    names = ["reference_id", "uri", "freshness_days", "last_verified", "signature", "signature_verified", "resolved_ok"]
    return tuple(changes.get(n, v) for n, v in zip(names, base))


@pytest.mark.parametrize("reference, log, outcome, reason", [
    (swap(GOOD, reference_id="other"), [record()], "needsAction", "reference-missing"),
    (swap(GOOD, uri=" "), [record()], "failed", "reference-unresolvable"),
    (swap(GOOD, resolved_ok=False), [record()], "failed", "reference-unresolvable"),
    (swap(GOOD, last_verified=None), [record()], "needsAction", "reference-never-verified"),
    (swap(GOOD, freshness_days=10), [record()], "failed", "stale:16d>10d"),
    (swap(GOOD, signature=None), [record()], "needsAction", "signature-missing"),
    (swap(GOOD, signature_verified=False), [record()], "failed", "signature-invalid"),
    (GOOD, [record(controls=["X"])], "needsAction", "awaiting-attestation"),
    (GOOD, [record(covers=["X"])], "needsAction", "awaiting-attestation"),
    (GOOD, [record(role="Role_OPs")], "failed", "signer-role-mismatch:Role_OPs!=Role_ITAdmin"),
    (GOOD, [record(role="Role_ITAdmin")], "passed", None),
    (GOOD, [record(at_="2026-06-01T00:00:00+00:00")], "failed", "attestation-predates-reference"),
    (GOOD, [record(outcome="needsAction")], "needsAction", "attestation-outcome:needsAction"),
    (GOOD, [record(outcome="failed")], "failed", None),
    (swap(GOOD, signature_verified=None, resolved_ok=None), [record()], "passed", None),
    (GOOD, [record("old", outcome="failed", at_="2026-06-16T00:00:00+00:00"), record("new", line=2)], "passed", None),
    (GOOD, [record("first", outcome="failed"), record("second", line=2)], "failed", None),
])
def test_reference_decision_list(frame, reference, log, outcome, reason):
    uses = frame("control_id string, reference_id string, cover_key string, required_role string", ("C", "R", "R", "Role_ITAdmin"))
    got = orc.evaluate_attested_reference(uses, frame(REF, reference), orc.latest_attestation(frame(LOG, *log)), F.lit(NOW))
    assert rows(got, "outcome", "reason") == [(outcome, reason)]


@pytest.mark.parametrize("bad, reason", [
    (record(id_=""), "empty-id"), (record(role="Boss"), "bad-role"), (record(outcome="untested"), "bad-outcome"),
    (record(covers=[]), "empty-covers"), (record(controls=[]), "empty-controls"), (record(at_="soon"), "bad-timestamp"),
    (record(at_="2026-06-20T12:00:00"), "naive-timestamp"), (record(adequacy=""), "passed-without-rationale"),
    (record(algo="rot13", sig="x"), "bad-sig-algo"), (record(sig="x"), "sig-without-algo"),
    (record(algo="ed25519-v1"), "algo-without-sig"), (record(why="w"), "justification-without-evidence"),
])
def test_log_rules(frame, bad, reason):
    valid, rejects = at.validate_attestation_log(frame(LOG, bad))
    assert valid.count() == 0
    assert rows(rejects, "reason") == [(reason,)]


def test_log_accepts_and_finds_repeats(frame):
    log = frame(LOG, record(), record(line=2), record(file="g"), record("u", algo="ed25519-v1", sig="x", at_="2026-06-20T12:00:00Z", line=3))
    valid, rejects = at.validate_attestation_log(log)
    assert rows(valid, "_file", "id", "_line") == [("f", "r1", 1), ("f", "u", 3), ("g", "r1", 1)]
    assert rows(rejects, "_line", "reason") == [(2, "duplicate-id")]


def test_auto_attest_paths(frame):
    pair = "contract_id string, control_id string"
    outcome = pair + ", outcome string"
    got = at.auto_attest(
        frame(pair, *[("K", c) for c in "abcdef"]),
        frame(outcome, ("K", "a", "failed"), ("K", "c", "passed")),
        frame(outcome, ("K", "c", "failed"), ("K", "d", "passed")),
        frame("control_id string", ("e",), ("a",)),
    )
    assert rows(got, "control_id", "outcome", "oracle_outcome", "path") == [
        ("a", "passed", "failed", "machine"), ("b", "needsAction", "needsAction", "none"),
        ("c", "failed", "failed", "reference"), ("d", "passed", "passed", "reference"),
        ("e", "passed", "inherited", "inherited"), ("f", "needsAction", "needsAction", "none")]


# -- obligations and gates -----------------------------------------------------------

OBL = "contract_id string, name string, obligation_type string, data_marker string, source_ref string, acknowledged boolean"
TOK = "contract_id string, name string, token string"
CAT = ("AC.L2-3.1.1", "AC.L2-3.1.3", "SC.L2-3.13.8", "SC.L2-3.13.11", "SC.L2-3.13.16")


def resolve(spark, frame, obligations, tokens):
    catalog = frame("control_id string", *[(c,) for c in CAT])
    return ob.resolve_obligations(frame(OBL, *obligations), frame(TOK, *tokens), catalog, vocab.rules(spark), vocab.rule_tokens(spark))


def test_obligation_resolution(spark, frame):
    obligations = [
        ("K", "OBL-CMMC-L2", "framework", None, None, None), ("K", "OBL-ITAR", "data", "ITAR", None, None),
        ("K", "OBL-IL5", "hosting", None, None, None), ("K", "tokened", "environment", None, None, None),
        ("K", "explicit", "data", None, None, None), ("K", "alien", "data", None, None, None),
        ("K", "odd", "wish", None, None, None), ("K", "report", "deliverable", None, None, None),
        ("K", "drawing", "deliverable", "CUI", None, False), ("K", "reviewed", "deliverable", "ITAR", None, True),
        ("K", "badreport", "deliverable", None, None, None),
    ]
    tokens = [("K", "tokened", "TIER1-SCOPE"), ("K", "explicit", "AC.L2-3.1.1"), ("K", "explicit", "US-PERSON"),
              ("K", "alien", "XX.L2-3.99.99"), ("K", "drawing", "AC.L2-3.1.1"), ("K", "badreport", "XX.L2-3.99.99")]
    status, resolved = resolve(spark, frame, obligations, tokens)
    assert dict(rows(status, "name", "status")) == {
        "OBL-CMMC-L2": "resolved", "OBL-ITAR": "resolved", "OBL-IL5": "resolved", "tokened": "resolved",
        "explicit": "resolved", "alien": "unknown_control", "odd": "unknown_type", "report": "deliverable",
        "drawing": "spillover", "reviewed": "acknowledged", "badreport": "unknown_control"}
    by_name = {}
    for name, control, marker in rows(resolved, "name", "control_id", "marker"):
        by_name.setdefault(name, set()).add(control or marker)
    assert by_name == {
        "OBL-CMMC-L2": {"*"}, "OBL-ITAR": {"SC.L2-3.13.11", "US-PERSON", "RESIDENCY", "E2E-CUI-BOUNDARY"},
        "tokened": {"TIER1-SCOPE"}, "explicit": {"AC.L2-3.1.1", "US-PERSON"}}
    affirmed, verdict = ob.profile_signoff(status)
    assert rows(affirmed, "name") == [("report",)]
    assert rows(verdict, "attested", "blocking", "acknowledged", "mode") == [(False, 1, 1, "manual")]


def test_clause_completeness(spark, frame):
    cited = frame("contract_id string, clause string", ("K", "7012"), ("K", "9999"), ("L", "7021"))
    present = frame("contract_id string, token string", ("K", "CUI"), ("L", "CMMC-status"))
    missing, unknown = ob.clause_gaps(cited, present, vocab.clauses(spark))
    assert rows(missing) == [("K", "7012", "800-171")] and rows(unknown) == [("K", "9999")]
    assert rows(ob.clause_completeness(cited, present, vocab.clauses(spark))) == [("K", False, 1, 1), ("L", True, 0, 0)]


def gate(frame, required, claims, modules, included):
    return (frame("contract_id string, control_id string", *required), frame("module_id string, control_id string", *claims),
            frame("module_id string, method string", *modules), frame("control_id string, weight long", ("a", 5), ("b", 1), ("z", 3)),
            frame("contract_id string, module_id string", *included))


def test_planning_gate(frame):
    required, claim, module, control, included = gate(
        frame, [("K", "a"), ("K", "b"), ("L", "z")], [("m1", "a"), ("m2", "a"), ("m2", "b"), ("m3", "q")],
        [("m1", "oracle-x"), ("m2", None), ("m3", "oracle-x")], [("K", "m1"), ("K", "m3"), ("L", "m1")])
    assert rows(gt.gate_forward(required, claim, control)) == [("L", "z", 3)]
    assert rows(gt.gate_backward(required, claim, included)) == [("K", "m3"), ("L", "m1")]
    assert rows(gt.gate_paper_claims(required, claim, module)) == [("K", "m2")]
    report = gt.gate_report(required, claim, module, control, included)
    assert rows(report, "contract_id", "gaps", "orphans", "paper_claims", "passed") == [("K", 0, 1, 1, False), ("L", 1, 1, 0, False)]
    header = frame("contract_id string, attested boolean", ("K", True), ("L", False), ("M", True))
    orders, _, _, refusals = gt.compile_orders(header, required, included, gt.order_flaws(header, required, claim, module, included))
    assert rows(refusals) == [("K", "orphan-module"), ("L", "profile-not-attested")]
    assert rows(orders, "contract_id") == [("M",)]


@pytest.mark.parametrize("popular", ["module", "control"])
def test_included_controls_follow_either_end(frame, popular):
    wide = [(f"m{i}", "c0") for i in range(30)] if popular == "control" else [("m0", f"c{i}") for i in range(30)]
    required = frame("contract_id string, control_id string", ("K", "c0"), ("K", "c5"))
    included = frame("contract_id string, module_id string", ("K", "m0"), ("K", "m7"))
    got = gt.included_controls(required, frame("module_id string, control_id string", *wide), included)
    want = {(m, c) for m, c in wide if m in ("m0", "m7") and c in ("c0", "c5")}
    assert {(r["module_id"], r["control_id"]) for r in got.collect()} == want


def test_residency(frame):
    planned = frame("contract_id string, resource_id string, region string",
                    ("us", "r1", "us-east1"), ("us", "r2", None), ("eu", "r1", "europe-west1"), ("eu", "r2", "US-west1"), ("none", "r1", None))
    assert rows(gt.residency_gate(planned), "contract_id", "findings", "passed") == [("eu", 2, False), ("none", 1, False), ("us", 0, True)]
    assert rows(gt.residency_findings(planned), "contract_id", "resource_id", "finding") == [
        ("eu", "r1", "criterion-failed:ITAR-120.54"), ("eu", "r1", "region-not-us"), ("none", "<none>", "no-region-signal")]


def test_vocabulary_sizes(spark):
    assert len(vocab.CRITERION_ROWS) == 66 and len({r[0] for r in vocab.CRITERION_ROWS}) == 66
    assert len(vocab.PLAN_ROWS) == 15


@pytest.mark.parametrize("metric, comparator, threshold, outcome, reason", [
    ("23.5", "le", "24", "passed", None), ("24.0", "le", "24", "passed", None), ("1e1", "le", "24", "passed", None), ("24.5", "le", "24", "failed", None),
    ("24.0", "eq", "24", "passed", None), ("true", "eq", "1", "passed", None), ("1", "in", "[true, 5]", "passed", None), ("2.5", "in", "[2, 2.5]", "passed", None),
    ('"24"', "eq", "24", "failed", None), ('"24"', "ne", "24", "passed", None), ("null", "ge", "1", "needsAction", "not-comparable"),
    ('"x"', "le", "24", "needsAction", "not-comparable"), ('"b"', "ge", '"a"', "passed", None), ("null", "eq", "null", "passed", None),
    ('["a"]', "eq", '["a"]', "passed", None), ("9007199254740993", "eq", "9007199254740992", "failed", None)])
def test_values_compare_as_numbers_or_text(frame, metric, comparator, threshold, outcome, reason):
    evidence = frame("contract_id string, evidence_id string, summary string, seq long", ("K", "e", '{"m": ' + metric + "}", 1))
    rule = frame("control_id string, metric_key string, comparator string, threshold string", ("c", "m", comparator, threshold))
    got = orc.evaluate_criteria(evidence, frame("contract_id string, evidence_id string, control_id string", ("K", "e", "c")), rule).first()
    assert (got["outcome"], got["reason"]) == (outcome, reason)


def test_fused_shapes_are_the_single_ones(frame):
    att = frame("contract_id long, att_id string, control_id string, outcome string, oracle_outcome string, backed_by string, override_justification string, override_evidence string, adequacy string",
                (1, "x", "a", "passed", "failed", None, None, None, "ok"), (1, "y", "b", "passed", None, "s", "why", None, ""),
                (1, "z", "c", "failed", "failed", None, "why", "proof", None), (2, "w", "a", None, None, None, None, None, "ok"))
    assertion = frame("contract_id long, assertion string, outcome string", (1, "s", "failed"), (2, "s", "passed"))
    columns = ("contract_id", "shape", "focus", "path", "message")
    single = va.validate(va.contradiction_shape(att, assertion), va.override_evidence_shape(att), va.passed_requires_adequacy_shape(att))
    assert rows(va.sign_off_shapes(att, assertion), *columns) == rows(single, *columns) and single.count() > 3
    acts = frame("run_id long, activity string, step string, started_at string, agent string",
                 (1, "p", "s1", "t", "me"), (1, "p", "s2", "t", None), (1, "q", "no", None, None), (2, "p", "s1", "t", None))
    steps = frame("step string", ("s1",), ("s2",))
    single = va.validate(va.plan_instantiation_shape(acts, steps), va.activity_agent_shape(acts))
    assert rows(va.activity_shapes(acts, steps), *columns) == rows(single, *columns) and single.count() > 3
    cites = frame("contract_id long, att_id string, evidence_id string", (1, "x", "e1"), (1, "y", "e1"), (1, "y", "e2"), (2, "w", "e1"))
    held = frame("contract_id long, evidence_id string, control_id string", (1, "e1", "a"), (1, "e2", "b"), (2, "e1", "a"))
    asked = frame("contract_id long, control_id string", (1, "a"), (1, "c"), (2, "a"), (2, "?"))
    control = frame("control_id string", ("a",), ("b",), ("c",))
    single = va.validate(va.forward_traceability_shape(asked, control, att, cites, held), va.backward_traceability_shape(att, cites, held))
    assert rows(va.traceability_shapes(asked, control, att, cites, held), *columns) == rows(single, *columns) and single.count() == 3

"""Constraint suite, provenance, packages, files and plan evidence."""

import json

from helpers import rows
from pyspark.sql import functions as F
from trailspark.functions import vocab
from trailspark.operators import evidence as ev
from trailspark.operators import package as pk
from trailspark.operators import provenance as pv
from trailspark.operators import validate as va
from trailspark.session import durable
from trailspark.sources import files

ATT = ("contract_id string, att_id string, control_id string, outcome string, oracle_outcome string, backed_by string, "
       "override_justification string, override_evidence string, adequacy string, sufficiency string, official string")


def att(i, outcome="passed", oracle=None, backed=None, why=None, proof=None, adequacy="a", sufficiency="s", official="o", control="c"):
    return ("K", i, control, outcome, oracle, backed, why, proof, adequacy, sufficiency, official)


def test_contradiction_follows_both_paths(frame):
    signed = frame(ATT, att("ok"), att("stated", oracle="failed"), att("asserted", backed="x"), att("cleared", oracle="failed", why="w", proof="p"),
                   att("half", oracle="failed", why="w"), att("absent", backed="y"))
    assertion = frame("contract_id string, assertion string, outcome string", ("K", "x", "failed"))
    got = rows(va.contradiction_shape(signed, assertion), "focus", "path")
    assert got == [("asserted", "hasOutcome"), ("half", "hasOutcome"), ("half", "overrideEvidence"), ("stated", "hasOutcome")]
    assert rows(va.override_evidence_shape(signed), "focus") == [("half",)]


def test_attestation_shapes(frame):
    signed = frame(ATT, att("ok"), att("bare", None, adequacy=None, sufficiency=None, official=None), att("blank", adequacy=""), att("two"), att("two", "failed"))
    assert rows(va.attestation_shape(signed), "focus", "path") == [
        ("bare", "hasOutcome"), ("bare", "inContextOf"), ("bare", "inContextOf"), ("bare", "qualifiedAssociation"), ("two", "hasOutcome")]
    assert rows(va.passed_requires_adequacy_shape(signed), "focus") == [("blank",)]


def test_control_and_poam_shapes(frame):
    facts = frame("node string, control_id string, text string, weight long, poam_eligible boolean",
                  ("ok", "1", "t", 5, False), ("bad", None, "", 2, None), ("two", "2", "t", 1, True), ("two", "2", "t", 3, True))
    assert rows(va.control_shape(facts), "focus", "path") == [
        ("bad", "controlId"), ("bad", "poamEligible"), ("bad", "text"), ("bad", "weight"), ("two", "weight")]
    control = frame("control_id string, weight long", ("h", 3), ("l", 1))
    assert rows(va.poam_legality_shape(frame("contract_id string, control_id string", ("K", "h"), ("K", "l")), control), "focus") == [("h",)]


def test_trace_shapes(frame):
    pair, addr = "contract_id string, control_id string", "contract_id string, evidence_id string, control_id string"
    signed = frame(ATT, att("t1", control="a"), att("t2", control="b"))
    cited = frame("contract_id string, att_id string, evidence_id string", ("K", "t1", "e1"), ("K", "t2", "e1"))
    addresses = frame(addr, ("K", "e1", "a"))
    got = va.forward_traceability_shape(frame(pair, ("K", "a"), ("K", "b"), ("K", "x")), frame("control_id string", ("a",), ("b",)), signed, cited, addresses)
    assert rows(got, "focus") == [("b",)]
    assert rows(va.backward_traceability_shape(signed, cited, addresses), "focus") == [("t2",)]


def test_verdict(frame):
    k = "contract_id string"
    mismatch = frame(k, ("t",))
    broken = frame(k + ", shape string", ("t", "S"), ("m", "S"), ("r", "S"), ("n", "S"))
    status = frame(k + ", evidentiary_status string", ("t", "real"), ("m", "mock"), ("r", "real"), ("i", "real"))
    got = va.verify_verdict(frame(k, *[(c,) for c in "tmrni"]), mismatch, broken, status)
    assert dict(rows(got, "contract_id", "verdict")) == {"t": "tampered", "m": "advisory", "r": "failed", "n": "advisory", "i": "intact"}


def test_procedure_adherence(spark, frame):
    steps, precedes, outputs = vocab.plan_tables(spark)
    activity = frame("run_id string, activity string, step string",
                     ("good", "a1", "LoadOrder"), ("good", "a2", "FetchByHash"), ("bad", "b1", "FetchByHash"), ("bad", "b2", "Dance"), ("bad", "b3", None))
    realized = frame("run_id string, variable string", ("good", "ModuleHashes"))
    report = pv.procedure_adherence(activity, steps, precedes, outputs, realized)
    assert rows(report, "run_id", "ok", "orphan_activities", "predecessor_violations", "unrealized_outputs") == [("bad", False, 2, 1, 1), ("good", True, 0, 0, 0)]
    found = pv.deviations(activity, steps, precedes, outputs, realized)
    assert ("predecessor", "FetchByHash ran without LoadOrder") in rows(found, "kind", "detail")


def test_lineage_from_contract_to_order(frame):
    edges = pv.compile_provenance(frame("contract_id string", ("K",)))
    hops = {(r["source"], r["target"]): r["hops"] for r in pv.lineage_edges(edges).collect()}
    assert hops[("contract/K", "obligations/K")] == 1 and hops[("contract/K", "order/K")] == 3


def package(frame, algo="ed25519-v1", ok=True, stored=b"x", proof="p", outcome="passed"):
    import hashlib
    k = "contract_id string"
    held = [("K", "bom.json", bytearray(stored))] if stored is not None else [("L", "bom.json", bytearray(b""))]
    return pk.verify_package(
        frame(k + ", sig_algo string, signature_verified boolean", ("K", algo, ok)),
        frame(k + ", name string, sha256 string", ("K", "bom.json", hashlib.sha256(b"x").hexdigest())),
        frame(k + ", name string, content binary", *held),
        frame(k + ", control_id string, status string, evidence_backing string, attestation_outcome string, override_evidence string",
              ("K", "c", "MET", "override", outcome, proof)))


def test_package_forgery(frame):
    assert rows(package(frame)[0], "ok") == [(True,)]
    for change, issue in (
        ({"algo": "none"}, "manifest-unsigned"), ({"algo": None}, "manifest-unsigned"), ({"ok": False}, "signature-does-not-verify"),
        ({"stored": b"y"}, "artifact-hash-mismatch:bom.json"), ({"stored": None}, "artifact-missing:bom.json"),
        ({"proof": None}, "override-without-evidence:c"), ({"outcome": None}, "met-without-outcome:c"),
    ):
        verdict, issues = package(frame, **change)
        assert rows(issues, "issue") == [(issue,)] and rows(verdict, "ok") == [(False,)]


# -- evidence from exports and plans -----------------------------------------------------


def test_overlay(frame):
    got = ev.overlay_by_key(frame("f string, v int", ("a", 1), ("b", 1)), frame("f string, v int", ("b", 2), ("c", 2)), ["f"])
    assert rows(got) == [("a", 1), ("b", 2), ("c", 2)]


def test_policy_checks(spark, frame):
    facts = frame("contract_id string, evidence_id string, summary string", ("K", "e", '{"data_region": "US", "unauthorized_principals": 2}'), ("K", "f", '{"x": 1}'))
    pairs = frame("contract_id string, evidence_id string, control_id string", ("K", "e", "SC.L2-3.13.1"), ("K", "e", "AC.L2-3.1.1"), ("K", "f", "AC.L2-3.1.1"))
    assert rows(ev.derive_policy_checks(facts, pairs, vocab.policy_checks(spark)), "control_id", "status") == [("AC.L2-3.1.1", "FAIL"), ("SC.L2-3.13.1", "PASS")]


def test_plan_evidence(frame):
    tags = frame("contract_id string, module_id string, inherited boolean", ("K", "net", False), ("K", "iam", False), ("K", "csp", True), ("L", "net", False))
    scope = frame("contract_id string, module_id string, control_id string", ("K", "net", vocab.RESIDENCY_CONTROL), ("K", "iam", "AC.L2-3.1.1"), ("L", "net", vocab.RESIDENCY_CONTROL))
    signals = frame("contract_id string, signal string", ("K", "europe-west1"), ("K", "us-east1"), ("L", "in:us-locations"))
    assert rows(ev.plan_evidence(tags, scope, signals), "contract_id", "module_id", "status") == [("K", "iam", "PASS"), ("K", "net", "FAIL"), ("L", "net", "PASS")]


def test_dead_links_stay(frame):
    refs = frame("reference_id string, uri string, custodian string", ("a", "file://documents/a.md", "me"), ("b", "file:/documents/b.md", ""), ("c", "", "me"))
    docs = frame("path string, priority long, content binary, git_commit string, git_author string",
                 ("documents/a.md", 1, bytearray(b"late"), None, None), ("documents/a.md", 0, bytearray(b"early"), "g", "x"))
    got = rows(ev.document_evidence(refs, docs), "reference_id", "exists", "git_commit", "uploaded_by")
    assert got == [("a", True, "g", "me"), ("b", False, None, vocab.BOM_ROLE), ("c", False, None, "me")]


# -- files -------------------------------------------------------------------------------


def test_quads_round_trip(spark, tmp_path):
    (tmp_path / "order.nt").write_text('# c\n\n<urn:a> <urn:t#text> "x \\"y\\" ." .\n_:b0 <urn:t#n> "5"^^<urn:int> .\nnot a triple\n')
    quads = files.read_quads(spark, str(tmp_path / "*.nt"))
    assert rows(quads, "graph", "s", "o", "o_kind", "o_datatype") == [
        ("order", "<urn:a>", '"x \\"y\\" ."', "literal", None), ("order", "_:b0", '"5"^^<urn:int>', "literal", "urn:int"), ("order", None, None, None, None)]
    good = quads.filter("s is not null")
    files.write_snapshot(good, str(tmp_path / "out"))
    files.write_snapshot(good, str(tmp_path / "flat"), union=True)
    assert spark.read.parquet(str(tmp_path / "out")).filter("graph = 'order'").count() == 2
    assert "graph" not in spark.read.parquet(str(tmp_path / "flat")).columns


def test_exports_plans_and_log(spark, tmp_path):
    envelope = {"source_system": "s", "controls": ["C", "D"], "raw": {"b": 1, "a": [True]}, "summary": {"m": True}}
    (tmp_path / "x.json").write_text(json.dumps(envelope, indent=1))
    envelopes, controls = files.read_config_exports(spark, str(tmp_path / "x.json"))
    assert rows(envelopes, "artifact_id", "first_control", "raw", "summary", "evidentiary_status") == [("x.json", "C", '{"a":[true],"b":1}', '{"m":true}', "mock")]
    assert rows(controls) == [("x.json", "C"), ("x.json", "D")]
    resources = [
        {"address": "a1", "type": "terraform_data", "values": {"input": {"cmmc_module": "M", "cmmc_control": "C1, C2  C3", "region": "us-east1"}}},
        {"address": "a2", "type": "null_resource", "values": {"triggers": {"cmmc_control": "C4"}, "location": "eu"}}, {"address": "a3", "type": "x"}]
    (tmp_path / "K1.json").write_text(json.dumps({"planned_values": {"root_module": {"resources": resources}}}))
    plan = files.read_plan_json(spark, str(tmp_path / "K1.json"))
    assert rows(plan, "contract_id", "resource_id", "controls", "region") == [
        ("K1", "M", ["C1", "C2", "C3"], "us-east1"), ("K1", "a2", ["C4"], "eu"), ("K1", "a3", [], None)]
    (tmp_path / "log.jsonl").write_text('# head\n{"id": "1", "covers": ["R"]}\n\n{"id": "2"}\n')
    log = files.read_attestation_log(spark, str(tmp_path / "log.jsonl"))
    assert [r["id"] for r in log.orderBy("_line").collect()] == ["1", "2"]
    out = str(tmp_path / "appended")
    files.write_attestation_log(log, out)
    files.write_attestation_log(log, out)
    assert files.read_attestation_log(spark, out).count() == 4


def test_documents_and_blobs(spark, frame, tmp_path):
    for name in ("pkg", "repo"):
        (tmp_path / name / "documents").mkdir(parents=True)
        (tmp_path / name / "documents" / "a.md").write_text(name)
    docs = files.read_documents(spark, [str(tmp_path / "pkg"), str(tmp_path / "repo")])
    assert rows(docs, "path", "priority") == [("documents/a.md", 0), ("documents/a.md", 1)]
    files.write_blobs(frame("hash string, kind string, content binary", ("ab12", "k", bytearray(b"x"))), str(tmp_path / "blobs"))
    assert (tmp_path / "blobs" / "prefix=ab").is_dir() and files.read_blobs(spark, str(tmp_path / "blobs")).count() == 1


def test_property_tables(frame):
    t = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    quads = frame("s string, p string, o string", ("<u:1>", t, "<u:C>"), ("<u:1>", "<u:id>", '"x"'), ("<u:1>", "<u:m>", "<u:a#q>"),
                  ("<u:1>", "<u:m>", "<u:a#r>"), ("<u:2>", "<u:id>", '"y"'))
    table, bridges = files.quads_to_table(quads, "u:C", {"id": "u:id"}, {"m": "u:m"})
    assert rows(table) == [("<u:1>", "x")] and rows(bridges["m"], "m") == [("q",), ("r",)]


def test_durable_writes_to_the_checkpoint_folder(spark):
    kept = durable(spark.range(5).withColumn("x", F.col("id") * 2))
    assert kept.count() == 5 and "Scan parquet" in kept._jdf.queryExecution().toString()


def test_raw_files_are_written_once_and_all_or_none(spark, frame, tmp_path):
    import hashlib

    import pytest

    from pyspark.sql import functions as F

    digest = lambda b: hashlib.sha256(b).hexdigest()
    bodies = [f"blob {i}".encode() for i in range(40)] + [b""]
    blobs = frame("hash string, kind string, content binary", *[(digest(b), "k", bytearray(b)) for b in bodies]).repartition(4)
    root = tmp_path / "files"
    held = lambda: {p.relative_to(root).as_posix(): p.read_bytes() for p in root.rglob("*") if p.is_file()} if root.exists() else {}
    want = {f"{digest(b)[:2]}/{digest(b)}": b for b in bodies}
    files.export_blobs(blobs, str(root))
    assert held() == want
    files.export_blobs(blobs.unionByName(blobs), f"file://{root}")  # again, and twice: nothing changes
    assert held() == want and not (root / "_staging").exists()
    more = frame("hash string, kind string, content binary", ("ab" * 32, "k", bytearray(b"new")))
    # A task that fails, other bytes under a taken name, two contents for a name: nothing is left.
    broken = more.unionByName(more.select("hash", "kind", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("content")).alias("content")))
    taken = more.unionByName(blobs.limit(1).withColumn("content", F.encode(F.lit("other"), "UTF-8")))
    twice = more.unionByName(more.withColumn("content", F.encode(F.lit("else"), "UTF-8")))
    for bad in (broken, taken, twice):
        with pytest.raises(Exception):
            files.export_blobs(bad, str(root))
        assert held() == want
    files.export_blobs(more, str(root))
    assert held() == want | {f"ab/{'ab' * 32}": b"new"}

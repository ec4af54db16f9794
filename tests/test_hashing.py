"""Canonical JSON, group hashes, blobs, versions, bill of materials."""

import hashlib
import json

import pytest
from helpers import rows
from pyspark.sql import functions as F
from trailspark.functions import groups as gr
from trailspark.functions import text as tx
from trailspark.operators import attest as at
from trailspark.operators import bom as bm
from trailspark.operators import evidence as ev
from trailspark.operators import gates as gt
from trailspark.operators import store as st
from trailspark.sources import files


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TEXTS = ["a", 'q"b\\c', "é\\u00C9 \\\\u1234 \x01\x1f\x7f\n\t/", "😀x\\", "", None, "\\uABCD", "\x08\x0c\r"]


def test_json_text_matches_ascii_json(frame):
    got = frame("i int, t string", *enumerate(TEXTS)).select("i", tx.json_text(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == {i: json.dumps(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("text, slug, line", [
    ("  A b\tc ", "a-b-c", "A b c"), ("***", "x", "***"), ("x  y", "x-y", "x y"), ("", "x", "-")])
def test_slug_and_one_line(frame, text, slug, line):
    c = F.col("t")
    assert tuple(frame("t string", (text,)).select(tx.slug(c), tx.one_line(c)).first()) == (slug, line)


@pytest.mark.parametrize("value, us", [("", True), ("in:us-locations", True), ("in:eu", False), (" US ", True), ("europe", False)])
def test_us_location(frame, value, us):
    assert frame("t string", (value,)).select(tx.is_us_location(F.col("t"))).first()[0] is us


def test_names(frame):
    one = frame("i string", ("http://x/y#AC.L2-3.13.1",)).select(tx.local_name(F.col("i")), tx.family_of(F.col("i"))).first()
    assert tuple(one) == ("AC.L2-3.13.1", "3.13")
    days = frame("n string", ("Annual ",), ("45",), ("-1",), ("weekly",)).select(tx.resolve_policy(F.col("n")))
    assert [r[0] for r in days.collect()] == [365, 45, None, None]


# -- groups, also larger than one task may hold ----------------------------------------


def lines(frame):
    hot = [("hot", f"line{i:03d}") for i in range(300)]
    return frame("k string, line string", *hot, ("cold", "b"), ("cold", "a"), ("cold", "a"))


def tree(lines):
    """The group hash, written plainly."""
    leaves = {}
    for line in set(lines):
        leaves.setdefault(sha(line)[:4], []).append(line)
    return sha("\n".join(sorted(sha("\n".join(sorted(own))) for own in leaves.values())))


def test_group_digest_is_one_formula_for_every_size(spark, frame):
    digest = lambda df: dict(rows(gr.group_digest(df, ["k"], F.col("line"), "d")))
    got = digest(lines(frame))
    assert got == {"cold": tree(["a", "b"]), "hot": tree([f"line{i:03d}" for i in range(300)])}
    assert got == digest(lines(frame).repartition(7))
    assert digest(lines(frame).filter("line <> 'line123'"))["hot"] != got["hot"]
    many = spark.range(300_000).selectExpr("IF(id = 0, 'one', 'many') AS k", "CAST(id AS STRING) AS line")
    assert digest(many) == {"one": tree(["0"]), "many": tree([str(i) for i in range(1, 300_000)])}


def test_repeated_lines_count_when_asked(frame):
    got = gr.group_digest(lines(frame).filter("k = 'cold'"), ["k"], F.col("line"), "t", repeats=True)
    assert got.first()["t"] == tree(["2 a", "1 b"])


# -- evidence and orders ---------------------------------------------------------------


def test_evidence_chain_and_tampering(frame):
    config = {"a": [1, True, None], "b": "x"}
    artifacts = frame("method string, origin string, first_control string, payload string",
                      ("config-export", "sys", "C1", json.dumps(config, sort_keys=True)), ("policy-check", "opa", None, '{"status": "PASS"}'))
    model = [sha(json.dumps({"source": "sys", "control": "C1", "config": config}, sort_keys=True)),
             sha(json.dumps({"tool": "opa", "control": "", "result": {"status": "PASS"}}, sort_keys=True))]
    chain = [sha(json.dumps({"model_hash": m, "proof_hash": None, "sim_hash": None}, sort_keys=True)) for m in model]
    got = ev.evidence_hash_chain(artifacts)
    assert rows(got, "method", "model_hash", "content_hash") == [("config-export", model[0], chain[0]), ("policy-check", model[1], chain[1])]
    stored = frame("contract_id string, evidence_id string, model_hash string, content_hash string",
                   ("K", "ok", model[0], chain[0]), ("K", "bad", model[0], chain[1]), ("K", "open", None, chain[1]))
    assert rows(ev.reverify_evidence(stored), "evidence_id", "actual") == [("bad", chain[0])]


def test_binding_is_idempotent(frame):
    schema = ("contract_id string, artifact_id string, method string, origin string, first_control string, payload string, subtype string, "
              "summary string, source_file string, evidentiary_status string, collected_at string")
    same = lambda n: ("K", n, "config-export", "Sys One", "C", "{}", "ConfigExport", "{}", n, "mock", "t")
    evidence, addresses, activity = ev.bind_evidence(
        frame(schema, same("a"), same("b")), frame("contract_id string, artifact_id string, control_id string", ("K", "a", "C"), ("K", "b", "D")))
    assert rows(evidence, "source_file") == [("a",)]
    assert {r["control_id"] for r in addresses.collect()} == {"C", "D"} and addresses.select("evidence_id").distinct().count() == 1
    assert rows(activity, "agent") == [("collector/sys-one",)]


def test_order_and_profile_hashes(spark, frame):
    required = frame("contract_id string, control_id string", ("K", "b"), ("K", "a"))
    assert gt.control_set_hash(required).first()["control_set_hash"] == tree(["a", "b"])
    from trailspark.operators import obligations as ob
    hashed = ob.profile_hash(
        frame("contract_id string, name string, obligation_type string, data_marker string, source_ref string", ("K", "o2", "data", "CUI", None), ("K", "o1", "hosting", None, "§7")),
        frame("contract_id string, name string, token string", ("K", "o2", "z"), ("K", "o2", "y")))
    body = lambda *v: json.dumps(dict(zip(("type", "data_marker", "source_ref"), v)), sort_keys=True, ensure_ascii=True)
    assert hashed.first()["cop_hash"] == tree([
        '"o2": ' + body("data", "CUI", None), '"o1": ' + body("hosting", None, "§7"), '"o2" derives "z"', '"o2" derives "y"'])


def test_module_description_inlines_owned_nodes(frame):
    facts = frame("module_id string, s string, p string, o string", ("m", "<m>", "<l>", '"x"'), ("m", "<m>", "<own>", "_:1"), ("m", "<m>", "<own>", "_:2"))
    nodes = frame("node string, p string, o string", ("_:1", "<t>", "<S>"), ("_:2", "<t>", "<S>"), ("_:1", "<r>", "<c>"))
    want = ['1 <m> <l> "x" .', "2 <m> <own>/<t> <S> .", "1 <m> <own>/<r> <c> ."]
    assert ev.module_description_hash(facts, nodes).first()["module_hash"] == tree(want)


def test_record_hash(frame):
    from test_rules import LOG, record
    payload = {"id": "r1", "signer": "N", "signer_role": "Role_AffirmingOfficial", "signed_at": "2026-06-20T12:00:00+00:00", "covers": ["R"],
               "controls_attested": ["C"], "outcome": "passed", "adequacy": "é", "sufficiency": "s", "notes": "", "override_justification": None, "override_evidence": None}
    got = at.record_hashes(frame(LOG, record(adequacy="é", sig="x", algo="ed25519-v1"))).first()["record_hash"]
    assert got == sha(json.dumps(payload, sort_keys=True, separators=(",", ":")))


# -- bill of materials -----------------------------------------------------------------


@pytest.mark.parametrize("outcome, oracle, held, documented, backing", [
    ("passed", "failed", True, True, "override"), ("passed", "passed", True, True, "attested-evidenced"),
    ("passed", "passed", True, False, "machine"), ("passed", "passed", False, False, "human-only"),
    ("failed", "passed", True, True, "machine"), ("passed", None, False, None, "human-only"), (None, None, None, None, "human-only")])
def test_backing(frame, outcome, oracle, held, documented, backing):
    row = frame("a string, b string, c boolean, d boolean", (outcome, oracle, held, documented))
    assert row.select(bm.evidence_backing(*[F.col(c) for c in "abcd"])).first()[0] == backing


def test_bom_document_rows_and_hash(frame):
    k, kc = "contract_id string", "contract_id string, control_id string"
    signed = frame(kc + ", outcome string, official string, override_justification string, override_evidence string",
                   ("K", "b", "passed", "Zoë", None, None), ("K", "a", "failed", "Zoë", None, None))
    outcomes = frame(kc + ", outcome string", ("K", "b", "passed"))
    empty = frame(kc + ", resource_id string", ("K", "b", "r2"), ("K", "b", "r1"))
    table = bm.bom_rows(frame(kc, ("K", "a"), ("K", "b"), ("K", "c")), empty, frame(kc + ", content_hash string", ("K", "b", "h1")), outcomes, signed)
    assert rows(table, "control_id", "status", "evidence_backing") == [("a", "NOT MET", "human-only"), ("b", "MET", "machine"), ("c", "NOT MET", "human-only")]
    orders = frame(k + ", order_hash string, state_hash string, tier string, impact_level string, standard string", ("K", "oh", None, "Tier1", "IL4", "S"))
    planned = frame(k + ", resource_id string, region string", ("K", "r1", "us-east1"), ("K", "r2", "eu"))
    evidence = frame(k + ", content_hash string, evidentiary_status string", ("K", "h1", "real"))
    resources, hashes = empty, frame(kc + ", content_hash string", ("K", "b", "h1"))
    document = bm.bom_document(orders, table, resources, hashes, signed, evidence, outcomes, frame(k + ", module_id string, module_hash string", ("K", "m", "mh")),
                               planned, gt.residency_findings(planned), gt.residency_gate(planned))
    got = {(r["section"], r["key"], r["value"]) for r in document.collect()}
    assert {key for section, key, _ in got if section == "control"} == {"a", "b", "c"}
    assert {v for section, key, v in got if (section, key) == ("control_resource", "b")} == {"r1", "r2"}
    assert {v for section, _, v in got if section == "finding"} == {"criterion-failed:ITAR-120.54", "region-not-us"}
    head = {key: v for section, key, v in got if section == "order"}
    assert (head["order_hash"], head["state_hash"], head["policy_passed"], head["evidentiary_status"]) == ("oh", "", "false", "real")
    assert all(json.loads(v) for section, _, v in got if section in ("control", "attestation"))
    assert bm.document_hash(document).first()["bom_hash"] == tree(["\t".join(x) for x in got])
    boms, none = bm.document_hash(document), frame(k + ", hash string")
    blobs = frame("hash string, content binary")
    assert rows(bm.verify_bom(boms, document, none, blobs), "verified") == [(True,)]
    assert rows(bm.verify_bom(boms, document.filter("key <> 'tier'"), none, blobs), "verified") == [(False,)]
    assert rows(bm.verify_bom(boms, document.limit(0), none, blobs), "document_ok") == [(False,)]


def test_weakest_status_wins(frame):
    status = frame("contract_id string, evidentiary_status string", ("a", "real"), ("a", "semiAuto"), ("b", "real"))
    got = bm.evidentiary_status(frame("contract_id string", ("a",), ("b",), ("c",)), status)
    assert rows(got) == [("a", "mock"), ("b", "real"), ("c", "mock")]


# -- store -----------------------------------------------------------------------------


def test_blobs_are_written_once(frame):
    good, other = bytearray(b"x"), bytearray(b"y")
    h = hashlib.sha256(b"x").hexdigest()
    blob = "hash string, content binary, kind string"
    store = frame("hash string, content binary", (h, other))
    fresh, rejects = st.put_blobs(frame(blob, (None, good, "a"), (None, other, "a"), (None, other, "a"), (h, other, "a")), store)
    assert [bytes(r["content"]) for r in fresh.collect()] == [b"y"]
    assert {(r["hash"], r["actual"]) for r in rejects.collect()} == {(h, h), (h, hashlib.sha256(b"y").hexdigest())}
    assert rows(st.verify_blobs(frame("hash string", (h,), ("zz",)), store)) == sorted([(h, False), ("zz", False)])


def test_versions_append_and_resolve(frame):
    snap = "ref string, seq long, graph string, line string"
    one = frame(snap, ("main", 0, "g", "<a> <b> <c> ."), ("main", 0, "g", "<a> <b> <b> ."), ("main", 0, "h", "<x> <y> <z> ."))
    commits, objects = st.commit_snapshot(one, "p")
    g, h = tree(["<a> <b> <b> .", "<a> <b> <c> ."]), tree(["<x> <y> <z> ."])
    version = sha(json.dumps({"project": "p", "ref": "main", "graphs": tree([f"g {g}", f"h {h}"])}, sort_keys=True))
    assert rows(commits, "graph", "graph_hash", "version") == [("g", g, version), ("h", h, version)]
    again, more = st.commit_snapshot(one, "p", commits, objects)
    assert more.count() == 0 and rows(again, "seq", "version") == [(1, version)] * 2
    changed = frame(snap, ("main", 0, "g", "<a> <b> <c> ."))
    third, lines_ = st.commit_snapshot(changed, "p", commits.unionByName(again), objects)
    everything, stored = commits.unionByName(again).unionByName(third), objects.unionByName(lines_)
    assert rows(st.resolve_version(everything, stored), "line") == [("<a> <b> <c> .",)]
    assert st.resolve_version(everything, stored, version).count() == 3
    assert st.resolve_version(everything, stored, "nope").count() == 0
    assert rows(st.unknown_version(everything, "nope")) == [("main",)]
    assert [r["seq"] for r in st.history(everything).collect()] == [0, 1, 2]
    assert rows(st.snapshot_diff(one, changed, ["graph"]), "change", "line") == [("removed", "<a> <b> <b> ."), ("removed", "<x> <y> <z> .")]


def test_fingerprint_ignores_blank_labels(frame):
    quad = "contract_id string, graph string, s string, p string, o string"
    make = lambda a, b: frame(quad, ("K", "g", a, "<p>", "<o>"), ("K", "g", "<s>", "<p>", b))
    assert rows(st.dataset_fingerprint(make("_:1", "_:2"))) == rows(st.dataset_fingerprint(make("_:8", "_:9")))
    assert rows(st.dataset_fingerprint(make("_:1", "_:2"))) != rows(st.dataset_fingerprint(make("_:1", "<x>")))


def test_hashes_of_ingested_files(spark, tmp_path):
    texts = {
        "plain.json": '{"source_system": "s", "controls": ["C"], "raw": {"b": 1, "a": "x"}, "summary": {"m": true}}',
        "nested.json": '{"source_system": "é", "controls": ["C"],\n "raw": {"z": 1, "a": {"n": 24.0, "t": "é😀\\u00e9", "l": [1.50, 1e2, 1e-7, {"y": null, "x": -0.0}]}, '
                       '"big": 123456789012345678901234567890}, "summary": {"b": 2.0, "a": "ü"}}',
        "none.json": '{"source_system": "s"}', "broken.json": "{"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    envelopes, _ = files.read_config_exports(spark, str(tmp_path))
    chain = ev.evidence_hash_chain(envelopes.select(
        "artifact_id", "summary_canonical", "first_control", F.lit("config-export").alias("method"), F.col("source_system").alias("origin"), F.col("raw_canonical").alias("payload")))
    got = {r.artifact_id: r for r in chain.collect()}
    assert len(got) == 4 and got["broken.json"].payload is None
    for name in ("plain.json", "nested.json", "none.json"):
        e, r = json.loads(texts[name]), got[name]
        payload = {"source": e["source_system"], "control": e.get("controls", [""])[0], "config": e.get("raw", {})}
        assert (r.payload, r.summary_canonical) == (json.dumps(e.get("raw", {}), sort_keys=True), json.dumps(e.get("summary", {}), sort_keys=True))
        assert r.model_hash == sha(json.dumps(payload, sort_keys=True))
        assert r.content_hash == sha(json.dumps({"model_hash": r.model_hash, "proof_hash": None, "sim_hash": None}, sort_keys=True))


def test_leaves_commit_and_diff_like_whole_graphs(spark, frame):
    import random

    rng = random.Random(4)
    lines = [f"<s{i}> <p> <o{rng.randrange(9)}> ." for i in range(400)]
    first = frame("ref string, seq long, graph string, line string",
                  *[(r, 0, g, x) for r in "ab" for g in ("order", "plan") for x in lines if rng.random() < 0.6])
    held = {tuple(r) for r in first.select("ref", "graph", "line").collect()}
    gone = {x for x in held if rng.random() < 0.02} | {x for x in held if x[:2] == ("b", "plan")}  # a graph goes whole
    come = {("a", "order", f"<new{i}> <p> <o> .") for i in range(5)} | {("c", "order", "<first> <of> <ref> .")}
    change = frame("ref string, graph string, line string, change string",
                   *[(*x, "removed") for x in gone], *[(*x, "added") for x in come], ("a", "order", "<not> <there> <x> .", "removed"))
    second = frame("ref string, seq long, graph string, line string", *[(r, 1, g, x) for r, g, x in (held - gone) | come])
    keys = ["ref", "graph"]
    leaves, stored = st.commit_leaves(first)
    assert rows(st.leaf_graph_hash(leaves, keys)) == rows(st.graph_hash(first, keys))
    later, more = st.commit_change(leaves, stored, change)
    assert rows(st.leaf_graph_hash(later, keys)) == rows(st.graph_hash(second, keys))
    store = stored.unionByName(more)
    assert rows(st.leaf_lines(later, store, keys)) == rows(second.select(*keys, "line"))
    assert rows(st.leaf_diff(leaves, later, store, keys), *keys, "line", "change") == rows(
        st.snapshot_diff(first, second, keys), *keys, "line", "change")
    # Leaves of unchanged lines are not stored again, and a leaf of several graphs is stored once.
    assert more.join(stored, "digest").count() == 0
    assert stored.count() == stored.distinct().count() and stored.select("digest").distinct().count() == leaves.select("digest").distinct().count()
    assert st.commit_leaves(second, store)[1].count() == 0


def test_several_digests_at_once_are_the_single_ones(frame):
    from trailspark.functions.groups import group_digest, group_digests

    data = frame("k long, part string, line string", *[(k % 3, "xyz"[k % 2], f"line {k % 11}") for k in range(60)], (9, "y", "only"))
    both = group_digests(data, ["k"], "part", F.col("line"), {"x": "hx", "y": "hy", "z": "hz"})
    for part, out in (("x", "hx"), ("y", "hy")):
        single = group_digest(data.filter(F.col("part") == part), ["k"], F.col("line"), out)
        assert rows(both.filter(F.col(out).isNotNull()), "k", out) == rows(single, "k", out)
    assert both.filter("hz is not null").count() == 0 and rows(both.filter("k = 9"), "hx") == [(None,)]


def test_lineage_doubles_and_raises(spark, frame):
    import pytest

    from trailspark.operators import provenance as pv

    chain = lambda n: [(0, "used", f"a{i}", f"e{i}") for i in range(n)] + [(0, "generated", f"a{i}", f"e{i + 1}") for i in range(n)]
    schema = "run_id long, kind string, activity string, entity string"
    for n in (1, 2, 5, 7, 8):
        found = pv.lineage_edges(frame(schema, *chain(n)), steps=8)
        assert rows(found, "source", "target", "hops") == sorted(
            ((f"e{i}", f"e{j}", j - i) for i in range(n + 1) for j in range(i + 1, n + 1)), key=lambda r: [(False, str(v)) for v in r])
    for bad in (chain(9), [*chain(2), (0, "used", "b", "e2"), (0, "generated", "b", "e0")]):
        with pytest.raises(ValueError):
            pv.lineage_edges(frame(schema, *bad), steps=8)


def test_tables_of_cuts_are_removed(spark, tmp_path):
    from pathlib import Path

    from trailspark import session

    with session.scratch(spark):
        first = session.durable(spark.range(3))
        second = session.durable(first.selectExpr("id + 1 AS id"))
        assert second.count() == 3
        session.discard(first)
        assert not Path(first._cut.removeprefix("file:")).exists() and second.count() == 3
    assert not Path(second._cut.removeprefix("file:")).exists()

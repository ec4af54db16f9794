"""Graph hashes, blobs, versions, term checks and file parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark import schemas
from trailspark.functions import vocab
from trailspark.operators import store as st
from trailspark.functions.groups import digest_sql
from trailspark.plans.registry import query, shared
from trailspark.session import durable
from trailspark.sources import files

_PROJECT = "traces"


@query("H5_graph_hash", digest_sql("SELECT contract_id, graph, s || ' ' || p || ' ' || o || ' .' AS line FROM quads", "contract_id, graph", "graph_hash"), gather=True)
def _(p):
    return st.graph_hash(p.quads.select("contract_id", "graph", st.quad_line().alias("line")), ["contract_id", "graph"])


@query("H6_dataset_fingerprint", digest_sql("""SELECT contract_id,
  s || chr(9) || p || chr(9) || CASE WHEN starts_with(o, '_:') THEN '_:b' ELSE o END || chr(9) || graph AS line FROM quads""", "contract_id", "fingerprint"), gather=True)
def _(p):
    return st.dataset_fingerprint(p.quads)


@query("H7_triples_by_graph", "SELECT graph, count(*) AS triples FROM quads GROUP BY graph")
def _(p):
    return st.triples_by_graph(p.quads)


@query("H7_quad_counts", """SELECT l.graph, count(q.s) AS triples FROM (VALUES ('ontology'), ('plan'), ('structural'), ('order'), ('evidence'),
  ('attestations'), ('plan_execution'), ('audit')) AS l(graph) LEFT JOIN quads q USING (graph) GROUP BY l.graph""")
def _(p):
    return st.quad_counts(p.quads, vocab.layers(p.spark))


@shared
def _held(p):
    """Blobs of every fifth document are stored already, some under a hash they do not have."""
    own = p.blob.filter("doc_id % 5 = 0 and doc_id % 41 <> 0").select(
        "hash", F.when(F.col("doc_id") % 35 == 0, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("content")).alias("content"),
        "doc_id",
    )
    return own.groupBy("hash").agg(F.min_by("content", "doc_id").alias("content"))


_HELD = """SELECT h, arg_min(doc_id % 35 = 0, doc_id) AS other FROM (SELECT doc_id, sha256(text) AS h FROM documents
  WHERE doc_id % 5 = 0 AND doc_id % 41 <> 0) GROUP BY h"""


@query("C1_put_blobs", f"""SELECT DISTINCT sha256(text) AS hash, 'document' AS kind, octet_length(encode(text)) AS bytes FROM documents
  WHERE doc_id % 41 <> 0 AND sha256(text) NOT IN (SELECT h FROM ({_HELD}))""")
def _(p):
    fresh, _ = st.put_blobs(p.blob.drop("doc_id"), _held(p))
    return fresh.select("hash", "kind", F.octet_length("content").cast("bigint").alias("bytes"))


@query("C1_rejected_blobs", f"""SELECT DISTINCT sha256('x' || sha256(text)) AS hash, sha256(text) AS actual, 'document' AS kind FROM documents WHERE doc_id % 41 = 0
  UNION SELECT h, h, 'document' FROM ({_HELD}) WHERE other AND h IN (SELECT sha256(text) FROM documents WHERE doc_id % 41 <> 0)""")
def _(p):
    return st.put_blobs(p.blob.drop("doc_id"), _held(p))[1]


_NAMED = "CASE WHEN doc_id % 41 = 0 THEN sha256('x' || sha256(text)) ELSE sha256(text) END"


@query("C2_verify_blobs", f"""SELECT DISTINCT d.hash, coalesce(NOT h.other, false) AS verified FROM (SELECT {_NAMED} AS hash FROM documents) d
  LEFT JOIN ({_HELD}) h ON h.h = d.hash""")
def _(p):
    """Every blob is wanted; those of a wrong name are not stored."""
    return st.verify_blobs(p.blob, _held(p))


@query("C3_latest_bom", """SELECT o_custkey AS contract_id, sha256('bom-' || max(o_orderkey)) AS bom_hash FROM orders GROUP BY o_custkey""")
def _(p):
    return st.latest_bom(p.bom_index)


@query("C3_bom_artifacts", """SELECT o.contract_id, sha256('bom-' || o.last) AS bom_hash, e.content_hash AS hash FROM (SELECT o_custkey AS contract_id,
  max(o_orderkey) AS last FROM orders GROUP BY o_custkey) o JOIN evidence e ON e.contract_id = o.last""", gather=True)
def _(p):
    return st.bom_artifacts(st.latest_bom(p.bom_index), p.artifact_index)


@query("C3_bom_signature", """SELECT o.contract_id, sha256('bom-' || o.last) AS bom_hash, CASE WHEN o.last % 3 <> 0 THEN sha256('sig-' || o.last) END AS sig_hash
  FROM (SELECT o_custkey AS contract_id, max(o_orderkey) AS last FROM orders GROUP BY o_custkey) o""")
def _(p):
    signatures = p.bom_index.filter("seq % 3 <> 0").select(
        "bom_hash", F.sha2(F.concat(F.lit("sig-"), F.col("seq")), 256).alias("sig_hash")
    )
    return st.bom_signature(st.latest_bom(p.bom_index), signatures)


@query("C4_read_through", f"SELECT DISTINCT {_NAMED} AS hash, octet_length(encode(text)) AS bytes FROM documents")
def _(p):
    return _tiers(p)[0].select("hash", F.octet_length("content").cast("bigint").alias("bytes"))


@query("C4_backfill", f"""SELECT DISTINCT {_NAMED} AS hash FROM documents
  WHERE {_NAMED} NOT IN (SELECT {_NAMED} FROM documents WHERE doc_id % 3 = 0)""")
def _(p):
    return _tiers(p)[1].select("hash")


@shared
def _tiers(p):
    local = p.blob.filter("doc_id % 3 = 0").select("hash", "content").dropDuplicates(["hash"])
    return st.read_through(local, p.blob.select("hash", "content"))


@shared
def _commit(p):
    return st.commit_snapshot(p.snapshots, _PROJECT)


@query("C5_commit_snapshot", "SELECT ref, seq, version, graph, graph_hash FROM commits")
def _(p):
    return _commit(p)[0]


@query("C5_snapshot_objects", """SELECT h.graph_hash, s.line FROM (SELECT graph_hash, ref, seq, graph, row_number() OVER (PARTITION BY graph_hash ORDER BY ref, seq, graph) AS rn
  FROM graph_hashes) h JOIN snapshots s USING (ref, seq, graph) WHERE rn = 1""")
def _(p):
    return _commit(p)[1]


@query("C6_resolve_version", """SELECT s.ref, c.version, s.graph, s.line FROM snapshots s JOIN commits c USING (ref, seq, graph)
  JOIN (SELECT ref, max(seq) AS seq FROM commits GROUP BY ref) m USING (ref, seq)""")
def _(p):
    return st.resolve_version(*_commit(p))


@query("C7_history", "SELECT DISTINCT ref, seq, version FROM commits")
def _(p):
    return st.history(_commit(p)[0])


@query("C7_graph_hash_at", """SELECT ref, version, graph_hash FROM commits JOIN (SELECT ref, max(seq) AS seq FROM commits GROUP BY ref) m USING (ref, seq)
  WHERE graph = 'order'""")
def _(p):
    return st.graph_hash_at(_commit(p)[0], "order")


@query("C8_snapshot_diff", """SELECT ref, graph, line, 'added' AS change FROM (SELECT ref, graph, line FROM snapshots WHERE seq = 1
    EXCEPT SELECT ref, graph, line FROM snapshots WHERE seq = 0)
  UNION ALL SELECT ref, graph, line, 'removed' FROM (SELECT ref, graph, line FROM snapshots WHERE seq = 0
    EXCEPT SELECT ref, graph, line FROM snapshots WHERE seq = 1)""")
def _(p):
    """Over the leaves and lines that committing both versions has stored."""
    leaves, stored = _leaves(p)
    return st.leaf_diff(leaves.filter("seq = 0"), leaves.filter("seq = 1"), stored, ["ref", "graph"])


@shared
def _leaves(p):
    leaves, stored = st.commit_leaves(p.snapshots)
    leaves = durable(leaves)
    return leaves, durable(stored)


@query("C5_commit_leaves", """SELECT ref, seq, graph, graph_hash FROM graph_hashes""")
def _(p):
    """Graph hashes from leaves kept by version."""
    return st.leaf_graph_hash(_leaves(p)[0], ["ref", "seq", "graph"])


@query("C5_commit_change", """SELECT ref, graph, graph_hash FROM graph_hashes WHERE seq = 1""")
def _(p):
    """The second version made from the first one's leaves and the lines that change."""
    first, second = p.snapshots.filter("seq = 0"), p.snapshots.filter("seq = 1")
    leaves, stored = map(durable, st.commit_leaves(first))
    change = st.snapshot_diff(first, second, ["ref", "graph"])
    return st.leaf_graph_hash(st.commit_change(leaves, stored, change)[0], ["ref", "graph"])


@query("C8_leaf_lines", "SELECT ref, graph, line FROM snapshots WHERE seq = 1")
def _(p):
    """The second version's lines, read back from its leaves."""
    leaves, stored = _leaves(p)
    return st.leaf_lines(leaves.filter("seq = 1"), stored, ["ref", "graph"])


@query("C9_undefined_terms", """SELECT term, count(*) AS uses FROM (SELECT regexp_extract(t, '^<urn:control/([0-9]+)>$', 1) AS term FROM (SELECT unnest([s, p, o]) AS t FROM quads))
  WHERE term <> '' AND CAST(term AS BIGINT) % 9 = 0 GROUP BY term""")
def _(p):
    """Controls divisible by nine are missing from the imported vocabulary."""
    defined = p.control.filter("control_id % 9 <> 0").select(
        F.concat(F.lit("<urn:control/"), F.col("control_id"), F.lit(">")).alias("s")
    )
    return st.undefined_terms(p.quads, defined, "urn:control/")


@query("C10_size_budget", """SELECT count(*) AS triples, CAST(100000 AS BIGINT) AS budget, 100000 - count(*) AS headroom, count(*) <= 100000 AS "within"
  FROM (SELECT DISTINCT s, p, o FROM quads)""")
def _(p):
    return st.size_budget(p.quads, 100_000)


@query("C10_axiom_counts", """SELECT 'subclass' AS axiom, count(DISTINCT p_brand || p_type) AS axioms FROM part
  UNION ALL SELECT 'subproperty', count(DISTINCT p_name || p_brand) FROM part""")
def _(p):
    iri = lambda c: F.concat(F.lit("<urn:"), F.col(c), F.lit(">"))
    schema = "<http://www.w3.org/2000/01/rdf-schema#"
    part = p.table("part")
    sub = part.select(iri("p_brand").alias("s"), F.lit(schema + "subClassOf>").alias("p"), iri("p_type").alias("o"))
    prop = part.select(iri("p_name").alias("s"), F.lit(schema + "subPropertyOf>").alias("p"), iri("p_brand").alias("o"))
    return st.axiom_counts(sub.unionByName(prop))


# -- file formats ------------------------------------------------------------------


@query("S1_parse_quads", """SELECT contract_id, graph, s, p, o, CASE WHEN starts_with(o, '<') THEN 'iri' WHEN starts_with(o, '_:') THEN 'blank' ELSE 'literal' END AS o_kind,
  CAST(NULL AS VARCHAR) AS o_datatype FROM quads""")
def _(p):
    lines = p.quads.select("contract_id", "graph", st.quad_line().alias("line"))
    return files.parse_quad_lines(lines).drop("line")


def _typed_quads(p):
    """Controls as typed quads."""
    subject = F.concat(F.lit("<urn:control/"), F.col("control_id"), F.lit(">"))
    base = "http://www.w3.org/2001/XMLSchema#"
    part = lambda pred, obj: p.control.select(subject.alias("s"), F.lit(pred).alias("p"), obj.alias("o"))
    quote = lambda c, suffix="": F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"' + suffix))
    rows = part("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", F.lit("<urn:term#Control>"))
    for name, obj in (
        ("text", quote("text")), ("weight", quote("weight", f"^^<{base}integer>")),
        ("poamEligible", quote("poam_eligible", f"^^<{base}boolean>")),
        ("family", F.concat(F.lit("<urn:family#"), F.col("family"), F.lit(">"))),
    ):
        rows = rows.unionByName(part(f"<urn:term#{name}>", obj))
    claims = p.module_claim.select(subject.alias("s"), F.lit("<urn:term#claimedBy>").alias("p"),
                                   F.concat(F.lit("<urn:module/"), F.col("module_id"), F.lit(">")).alias("o"))
    return rows.unionByName(claims)


@shared
def _tables(p):
    return files.quads_to_table(
        _typed_quads(p), "urn:term#Control",
        {"text": "urn:term#text", "weight": "urn:term#weight", "poam_eligible": "urn:term#poamEligible", "family": "urn:term#family"},
        {"module": "urn:term#claimedBy"},
    )


@query("S11_property_table", """SELECT '<urn:control/' || control_id || '>' AS s, text, CAST(weight AS VARCHAR) AS weight,
  CAST(poam_eligible AS VARCHAR) AS poam_eligible, family FROM control""")
def _(p):
    return _tables(p)[0]


@query("S11_bridge_table", """SELECT '<urn:control/' || control_id || '>' AS s, CAST(module_id AS VARCHAR) AS module FROM module_claim
  WHERE control_id IN (SELECT control_id FROM control)""")
def _(p):
    return _tables(p)[1]["module"]


@query("S2_parse_exports", """SELECT evidence_id AS artifact_id, 'sys-' || source_module AS source_system, evidentiary_status,
  CAST(source_control AS VARCHAR) AS first_control, '{"control":' || source_control || ',"module":' || source_module || '}' AS raw,
  replace(summary, ' ', '') AS summary FROM evidence""")
def _(p):
    """Envelopes as JSON text, parsed with the file schema; object keys come back sorted."""
    envelope = F.concat(
        F.lit('{"source_system": "sys-'), "source_module", F.lit('", "controls": ["'), "source_control",
        F.lit('"], "evidentiary_status": "'), "evidentiary_status", F.lit('", "raw": {"module": '), "source_module",
        F.lit(', "control": '), "source_control", F.lit('}, "summary": '), "summary", F.lit("}"),
    )
    raw = p.evidence.select(
        F.col("evidence_id").alias("source_file"), F.from_json(envelope, schemas.EVIDENCE_ENVELOPE).alias("e")
    ).select("source_file", "e.*")
    return files.split_envelopes(raw)[0].select(
        "artifact_id", "source_system", "evidentiary_status", "first_control", "raw", "summary"
    )


@query("S5_parse_plans", """SELECT CAST(contract_id AS VARCHAR) AS contract_id, CASE WHEN module_id % 5 = 0 THEN 'addr.' || module_id ELSE resource_id END AS resource_id,
  'addr.' || module_id AS address, type, 'A' || module_id || ',B' || module_id AS controls, region FROM planned_resource""")
def _(p):
    """Plan documents as JSON text: labels in input, triggers or plain values."""
    m = F.col("module_id")
    region = F.when(F.col("region").isNull(), "").otherwise(F.concat(F.lit('"region": "'), "region", F.lit('", ')))
    tag = F.when(m % 5 == 0, "").otherwise(F.concat(F.lit('"cmmc_module": "'), "resource_id", F.lit('", ')))
    control = F.concat(F.lit('"cmmc_control": "A'), m, F.lit(", B"), m, F.lit('"'))
    where = F.when(m % 2 == 0, '{"input": {').otherwise('{"input": {}, "triggers": {')
    values = F.when(m % 3 == 0, F.concat(where, tag, control, F.lit("}, "), F.coalesce(
        F.concat(F.lit('"location": "'), "region", F.lit('"}')), F.lit('"size": 1}')))).otherwise(
        F.concat(where, tag, region, control, F.lit("}}")))
    resource = F.concat(F.lit('{"address": "addr.'), m, F.lit('", "type": "'), "type", F.lit('", "values": '), values, F.lit("}"))
    document = F.concat(F.lit('{"contract_id": "'), "contract_id", F.lit('", "planned_values": {"root_module": {"resources": ['), resource, F.lit("]}}}"))
    plans = p.planned_resource.select(F.from_json(document, schemas.PLAN_DOCUMENT).alias("d")).select("d.*")
    return files.plan_resources(plans).select("contract_id", "resource_id", "address", "type", "controls", "region")


@query("S8_parse_attestation_log", """SELECT 'log' AS _file, line AS _line, id, signer_role, cover_key AS covers, outcome, sig, sig_algo, notes FROM attestation_log""")
def _(p):
    """Records written as JSON lines, with comment and blank lines between them."""
    names = [f.name for f in schemas.ATTESTATION_RECORD.fields]
    written = p.attestation_log.select("_file", "_line", F.to_json(F.struct(*names)).alias("value"))
    noise = p.attestation_log.select(
        "_file", (-F.col("_line") - 1).alias("_line"),
        F.when(F.col("_line") % 2 == 0, "  # note").otherwise("   ").alias("value"),
    )
    return files.parse_attestation_lines(written.unionByName(noise)).select(
        "_file", "_line", "id", "signer_role", "covers", "outcome", "sig", "sig_algo", "notes"
    )


@query("S12_snapshot_graphs", "SELECT DISTINCT graph, s, p, o FROM quads")
def _(p):
    return files.snapshot_rows(p.quads)


@query("S12_snapshot_union", "SELECT DISTINCT s, p, o FROM quads")
def _(p):
    return files.snapshot_rows(p.quads, union=True)


@query("S9_log_lines", """SELECT id, signer, cover_key AS cover, outcome, override_justification IS NULL AS no_override FROM attestation_log""")
def _(p):
    """The lines as written, read back field by field."""
    get = lambda path: F.get_json_object("value", path)
    return files.attestation_lines(p.attestation_log).select(
        get("$.id").alias("id"), get("$.signer").alias("signer"), get("$.covers[0]").alias("cover"), get("$.outcome").alias("outcome"),
        F.contains("value", F.lit('"override_justification":null')).alias("no_override"))

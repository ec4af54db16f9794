"""Lookups, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.operators import lookups as lk
from trailspark.plans.registry import query

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query("F1_all_controls", "SELECT control_id, text, weight FROM control")
def _(p):
    return lk.all_controls(p.control)


@query("F2_control_text", "SELECT text FROM control WHERE control_id = 42")
def _(p):
    return lk.control_text(p.control, 42)


@query("F3_controls_full", "SELECT control_id, text, family, weight, poam_eligible FROM control")
def _(p):
    return lk.controls_full(p.control)


@query("F4_all_evidence", """SELECT contract_id, evidence_id, CASE WHEN subtype <> 'Other' THEN subtype END AS subtype,
  content_hash, summary FROM evidence""")
def _(p):
    return lk.all_evidence(p.evidence)


@query("F5_evidentiary_statuses", "SELECT DISTINCT evidentiary_status AS status FROM evidence")
def _(p):
    return lk.evidentiary_statuses(p.evidence)


@query("F6_evidence_hashes", "SELECT DISTINCT content_hash FROM evidence")
def _(p):
    return lk.evidence_hashes(p.evidence)


@query("F7_poam_refs", "SELECT contract_id, control_id, poam_item FROM poam")
def _(p):
    return lk.poam_refs(p.control, p.poam)


@query("F8_mock_statuses_present",
       "SELECT DISTINCT contract_id, evidentiary_status AS status FROM evidence WHERE evidentiary_status = 'mock'")
def _(p):
    return lk.mock_statuses_present(p.evidence)


@query("F9_region_predicates", """SELECT contract_id, resource_id, coalesce(starts_with(region, 'us'), false) AS us_region,
  CASE WHEN region IS NULL THEN NULL ELSE starts_with(region, 'us') END AS us_location FROM planned_resource""")
def _(p):
    return p.planned_resource.select(
        "contract_id", "resource_id", tx.is_us_region(F.col("region")).alias("us_region"),
        tx.is_us_location(F.concat(F.lit("in:"), F.col("region"))).alias("us_location"),
    )


@query("F10_text_helpers", """SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS slug,
  CASE WHEN coalesce(text, '') = '' THEN '-' ELSE
    trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ')
  END AS one_line,
  CASE WHEN regexp_matches(text, '3\\.[0-9]+') THEN '3.' || regexp_extract(text, '3\\.([0-9]+)', 1) ELSE 'other' END AS family,
  list_extract(string_split('documents/' || source || '#' || doc_id, '#'), -1) AS local_name FROM documents""")
def _(p):
    text = F.col("text")
    iri = F.concat(F.lit("documents/"), F.col("source"), F.lit("#"), F.col("doc_id"))
    return p.table("documents").select(
        "doc_id", tx.slug(text).alias("slug"), tx.one_line(text).alias("one_line"),
        tx.family_of(text).alias("family"), tx.local_name(iri).alias("local_name"),
    )


@query("F11_query_layer", "SELECT contract_id, s, p, o FROM quads WHERE graph = 'evidence'")
def _(p):
    return lk.query_layer(p.quads, "evidence")


@query("F12_freshness_policy", """SELECT reference_id, CASE freshness_days WHEN 0 THEN 'event-based (per event)' WHEN 90 THEN 'quarterly'
  WHEN 180 THEN 'semi-annual' WHEN 365 THEN 'annual' END AS label,
  CASE reference_id % 4 WHEN 0 THEN freshness_days WHEN 1 THEN 30 WHEN 2 THEN NULL ELSE NULL END AS days FROM reference""")
def _(p):
    days = F.col("freshness_days")
    kind = F.col("reference_id") % 4
    name = F.when(kind == 0, days.cast("string")).when(kind == 1, " Monthly ").when(kind == 2, "-5").otherwise("weekly")
    return p.reference.select(
        "reference_id", tx.freshness_label(days).alias("label"), tx.resolve_policy(name).alias("days")
    )


@query("J1_evidence_for_control", """SELECT contract_id, control_id, evidence_id, CASE WHEN subtype <> 'Other' THEN subtype END AS subtype,
  content_hash, summary FROM addresses JOIN evidence USING (contract_id, evidence_id)
  WHERE control_id IN (SELECT control_id FROM control)""")
def _(p):
    return lk.evidence_for_control(p.evidence, p.addresses, p.control)


@query("J1_evidence_detail", f"""SELECT contract_id, control_id, evidence_id, content_hash, model_hash, summary,
  evidentiary_status AS status, {_TIME.format('generated_at')} FROM addresses JOIN evidence USING (contract_id, evidence_id)
  WHERE control_id IN (SELECT control_id FROM control)""")
def _(p):
    return lk.evidence_detail(p.evidence, p.addresses, p.control)


@query("J2_evidence_location", """SELECT contract_id, control_id, evidence_id, content_hash, evidentiary_status AS status, source_file,
  'registry://evidence/' || content_hash AS document_ref FROM addresses JOIN evidence USING (contract_id, evidence_id)
  WHERE control_id IN (SELECT control_id FROM control)""")
def _(p):
    return lk.evidence_location(p.evidence, p.addresses, p.control)


@query("J3_control_implementation", "SELECT control_id, label, method FROM module_claim JOIN module USING (module_id)")
def _(p):
    return lk.control_implementation(p.control, p.module_claim, p.module)


@query("J4_all_attestations", f"""SELECT contract_id, att_id, control_id, official, adequacy, sufficiency, outcome, mode,
  {_TIME.format('generated_at')} FROM attestation WHERE sufficiency IS NOT NULL""")
def _(p):
    return lk.all_attestations(p.attestation, p.control)


@query("J5_backward_trace_rows", """SELECT a.contract_id, a.control_id, e.content_hash, e.summary, a.official, a.outcome
  FROM attestation_evidence x JOIN attestation a USING (contract_id, att_id) JOIN evidence e USING (contract_id, evidence_id)""")
def _(p):
    return lk.backward_trace_rows(p.attestation, p.attestation_evidence, p.evidence, p.control)


@query("J6_unattested_controls", """SELECT contract_id, control_id FROM order_control o WHERE NOT EXISTS
  (SELECT 1 FROM attestation a WHERE a.contract_id = o.contract_id AND a.control_id = o.control_id)""")
def _(p):
    return lk.unattested_controls(p.order_control, p.attestation)


@query("J7_control_outcomes",
       "SELECT contract_id, control_id, outcome FROM order_control LEFT JOIN attestation USING (contract_id, control_id)")
def _(p):
    return lk.control_outcomes(p.order_control, p.attestation)


@query("J8_satisfy_pairs", "SELECT module_id, control_id FROM module_claim")
def _(p):
    return lk.satisfy_pairs(p.module_claim, p.module)


@query("J8_verification_methods", "SELECT module_id, method FROM module WHERE method IS NOT NULL")
def _(p):
    return lk.verification_methods(p.module)


_EDGE = "SELECT DISTINCT module_id, control_id FROM lines WHERE control_id % 20 <> 3"


@query("J9_satisfy_agreement", f"""SELECT module_id, control_id, 'edge-without-claim' AS issue FROM ({_EDGE} EXCEPT SELECT module_id, control_id FROM module_claim)
  UNION ALL SELECT module_id, control_id, 'claim-without-edge' FROM (SELECT module_id, control_id FROM module_claim EXCEPT {_EDGE})
  UNION ALL SELECT module_id, control_id, 'unknown-control' FROM module_claim WHERE control_id % 11 = 5""")
def _(p):
    edges = p.order_pairs.filter(F.col("control_id") % 20 != 3)
    return lk.satisfy_agreement(edges, p.module_claim, p.control.filter(F.col("control_id") % 11 != 5))


@query("J10_attested_controls", f"""SELECT f.control_id, f.module_id, f.role AS required_role, r.reference_id, r.uri, r.custodian, r.source_system,
  r.freshness_days, {_TIME.format('last_verified')},
  r.version, r.signature FROM first_claim f LEFT JOIN reference r ON r.reference_id = f.reference_id""")
def _(p):
    return lk.attested_controls(p.module_claim, p.module, p.reference)


def _refs(p):
    return lk.control_references(p.module_claim, p.module, p.reference)


_REFS = """SELECT mc.control_id, m.module_id, m.reference_id, CAST(m.source_id AS VARCHAR) AS source, coalesce(r.uri, '') AS uri,
  coalesce(r.version, '') AS version, coalesce(r.signature, '') AS signature FROM module_claim mc JOIN module m USING (module_id)
  LEFT JOIN reference r ON r.reference_id = m.reference_id WHERE m.reference_id IS NOT NULL"""


@query("J11_control_references", _REFS)
def _(p):
    return _refs(p)


@query("J11_control_reference_map", f"SELECT DISTINCT control_id, reference_id, source, uri, version, signature FROM ({_REFS})")
def _(p):
    return lk.control_reference_map(_refs(p))


@query("J11_policy_inventory", f"SELECT DISTINCT reference_id, source, uri, version, signature FROM ({_REFS})")
def _(p):
    return lk.policy_inventory(_refs(p))


@query("J12_inherited_controls",
       "SELECT DISTINCT control_id FROM module_claim JOIN module USING (module_id) WHERE starts_with(method, 'inherited')")
def _(p):
    return lk.inherited_controls(p.module_claim, p.module)


_CHAIN = f"""SELECT mc.control_id, m.label AS module, s.label AS source, coalesce(r.uri, '') AS uri,
  coalesce(r.freshness_days, 0) AS freshness_days, CASE coalesce(r.freshness_days, 0) WHEN 0 THEN 'event-based (per event)'
    WHEN 90 THEN 'quarterly' WHEN 180 THEN 'semi-annual' ELSE 'annual' END AS freshness, {_TIME.format('last_verified')},
  coalesce(r.custodian, '') AS custodian, m.role FROM module_claim mc JOIN module m USING (module_id)
  JOIN source_label s ON s.source_id = m.source_id LEFT JOIN reference r ON r.reference_id = m.reference_id
  WHERE m.method = 'oracle-attested-reference'"""


@query("J13_reference_chain", _CHAIN)
def _(p):
    return lk.reference_chain(p.module_claim, p.module, p.reference, p.source)


@query("J14_machine_verified", """SELECT control_id, bool_or(coalesce(method_is_iri AND method IS NOT NULL
  AND method <> 'oracle-attested-reference', false)) AS machine_verified FROM module_claim JOIN module USING (module_id) GROUP BY control_id""")
def _(p):
    return lk.machine_verified(p.module_claim, p.module)


@query("U2_set_difference", """SELECT DISTINCT control_id FROM order_control EXCEPT SELECT control_id FROM module_claim""")
def _(p):
    return lk.set_difference(p.order_control, p.module_claim, ["control_id"])


@query("U3_set_intersection", """SELECT DISTINCT control_id FROM order_control INTERSECT SELECT control_id FROM module_claim""")
def _(p):
    return lk.set_intersection(p.order_control, p.module_claim, ["control_id"])


@query("U4_merge_graphs", "SELECT DISTINCT contract_id, s, p, o FROM quads")
def _(p):
    return lk.merge_graphs(p.quads)

"""Audit, scoring, bill of materials, matrix and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.operators import audit as au
from trailspark.operators import bom as bm
from trailspark.operators import lookups as lk
from trailspark.operators import gates as gt
from trailspark.plans.catalog import _CHAIN
from trailspark.plans.evaluation import _outcomes
from trailspark.plans.registry import cut, query, shared
from trailspark.plans.views import _LABEL
from trailspark.session import durable_buckets

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@shared
def _met(p):
    return au.met_attestations(p.attestation)


@query("T1_met_attestations", """SELECT contract_id, att_id, control_id, outcome, oracle_outcome, met, backed_by IS NOT NULL AS backed,
  overridden AS override, override_justification IS NOT NULL AND override_evidence IS NULL AS justification_only, contradicted FROM met""")
def _(p):
    return _met(p)


@query("T2_forward_trace", "SELECT * FROM forward_fail")
def _(p):
    return au.forward_trace(p.order_control, p.module_claim, p.attestation, p.addresses)


@query("T3_backward_trace", "SELECT contract_id, evidence_id, control_id, att_id FROM backward_fail")
def _(p):
    return au.backward_trace(p.attestation, p.attestation_evidence, p.addresses)


@query("T4_bidirectional", """SELECT *, forward_failures = 0 AS forward_passed, backward_failures = 0 AS backward_passed,
  forward_failures = 0 AND backward_failures = 0 AS passed FROM directions""")
def _(p):
    return au.bidirectional(p.order_control, p.module_claim, p.attestation, p.attestation_evidence, p.addresses)


@query("T5_contradictions", """SELECT contract_id, att_id, control_id, coalesce(oracle_outcome, 'absent') AS oracle_outcome
  FROM met WHERE contradicted""")
def _(p):
    return au.contradictions(_met(p))


@query("T6_proven_vs_attested", """SELECT contract_id, count(*) FILTER (oracle_outcome = 'passed') AS met_by_machine,
  count(*) FILTER (oracle_outcome IS DISTINCT FROM 'passed') AS met_by_human_only FROM met WHERE met GROUP BY contract_id""")
def _(p):
    return au.proven_vs_attested(_met(p))


@query("T6_proven_split", """SELECT contract_id, control_id, CASE WHEN oracle_outcome = 'passed' THEN 'machine' ELSE 'human-only' END AS kind
  FROM met WHERE met""")
def _(p):
    return au.proven_split(_met(p))


@query("T7_coverage_matrix", """SELECT contract_id, control_id, evidence_id, 'covered+' || coalesce(outcome, 'unattested') AS status
  FROM addresses LEFT JOIN attestation USING (contract_id, control_id)""")
def _(p):
    return au.coverage_matrix(p.addresses, p.attestation)


@query("T8_orphans", """SELECT contract_id, 'control-without-evidence' AS kind, CAST(control_id AS VARCHAR) AS subject FROM (
    SELECT contract_id, control_id FROM order_control EXCEPT SELECT contract_id, control_id FROM addresses)
  UNION ALL SELECT contract_id, 'evidence-without-control', evidence_id FROM evidence WHERE source_module % 9 = 0""")
def _(p):
    return au.orphans(p.order_control, p.evidence, p.addresses)


@query("T9_met_control_ids", "SELECT contract_id, control_id FROM met WHERE met")
def _(p):
    return au.met_control_ids(_met(p))


@query("T9_poam_control_ids", "SELECT contract_id, control_id FROM poam")
def _(p):
    return au.poam_control_ids(p.poam)


@shared
def _statuses(p):
    return au.control_statuses(p.order_control, p.control, _met(p), p.poam)


@query("T10_control_statuses", "SELECT * FROM control_status")
def _(p):
    return _statuses(p)


@query("T11_score", """SELECT s.* FROM scores s WHERE contract_id IN (SELECT contract_id FROM order_control)""")
def _(p):
    return au.score_statuses(_statuses(p))


@query("T11_score_findings", """SELECT contract_id, control_id, weight, 'unmet' AS finding FROM control_status WHERE NOT met
  UNION ALL SELECT contract_id, control_id, weight, 'illegal-poam' FROM control_status WHERE on_poam AND (weight > 1 OR NOT poam_eligible)
  UNION ALL SELECT contract_id, control_id, weight, 'contradiction' FROM control_status WHERE contradicted""")
def _(p):
    return au.score_findings(_statuses(p))


@query("T12_compute_score", "SELECT * FROM scores")
def compute_score(p):
    return au.compute_score(p.order_hdr, p.order_control, p.control, _met(p), p.poam)


@shared
def _report(p):
    return au.audit_report(
        p.order_hdr, p.order_control, p.control, p.module_claim, p.attestation, p.attestation_evidence,
        p.addresses, p.poam,
    )


@query("T13_audit_report", "SELECT * FROM report", gather=True)
def _(p):
    return _report(p)


@query("T13_stored_report", "SELECT * FROM report")
def _(p):
    """The report over property tables that are stored in buckets of (contract, control)."""
    for name in ("order_control", "attestation", "addresses", "poam"):
        p.__dict__[name] = durable_buckets(getattr(p, name), "contract_id", "control_id")
    return _report(p)


@query("T14_audit_summary_facts", """SELECT contract_id, fact, value FROM (SELECT contract_id,
  CAST(forward_passed AS VARCHAR) AS forward_passed, CAST(backward_passed AS VARCHAR) AS backward_passed,
  CAST(bidirectional_passed AS VARCHAR) AS bidirectional_passed, CAST(contradiction_count AS VARCHAR) AS contradiction_count,
  CAST(met_by_machine AS VARCHAR) AS met_by_machine, CAST(met_by_human_only AS VARCHAR) AS met_by_human_only,
  CAST(score AS VARCHAR) AS score, status, CAST(valid_submission AS VARCHAR) AS valid_submission FROM report)
  UNPIVOT (value FOR fact IN (forward_passed, backward_passed, bidirectional_passed, contradiction_count, met_by_machine,
    met_by_human_only, score, status, valid_submission))""", gather=True)
def _(p):
    return au.audit_summary_facts(_report(p))


@query("T15_score_breakdown", """SELECT o.contract_id, o.control_id, c.weight,
  CASE WHEN m.met AND m.oracle_outcome = 'passed' THEN 'passed' WHEN m.contradicted THEN coalesce(m.oracle_outcome, 'absent') ELSE '-' END AS oracle,
  CASE WHEN m.met THEN 'MET' ELSE 'NOT MET' END AS attestation,
  CASE WHEN m.met AND m.oracle_outcome = 'passed' THEN 'machine' WHEN m.contradicted THEN 'override' WHEN m.met THEN 'human-only' ELSE '-' END AS backing,
  CASE WHEN m.met THEN '0' ELSE '-' || c.weight END AS impact, CASE WHEN m.met THEN 'PASS' ELSE 'FAIL' END AS status
  FROM order_control o JOIN control c USING (control_id) LEFT JOIN met m ON m.contract_id = o.contract_id AND m.control_id = o.control_id""")
def _(p):
    return au.score_breakdown(p.order_control, p.control, _met(p))


# -- bill of materials -------------------------------------------------------------


@shared
def _row_hashes(p):
    return bm.row_evidence(p.order_control, p.evidence, p.addresses, p.document_use)


@shared
def _rows(p):
    return bm.bom_rows(
        p.order_control, p.resource_control, _row_hashes(p), _outcomes(p), p.attestation, p.document_use
    )


@query("T16_explain_control", """SELECT contract_id, control_id, item, value FROM (SELECT contract_id, control_id,
    coalesce(oracle_outcome, 'not run') AS "oracle outcome", status AS attestation, CAST(weight AS VARCHAR) AS weight,
    evidence_backing AS backing, coalesce(reference_id, '-') AS reference FROM bom_rows JOIN control USING (control_id))
    UNPIVOT (value FOR item IN ("oracle outcome", attestation, weight, backing, reference))
  UNION ALL SELECT contract_id, control_id, 'evidence', content_hash FROM row_hashes JOIN order_control USING (contract_id, control_id)
  UNION ALL SELECT contract_id, control_id, 'resource', resource_id FROM resource_control""", gather=True)
def _(p):
    return bm.explain_control(_rows(p), p.control, _row_hashes(p), p.resource_control)


@query("B1_bom_rows", "SELECT * FROM bom_rows", gather=True)
def _(p):
    return _rows(p)


@query("B2_evidence_backing", """SELECT evidence_backing, status, count(*) AS controls FROM bom_rows GROUP BY ALL""", gather=True)
def _(p):
    return _rows(p).groupBy("evidence_backing", "status").agg(F.count(F.lit(1)).alias("controls"))


@query("B3_evidentiary_status", "SELECT contract_id, evidentiary_status FROM evidentiary")
def _(p):
    return bm.evidentiary_status(p.order_hdr, p.evidence)


@query("B4_bom_header", """SELECT o.*, s.evidentiary_status, coalesce(g.findings = 0, false) AS policy_passed, coalesce(r.controls, 0) AS controls,
  coalesce(r.met, 0) AS met, coalesce(e.n, 0) AS evidence_items, coalesce(c.n, 0) AS oracle_outcomes, coalesce(m.n, 0) AS modules,
  coalesce(g.findings, 0) AS policy_findings FROM bom_order o JOIN evidentiary s USING (contract_id)
  LEFT JOIN (SELECT contract_id, count(*) AS controls, count(*) FILTER (status = 'MET') AS met FROM bom_rows GROUP BY 1) r USING (contract_id)
  LEFT JOIN (SELECT contract_id, count(*) AS n FROM evidence GROUP BY 1) e USING (contract_id)
  LEFT JOIN (SELECT contract_id, count(*) AS n FROM outcomes GROUP BY 1) c USING (contract_id)
  LEFT JOIN (SELECT contract_id, count(*) AS n FROM module_hash GROUP BY 1) m USING (contract_id)
  LEFT JOIN gate g USING (contract_id)""")
def _(p):
    return bm.bom_header(
        p.bom_order, _rows(p), p.evidence, gt.residency_gate(p.planned_resource), _outcomes(p), p.module_hash
    )


@shared
def _document(p):
    return bm.bom_document(
        p.bom_order, _rows(p), p.resource_control, _row_hashes(p), p.attestation, p.evidence, _outcomes(p), p.module_hash,
        p.planned_resource, gt.residency_findings(p.planned_resource), gt.residency_gate(p.planned_resource),
    )


@shared
def _boms(p):
    return bm.document_hash(_document(p))


def _settled(p):
    """The sets that a bill of materials reads in several sections, written once each."""
    cut(p, "order_control", "order_module", "attestation", "evidence", "resource_control", _outcomes, _row_hashes, _rows)


@query("B5_bom_document", "SELECT contract_id, section, key, value FROM bom_lines", gather=True)
def _(p):
    return _document(p)


@query("B5_bom_hash", "SELECT contract_id, bom_hash FROM bom_hashes", gather=True)
def _(p):
    _settled(p)
    return _boms(p)


@query("B4_bom_maps", "SELECT contract_id, section, key, value FROM bom_lines WHERE section IN ('oracle', 'module', 'evidence', 'order')", gather=True)
def _(p):
    """The oracle map, module map, hashes and header facts as rows."""
    return _document(p).filter(F.col("section").isin("oracle", "module", "evidence", "order"))


@shared
def _artifacts(p):
    return bm.artifact_hashes(p.bom_order, p.evidence, p.module_hash, _row_hashes(p))


@query("B6_artifact_hashes", "SELECT contract_id, hash FROM artifact_hashes", gather=True)
def _(p):
    return _artifacts(p)


@query("B7_verify_bom", """SELECT d.contract_id, contract_id % 6 <> 0 AND contract_id % 7 <> 0 AND coalesce(b.n, 0) = 0 AS verified,
  contract_id % 6 <> 0 AND contract_id % 7 <> 0 AS document_ok, coalesce(b.n, 0) AS tampered_artifacts FROM bom_order d
  LEFT JOIN (SELECT contract_id, count(DISTINCT content_hash) AS n FROM evidence WHERE source_module % 8 = 1 GROUP BY 1) b USING (contract_id)""", gather=True)
def _(p):
    """Every 6th document is stored with another tier, every 7th not at all; some artifacts are bad."""
    _settled(p)
    cut(p, _document)
    key = F.col("contract_id")
    tier = (key % 6 == 0) & (F.col("section") == "order") & (F.col("key") == "tier")
    stored = _document(p).filter(key % 7 != 0).withColumn("value", F.when(tier, "other").otherwise(F.col("value")))
    bad = p.evidence.filter("source_module % 8 = 1").select(
        F.col("content_hash").alias("hash"), F.encode(F.lit("other"), "UTF-8").alias("content")
    )
    return bm.verify_bom(_boms(p), stored, _artifacts(p), bad.distinct())


@query("B8_bom_facts", """SELECT contract_id, subject, fact, value FROM (SELECT h.contract_id, h.bom AS subject,
      unnest(['type', 'bomHash', 'forContract', 'derivedFromOrder', 'stateHash', 'evidentiaryStatus']) AS fact,
      unnest(['BillOfMaterials', bom_hash, CAST(contract_id AS VARCHAR), order_hash, state_hash, evidentiary_status]) AS value
      FROM bom_heads h JOIN bom_order USING (contract_id) JOIN evidentiary USING (contract_id)) WHERE value IS NOT NULL
  UNION ALL SELECT h.contract_id, h.bom, 'referencesArtifact', a.hash FROM bom_heads h JOIN artifact_hashes a USING (contract_id)
  UNION ALL SELECT h.contract_id, h.bom, 'hasControlMapping', h.bom || '/mapping/' || r.control_id FROM bom_heads h JOIN bom_rows r USING (contract_id)
  UNION ALL SELECT h.contract_id, h.bom || '/mapping/' || f.control_id, f.fact, f.value FROM bom_heads h JOIN (
    SELECT contract_id, control_id, unnest(['type', 'control', 'bomStatus', 'evidenceBacking']) AS fact,
      unnest(['ControlMapping', CAST(control_id AS VARCHAR), status, evidence_backing]) AS value FROM bom_rows
    UNION ALL SELECT contract_id, control_id, 'resource', resource_id FROM resource_control
    UNION ALL SELECT contract_id, control_id, 'evidenceHash', content_hash FROM row_hashes JOIN order_control USING (contract_id, control_id)) f
  ON f.contract_id = h.contract_id""", gather=True)
def _(p):
    _settled(p)
    cut(p, _boms)
    status = bm.evidentiary_status(p.bom_order, p.evidence)
    return bm.bom_facts(_boms(p), p.bom_order, status, _artifacts(p), _rows(p), p.resource_control, _row_hashes(p))


@shared
def _vcrm(p):
    return bm.vcrm_matrix(
        p.order_control, p.module_claim, p.module, p.attestation, p.attestation_evidence, p.evidence,
        p.addresses, p.poam,
    )


@query("B9_vcrm_matrix", "SELECT contract_id, control_id, item, value FROM vcrm", gather=True)
def _(p):
    return _vcrm(p)[0]


@query("B9_implementations", "SELECT DISTINCT control_id, label FROM module_claim JOIN module USING (module_id)")
def _(p):
    return _vcrm(p)[1]


@query("B10_control_detail", f"""SELECT a.contract_id, a.control_id, a.att_id, c.text AS statement, c.family, c.weight, c.poam_eligible,
  {_LABEL.format('a.outcome')} AS status, a.official, {_TIME.format('generated_at')}, coalesce(nullif(a.adequacy, ''), '-') AS adequacy,
  coalesce(a.sufficiency, '-') AS sufficiency, a.override_justification AS override FROM attestation a JOIN control c USING (control_id)""")
def _(p):
    return bm.control_detail(p.control, p.attestation)


@query("B11_document_date", """SELECT h.contract_id, coalesce(strftime(max(t), '%Y-%m-%d %H:%M:%S'), '-') AS document_date FROM order_hdr h LEFT JOIN (
  SELECT contract_id, generated_at AS t FROM attestation UNION ALL SELECT contract_id, generated_at FROM evidence) USING (contract_id) GROUP BY h.contract_id""")
def _(p):
    return bm.document_date(p.order_hdr, p.attestation, p.evidence)


@query("B12_family_rollup", """SELECT '3.' || (control_id % 14 + 1) AS family, count(*) AS total, count(*) FILTER (status = 'MET') AS met,
  count(*) FILTER (evidence_backing = 'machine') AS machine, count(*) FILTER (evidence_backing = 'attested-evidenced') AS attested,
  count(*) FILTER (evidence_backing = 'human-only') AS human, count(*) FILTER (evidence_backing = 'override') AS override FROM bom_rows GROUP BY 1""", gather=True)
def _(p):
    family = F.concat(F.lit("3."), F.col("control_id") % 14 + 1)
    return bm.family_rollup(_rows(p), family)


@shared
def _coverage(p):
    return bm.catalog_coverage(p.control, p.module_claim, p.module)


@query("B13_catalog_coverage", "SELECT control_id, family, weight, kind, non_deferrable, inherited FROM coverage")
def _(p):
    return _coverage(p)


@query("B14_family_kind_tally", """SELECT family, CAST(coalesce(sum(weight) FILTER (kind = 'machine'), 0) AS BIGINT) AS machine,
  CAST(coalesce(sum(weight) FILTER (kind = 'attested'), 0) AS BIGINT) AS attested, CAST(coalesce(sum(weight) FILTER (kind = 'inherited'), 0) AS BIGINT) AS inherited,
  CAST(coalesce(sum(weight) FILTER (kind = 'unclaimed'), 0) AS BIGINT) AS unclaimed FROM coverage GROUP BY family""")
def _(p):
    return bm.family_kind_tally(_coverage(p))


@query("B15_authoritative_sources", f"SELECT source, count(*) AS controls FROM ({_CHAIN}) GROUP BY source")
def _(p):
    return bm.authoritative_sources(lk.reference_chain(p.module_claim, p.module, p.reference, p.source))


@query("B16_report_facts", """SELECT r.contract_id, count(*) AS total, count(*) FILTER (r.status = 'MET') AS met, count(*) FILTER (r.status <> 'MET') AS not_met,
  count(*) FILTER (r.evidence_backing = 'override') AS override, coalesce(max(s.met_by_machine), 0) AS machine,
  coalesce(max(s.met_by_human_only), 0) AS human, coalesce(max(s.contradiction_count), 0) AS contradictions
  FROM bom_rows r LEFT JOIN split s USING (contract_id) GROUP BY r.contract_id""", gather=True)
def _(p):
    return bm.report_facts(_rows(p), _met(p))


@query("B19_vcrm_drift", """SELECT contract_id, control_id, CASE WHEN control_id % 10 = 3 THEN 'added' WHEN control_id % 10 = 4 THEN 'removed' ELSE 'changed' END AS drift
  FROM order_control WHERE control_id % 10 IN (3, 4) OR (control_id % 10 = 5 AND contract_id % 2 = 0)""", gather=True)
def _(p):
    """Against a stored matrix that lacks some rows, has others more and differs in some."""
    matrix = _vcrm(p)[0]
    last = F.col("control_id") % 10
    other = (last == 5) & (F.col("contract_id") % 2 == 0) & (F.col("item") == "status")
    stored = matrix.filter(last != 3).withColumn("value", F.when(other, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return bm.vcrm_drift(matrix.filter(last != 4), stored)


@query("B20_family_exposure", """SELECT c.family, count(*) AS controls, CAST(sum(c.weight) AS BIGINT) AS points_at_risk,
  count(*) FILTER (o.control_id IN (SELECT control_id FROM module_claim)) AS covered FROM order_control o JOIN control c USING (control_id) GROUP BY c.family""")
def _(p):
    return bm.family_exposure(p.order_control, p.control, p.module_claim)

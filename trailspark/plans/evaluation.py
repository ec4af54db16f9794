"""Machine criteria, freshness, attested references, evidence binding, sign-offs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.operators import attest as at
from trailspark.operators import evidence as ev
from trailspark.operators import lookups as lk
from trailspark.operators import oracles as orc
from trailspark.plans.registry import query, shared
from trailspark.plans.views import _LABEL

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@shared
def _results(p):
    return orc.evaluate_criteria(p.evidence, p.addresses, p.criterion)


@shared
def _outcomes(p):
    return orc.control_outcomes_last_wins(p.by_contract(_results(p).select("contract_id", "control_id", "evidence_id", "seq", "outcome")))


@query("O1_evaluate_criteria", """SELECT contract_id, evidence_id, control_id, metric_key, comparator, threshold, outcome, reason,
  metric_value, seq FROM criteria_result""")
def _(p):
    return _results(p)


@query("O2_control_outcomes", "SELECT contract_id, control_id, outcome FROM outcomes")
def _(p):
    return _outcomes(p)


@query("O3_assertions", """SELECT contract_id, 'controlcheck/' || control_id || '/' || evidence_id AS assertion, evidence_id AS backed_by,
  control_id AS evaluates_against, 'automatic' AS mode, outcome, reason, metric_key, threshold AS threshold_value, metric_value
  FROM criteria_result""")
def _(p):
    return orc.assertions(_results(p))


@query("O4_check_freshness", "SELECT reference_id, freshness_days, is_fresh, reason, age_days FROM fresh")
def _(p):
    return orc.check_freshness(p.reference, p.now)


_VERDICTS = """SELECT u.*, CASE WHEN u.unregistered THEN 'needsAction' WHEN r.uri = '' OR NOT r.resolved_ok THEN 'failed'
    WHEN r.last_verified IS NULL THEN 'needsAction' WHEN NOT f.is_fresh THEN 'failed' WHEN r.signature IS NULL THEN 'needsAction'
    WHEN NOT r.signature_verified THEN 'failed' WHEN l.att_id IS NULL THEN 'needsAction'
    WHEN l.signer_role <> 'Role_AffirmingOfficial' AND l.signer_role <> u.required_role THEN 'failed'
    WHEN l.signed_on < r.last_verified THEN 'failed' ELSE l.att_outcome END AS outcome,
  CASE WHEN u.unregistered THEN 'reference-missing' WHEN r.uri = '' OR NOT r.resolved_ok THEN 'reference-unresolvable'
    WHEN r.last_verified IS NULL THEN 'reference-never-verified' WHEN NOT f.is_fresh THEN f.reason WHEN r.signature IS NULL THEN 'signature-missing'
    WHEN NOT r.signature_verified THEN 'signature-invalid' WHEN l.att_id IS NULL THEN 'awaiting-attestation'
    WHEN l.signer_role <> 'Role_AffirmingOfficial' AND l.signer_role <> u.required_role
      THEN 'signer-role-mismatch:' || l.signer_role || '!=' || u.required_role
    WHEN l.signed_on < r.last_verified THEN 'attestation-predates-reference'
    WHEN l.att_outcome = 'needsAction' THEN 'attestation-outcome:needsAction' END AS reason,
  l.att_id, CASE WHEN NOT u.unregistered THEN f.age_days END AS age_days
  FROM attested_use u LEFT JOIN reference r USING (reference_id) LEFT JOIN fresh f USING (reference_id)
  LEFT JOIN latest_log l ON l.cover_key = u.cover_key AND l.control_id = u.control_id"""


@query("O5_attested_reference", f"""SELECT CASE WHEN unregistered THEN NULL ELSE reference_id END AS reference_id, cover_key, control_id,
  required_role, outcome, reason, att_id, age_days FROM ({_VERDICTS})""")
def _(p):
    uses = p.attested_use.select(
        F.when(~F.col("unregistered"), F.col("reference_id")).alias("reference_id"),
        "cover_key", "control_id", "required_role",
    )
    return orc.evaluate_attested_reference(uses, p.reference, orc.latest_attestation(p.attestation_log), p.now)


@query("O6_latest_attestation", """SELECT cover_key, control_id, att_id, signer, signer_role, att_outcome, adequacy, sufficiency, notes,
  strftime(signed_on, '%Y-%m-%d') || ' 00:00:00' AS signed_at FROM latest_log""")
def _(p):
    return orc.latest_attestation(p.attestation_log)


_FIRST_VERDICT = """SELECT f.control_id, f.reference_id, CASE WHEN r.reference_id IS NULL THEN 'needsAction'
    WHEN r.uri = '' OR NOT r.resolved_ok THEN 'failed' WHEN r.last_verified IS NULL THEN 'needsAction' WHEN NOT x.is_fresh THEN 'failed'
    WHEN r.signature IS NULL THEN 'needsAction' WHEN NOT r.signature_verified THEN 'failed' WHEN l.att_id IS NULL THEN 'needsAction'
    WHEN l.signer_role <> 'Role_AffirmingOfficial' AND l.signer_role <> f.role THEN 'failed'
    WHEN l.signed_on < r.last_verified THEN 'failed' ELSE l.att_outcome END AS outcome,
  CASE WHEN r.reference_id IS NULL THEN 'reference-missing' WHEN r.uri = '' OR NOT r.resolved_ok THEN 'reference-unresolvable'
    WHEN r.last_verified IS NULL THEN 'reference-never-verified' WHEN NOT x.is_fresh THEN x.reason WHEN r.signature IS NULL THEN 'signature-missing'
    WHEN NOT r.signature_verified THEN 'signature-invalid' WHEN l.att_id IS NULL THEN 'awaiting-attestation'
    WHEN l.signer_role <> 'Role_AffirmingOfficial' AND l.signer_role <> f.role THEN 'signer-role-mismatch:' || l.signer_role || '!=' || f.role
    WHEN l.signed_on < r.last_verified THEN 'attestation-predates-reference'
    WHEN l.att_outcome = 'needsAction' THEN 'attestation-outcome:needsAction' END AS reason, l.att_id
  FROM first_claim f LEFT JOIN reference r ON r.reference_id = f.reference_id LEFT JOIN fresh x ON x.reference_id = f.reference_id
  LEFT JOIN latest_log l ON l.cover_key = CAST(f.reference_id AS VARCHAR) AND l.control_id = CAST(f.control_id AS VARCHAR)"""

_TRACK = f"""SELECT o.contract_id, o.control_id, v.reference_id, v.outcome, v.reason, v.att_id FROM order_control o
  JOIN ({_FIRST_VERDICT}) v ON v.control_id = o.control_id WHERE NOT EXISTS (SELECT 1 FROM outcomes c
    WHERE c.contract_id = o.contract_id AND c.control_id = o.control_id AND c.outcome IN ('passed', 'failed'))"""


@shared
def _references(p):
    return orc.reference_pass(
        p.order_control, p.module_claim, p.module, p.reference, _outcomes(p), p.attestation_log, p.now
    )


@query("O7_reference_pass", _TRACK)
def _(p):
    return _references(p)


_MERGED = f"""SELECT contract_id, control_id, outcome FROM ({_TRACK}) t UNION ALL SELECT contract_id, control_id, outcome FROM outcomes c
  WHERE NOT EXISTS (SELECT 1 FROM ({_TRACK}) t WHERE t.contract_id = c.contract_id AND t.control_id = c.control_id)"""


@query("O7_merged_outcomes", _MERGED, gather=True)
def _(p):
    return orc.merge_outcomes(_outcomes(p), _references(p))


@query("O8_outcome_counts", "SELECT outcome, count(*) AS results FROM criteria_result GROUP BY outcome")
def _(p):
    return orc.outcome_counts(_results(p))


# -- evidence ----------------------------------------------------------------------


@query("S3_overlay_by_key", """SELECT contract_id, evidence_id, summary FROM evidence WHERE source_module % 4 <> 1
  UNION ALL SELECT contract_id, evidence_id, '{"qty": 0}' FROM evidence WHERE source_module % 4 = 1""")
def _(p):
    base = p.evidence.select("contract_id", "evidence_id", "summary", "source_module")
    over = base.filter("source_module % 4 = 1").withColumn("summary", F.lit('{"qty": 0}'))
    return ev.overlay_by_key(base, over, ["contract_id", "evidence_id"]).drop("source_module")


@query("S4_derive_policy_checks", """SELECT a.contract_id, a.evidence_id, a.control_id, 'qty' AS metric_key, 'opa' AS tool,
  CASE WHEN e.qty = p.p_size THEN 'PASS' ELSE 'FAIL' END AS status, 'qty=' || e.qty || ' eq ' || p.p_size AS detail,
  '{"qty": ' || e.qty || '}' AS summary FROM addresses a JOIN evidence e USING (contract_id, evidence_id)
  JOIN part p ON p.p_partkey = a.control_id WHERE p.p_partkey % 4 = 1 AND e.source_module % 11 <> 0""")
def _(p):
    return ev.derive_policy_checks(p.evidence, p.addresses, p.policy_check)


@query("H1_evidence_hash_chain", "SELECT contract_id, artifact_id, model_hash, content_hash FROM artifact_hash")
def _(p):
    return ev.evidence_hash_chain(p.artifact).select("contract_id", "artifact_id", "model_hash", "content_hash")


@query("H4_reverify_evidence", """SELECT contract_id, evidence_id, content_hash AS expected,
  sha256('{"model_hash": "' || model_hash || '", "proof_hash": null, "sim_hash": null}') AS actual FROM evidence
  WHERE (source_control + source_module) % 97 = 0""")
def _(p):
    return ev.reverify_evidence(p.evidence)


@shared
def _bound(p):
    return ev.bind_evidence(p.artifact, p.artifact_control)


@query("S10_bind_evidence", f"""SELECT contract_id, 'evidence/' || substr(content_hash, 1, 16) AS evidence_id, subtype, summary, source_file,
  evidentiary_status, {_TIME.format('collected_at')}, model_hash, content_hash, 'registry://evidence/' || content_hash AS document_ref
  FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, content_hash ORDER BY artifact_id) AS rn FROM artifact_hash) WHERE rn = 1""", gather=True)
def _(p):
    return _bound(p)[0]


@query("S10_bound_addresses", """SELECT DISTINCT contract_id, 'evidence/' || substr(content_hash, 1, 16) AS evidence_id, a.control_id
  FROM artifact_hash h JOIN addresses a USING (contract_id) WHERE a.evidence_id = h.artifact_id""")
def _(p):
    return _bound(p)[1]


@query("S10_bound_activities", f"""SELECT contract_id, 'exec/CollectEvidence-' || substr(content_hash, 1, 16) AS activity, 'CollectEvidence' AS step,
  strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS started_at, 'collector/' || replace(origin, '.', '-') AS agent,
  'evidence/' || substr(content_hash, 1, 16) AS evidence_id
  FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, content_hash ORDER BY artifact_id) AS rn FROM artifact_hash) WHERE rn = 1""", gather=True)
def _(p):
    return _bound(p)[2]


@query("S13_document_evidence", """SELECT 'DE-' || r.reference_id AS evidence_id, r.reference_id, r.uri,
  CASE WHEN d.sha IS NOT NULL THEN 'documents/' || r.reference_id || '.md' END AS resolved_path, d.sha IS NOT NULL AS "exists", d.sha AS sha256,
  CASE WHEN d.sha IS NOT NULL AND r.reference_id % 3 <> 0 THEN sha256('commit-' || r.reference_id) END AS git_commit,
  CASE WHEN d.sha IS NOT NULL THEN 'author-' || (r.reference_id % 4) END AS git_author, d.base, r.custodian AS uploaded_by
  FROM reference r LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) WHEN doc_id % 5 <> 0 THEN sha256(text || chr(10)) END AS sha,
      CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS base FROM documents
    WHERE doc_id % 31 <> 0 AND doc_id % 17 <> 0 AND (doc_id % 2 = 0 OR doc_id % 5 <> 0)) d ON d.doc_id = r.reference_id""")
def _(p):
    return ev.document_evidence(p.reference, p.document)


# -- sign-offs ---------------------------------------------------------------------

_REASONS = """SELECT 'log' AS _file, line AS _line, id, unnest(list_filter([
  CASE WHEN outcome = 'passed' AND (adequacy = '' OR sufficiency = '') THEN 'passed-without-rationale' END,
  CASE WHEN sig_algo = 'none' AND sig IS NOT NULL THEN 'sig-without-algo' END,
  CASE WHEN override_justification IS NOT NULL AND override_evidence IS NULL THEN 'justification-without-evidence' END],
  lambda x: x IS NOT NULL)) AS reason FROM attestation_log"""


@query("A1_log_rejects", _REASONS)
def _(p):
    return at.validate_attestation_log(p.attestation_log)[1]


@query("A1_valid_log", f"""SELECT id, signer, signer_role, outcome, line AS _line FROM attestation_log
  WHERE id NOT IN (SELECT id FROM ({_REASONS}))""")
def _(p):
    return at.validate_attestation_log(p.attestation_log)[0].select("id", "signer", "signer_role", "outcome", "_line")


# JSON's ASCII escape of a text, character by character; two units above U+FFFF.
_NOTES = """array_to_string([CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
    WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' WHEN unicode(c) < 32 OR (unicode(c) > 126 AND unicode(c) < 65536 AND unicode(c) <> 127) THEN '\\u' || format('{:04x}', unicode(c))
    WHEN unicode(c) >= 65536 THEN '\\u' || format('{:04x}', 55296 + (unicode(c) - 65536) // 1024) || '\\u' || format('{:04x}', 56320 + (unicode(c) - 65536) % 1024)
    ELSE c END FOR c IN string_split(notes, '')], '')"""


@query("A2_record_hashes", """SELECT 'log' AS _file, line AS _line, id, sha256('{"adequacy":"' || adequacy || '","controls_attested":['
  || (SELECT string_agg('"' || c || '"', ',' ORDER BY c) FROM generate_series(0, 49) AS g(c) WHERE c % 7 <> conv_id % 7)
  || '],"covers":["' || cover_key || '"],"id":"' || id || '","notes":"' || """ + _NOTES + """ || '","outcome":"' || outcome || '","override_evidence":'
  || coalesce('"' || override_evidence || '"', 'null') || ',"override_justification":' || coalesce('"' || override_justification || '"', 'null')
  || ',"signed_at":"' || strftime(signed_on, '%Y-%m-%d') || 'T00:00:00+00:00","signer":"' || signer || '","signer_role":"' || signer_role
  || '","sufficiency":"' || sufficiency || '"}') AS record_hash FROM attestation_log""")
def _(p):
    return at.record_hashes(p.attestation_log)


@query("A3_auto_attest", f"""SELECT o.contract_id, o.control_id, 'ATT-' || o.control_id AS att_id,
  CASE WHEN t.outcome IS NOT NULL THEN t.outcome WHEN m.outcome IS NOT NULL OR i.control_id IS NOT NULL THEN 'passed' ELSE 'needsAction' END AS outcome,
  CASE WHEN t.outcome IS NOT NULL THEN t.outcome WHEN m.outcome IS NOT NULL THEN m.outcome WHEN i.control_id IS NOT NULL THEN 'inherited'
    ELSE 'needsAction' END AS oracle_outcome,
  CASE WHEN t.outcome IS NOT NULL THEN 'reference' WHEN m.outcome IS NOT NULL THEN 'machine' WHEN i.control_id IS NOT NULL THEN 'inherited'
    ELSE 'none' END AS path
  FROM order_control o LEFT JOIN ({_TRACK}) t USING (contract_id, control_id) LEFT JOIN outcomes m USING (contract_id, control_id)
  LEFT JOIN (SELECT DISTINCT control_id FROM module_claim JOIN module USING (module_id) WHERE starts_with(method, 'inherited')) i USING (control_id)""")
def _(p):
    return at.auto_attest(
        p.order_control, _outcomes(p), _references(p), lk.inherited_controls(p.module_claim, p.module)
    )


@query("A4_attach_evidence", """SELECT contract_id, att_id, evidence_id FROM attestation JOIN addresses USING (contract_id, control_id)
  UNION ALL SELECT contract_id, att_id, document_evidence FROM attestation WHERE document_evidence IS NOT NULL""")
def _(p):
    documents = p.attestation.filter("document_evidence is not null").select(
        "contract_id", "control_id", F.col("document_evidence").alias("evidence_id")
    )
    return at.attach_evidence(p.attestation, p.addresses, documents)


@query("A5_resolve_oracle_outcome", """SELECT contract_id, att_id, control_id, outcome, backed_by, coalesce(oracle_outcome,
  CASE WHEN backed_by IS NOT NULL THEN CASE WHEN control_id % 3 = 0 THEN 'failed' ELSE 'passed' END END) AS oracle_outcome FROM attestation""")
def _(p):
    return at.resolve_oracle_outcome(p.attestation, p.assertion)


@query("A6_status_label", f"SELECT contract_id, att_id, control_id, {_LABEL.format('outcome')} AS status FROM attestation")
def _(p):
    return at.status_labels(p.attestation)


@query("A7_attestation_detail", f"""SELECT a.contract_id, a.att_id, a.control_id, a.official, a.adequacy, a.sufficiency, a.outcome AS outcome_short, a.mode,
  {_TIME.format('generated_at')}, a.override_justification AS override, a.override_evidence, a.oracle_outcome, a.document_evidence,
  e.evidence_id FROM attestation a LEFT JOIN (SELECT DISTINCT contract_id, att_id, evidence_id FROM attestation_evidence) e USING (contract_id, att_id)
  WHERE a.sufficiency IS NOT NULL""")
def _(p):
    return at.attestation_detail(p.attestation, p.attestation_evidence)

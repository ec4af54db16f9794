"""Constraint suite, procedure adherence, provenance and audit packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.operators import audit as au
from trailspark.operators import evidence as ev
from trailspark.operators import gates as gt
from trailspark.operators import lookups as lk
from trailspark.operators import package as pk
from trailspark.operators import provenance as pv
from trailspark.operators import validate as va
from trailspark.plans.auditing import _boms, _met, _rows
from trailspark.plans.catalog import _REFS
from trailspark.plans.evaluation import _outcomes, _results
from trailspark.plans.registry import BODIES, BUILDERS, cut, query, shared

_NONE = "CAST(NULL AS VARCHAR) AS contract_id"


def _shape(shape: str, focus: str, path: str, message: str, source: str, contract: str = "CAST(contract_id AS VARCHAR) AS contract_id") -> str:
    return (f"SELECT {contract}, '{shape}' AS shape, CAST({focus} AS VARCHAR) AS focus, '{path}' AS path, "
            f"'{message}' AS message FROM {source}")


def _any(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _control_facts(p):
    """Catalog facts with defects: missing ids, second weights, odd weights, blank texts."""
    c = F.col("control_id")
    base = p.control.select(
        c.alias("node"), F.when(c % 31 != 0, c).alias("control_id"),
        F.when(c % 37 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(c % 41 == 0, F.lit(2).cast("bigint")).otherwise(F.col("weight")).alias("weight"),
        F.when(c % 43 != 0, F.col("poam_eligible")).alias("poam_eligible"),
    )
    second = p.control.filter(c % 29 == 0).select(
        c.alias("node"), c.alias("control_id"), F.lit("again").alias("text"),
        (F.col("weight") + 2).alias("weight"), ~F.col("poam_eligible"),
    )
    return base.unionByName(second.toDF(*base.columns))



@query("V1_control_shape", _any(
    _shape("ControlShape", "control_id", "controlId", "exactly one control id", "control WHERE control_id % 31 = 0 AND control_id % 29 <> 0", _NONE),
    _shape("ControlShape", "control_id", "text", "a non-empty statement", "control WHERE control_id % 37 = 0 AND control_id % 29 <> 0", _NONE),
    _shape("ControlShape", "control_id", "weight", "exactly one weight of 1, 3 or 5", "control WHERE control_id % 41 = 0 OR control_id % 29 = 0", _NONE),
    _shape("ControlShape", "control_id", "poamEligible", "exactly one eligibility flag",
           "control WHERE (control_id % 43 = 0) <> (control_id % 29 = 0)", _NONE),
))
def _(p):
    return va.control_shape(_control_facts(p))


@query("V2_poam_legality_shape", _shape(
    "PoamLegalityShape", "control_id", "poamItem", "only one-point controls may carry a plan-of-action item",
    "poam JOIN control USING (control_id) WHERE weight > 1"))
def _(p):
    return va.poam_legality_shape(p.poam, p.control)


_CONTRA = _any(
    _shape("ContradictionShape", "att_id", "hasOutcome", "met over a failed check without justification and evidence",
           """attestation WHERE outcome = 'passed' AND NOT (override_justification IS NOT NULL AND override_evidence IS NOT NULL)
           AND (coalesce(oracle_outcome = 'failed', false) OR (backed_by IS NOT NULL AND control_id % 3 = 0))"""),
    _shape("ContradictionShape", "att_id", "overrideEvidence", "override without evidence",
           "attestation WHERE override_justification IS NOT NULL AND override_evidence IS NULL"),
)


@query("V3_contradiction_shape", _CONTRA)
def _(p):
    return va.contradiction_shape(p.attestation, p.assertion)


_OVERRIDE = _shape("OverrideEvidenceShape", "att_id", "overrideEvidence", "justification without evidence",
                   "attestation WHERE override_justification IS NOT NULL AND override_evidence IS NULL")


@query("V4_override_evidence_shape", _OVERRIDE)
def _(p):
    return va.override_evidence_shape(p.attestation)


_ATTEST = _shape("AttestationShape", "att_id", "inContextOf", "a sufficiency justification", "attestation WHERE sufficiency IS NULL")


@query("V5_attestation_shape", _ATTEST)
def _(p):
    return va.attestation_shape(p.attestation)


@query("V6_plan_instantiation_shape", _any(
    _shape("PlanInstantiationShape", "activity", "correspondsToStep", "exactly one known step", "activity WHERE step NOT IN ('signup', 'view', 'click', 'purchase')",
           "CAST(run_id AS VARCHAR) AS contract_id"),
    _shape("PlanInstantiationShape", "activity", "startedAtTime", "exactly one start time", "activity WHERE started_at IS NULL",
           "CAST(run_id AS VARCHAR) AS contract_id"),
))
def _(p):
    return va.plan_instantiation_shape(p.activity, p.plan[0])


_EVIDENCE = _any(
    _shape("EvidenceShape", "evidence_id", "sourceFile", "a source file", "evidence WHERE source_file IS NULL"),
    _shape("EvidenceShape", "evidence_id", "addresses", "at least one addressed control", "evidence WHERE source_module % 9 = 0"),
)


@query("V7_evidence_shape", _any(_EVIDENCE, _shape(
    "EvidenceShape", "evidence_id", "wasGeneratedBy", "exactly one generating activity", "evidence WHERE source_module % 17 < 2")))
def _(p):
    """Evidence of some modules has no generating activity, of others two."""
    made = p.evidence.filter("source_module % 17 <> 0").select(
        "contract_id", "evidence_id", F.concat(F.lit("collect-"), "evidence_id").alias("activity")
    )
    again = p.evidence.filter("source_module % 17 = 1").select(
        "contract_id", "evidence_id", F.concat(F.lit("again-"), "evidence_id").alias("activity")
    )
    return va.evidence_shape(p.evidence, p.addresses, made.unionByName(again))


@query("V8_requirement_shape", _any(
    _shape("RequirementShape", "doc_id", "declaredName", "a declared name", "documents WHERE doc_id % 12 = 0", _NONE),
    _shape("RequirementShape", "doc_id", "text", "a text", "documents WHERE doc_id % 15 = 0", _NONE),
))
def _(p):
    d = F.col("doc_id")
    return va.requirement_shape(p.table("documents").select(
        d.alias("requirement"), F.when(d % 12 != 0, F.col("source")).alias("declared_name"),
        F.when(d % 15 != 0, F.col("text")).alias("text"),
    ))


_SUPPORTS = "(SELECT DISTINCT l_partkey AS node, l_partkey + l_suppkey AS supported_by FROM lineitem)"


@query("V9_strategy_supported_shape", _shape(
    "StrategySupportedShape", "p_partkey", "supportedBy", "at least one supporting solution",
    f"""part WHERE p_partkey % 3 = 1 AND NOT EXISTS (SELECT 1 FROM {_SUPPORTS} s WHERE s.node = p_partkey AND s.supported_by % 3 = 2
      AND s.supported_by IN (SELECT p_partkey FROM part))""", _NONE))
def _(p):
    return va.strategy_supported_shape(*p.argument)


@query("V9_goal_supported_shape", _shape(
    "GoalSupportedShape", "p_partkey", "supportedBy", "at least one incoming support",
    f"part WHERE p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT supported_by FROM {_SUPPORTS})", _NONE))
def _(p):
    return va.goal_supported_shape(*p.argument)


@query("V10_statement_shape", _any(*[
    _shape("GsnTextShape", "att_id", "statement", "a non-empty statement", f"attestation WHERE control_id % {n} = 0", _NONE) for n in (50, 40)]))
def _(p):
    """The adequacy and the sufficiency text of every sign-off."""
    text = lambda name: p.attestation.select(F.col("att_id").alias("node"), F.col(name).alias("statement"))
    return va.statement_shape(text("adequacy").unionByName(text("sufficiency")))


@query("V11_activity_agent_shape", _shape(
    "ActivityAgentShape", "activity", "wasAssociatedWith", "at least one agent", "activity WHERE agent IS NULL",
    "CAST(run_id AS VARCHAR) AS contract_id"))
def _(p):
    return va.activity_agent_shape(p.activity)


@query("V12_generating_activity_shape", """SELECT CAST(event_id // 5 AS VARCHAR) AS contract_id, 'EntityGeneratingActivityShape' AS shape,
  'ent-' || event_id AS focus, 'wasGeneratedBy' AS path, 'at most one generating activity' AS message FROM events WHERE event_id % 23 = 0""")
def _(p):
    """Every 23rd entity is claimed by a second activity."""
    extra = p.prov_edge.filter("kind = 'generated'").filter(
        F.regexp_extract("entity", r"(\d+)", 1).cast("bigint") % 23 == 0
    ).withColumn("activity", F.concat("activity", F.lit("-again")))
    return va.generating_activity_shape(p.prov_edge.unionByName(extra))


_PASSED = _shape("PassedRequiresAdequacyAndSufficiencyShape", "att_id", "inContextOf", "non-empty adequacy text",
                 "attestation WHERE outcome = 'passed' AND adequacy = ''")


@query("V13_passed_requires_adequacy_shape", _PASSED)
def _(p):
    return va.passed_requires_adequacy_shape(p.attestation)


_FORWARD = _shape("ForwardTraceabilityShape", "control_id", "requiresControl", "required control reaches no addressing evidence with a sign-off",
                  """order_control o WHERE NOT EXISTS (SELECT 1 FROM attestation_evidence x JOIN addresses d
    ON d.contract_id = x.contract_id AND d.evidence_id = x.evidence_id AND d.control_id = x.control_id
    WHERE x.contract_id = o.contract_id AND x.control_id = o.control_id)""")


@query("V14_forward_traceability_shape", _FORWARD)
def _(p):
    return va.forward_traceability_shape(
        p.order_control, p.control, p.attestation, p.attestation_evidence, p.addresses
    )


_BACKWARD = _shape("BackwardTraceabilityShape", "att_id", "hasEvidence", "evidence does not address the signed control",
                   "(SELECT DISTINCT contract_id, att_id FROM backward_fail)")


@query("V15_backward_traceability_shape", _BACKWARD)
def _(p):
    return va.backward_traceability_shape(p.attestation, p.attestation_evidence, p.addresses)


_SHAPES = (
    "V1_control_shape", "V2_poam_legality_shape", "V3_contradiction_shape", "V4_override_evidence_shape", "V5_attestation_shape",
    "V6_plan_instantiation_shape", "V7_evidence_shape", "V8_requirement_shape", "V9_strategy_supported_shape", "V9_goal_supported_shape",
    "V10_statement_shape", "V11_activity_agent_shape", "V12_generating_activity_shape", "V13_passed_requires_adequacy_shape",
    "V14_forward_traceability_shape", "V15_backward_traceability_shape",
)


@shared
def _violations(p):
    """All shapes; those over the same rows in one pass."""
    fused = ("V3", "V4", "V13", "V6", "V11", "V14", "V15")
    cut(p, "attestation", "evidence", "order_control")
    return va.validate(
        va.sign_off_shapes(p.attestation, p.assertion), va.activity_shapes(p.activity, p.plan[0]),
        va.traceability_shapes(p.order_control, p.control, p.attestation, p.attestation_evidence, p.addresses),
        *[BUILDERS[name](p) for name in _SHAPES if name.split("_")[0] not in fused])


_ALL = _any(*[f"SELECT contract_id, shape, focus, path, message FROM ({BODIES[name]})" for name in _SHAPES])


@query("V16_violations", _ALL, gather=True)
def _(p):
    return _violations(p)


@query("V16_violations_by_shape", f"SELECT shape, count(*) AS violations FROM ({_ALL}) GROUP BY shape", gather=True)
def _(p):
    return va.violations_by_shape(_violations(p))


@query("V17_verify_verdict", f"""SELECT h.contract_id, coalesce(m.n, 0) AS mismatches, coalesce(v.n, 0) AS violations,
  CASE WHEN m.n > 0 THEN 'tampered' WHEN v.n > 0 AND s.evidentiary_status = 'mock' THEN 'advisory' WHEN v.n > 0 THEN 'failed' ELSE 'intact' END AS verdict
  FROM order_hdr h LEFT JOIN (SELECT contract_id, count(*) AS n FROM evidence WHERE (source_control + source_module) % 97 = 0 GROUP BY 1) m USING (contract_id)
  LEFT JOIN (SELECT CAST(contract_id AS BIGINT) AS contract_id, count(*) AS n FROM ({_ALL}) GROUP BY 1) v USING (contract_id)
  LEFT JOIN evidentiary s USING (contract_id)""", gather=True)
def _(p):
    from trailspark.operators.bom import evidentiary_status

    return va.verify_verdict(
        p.order_hdr, ev.reverify_evidence(p.evidence), _violations(p), evidentiary_status(p.order_hdr, p.evidence)
    )


# -- procedure adherence and provenance ----------------------------------------------


@query("R1_orphan_activities", "SELECT run_id, activity, step FROM activity WHERE step NOT IN ('signup', 'view', 'click', 'purchase')")
def _(p):
    return pv.orphan_activities(p.activity, p.plan[0])


@query("R2_predecessor_violations", "SELECT run_id, step, predecessor FROM predecessor_gap")
def _(p):
    return pv.predecessor_violations(p.activity, *p.plan[:2])


@query("R3_unrealized_outputs", "SELECT run_id, step, variable FROM output_gap")
def _(p):
    return pv.unrealized_outputs(p.activity, p.plan[0], p.plan[2], p.realized)


_ADHERENCE = """SELECT a.run_id, coalesce(e.n, 0) AS executed_steps, coalesce(o.n, 0) AS orphan_activities, coalesce(g.n, 0) AS predecessor_violations,
  coalesce(u.n, 0) AS unrealized_outputs, coalesce(o.n, 0) + coalesce(g.n, 0) + coalesce(u.n, 0) = 0 AS ok FROM (SELECT DISTINCT run_id FROM activity) a
  LEFT JOIN (SELECT run_id, count(*) AS n FROM executed GROUP BY 1) e USING (run_id)
  LEFT JOIN (SELECT run_id, count(*) AS n FROM activity WHERE step NOT IN ('signup', 'view', 'click', 'purchase') GROUP BY 1) o USING (run_id)
  LEFT JOIN (SELECT run_id, count(*) AS n FROM predecessor_gap GROUP BY 1) g USING (run_id)
  LEFT JOIN (SELECT run_id, count(*) AS n FROM output_gap GROUP BY 1) u USING (run_id)"""


@shared
def _adherence(p):
    return pv.procedure_adherence(p.activity, *p.plan, p.realized)


@query("R4_procedure_adherence", _ADHERENCE)
def _(p):
    return _adherence(p)


@query("R4_deviations", """SELECT run_id, 'orphan' AS kind, activity AS detail FROM activity WHERE step NOT IN ('signup', 'view', 'click', 'purchase')
  UNION ALL SELECT run_id, 'predecessor', step || ' ran without ' || predecessor FROM predecessor_gap
  UNION ALL SELECT run_id, 'output', step || ' -> ' || variable FROM output_gap""")
def _(p):
    return pv.deviations(p.activity, *p.plan, p.realized)


@query("R5_compile_provenance", """SELECT contract_id AS run_id, t.kind, 'exec/' || contract_id || '/' || t.step AS activity, t.name || '/' || contract_id AS entity, t.variable
  FROM order_hdr, (VALUES ('ExtractObligations', 'used', 'contract', 'Contract'), ('ExtractObligations', 'generated', 'obligations', 'Obligations'),
    ('ResolveControls', 'used', 'obligations', 'Obligations'), ('ResolveControls', 'generated', 'controls', 'RequiredControls'),
    ('AttestCOP', 'used', 'obligations', 'Obligations'), ('AttestCOP', 'generated', 'cop', 'COP'), ('Gate1', 'used', 'controls', 'RequiredControls'),
    ('EmitOrder', 'used', 'controls', 'RequiredControls'), ('EmitOrder', 'used', 'cop', 'COP'), ('EmitOrder', 'generated', 'order', 'Order')) AS t(step, kind, name, variable)""")
def _(p):
    return pv.compile_provenance(p.order_hdr)


_RAN = "WHERE contract_id NOT IN (SELECT contract_id FROM gate WHERE findings > 0)"


@query("R5_runtime_provenance", f"""SELECT contract_id AS run_id, t.kind, 'exec/' || contract_id || '/' || t.step AS activity, t.name || '/' || contract_id AS entity, t.variable
  FROM order_hdr, (VALUES ('LoadOrder', 'used', 'order', 'Order'), ('FetchByHash', 'used', 'order', 'Order'),
    ('FetchByHash', 'generated', 'modulehashes', 'ModuleHashes'), ('Plan', 'generated', 'planhash', 'PlanHash')) AS t(step, kind, name, variable) {_RAN}
  UNION ALL SELECT contract_id, 'variable', NULL, evidence_id, 'Evidence' FROM evidence {_RAN}
  UNION ALL SELECT contract_id, 'used', 'exec/' || contract_id || '/Oracles', evidence_id, 'Evidence' FROM evidence {_RAN}
  UNION ALL SELECT contract_id, 'variable', NULL, 'controlcheck/' || control_id || '/' || evidence_id, 'OracleAssertions' FROM criteria_result {_RAN}""")
def _(p):
    """Contracts that the residency gate halts run no further stage."""
    from trailspark.operators.oracles import assertions

    gate = gt.residency_gate(p.planned_resource)
    ran = lambda rows: gt.halted_contracts(rows, gate)
    return pv.runtime_provenance(ran(p.order_hdr), ran(p.evidence), ran(assertions(_results(p))))


@query("R5_downstream_provenance", f"""SELECT contract_id AS run_id, t.kind, 'exec/' || contract_id || '/' || t.step AS activity, t.name || '/' || contract_id AS entity, t.variable
  FROM order_hdr, (VALUES ('Attestation', 'generated', 'attestations', 'Attestations'), ('Audit', 'generated', 'bom', 'BOM'),
    ('SignAndStore', 'generated', 'ssp', 'SSP')) AS t(step, kind, name, variable) {_RAN}""")
def _(p):
    return pv.downstream_provenance(gt.halted_contracts(p.order_hdr, gt.residency_gate(p.planned_resource)))


@query("R6_lineage_edges", """SELECT event_id // 5 AS run_id, 'ent-' || event_id AS source, 'ent-' || (event_id + n) AS target, n AS hops
  FROM events, generate_series(1, 15) AS g(n) WHERE (event_id + n) // 5 = event_id // 5 AND event_id + n <= (SELECT max(event_id) FROM events)""")
def _(p):
    return pv.lineage_edges(p.prov_edge)


@query("R7_traceability_edges", """SELECT contract_id, 'Order' AS source, CAST(module_id AS VARCHAR) AS target, 'includes' AS edge, CAST(NULL AS VARCHAR) AS state FROM order_module
  UNION ALL SELECT i.contract_id, CAST(i.module_id AS VARCHAR), CAST(i.control_id AS VARCHAR), 'claims',
    CASE WHEN m.contradicted THEN 'contradicted' ELSE coalesce(o.outcome, 'no-check') END
  FROM included i LEFT JOIN outcomes o USING (contract_id, control_id) LEFT JOIN met m ON m.contract_id = i.contract_id AND m.control_id = i.control_id""", gather=True)
def _(p):
    return pv.traceability_edges(
        p.order_module, p.order_control, p.module_claim, _outcomes(p), au.contradictions(_met(p))
    )


# -- audit package -----------------------------------------------------------------


@query("B17_package_manifest", f"""SELECT d.contract_id, d.bom_hash, s.evidentiary_status, c.score, c.status AS score_status,
  c.valid_submission, coalesce(c.contradictions, 0) AS contradictions, coalesce(m.met_by_machine, 0) AS machine,
  coalesce(m.met_by_human_only, 0) AS human_only, a.ok AS procedure_ok FROM bom_hashes d LEFT JOIN evidentiary s USING (contract_id)
  LEFT JOIN scores c USING (contract_id) LEFT JOIN split m USING (contract_id) LEFT JOIN ({_ADHERENCE}) a ON a.run_id = d.contract_id""", gather=True)
def _(p):
    """Run numbers stand for contracts in the adherence part."""
    from trailspark.operators.bom import evidentiary_status
    from trailspark.plans.auditing import _settled, compute_score

    _settled(p)
    cut(p, "poam")
    adherence = _adherence(p).select(F.col("run_id").alias("contract_id"), "ok")
    return pk.package_manifest(
        _boms(p), evidentiary_status(p.order_hdr, p.evidence), compute_score(p),
        au.proven_vs_attested(_met(p)), adherence,
    )


@query("B17_manifest_controls", f"""SELECT r.*, a.official, a.override_justification, a.override_evidence, x.reference_id AS policy, x.uri,
  x.version, x.signature FROM bom_rows r LEFT JOIN attestation a ON a.contract_id = r.contract_id AND a.control_id = r.control_id
  LEFT JOIN ({_REFS}) x ON x.control_id = r.control_id""", gather=True)
def _(p):
    refs = lk.control_references(p.module_claim, p.module, p.reference)
    return pk.manifest_controls(_rows(p), p.attestation, refs)


@shared
def _package(p):
    """Every 5th manifest is unsigned, every 7th has a bad signature, every 9th a bad one on its bill of materials; files are lost or changed."""
    key = F.col("contract_id")
    manifests = p.order_hdr.select(
        "contract_id", F.when(key % 5 == 0, "none").otherwise("ed25519-v1").alias("sig_algo"),
        (key % 7 != 0).alias("signature_verified"), F.when(key % 3 == 0, key % 9 != 0).alias("bom_signature_verified"),
    )
    body = F.concat(F.lit("bom-"), key)
    artifacts = p.order_hdr.select("contract_id", F.lit("bom.json").alias("name"), F.sha2(body, 256).alias("sha256"))
    files = p.order_hdr.filter(key % 11 != 0).select(
        "contract_id", F.lit("bom.json").alias("name"),
        F.encode(F.when(key % 13 == 0, F.concat(body, F.lit("x"))).otherwise(body), "UTF-8").alias("content"),
    )
    signed = p.attestation.select("contract_id", "control_id", "override_evidence")
    controls = _rows(p).join(signed, ["contract_id", "control_id"], "left")
    return pk.verify_package(manifests, artifacts, files, controls)


_ISSUES = """SELECT contract_id, 'signature' AS part, CASE WHEN contract_id % 5 = 0 THEN 'manifest-unsigned' ELSE 'signature-does-not-verify' END AS issue
    FROM order_hdr WHERE contract_id % 5 = 0 OR contract_id % 7 = 0
  UNION ALL SELECT contract_id, 'artifact', CASE WHEN contract_id % 11 = 0 THEN 'artifact-missing:bom.json' ELSE 'artifact-hash-mismatch:bom.json' END
    FROM order_hdr WHERE contract_id % 11 = 0 OR contract_id % 13 = 0
  UNION ALL SELECT contract_id, 'artifact', 'bom-signature-does-not-verify' FROM order_hdr WHERE contract_id % 9 = 0
  UNION ALL SELECT r.contract_id, 'chain', 'override-without-evidence:' || r.control_id FROM bom_rows r
    JOIN attestation a ON a.contract_id = r.contract_id AND a.control_id = r.control_id
    WHERE r.evidence_backing = 'override' AND a.override_evidence IS NULL"""


@query("B18_package_issues", _ISSUES, gather=True)
def _(p):
    return _package(p)[1]


@query("B18_verify_package", f"""SELECT h.contract_id, count(*) FILTER (part = 'signature') = 0 AS signature_ok, count(*) FILTER (part = 'artifact') = 0 AS artifacts_ok,
  count(*) FILTER (part = 'chain') = 0 AS chain_ok, count(part) AS issues, count(part) = 0 AS ok FROM order_hdr h LEFT JOIN ({_ISSUES}) i USING (contract_id)
  GROUP BY h.contract_id""", gather=True)
def _(p):
    return _package(p)[0]

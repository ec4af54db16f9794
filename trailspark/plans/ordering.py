"""Obligations, planning gate, order compilation and verification, residency."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.functions import vocab
from trailspark.operators import evidence as ev
from trailspark.operators import gates as gt
from trailspark.operators import obligations as ob
from trailspark.functions.groups import digest_sql
from trailspark.plans.registry import cut, query, shared

_PART_ID = "^[0-9]+$"


@shared
def _resolve(p):
    return ob.resolve_obligations(
        p.obligation, p.obligation_derive, p.control, vocab.rules(p.spark), vocab.rule_tokens(p.spark), _PART_ID
    )


@query("G1_obligation_status", """SELECT contract_id, name, obligation_type, data_marker, source_ref, acknowledged, status
  FROM obligation_state""")
def _(p):
    return _resolve(p)[0]


@query("G1_resolve_obligations", "SELECT contract_id, name, control_id, marker FROM resolved")
def _(p):
    return _resolve(p)[1]


@query("U1_required_controls", """SELECT DISTINCT contract_id, control_id FROM resolved WHERE control_id = '*'
    OR (control_id IS NOT NULL AND contract_id NOT IN (SELECT contract_id FROM resolved WHERE control_id = '*'))""")
def _(p):
    return ob.required_controls(_resolve(p)[1])


@query("G2_policy_markers", "SELECT DISTINCT contract_id, marker FROM resolved WHERE marker IS NOT NULL")
def _(p):
    return ob.policy_markers(_resolve(p)[1])


@query("G3_profile_affirmations", """SELECT contract_id, name, true AS no_environment_control FROM obligation_state
  WHERE status = 'deliverable'""")
def _(p):
    return ob.profile_signoff(_resolve(p)[0])[0]


@query("G3_profile_signoff", """SELECT contract_id, NOT bool_or(status = 'spillover') AS attested,
  count(*) FILTER (status = 'deliverable') AS affirmations, count(*) FILTER (status = 'spillover') AS blocking,
  count(*) FILTER (status = 'acknowledged') AS acknowledged, 'manual' AS mode FROM obligation_state GROUP BY contract_id""")
def _(p):
    return ob.profile_signoff(_resolve(p)[0])[1]


@query("G4_clause_missing", "SELECT contract_id, clause, token FROM clause_missing")
def _(p):
    return ob.clause_gaps(p.cited_clause, p.present_token, p.clause_rule)[0]


@query("G4_clause_completeness", """SELECT h.contract_id, count(m.token) = 0 AS ok, count(m.token) AS missing,
  CAST(max(CASE WHEN h.priority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS BIGINT) AS unknown_clauses
  FROM order_hdr h LEFT JOIN clause_missing m USING (contract_id) GROUP BY h.contract_id""")
def _(p):
    return ob.clause_completeness(p.cited_clause, p.present_token, p.clause_rule)


@shared
def _edges(p):
    return gt.claim_edges(p.module_claim)


@query("G5_gate_forward", """SELECT contract_id, control_id, weight FROM order_control JOIN control USING (control_id)
  WHERE control_id NOT IN (SELECT control_id FROM module_claim)""")
def _(p):
    return gt.gate_forward(p.order_control, p.module_claim, p.control)


@query("G6_gate_backward", """SELECT contract_id, module_id FROM order_module EXCEPT SELECT contract_id, module_id FROM included""")
def _(p):
    return gt.gate_backward(p.order_control, p.module_claim, p.order_module)


@query("G7_gate_paper_claims", """SELECT DISTINCT contract_id, module_id FROM order_control JOIN module_claim USING (control_id)
  JOIN module USING (module_id) WHERE method IS NULL""")
def _(p):
    return gt.gate_paper_claims(p.order_control, p.module_claim, p.module)


@query("G8_gate_report", """SELECT contract_id, required, gaps, included, orphans, claiming, paper_claims,
  gaps = 0 AS forward_passed, orphans = 0 AS backward_passed, paper_claims = 0 AS methods_passed,
  gaps = 0 AND orphans = 0 AND paper_claims = 0 AS passed FROM gate_report""", gather=True)
def _(p):
    cut(p, "order_control", "order_module", "module_claim", _edges)
    return gt.gate_report(p.order_control, _edges(p), p.module, p.control, p.order_module)


@query("G8_forward_map", """SELECT o.contract_id, o.control_id, coalesce(m.n, 0) AS modules, c.modules_digest FROM order_control o
  LEFT JOIN (SELECT control_id, count(*) AS n FROM module_claim GROUP BY 1) m USING (control_id) LEFT JOIN claimers c USING (control_id)""")
def _(p):
    return gt.gate_maps(p.order_control, p.module_claim, p.order_module)[0]


@query("G8_backward_map", """SELECT o.contract_id, o.module_id, i.control_id FROM order_module o LEFT JOIN included i
  ON i.contract_id = o.contract_id AND i.module_id = o.module_id""", gather=True)
def _(p):
    cut(p, "module_claim", _edges)
    return gt.gate_maps(p.order_control, _edges(p), p.order_module)[1]


@query("G9_default_scope", "SELECT contract_id, item, value FROM scope_rows")
def _(p):
    return ob.default_scope(p.obligation, ob.policy_markers(_resolve(p)[1]))


@shared
def _compiled(p):
    cut(p, "order_control", "order_module", "module_claim", _edges)
    flaws = gt.order_flaws(p.order_hdr, p.order_control, _edges(p), p.module, p.order_module)
    return gt.compile_orders(p.order_hdr, p.order_control, p.order_module, flaws)


@query("G10_compiled_orders", """SELECT contract_id, 'Tier1' AS tier, 'IL4' AS impact_level, 'NIST SP 800-171 Rev 2' AS standard
  FROM decisions WHERE reason IS NULL""", gather=True)
def _(p):
    return _compiled(p)[0]


@query("G10_compiled_controls", """SELECT contract_id, control_id FROM order_control JOIN decisions USING (contract_id) WHERE reason IS NULL""", gather=True)
def _(p):
    return _compiled(p)[1]


@query("G10_compiled_modules", """SELECT contract_id, module_id FROM order_module JOIN decisions USING (contract_id) WHERE reason IS NULL""", gather=True)
def _(p):
    return _compiled(p)[2]


@query("G10_refused_orders", "SELECT contract_id, reason FROM decisions WHERE reason IS NOT NULL", gather=True)
def _(p):
    return _compiled(p)[3]


@query("G11_obligation_rows", """SELECT s.contract_id, s.name, s.obligation_type, coalesce(s.data_marker, '') AS data_marker, r.control_id, r.marker,
  CASE WHEN s.status IN ('spillover', 'acknowledged') THEN 'marked deliverable: explicit spillover acknowledgement required'
    WHEN r.marker IS NOT NULL THEN 'policy marker' ELSE '' END AS note
  FROM obligation_state s LEFT JOIN resolved r USING (contract_id, name)""")
def _(p):
    return ob.obligation_rows(*_resolve(p))


# -- hashes of an order ------------------------------------------------------------


@shared
def _hashes(p):
    cut(p, "order_control", "order_module", "module_claim", "obligation", "obligation_derive", _edges)
    scope = p.by_contract(ob.default_scope(p.obligation, ob.policy_markers(_resolve(p)[1])))
    return gt.order_hashes(p.order_control, _edges(p), p.module, p.order_module,
                           ob.profile_lines(p.obligation, p.obligation_derive), scope, p.module_hash)


@query("H3_control_set_hash", "SELECT contract_id, control_set_hash FROM control_set_hashes")
def _(p):
    return gt.control_set_hash(p.order_control)


@query("H3_profile_hash", "SELECT contract_id, cop_hash FROM cop_hashes")
def _(p):
    return ob.profile_hash(p.obligation, p.obligation_derive)


@query("H3_coverage_proof_hash", "SELECT contract_id, coverage_proof_hash FROM coverage_hashes", gather=True)
def _(p):
    cut(p, "module_claim")
    return gt.coverage_proof_hash(p.order_control, p.module_claim, p.module, p.order_module)


@query("H3_order_hash", "SELECT contract_id, order_hash FROM order_hashes", gather=True)
def _(p):
    return _hashes(p).select("contract_id", "order_hash")


@query("P1_verify_orders", """SELECT contract_id, reason IS NULL AS verified, reason FROM (SELECT h.contract_id,
  CASE WHEN NOT attested THEN 'not-attested' WHEN contract_id % 7 = 0 THEN 'control-set-hash-mismatch'
    WHEN contract_id % 11 = 0 OR order_hash IS NULL THEN 'order-hash-mismatch' END AS reason
  FROM order_hdr h JOIN order_hashes USING (contract_id))""", gather=True)
def _(p):
    """Stated hashes are the compiled ones, tampered with on every 7th and 11th contract."""
    cut(p, _hashes)
    fresh = _hashes(p).select("contract_id", "control_set_hash", "order_hash")
    key = F.col("contract_id")
    bad = lambda n, name: F.when(key % n == 0, tx.sha256(F.col(name))).otherwise(F.col(name)).alias(name)
    stated = p.order_hdr.select("contract_id", "attested").join(fresh, "contract_id").select(
        "contract_id", "attested", bad(7, "control_set_hash"), bad(11, "order_hash")
    )
    return gt.verify_orders(stated, fresh)


_MODULE_HASH = digest_sql("""SELECT module_id, count(*) || ' ' || s || ' ' || p || ' ' || o || ' .' AS line FROM module_fact
    GROUP BY module_id, s, p, o""", "module_id", "module_hash")


@query("H2_module_description_hash", _MODULE_HASH)
def _(p):
    return ev.module_description_hash(p.module_fact, p.node_fact)


@query("P2_verify_modules", f"""SELECT om.contract_id, om.module_id, CASE WHEN (om.contract_id + om.module_id) % 53 = 0 THEN 'bad' ELSE h.module_hash END AS stated_hash,
  h.module_hash AS actual_hash, (om.contract_id + om.module_id) % 53 <> 0 AS verified FROM order_module om JOIN ({_MODULE_HASH}) h USING (module_id)""")
def _(p):
    actual = ev.module_description_hash(p.module_fact, p.node_fact)
    bad = (F.col("contract_id") + F.col("module_id")) % 53 == 0
    stated = p.order_module.join(actual, "module_id").select(
        "contract_id", "module_id", F.when(bad, "bad").otherwise(F.col("module_hash")).alias("stated_hash")
    )
    return gt.verify_modules(stated, actual)


# -- residency ---------------------------------------------------------------------


@query("P3_residency_findings", """SELECT contract_id, resource_id, unnest(['region-not-us', 'criterion-failed:ITAR-120.54']) AS finding, region
    FROM planned_resource WHERE region IS NOT NULL AND NOT starts_with(region, 'us')
  UNION ALL SELECT contract_id, '<none>', 'no-region-signal', NULL FROM gate WHERE region_signals = 0""")
def _(p):
    return gt.residency_findings(p.planned_resource)


@query("P3_residency_gate", "SELECT *, findings = 0 AS passed FROM gate")
def _(p):
    return gt.residency_gate(p.planned_resource)


@query("P4_halted_contracts", """SELECT contract_id, control_id FROM order_control WHERE contract_id NOT IN
  (SELECT contract_id FROM gate WHERE findings > 0)""")
def _(p):
    return gt.halted_contracts(p.order_control, gt.residency_gate(p.planned_resource))


@query("P5_plan_conformance", """SELECT contract_id, resource_id, count(*) AS rows,
  CASE WHEN resource_id = '' THEN 'resource-id-missing' ELSE 'resource-id-repeated' END AS issue
  FROM (SELECT contract_id, CASE WHEN module_id % 13 = 0 THEN '' ELSE 'res-' || (module_id % 25) END AS resource_id FROM order_module)
  GROUP BY contract_id, resource_id HAVING resource_id = '' OR count(*) > 1""")
def _(p):
    m = F.col("module_id")
    loose = p.order_module.select(
        "contract_id", F.when(m % 13 == 0, "").otherwise(F.concat(F.lit("res-"), m % 25)).alias("resource_id")
    )
    return gt.plan_conformance(loose)


@query("S7_region_signals", "SELECT contract_id, address, signal FROM signals")
def _(p):
    return ev.region_signals(p.region_input)


@query("S6_plan_evidence", """SELECT t.contract_id, t.module_id,
  CASE WHEN s.module_id IS NOT NULL AND n.contract_id IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN s.module_id IS NOT NULL THEN 'terraform-plan-residency' ELSE 'terraform-plan-presence' END AS "check",
  CASE WHEN s.module_id IS NULL THEN NULL WHEN n.contract_id IS NOT NULL THEN 'NON-US' ELSE 'US' END AS data_region,
  'mock-plan' AS evidentiary_status, 'terraform-plan' AS tool
  FROM order_module t LEFT JOIN (SELECT DISTINCT contract_id, module_id FROM lines WHERE control_id % 5 = 0) s USING (contract_id, module_id)
  LEFT JOIN (SELECT DISTINCT contract_id FROM signals WHERE NOT (contains(signal, 'us-locations')
    OR starts_with(regexp_replace(signal, '^[^:]*:', ''), 'us'))) n USING (contract_id) WHERE t.module_id % 10 <> 1""")
def _(p):
    """Controls divisible by five stand for the residency control."""
    tags = p.order_module.select("contract_id", "module_id", (F.col("module_id") % 10 == 1).alias("inherited"))
    control = F.when(F.col("control_id") % 5 == 0, vocab.RESIDENCY_CONTROL).otherwise(F.col("control_id").cast("string"))
    scoped = p.module_use.select("contract_id", "module_id", control.alias("control_id"))
    return ev.plan_evidence(tags, scoped, ev.region_signals(p.region_input))

"""The projection as SQL views, for the SQL that checks each query."""

from __future__ import annotations

from trailspark.functions.groups import digest_sql

_ROLE = """CASE {0} % 4 WHEN 0 THEN 'Role_AffirmingOfficial' WHEN 1 THEN 'Role_SecurityOfficer'
  WHEN 2 THEN 'Role_ITAdmin' ELSE 'Role_OPs' END"""

_LABEL = """CASE {0} WHEN 'passed' THEN 'MET' WHEN 'failed' THEN 'NOT MET' WHEN 'inapplicable' THEN 'N/A'
  WHEN 'untested' THEN 'PLANNED' WHEN 'needsAction' THEN 'NEEDS ACTION' END"""

# In definition order: a view may name the ones above it.
VIEWS: dict[str, str] = {
    "lines": """SELECT l_orderkey AS contract_id, l_partkey AS control_id, l_suppkey AS module_id,
  l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""",
    "control": """SELECT p_partkey AS control_id, p_name AS text, p_type AS family,
  CAST(CASE p_size % 5 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END AS BIGINT) AS weight,
  (p_size % 5 > 1 AND p_partkey % 10 <> 0) AS poam_eligible,
  (p_size % 5 = 0 AND p_partkey % 7 = 0) AS variable_weight,
  CASE WHEN p_size % 5 = 0 AND p_partkey % 7 = 0 THEN CAST(3 AS BIGINT) END AS weight_if_partial
  FROM part""",
    "module": f"""SELECT s_suppkey AS module_id, s_name AS label,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN 'inherited:csp'
    WHEN s_suppkey % 10 <= 4 THEN 'oracle-attested-reference' ELSE 'oracle-config-check' END AS method,
  s_suppkey % 10 >= 2 AS method_is_iri,
  CASE WHEN s_suppkey % 10 IN (2, 3) THEN s_suppkey END AS reference_id,
  {_ROLE.format('s_suppkey')} AS role, CAST(s_nationkey AS BIGINT) AS source_id FROM supplier""",
    "module_claim": "SELECT DISTINCT module_id, control_id FROM lines WHERE control_id % 20 <> 7",
    "source_label": "SELECT CAST(n_nationkey AS BIGINT) AS source_id, n_name AS label FROM nation",
    "reference": """SELECT doc_id AS reference_id,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'file://documents/' || doc_id || '.md' END AS uri,
  source AS source_system,
  CAST(CASE lang WHEN 'en' THEN 365 WHEN 'de' THEN 180 WHEN 'fr' THEN 90 ELSE 0 END AS BIGINT) AS freshness_days,
  CASE WHEN doc_id % 19 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 400 AS INTEGER)) END AS last_verified,
  'custodian-' || (doc_id % 5) AS custodian, sha256(text) AS version,
  CASE WHEN doc_id % 23 <> 0 THEN 'sig-' || doc_id END AS signature,
  doc_id % 31 <> 0 AS resolved_ok, doc_id % 29 <> 0 AS signature_verified FROM documents""",
    "criterion": """SELECT p_partkey AS control_id, 'qty' AS metric_key,
  CASE p_partkey % 5 WHEN 0 THEN 'eq' WHEN 1 THEN 'ne' WHEN 2 THEN 'le' WHEN 3 THEN 'ge' ELSE 'in' END AS comparator,
  CASE WHEN p_partkey % 5 = 4 THEN '[' || p_size || ', ' || (p_size + 1) || ']' ELSE CAST(p_size AS VARCHAR) END AS threshold,
  p_size AS bound FROM part WHERE p_partkey % 3 <> 0""",
    "order_hdr": """SELECT o_orderkey AS contract_id, o_orderstatus <> 'P' AS attested, o_custkey AS owner,
  o_orderpriority AS priority FROM orders""",
    "order_control": "SELECT DISTINCT contract_id, control_id FROM lines",
    "order_module": "SELECT DISTINCT contract_id, module_id FROM lines",
    "obligation": """SELECT contract_id, 'OBL-' || l_linenumber AS name,
  CASE l_linenumber % 6 WHEN 0 THEN 'framework' WHEN 1 THEN 'hosting' WHEN 2 THEN 'data'
    WHEN 3 THEN 'personnel' WHEN 4 THEN 'environment' ELSE 'deliverable' END AS obligation_type,
  CASE max(l_returnflag) WHEN 'A' THEN 'CUI' WHEN 'R' THEN 'ITAR' END AS data_marker,
  'clause-' || l_linenumber AS source_ref, contract_id % 4 = 0 AS acknowledged
  FROM lines GROUP BY contract_id, l_linenumber""",
    "obligation_derive": """SELECT DISTINCT contract_id, 'OBL-' || l_linenumber AS name, CAST(control_id AS VARCHAR) AS token FROM lines
  UNION SELECT contract_id, 'OBL-' || l_linenumber, 'US-PERSON' FROM lines WHERE l_returnflag = 'R'
  UNION SELECT contract_id, 'OBL-' || l_linenumber, 'ALL-110-NIST-800-171' FROM lines WHERE contract_id % 40 = 0""",
    "obligation_state": """SELECT *, CASE
  WHEN obligation_type = 'deliverable' AND data_marker IS NOT NULL THEN CASE WHEN acknowledged THEN 'acknowledged' ELSE 'spillover' END
  WHEN obligation_type = 'deliverable' THEN 'deliverable' ELSE 'resolved' END AS status FROM obligation""",
    "resolved": """SELECT d.contract_id, d.name, '*' AS control_id, CAST(NULL AS VARCHAR) AS marker
    FROM obligation_state o JOIN obligation_derive d USING (contract_id, name)
    WHERE o.status = 'resolved' AND d.token = 'ALL-110-NIST-800-171'
  UNION SELECT d.contract_id, d.name, CASE WHEN regexp_matches(d.token, '^[0-9]+$') THEN d.token END,
      CASE WHEN NOT regexp_matches(d.token, '^[0-9]+$') THEN d.token END
    FROM obligation_state o JOIN obligation_derive d USING (contract_id, name)
    WHERE o.status = 'resolved' AND d.contract_id % 40 <> 0""",
    "clause_rule": """SELECT * FROM (VALUES ('1-URGENT', 'A'), ('1-URGENT', 'R'), ('2-HIGH', 'R'), ('3-MEDIUM', 'A'),
  ('3-MEDIUM', 'N'), ('3-MEDIUM', 'R'), ('5-LOW', 'N')) AS t(clause, token)""",
    "clause_missing": """SELECT h.contract_id, r.clause, r.token FROM order_hdr h JOIN clause_rule r ON r.clause = h.priority
  WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.contract_id = h.contract_id AND l.l_returnflag = r.token)""",
    "evidence": """SELECT contract_id, contract_id || '-' || control_id || '-' || module_id AS evidence_id,
  control_id AS source_control, module_id AS source_module,
  CASE module_id % 3 WHEN 0 THEN 'ConfigExport' WHEN 1 THEN 'PolicyCheck' ELSE 'Other' END AS subtype,
  module_id AS seq, max(CAST(l_quantity AS INTEGER)) AS qty,
  CASE WHEN module_id % 11 = 0 THEN '{"other": ' ELSE '{"qty": ' END || max(CAST(l_quantity AS INTEGER)) || '}' AS summary,
  CASE WHEN contract_id % 10 = 0 THEN 'mock' ELSE 'real' END AS evidentiary_status,
  CASE WHEN module_id % 6 <> 0 THEN 'exports/' || module_id || '.json' END AS source_file,
  max(l_shipdate) AS generated_at,
  sha256(contract_id || '-' || control_id || '-' || module_id) AS model_hash,
  sha256('{"model_hash": "' || CASE WHEN (control_id + module_id) % 97 = 0 THEN 'x' ELSE '' END
    || sha256(contract_id || '-' || control_id || '-' || module_id)
    || '", "proof_hash": null, "sim_hash": null}') AS content_hash
  FROM lines GROUP BY contract_id, control_id, module_id""",
    "addresses": """SELECT contract_id, evidence_id,
  CASE WHEN source_control % 13 = 0 THEN source_control + 1 ELSE source_control END AS control_id
  FROM evidence WHERE source_module % 9 <> 0""",
    "attestation": """SELECT contract_id, 'ATT-' || contract_id || '-' || control_id AS att_id, control_id,
  CASE WHEN f IN ('A', 'N') THEN 'passed' WHEN n % 2 = 0 THEN 'failed' ELSE 'needsAction' END AS outcome,
  CASE WHEN n = 1 THEN NULL WHEN s = 'F' AND f = 'N' THEN 'failed' WHEN n = 2 THEN 'inherited' ELSE 'passed' END AS oracle_outcome,
  CASE WHEN n IN (1, 3) THEN 'assert-' || control_id END AS backed_by,
  CASE WHEN t > 0.05 THEN 'why | ' || control_id END AS override_justification,
  CASE WHEN d > 0.05 THEN 'proof-' || control_id END AS override_evidence,
  CASE WHEN control_id % 6 = 0 THEN 'DE-' || control_id END AS document_evidence,
  'Official ' || (contract_id % 3) AS official,
  CASE WHEN n % 2 = 0 THEN 'manual' ELSE 'semiAuto' END AS mode, shipped AS generated_at,
  CASE WHEN control_id % 50 = 0 THEN '' ELSE 'adequate ' || control_id END AS adequacy,
  CASE WHEN control_id % 40 <> 0 THEN 'sufficient ' || control_id END AS sufficiency
  FROM (SELECT contract_id, control_id, max(l_returnflag) AS f, max(l_linestatus) AS s, max(l_linenumber) AS n,
      max(l_tax) AS t, max(l_discount) AS d, max(l_shipdate) AS shipped FROM lines GROUP BY contract_id, control_id)
  WHERE n % 7 <> 0""",
    "attestation_evidence": """SELECT a.contract_id, a.control_id, a.att_id, e.evidence_id FROM attestation a
  JOIN evidence e ON e.contract_id = a.contract_id AND e.source_control = a.control_id""",
    "poam": """SELECT contract_id, control_id, 'poam/POAM-' || contract_id || '-' || control_id AS poam_item
  FROM order_control oc WHERE control_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM attestation a
    WHERE a.contract_id = oc.contract_id AND a.control_id = oc.control_id AND a.outcome = 'passed')""",
    "met": """SELECT *, outcome = 'passed' AS met,
  override_justification IS NOT NULL AND override_evidence IS NOT NULL AS overridden,
  outcome = 'passed' AND NOT (override_justification IS NOT NULL AND override_evidence IS NOT NULL)
    AND (coalesce(oracle_outcome = 'failed', false) OR (backed_by IS NOT NULL AND oracle_outcome IS NULL)) AS contradicted
  FROM attestation""",
    "attestation_log": """SELECT 'log-' || conv_id || '-' || turn AS id, 'Signer ' || (conv_id % 9) AS signer,
  CASE WHEN conv_id % 3 = 0 THEN 'Role_AffirmingOfficial' WHEN role = 'user' THEN 'Role_SecurityOfficer'
    WHEN role = 'assistant' THEN 'Role_ITAdmin' ELSE 'Role_OPs' END AS signer_role,
  DATE '2024-03-01' + CAST(turn * 60 + conv_id % 20 AS INTEGER) AS signed_on,
  CASE WHEN conv_id % 6 = 5 THEN 'conv-' || conv_id ELSE CAST(conv_id AS VARCHAR) END AS cover_key, conv_id, turn,
  CASE WHEN conv_id % 7 = 3 THEN 'failed' WHEN conv_id % 7 = 4 THEN 'needsAction' ELSE 'passed' END AS outcome,
  CASE WHEN conv_id % 11 <> 0 THEN 'reviewed' ELSE '' END AS adequacy,
  CASE WHEN turn % 5 <> 4 THEN 'enough' ELSE '' END AS sufficiency,
  CASE WHEN conv_id % 4 = 0 THEN 'sig' || conv_id END AS sig,
  CASE WHEN conv_id % 8 = 0 THEN 'ed25519-v1' ELSE 'none' END AS sig_algo, text AS notes,
  CASE WHEN conv_id % 5 = 0 THEN 'override' END AS override_justification,
  CASE WHEN conv_id % 10 = 0 THEN 'artifact' END AS override_evidence,
  conv_id * 1000 + turn AS line FROM conversations""",
    "latest_log": """SELECT cover_key, CAST(c AS VARCHAR) AS control_id, id AS att_id, signer, signer_role,
  outcome AS att_outcome, adequacy, sufficiency, notes, signed_on FROM (
    SELECT l.*, c, row_number() OVER (PARTITION BY cover_key, c ORDER BY signed_on DESC, line) AS rn
    FROM attestation_log l, generate_series(0, 49) AS g(c) WHERE c % 7 <> l.conv_id % 7) WHERE rn = 1""",
    "attested_use": f"""SELECT doc_id AS reference_id, CAST(doc_id % 20 AS VARCHAR) AS cover_key,
  CAST(doc_id % 50 AS VARCHAR) AS control_id, {_ROLE.format('doc_id')} AS required_role,
  doc_id % 37 = 0 AS unregistered FROM documents""",
    "fresh": """SELECT reference_id, freshness_days, last_verified,
  CASE WHEN last_verified IS NULL THEN NULL
    WHEN freshness_days = 0 THEN true ELSE date_diff('day', last_verified, TIMESTAMP '2025-01-15') <= freshness_days END AS is_fresh,
  CASE WHEN freshness_days = 0 THEN 'event-based'
    WHEN last_verified IS NULL THEN NULL
    WHEN date_diff('day', last_verified, TIMESTAMP '2025-01-15') <= freshness_days THEN 'fresh'
    ELSE 'stale:' || date_diff('day', last_verified, TIMESTAMP '2025-01-15') || 'd>' || freshness_days || 'd' END AS reason,
  CASE WHEN freshness_days <> 0 AND last_verified IS NOT NULL
    THEN date_diff('day', last_verified, TIMESTAMP '2025-01-15') END AS age_days FROM reference""",
    "criteria_result": """SELECT a.contract_id, a.evidence_id, a.control_id, c.metric_key, c.comparator, c.threshold,
  CASE WHEN c.metric_key IS NULL OR e.source_module % 11 = 0 THEN 'needsAction'
    WHEN CASE c.comparator WHEN 'eq' THEN e.qty = c.bound WHEN 'ne' THEN e.qty <> c.bound WHEN 'le' THEN e.qty <= c.bound
      WHEN 'ge' THEN e.qty >= c.bound ELSE e.qty IN (c.bound, c.bound + 1) END THEN 'passed' ELSE 'failed' END AS outcome,
  CASE WHEN c.metric_key IS NULL THEN 'no-machine-criterion' WHEN e.source_module % 11 = 0 THEN 'metric-absent' END AS reason,
  CASE WHEN c.metric_key IS NOT NULL AND e.source_module % 11 <> 0 THEN CAST(e.qty AS VARCHAR) END AS metric_value, e.seq
  FROM addresses a JOIN evidence e USING (contract_id, evidence_id) LEFT JOIN criterion c ON c.control_id = a.control_id""",
    "outcomes": """SELECT contract_id, control_id, outcome FROM (SELECT *, row_number() OVER (
  PARTITION BY contract_id, control_id ORDER BY seq DESC, evidence_id DESC) AS rn FROM criteria_result) WHERE rn = 1""",
    "first_claim": """SELECT control_id, module_id, reference_id, role FROM (SELECT c.control_id, m.*, row_number() OVER (
  PARTITION BY c.control_id ORDER BY m.module_id) AS rn FROM module_claim c JOIN module m USING (module_id)
  WHERE m.method = 'oracle-attested-reference') WHERE rn = 1""",
    "planned_resource": """SELECT contract_id, 'res-' || module_id AS resource_id, module_id,
  CASE WHEN module_id % 4 = 0 THEN 'google_storage_bucket' ELSE 'terraform_data' END AS type,
  CASE WHEN module_id % 7 = 0 THEN NULL WHEN r_name = 'AMERICA' THEN 'us-east1' ELSE lower(r_name) END AS region
  FROM order_module JOIN supplier ON s_suppkey = module_id JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey""",
    "gate": """SELECT contract_id, count(*) AS resources, count(region) AS region_signals,
  count(*) FILTER (region IS NOT NULL AND NOT starts_with(region, 'us')) AS non_us,
  2 * count(*) FILTER (region IS NOT NULL AND NOT starts_with(region, 'us'))
    + CASE WHEN count(region) = 0 THEN 1 ELSE 0 END AS findings FROM planned_resource GROUP BY contract_id""",
    "resource_control": "SELECT DISTINCT contract_id, 'res-' || module_id AS resource_id, control_id FROM lines",
    "signals": """SELECT contract_id, 'res.m' || module_id AS address, region AS signal FROM planned_resource
    WHERE region IS NOT NULL AND module_id % 10 <> 4
  UNION ALL SELECT contract_id, 'policy.m' || module_id || '.resource_locations', unnest([region, 'in:' || region, 'in:us-locations'])
    FROM planned_resource WHERE region IS NOT NULL AND module_id % 10 = 4""",
    "activity": """SELECT event_id // 5 AS run_id, 'act-' || event_id AS activity, event_type AS step,
  CASE WHEN event_id % 43 <> 0 THEN ts END AS started_at,
  CASE WHEN event_id % 41 <> 0 THEN 'user-' || user_id END AS agent, value > 50 AS realised FROM events""",
    "executed": """SELECT DISTINCT run_id, step FROM activity WHERE step IN ('signup', 'view', 'click', 'purchase')""",
    "precedes": """SELECT * FROM (VALUES ('view', 'signup'), ('click', 'view'), ('purchase', 'click')) AS t(step, predecessor)""",
    "predecessor_gap": """SELECT e.run_id, e.step, p.predecessor FROM executed e JOIN precedes p USING (step)
  WHERE NOT EXISTS (SELECT 1 FROM executed x WHERE x.run_id = e.run_id AND x.step = p.predecessor)""",
    "output_gap": """SELECT e.run_id, e.step, 'var-' || e.step AS variable FROM executed e
  WHERE NOT EXISTS (SELECT 1 FROM activity a WHERE a.run_id = e.run_id AND a.step = e.step AND a.realised)""",
    "prov_edge": """SELECT event_id // 5 AS run_id, 'generated' AS kind, 'act-' || event_id AS activity, 'ent-' || event_id AS entity FROM events
  UNION ALL SELECT event_id // 5, 'used', 'act-' || event_id, 'ent-' || (event_id - 1) FROM events WHERE event_id % 5 <> 0""",
    "quads": """SELECT contract_id, 'order' AS graph, '<urn:order/' || contract_id || '>' AS s, '<urn:term#priority>' AS p,
    '"' || priority || '"' AS o FROM order_hdr
  UNION ALL SELECT contract_id, 'order', '<urn:order/' || contract_id || '>', '<urn:term#requiresControl>',
    '<urn:control/' || control_id || '>' FROM order_control
  UNION ALL SELECT contract_id, 'evidence', '<urn:evidence/' || evidence_id || '>', '<urn:term#addresses>',
    '<urn:control/' || control_id || '>' FROM addresses
  UNION ALL SELECT contract_id, 'attestations', '<urn:attestation/' || att_id || '>', '<urn:term#association>',
    '_:b' || control_id FROM attestation""",
    "snapshots": """SELECT o_custkey AS ref, 'order' AS graph, CAST(0 AS BIGINT) AS seq,
    '<urn:order/' || o_orderkey || '> <urn:term#status> "' || o_orderstatus || '" .' AS line FROM orders WHERE o_orderkey % 5 <> 0
  UNION SELECT o_custkey, 'order', 1, '<urn:order/' || o_orderkey || '> <urn:term#status> "'
    || CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE o_orderstatus END || '" .' FROM orders WHERE o_orderkey % 7 <> 0
  UNION SELECT o_custkey, 'structural', v, '<urn:owner/' || o_custkey || '> <urn:term#priority> "' || o_orderpriority || '" .'
    FROM orders, generate_series(0, 1) AS g(v)""",
    "graph_hashes": digest_sql("SELECT ref, seq, graph, line FROM snapshots", "ref, seq, graph", "graph_hash"),
    "versions": f"""SELECT ref, seq, sha256('{{"graphs": "' || g || '", "project": "traces", "ref": "' || ref || '"}}') AS version FROM ({digest_sql(
    "SELECT ref, seq, graph || ' ' || graph_hash AS line FROM graph_hashes", "ref, seq", "g")})""",
    "commits": "SELECT ref, seq, version, graph, graph_hash FROM graph_hashes JOIN versions USING (ref, seq)",
    "module_fact": """SELECT module_id, '<urn:module/' || module_id || '>' AS s, '<urn:term#label>' AS p, '"' || label || '"' AS o FROM module
  UNION ALL SELECT module_id, '<urn:module/' || module_id || '>', '<urn:term#method>', '"' || method || '"' FROM module WHERE method IS NOT NULL
  UNION ALL SELECT module_id, '<urn:module/' || module_id || '>', '<urn:term#claims>', '<urn:control/' || control_id || '>'
    FROM module_claim WHERE control_id % 10 <> 0
  UNION ALL SELECT module_id, '<urn:module/' || module_id || '>', '<urn:term#owns>/<urn:term#type>', '<urn:term#Satisfy>'
    FROM module_claim WHERE control_id % 10 = 0
  UNION ALL SELECT module_id, '<urn:module/' || module_id || '>', '<urn:term#owns>/<urn:term#requirement>', '<urn:control/' || control_id || '>'
    FROM module_claim WHERE control_id % 10 = 0""",
    "bom_order": """SELECT contract_id, sha256('order-' || contract_id) AS order_hash,
  CASE WHEN contract_id % 5 <> 0 THEN sha256('state-' || contract_id) END AS state_hash,
  'Tier1' AS tier, 'IL4' AS impact_level, 'NIST SP 800-171 Rev 2' AS standard FROM order_hdr""",
    "module_hash": "SELECT contract_id, module_id, sha256('module-' || module_id) AS module_hash FROM order_module",
    "document_use": """SELECT contract_id, control_id, 'REF-' || control_id AS reference_id,
  CASE WHEN control_id % 4 <> 2 THEN sha256('doc-' || control_id) END AS sha256, 'commit-' || control_id AS git_commit,
  '2024-06-01' AS git_committed_at, CASE WHEN control_id % 9 <> 0 THEN 'passed' ELSE 'failed' END AS outcome
  FROM attestation WHERE document_evidence IS NOT NULL""",
    "evidentiary": """SELECT h.contract_id, CASE WHEN bool_or(e.evidentiary_status = 'mock') OR count(e.evidence_id) = 0
  THEN 'mock' ELSE 'real' END AS evidentiary_status FROM order_hdr h LEFT JOIN evidence e USING (contract_id) GROUP BY h.contract_id""",
    "row_hashes": """SELECT a.contract_id, a.control_id, e.content_hash FROM addresses a JOIN evidence e USING (contract_id, evidence_id)
    JOIN order_control o ON o.contract_id = a.contract_id AND o.control_id = a.control_id
  UNION SELECT contract_id, control_id, sha256 FROM document_use WHERE sha256 IS NOT NULL""",
    "bom_rows": f"""SELECT o.contract_id, o.control_id,
  coalesce(r.n, 0) AS resources, coalesce(h.n, 0) AS hashes,
  oc.outcome AS oracle_outcome, a.outcome AS attestation_outcome,
  coalesce({_LABEL.format('a.outcome')}, 'NOT MET') AS status,
  CASE WHEN a.outcome = 'passed' AND oc.outcome = 'failed' THEN 'override'
    WHEN d.outcome = 'passed' AND a.outcome = 'passed' AND h.n IS NOT NULL THEN 'attested-evidenced'
    WHEN oc.outcome = 'passed' AND h.n IS NOT NULL THEN 'machine' ELSE 'human-only' END AS evidence_backing,
  d.reference_id, d.git_commit, d.git_committed_at
  FROM order_control o
  LEFT JOIN (SELECT contract_id, control_id, count(*) AS n
    FROM resource_control GROUP BY ALL) r ON r.contract_id = o.contract_id AND r.control_id = o.control_id
  LEFT JOIN (SELECT contract_id, control_id, count(*) AS n
    FROM row_hashes GROUP BY ALL) h ON h.contract_id = o.contract_id AND h.control_id = o.control_id
  LEFT JOIN outcomes oc ON oc.contract_id = o.contract_id AND oc.control_id = o.control_id
  LEFT JOIN attestation a ON a.contract_id = o.contract_id AND a.control_id = o.control_id
  LEFT JOIN document_use d ON d.contract_id = o.contract_id AND d.control_id = o.control_id AND d.sha256 IS NOT NULL""",
    "artifact_hashes": """SELECT contract_id, order_hash AS hash FROM bom_order UNION SELECT contract_id, state_hash FROM bom_order
    WHERE state_hash IS NOT NULL UNION SELECT contract_id, content_hash FROM evidence UNION SELECT contract_id, module_hash FROM module_hash
  UNION SELECT contract_id, content_hash FROM row_hashes JOIN order_control USING (contract_id, control_id)""",
    "bom_lines": """SELECT contract_id, 'order' AS section, unnest(['order_hash', 'state_hash', 'tier', 'impact_level', 'standard', 'evidentiary_status', 'schema', 'policy_passed']) AS key,
      unnest([order_hash, coalesce(state_hash, ''), tier, impact_level, standard, evidentiary_status, 'ce-bom/1', CASE WHEN findings = 0 THEN 'true' ELSE 'false' END]) AS value
    FROM bom_order JOIN evidentiary USING (contract_id) LEFT JOIN gate USING (contract_id)
  UNION SELECT contract_id, 'attestation', CAST(control_id AS VARCHAR), '{"official": "' || official || '", "outcome": "' || outcome || '", "override_evidence": '
      || coalesce('"' || override_evidence || '"', 'null') || ', "override_justification": ' || coalesce('"' || override_justification || '"', 'null')
      || ', "role": "Affirming Official"}' FROM attestation
  UNION SELECT contract_id, 'control', CAST(control_id AS VARCHAR), '{"attestation_outcome": ' || coalesce('"' || attestation_outcome || '"', 'null') || ', "control_id": "' || control_id
      || '", "evidence_backing": "' || evidence_backing || '", "git_commit": ' || coalesce('"' || git_commit || '"', 'null') || ', "git_committed_at": '
      || coalesce('"' || git_committed_at || '"', 'null') || ', "oracle_outcome": ' || coalesce('"' || oracle_outcome || '"', 'null')
      || ', "reference_id": ' || coalesce('"' || reference_id || '"', 'null') || ', "status": "' || status || '"}' FROM bom_rows
  UNION SELECT contract_id, 'control_resource', CAST(control_id AS VARCHAR), resource_id FROM resource_control
  UNION SELECT contract_id, 'control_evidence', CAST(control_id AS VARCHAR), content_hash FROM row_hashes JOIN order_control USING (contract_id, control_id)
  UNION SELECT contract_id, 'evidence', content_hash, '' FROM evidence
  UNION SELECT contract_id, 'module', CAST(module_id AS VARCHAR), module_hash FROM module_hash
  UNION SELECT contract_id, 'oracle', CAST(control_id AS VARCHAR), outcome FROM outcomes
  UNION SELECT contract_id, 'plan', resource_id, '' FROM planned_resource
  UNION SELECT contract_id, 'finding', resource_id, unnest(['region-not-us', 'criterion-failed:ITAR-120.54']) FROM planned_resource
    WHERE region IS NOT NULL AND NOT starts_with(region, 'us')
  UNION SELECT contract_id, 'finding', '<none>', 'no-region-signal' FROM gate WHERE region_signals = 0""",
    "bom_hashes": digest_sql("SELECT contract_id, section || chr(9) || key || chr(9) || value AS line FROM bom_lines", "contract_id", "bom_hash"),
    "bom_heads": "SELECT contract_id, 'BOM/' || bom_hash AS bom, bom_hash FROM bom_hashes",
    "control_status": """SELECT o.contract_id, o.control_id, c.weight, coalesce(m.met AND NOT m.contradicted, false) AS met,
  coalesce(m.contradicted, false) AS contradicted, p.control_id IS NOT NULL AS on_poam, c.poam_eligible,
  c.variable_weight, c.weight_if_partial
  FROM order_control o JOIN control c USING (control_id)
  LEFT JOIN met m ON m.contract_id = o.contract_id AND m.control_id = o.control_id
  LEFT JOIN poam p ON p.contract_id = o.contract_id AND p.control_id = o.control_id""",
    "scored": """SELECT contract_id, 110 - CAST(sum(CASE WHEN met THEN 0 ELSE weight END) AS BIGINT) AS score,
  count(*) AS controls, count(*) FILTER (NOT met) AS unmet,
  count(*) FILTER (on_poam AND (weight > 1 OR NOT poam_eligible)) AS illegal_poam,
  count(*) FILTER (contradicted) AS contradictions FROM control_status GROUP BY contract_id
  UNION ALL SELECT h.contract_id, 110 - (SELECT CAST(sum(weight) AS BIGINT) FROM control), (SELECT count(*) FROM control),
    (SELECT count(*) FROM control), 0, 0 FROM order_hdr h
    WHERE NOT EXISTS (SELECT 1 FROM order_control o WHERE o.contract_id = h.contract_id)""",
    "scores": """SELECT contract_id, score, CASE WHEN score >= 110 THEN 'Final' WHEN score >= 88 THEN 'Conditional' ELSE 'Ineligible' END AS status,
  controls, unmet, illegal_poam, contradictions, illegal_poam = 0 AND contradictions = 0 AS valid_submission FROM scored""",
    "forward_fail": """SELECT * FROM (SELECT o.contract_id, o.control_id,
  CASE WHEN NOT m THEN 'no-claiming-module' WHEN NOT a AND e THEN 'evidence-but-no-attestation' WHEN NOT a THEN 'not-attested' END AS reason,
  m AS has_module, a AS attested, e AS has_evidence FROM (SELECT oc.*,
    EXISTS (SELECT 1 FROM module_claim c WHERE c.control_id = oc.control_id) AS m,
    EXISTS (SELECT 1 FROM attestation t WHERE t.contract_id = oc.contract_id AND t.control_id = oc.control_id) AS a,
    EXISTS (SELECT 1 FROM addresses d WHERE d.contract_id = oc.contract_id AND d.control_id = oc.control_id) AS e
    FROM order_control oc) o) WHERE reason IS NOT NULL""",
    "backward_fail": """SELECT ae.contract_id, ae.evidence_id, ae.control_id, ae.att_id FROM attestation_evidence ae
  WHERE NOT EXISTS (SELECT 1 FROM addresses d WHERE d.contract_id = ae.contract_id AND d.evidence_id = ae.evidence_id
    AND d.control_id = ae.control_id)""",
    "directions": """SELECT contract_id, CAST(sum(a) AS BIGINT) AS forward_checked, CAST(sum(b) AS BIGINT) AS forward_failures,
  CAST(sum(c) AS BIGINT) AS backward_checked, CAST(sum(d) AS BIGINT) AS backward_failures FROM (
    SELECT contract_id, count(*) AS a, 0 AS b, 0 AS c, 0 AS d FROM order_control GROUP BY 1
    UNION ALL SELECT contract_id, 0, count(*), 0, 0 FROM forward_fail GROUP BY 1
    UNION ALL SELECT contract_id, 0, 0, count(DISTINCT att_id), 0 FROM attestation_evidence GROUP BY 1
    UNION ALL SELECT contract_id, 0, 0, 0, count(*) FROM backward_fail GROUP BY 1) GROUP BY contract_id""",
    "split": """SELECT contract_id, count(*) FILTER (met AND oracle_outcome = 'passed') AS met_by_machine,
  count(*) FILTER (met AND oracle_outcome IS DISTINCT FROM 'passed') AS met_by_human_only,
  count(*) FILTER (contradicted) AS contradiction_count FROM met GROUP BY contract_id""",
    "report": """SELECT h.contract_id, coalesce(d.forward_checked, 0) AS forward_checked, coalesce(d.forward_failures, 0) AS forward_failures,
  coalesce(d.backward_checked, 0) AS backward_checked, coalesce(d.backward_failures, 0) AS backward_failures,
  coalesce(s.met_by_machine, 0) AS met_by_machine, coalesce(s.met_by_human_only, 0) AS met_by_human_only,
  coalesce(s.contradiction_count, 0) AS contradiction_count,
  coalesce(d.forward_failures, 0) = 0 AS forward_passed, coalesce(d.backward_failures, 0) = 0 AS backward_passed,
  coalesce(d.forward_failures, 0) = 0 AND coalesce(d.backward_failures, 0) = 0 AS bidirectional_passed,
  c.score, c.status, c.valid_submission, c.unmet, c.illegal_poam,
  coalesce(d.forward_failures, 0) = 0 AND coalesce(d.backward_failures, 0) = 0 AND coalesce(s.contradiction_count, 0) = 0 AS passed
  FROM order_hdr h LEFT JOIN directions d USING (contract_id) LEFT JOIN split s USING (contract_id) LEFT JOIN scores c USING (contract_id)""",
    "included": """SELECT om.contract_id, om.module_id, mc.control_id FROM order_module om JOIN module_claim mc USING (module_id)
  JOIN order_control oc ON oc.contract_id = om.contract_id AND oc.control_id = mc.control_id""",
    "gate_report": """SELECT contract_id, CAST(sum(a) AS BIGINT) AS required, CAST(sum(b) AS BIGINT) AS gaps, CAST(sum(c) AS BIGINT) AS included,
  CAST(sum(d) AS BIGINT) AS orphans, CAST(sum(e) AS BIGINT) AS claiming, CAST(sum(f) AS BIGINT) AS paper_claims FROM (
    SELECT contract_id, 1 AS a, CASE WHEN NOT EXISTS (SELECT 1 FROM module_claim c WHERE c.control_id = o.control_id) THEN 1 ELSE 0 END AS b,
      0 AS c, 0 AS d, 0 AS e, 0 AS f FROM order_control o
    UNION ALL SELECT contract_id, 0, 0, 1, CASE WHEN NOT EXISTS (SELECT 1 FROM included i WHERE i.contract_id = om.contract_id
      AND i.module_id = om.module_id) THEN 1 ELSE 0 END, 0, 0 FROM order_module om
    UNION ALL SELECT contract_id, 0, 0, 0, 0, 1, CASE WHEN method IS NULL THEN 1 ELSE 0 END FROM (
      SELECT DISTINCT o.contract_id, m.module_id, m.method FROM order_control o JOIN module_claim c USING (control_id) JOIN module m USING (module_id)))
  GROUP BY contract_id""",
    "decisions": """SELECT h.contract_id, CASE WHEN NOT h.attested THEN 'profile-not-attested' WHEN g.gaps > 0 THEN 'control-without-module'
  WHEN g.orphans > 0 THEN 'orphan-module' WHEN g.paper_claims > 0 THEN 'claim-without-method' END AS reason
  FROM order_hdr h LEFT JOIN gate_report g USING (contract_id)""",
    "coverage": """SELECT c.control_id, c.family, c.weight, coalesce(k.kind, 'unclaimed') AS kind, c.weight > 1 AS non_deferrable,
  coalesce(k.kind = 'inherited', false) AS inherited FROM control c LEFT JOIN (
    SELECT control_id, CASE WHEN bool_or(coalesce(method = 'oracle-attested-reference', false)) THEN 'attested'
      WHEN bool_and(coalesce(starts_with(method, 'inherited'), false)) THEN 'inherited' ELSE 'machine' END AS kind
    FROM module_claim JOIN module USING (module_id) GROUP BY control_id) k USING (control_id)""",
    "scope_rows": """SELECT contract_id, 'data_class' AS item, data_marker AS value FROM obligation WHERE data_marker IS NOT NULL
  UNION SELECT contract_id, 'policy_marker', marker FROM resolved WHERE marker IS NOT NULL
  UNION SELECT contract_id, 'impact_level', 'IL4' FROM obligation UNION SELECT contract_id, 'tier', 'Tier1' FROM obligation""",
    "cop_hashes": digest_sql("""SELECT contract_id, '"' || name || '": {"data_marker": ' || coalesce('"' || data_marker || '"', 'null')
      || ', "source_ref": "' || source_ref || '", "type": "' || obligation_type || '"}' AS line FROM obligation
    UNION ALL SELECT contract_id, '"' || name || '" derives "' || token || '"' FROM obligation_derive""", "contract_id", "cop_hash"),
    "control_set_hashes": digest_sql("SELECT contract_id, CAST(control_id AS VARCHAR) AS line FROM order_control", "contract_id", "control_set_hash"),
    "claimers": digest_sql("SELECT control_id, CAST(module_id AS VARCHAR) AS line FROM module_claim", "control_id", "modules_digest"),
    "coverage_hashes": digest_sql("""SELECT contract_id, 'forward ' || control_id || ' ' || coalesce(modules_digest, '-') AS line FROM order_control LEFT JOIN claimers USING (control_id)
    UNION ALL SELECT contract_id, 'included ' || module_id FROM order_module
    UNION ALL SELECT contract_id, 'backward ' || module_id || ' ' || control_id FROM included
    UNION ALL SELECT contract_id, 'method ' || module_id || ' ' || method FROM order_module JOIN module USING (module_id) WHERE method IS NOT NULL""",
    "contract_id", "coverage_proof_hash"),
    "order_hashes": f"""SELECT contract_id, sha256('{{"contract": "' || contract_id || '", "control_set_hash": "' || control_set_hash || '", "cop_hash": "' || cop_hash
  || '", "coverage_proof_hash": "' || coverage_proof_hash || '", "impact_level": "IL4", "module_hashes": "' || m.h || '", "scope": "' || p.h
  || '", "standard": "NIST SP 800-171 Rev 2", "tier": "Tier1"}}') AS order_hash
  FROM control_set_hashes JOIN cop_hashes USING (contract_id) JOIN coverage_hashes USING (contract_id)
  JOIN ({digest_sql("SELECT contract_id, item || ' ' || value AS line FROM scope_rows", "contract_id", "h")}) p USING (contract_id)
  JOIN ({digest_sql("SELECT contract_id, module_id || ' ' || module_hash AS line FROM module_hash", "contract_id", "h")}) m USING (contract_id)""",
    "artifact": """SELECT contract_id, evidence_id AS artifact_id, CASE WHEN subtype = 'PolicyCheck' THEN 'policy-check' ELSE 'config-export' END AS method,
  'sys.' || (source_module % 2) AS origin, CASE WHEN source_module % 9 <> 0 THEN CAST(source_control % 3 AS VARCHAR) ELSE '' END AS first_control,
  summary, subtype, source_file, evidentiary_status, generated_at AS collected_at FROM evidence""",
    "artifact_hash": """SELECT *, sha256('{"model_hash": "' || model_hash || '", "proof_hash": null, "sim_hash": null}') AS content_hash FROM (
  SELECT *, CASE WHEN method = 'policy-check'
    THEN sha256('{"control": "' || first_control || '", "result": ' || summary || ', "tool": "' || origin || '"}')
    ELSE sha256('{"config": ' || summary || ', "control": "' || first_control || '", "source": "' || origin || '"}') END AS model_hash FROM artifact)""",
    "vcrm": f"""WITH a AS (SELECT t.*, {_LABEL.format('t.outcome')} AS status,
      CASE WHEN t.outcome = 'passed' AND t.oracle_outcome = 'failed' THEN 'override'
        WHEN t.document_evidence IS NOT NULL AND t.outcome = 'passed' AND x.att_id IS NOT NULL THEN 'attested-evidenced'
        WHEN t.oracle_outcome = 'passed' AND x.att_id IS NOT NULL THEN 'machine' ELSE 'human-only' END AS backing
    FROM attestation t LEFT JOIN (SELECT DISTINCT contract_id, att_id FROM attestation_evidence) x
      ON x.contract_id = t.contract_id AND x.att_id = t.att_id),
  d AS (SELECT d.contract_id, d.control_id, v.source_file, v.content_hash FROM addresses d JOIN evidence v USING (contract_id, evidence_id)
    JOIN order_control o ON o.contract_id = d.contract_id AND o.control_id = d.control_id)
  SELECT contract_id, control_id, 'status' AS item, status AS value FROM a UNION SELECT contract_id, control_id, 'backing', backing FROM a
  UNION SELECT contract_id, control_id, 'official', official FROM a
  UNION SELECT contract_id, control_id, 'override', replace(override_justification, '|', '\\|') FROM a WHERE override_justification IS NOT NULL
  UNION SELECT contract_id, control_id, 'gap', 'attested ' || status FROM a WHERE status <> 'MET'
  UNION SELECT contract_id, control_id, unnest(['status', 'gap']), unnest(['PLANNED', 'not attested (planned)']) FROM order_control o
    WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.contract_id = o.contract_id AND a.control_id = o.control_id)
  UNION SELECT contract_id, control_id, 'location', coalesce(source_file, 'registry://evidence/' || content_hash) FROM d
  UNION SELECT contract_id, control_id, 'hash', substr(content_hash, 1, 12) FROM d
  UNION SELECT contract_id, control_id, 'poam', 'POAM-' || contract_id || '-' || control_id FROM poam""",
}

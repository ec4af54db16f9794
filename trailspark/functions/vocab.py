"""Word lists, lookup tables and format tags.

These must equal the published rules and file formats for results to agree, so they
are stated as they are. The control catalog itself is input data and is not here.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Outcomes and the determination each one reads as.
STATUS_LABEL = {
    "passed": "MET",
    "failed": "NOT MET",
    "inapplicable": "N/A",
    "untested": "PLANNED",
    "needsAction": "NEEDS ACTION",
}

# Outcomes a check or a sign-off record may carry.
RECORD_OUTCOMES = ("passed", "failed", "needsAction")

# Display order of outcome counts.
OUTCOME_ORDER = ("passed", "failed", "needsAction")

# Obligation types and the data markers that make a deliverable dangerous.
OBLIGATION_TYPES = ("framework", "hosting", "data", "personnel", "environment", "deliverable")
SPILLOVER_MARKERS = ("CUI", "ITAR")

# What counts as a control id.
CONTROL_ID_PATTERN = r"^[A-Z]{2}\.L2-3\.\d+\.\d+$"

# The token in a rule row that stands for every control of the catalog.
ALL_CONTROLS = "*"

# Named obligation -> control ("*" = whole catalog) or policy marker.
RULE_ROWS = (
    ("OBL-CMMC-L2", ALL_CONTROLS, None),
    ("OBL-ITAR", "SC.L2-3.13.11", None),
    ("OBL-ITAR", None, "US-PERSON"),
    ("OBL-ITAR", None, "RESIDENCY"),
    ("OBL-ITAR", None, "E2E-CUI-BOUNDARY"),
    ("OBL-CUI-BOUNDARY", "AC.L2-3.1.1", None),
    ("OBL-CUI-BOUNDARY", "AC.L2-3.1.3", None),
    ("OBL-CUI-BOUNDARY", "SC.L2-3.13.8", None),
    ("OBL-CUI-BOUNDARY", "SC.L2-3.13.16", None),
    ("OBL-PHASE1-ENV", None, "TIER1-SCOPE"),
    ("OBL-IL5", None, None),
    ("IL5-OVERLAY", None, None),
)

# Expansion token in a derives list -> named rule.
TOKEN_ROWS = (
    ("ALL-110-NIST-800-171", "OBL-CMMC-L2"),
    ("IL5-OVERLAY", "IL5-OVERLAY"),
    ("TIER1-SCOPE", "OBL-PHASE1-ENV"),
)

# Cited clause -> obligation token it forces into the profile.
CLAUSE_ROWS = (
    ("7012", "CUI"),
    ("7012", "800-171"),
    ("7021", "CMMC-status"),
    ("ITAR-topic", "US-person"),
    ("ITAR-topic", "residency"),
    ("ITAR-topic", "e2e"),
)

# Order constants.
TARGET_TIER = "Tier1"
IMPACT_LEVEL = "IL4"
STANDARD = "NIST SP 800-171 Rev 2"

# Score thresholds.
FULL_SCORE = 110
CONDITIONAL_FLOOR = 88

# One-point controls that may not be deferred.
NON_DEFERRABLE_ONE_POINTERS = (
    "AC.L2-3.1.20", "AC.L2-3.1.22", "CA.L2-3.12.4",
    "PE.L2-3.10.3", "PE.L2-3.10.4", "PE.L2-3.10.5",
)

# Evidence statuses that make a whole bill of materials non-evidentiary, and the
# narrower set the matrix reports.
WEAK_STATUSES = ("mock", "mock-plan", "auto", "automatic", "semiAuto", "attested-reference-mock")
MOCK_STATUSES = ("mock", "mock-plan", "attested-reference-mock")

# Signer roles and signature algorithms of the attestation log.
AFFIRMING_OFFICIAL = "Role_AffirmingOfficial"
SIGNER_ROLES = (AFFIRMING_OFFICIAL, "Role_SecurityOfficer", "Role_ITAdmin", "Role_OPs")
SIG_ALGO_NONE = "none"
SIG_ALGOS = (SIG_ALGO_NONE, "ed25519-v1", "cosign-v1")

# Verification-method names.
ATTESTED_METHOD = "oracle-attested-reference"
INHERITED_PREFIX = "inherited"

# Freshness policies in days, and the plain name of each window.
POLICY_DAYS = {"annual": 365, "semi-annual": 180, "quarterly": 90, "monthly": 30, "event-based": 0}
FRESHNESS_LABEL = {
    0: "event-based (per event)", 30: "monthly", 90: "quarterly", 180: "semi-annual", 365: "annual",
}

# Default window of a reference that states none.
DEFAULT_FRESHNESS_DAYS = 365

# Residency: the criterion checked on plans and the control its evidence feeds.
RESIDENCY_CRITERION = "ITAR-120.54"
RESIDENCY_CONTROL = "SC.L2-3.13.1"

# Policy checks derived from exports: control, metric, threshold as JSON.
POLICY_CHECK_ROWS = (
    ("AC.L2-3.1.1", "unauthorized_principals", "0"),
    ("SC.L2-3.13.1", "data_region", '"US"'),
)
POLICY_TOOL = "opa"
PLAN_TOOL = "terraform-plan"
PLAN_STATUS = "mock-plan"

# Lifecycle layers in flow order.
LAYERS = (
    "ontology", "plan", "structural", "order",
    "evidence", "attestations", "plan_execution", "audit",
)

# Format tags that enter hashes.
BOM_SCHEMA = "ce-bom/1"
BOM_ROLE = "Affirming Official"

# Procedure: step, predecessors, output variables.
PLAN_ROWS = (
    ("ExtractObligations", (), ("Obligations",)),
    ("ResolveControls", ("ExtractObligations",), ("RequiredControls",)),
    ("AttestCOP", ("ExtractObligations",), ("COP",)),
    ("Gate1", ("ResolveControls",), ()),
    ("EmitOrder", ("Gate1", "AttestCOP"), ("Order",)),
    ("LoadOrder", (), ("ModuleHashes",)),
    ("FetchByHash", ("LoadOrder",), ("ModuleHashes",)),
    ("Plan", ("FetchByHash",), ("PlanHash",)),
    ("PolicyCheck", ("Plan",), ()),
    ("Apply", ("PolicyCheck",), ()),
    ("CollectEvidence", ("Apply",), ("Evidence",)),
    ("Oracles", ("CollectEvidence",), ("OracleAssertions",)),
    ("Attestation", ("Oracles",), ("Attestations",)),
    ("Audit", ("Attestation",), ("BOM",)),
    ("SignAndStore", ("Audit",), ("BOM", "SSP")),
)

# Machine criteria: control, metric, comparator, threshold as JSON.
CRITERION_ROWS = (
    ("IA.L2-3.5.3", "mfa_enforced_privileged", "eq", "true"),
    ("SC.L2-3.13.11", "fips_module_present", "eq", "true"),
    ("SC.L2-3.13.16", "cui_encrypted_at_rest", "eq", "true"),
    ("AC.L2-3.1.1", "unauthorized_principals", "eq", "0"),
    ("AC.L2-3.1.5", "overprivileged_bindings", "le", "0"),
    ("AU.L2-3.3.1", "audit_log_export_enabled", "eq", "true"),
    ("ITAR-120.54", "data_region", "eq", '"US"'),
    ("SC.L2-3.13.1", "data_region", "eq", '"US"'),
    ("SC.L2-3.13.3", "cui_subnet_private", "eq", "true"),
    ("SC.L2-3.13.4", "shared_resource_isolation", "eq", "true"),
    ("SC.L2-3.13.5", "public_access_denied", "eq", "true"),
    ("SC.L2-3.13.6", "default_deny_ingress", "eq", "true"),
    ("SC.L2-3.13.7", "split_tunnel_disabled", "eq", "true"),
    ("SC.L2-3.13.8", "tls_minimum_version", "ge", '"1.2"'),
    ("SC.L2-3.13.9", "session_termination_configured", "eq", "true"),
    ("SC.L2-3.13.15", "session_authenticity_protected", "eq", "true"),
    ("SI.L2-3.14.2", "malware_protection_active", "eq", "true"),
    ("SI.L2-3.14.4", "av_definition_age_hours", "le", "24"),
    ("SI.L2-3.14.7", "anomaly_detection_active", "eq", "true"),
    ("AC.L2-3.1.16", "wireless_authorized", "eq", "true"),
    ("AC.L2-3.1.17", "wireless_crypto_enforced", "eq", "true"),
    ("AC.L2-3.1.18", "mdm_enrolled", "eq", "true"),
    ("AC.L2-3.1.19", "mobile_encryption_at_rest", "eq", "true"),
    ("MP.L2-3.8.7", "removable_media_blocked", "eq", "true"),
    ("RA.L2-3.11.2", "vuln_scan_age_days", "le", "30"),
    ("SI.L2-3.14.1", "high_severity_findings_open", "eq", "0"),
    ("SI.L2-3.14.5", "scan_coverage_complete", "eq", "true"),
    ("IA.L2-3.5.1", "user_uniquely_identified", "eq", "true"),
    ("IA.L2-3.5.5", "identifier_reuse_days", "ge", "90"),
    ("IA.L2-3.5.6", "inactive_disable_days", "le", "30"),
    ("IA.L2-3.5.7", "password_complexity_enforced", "eq", "true"),
    ("IA.L2-3.5.8", "password_reuse_prohibited", "eq", "true"),
    ("IA.L2-3.5.9", "temp_password_expires_first_use", "eq", "true"),
    ("IA.L2-3.5.10", "passwords_stored_hashed", "eq", "true"),
    ("IA.L2-3.5.11", "auth_feedback_obscured", "eq", "true"),
    ("AC.L2-3.1.12", "remote_sessions_monitored", "eq", "true"),
    ("AC.L2-3.1.13", "remote_tls_enforced", "eq", "true"),
    ("AC.L2-3.1.14", "remote_routes_via_managed_proxy", "eq", "true"),
    ("CM.L2-3.4.3", "change_log_present", "eq", "true"),
    ("CM.L2-3.4.5", "required_reviews_enforced", "eq", "true"),
    ("MA.L2-3.7.5", "ops_mfa_enforced", "eq", "true"),
    ("AU.L2-3.3.4", "log_failure_alerting", "eq", "true"),
    ("AU.L2-3.3.7", "ntp_configured", "eq", "true"),
    ("AU.L2-3.3.8", "log_bucket_access_restricted", "eq", "true"),
    ("AU.L2-3.3.9", "audit_mgmt_privileged", "eq", "true"),
    ("CM.L2-3.4.8", "deny_by_default_binauth", "eq", "true"),
    ("CM.L2-3.4.9", "user_software_approval_required", "eq", "true"),
    ("AC.L2-3.1.8", "failed_login_lockout_enabled", "eq", "true"),
    ("AC.L2-3.1.10", "idle_session_timeout_minutes", "le", "15"),
    ("AC.L2-3.1.11", "session_termination_conditions", "eq", "true"),
    ("AC.L2-3.1.20", "external_system_perimeter_defined", "eq", "true"),
    ("AC.L2-3.1.6", "non_privileged_accounts_used_for_non_security", "eq", "true"),
    ("AC.L2-3.1.7", "privileged_actions_logged", "eq", "true"),
    ("AC.L2-3.1.2", "transaction_type_restrictions_enforced", "eq", "true"),
    ("AC.L2-3.1.3", "cui_flow_control_enforced", "eq", "true"),
    ("AU.L2-3.3.2", "audit_user_attribution_enabled", "eq", "true"),
    ("AU.L2-3.3.5", "audit_correlation_enabled", "eq", "true"),
    ("CM.L2-3.4.1", "config_baseline_established", "eq", "true"),
    ("CM.L2-3.4.2", "config_change_enforcement_active", "eq", "true"),
    ("CM.L2-3.4.6", "least_functionality_enforced", "eq", "true"),
    ("CM.L2-3.4.7", "nonessential_services_disabled", "eq", "true"),
    ("IA.L2-3.5.2", "device_authentication_required", "eq", "true"),
    ("IA.L2-3.5.4", "replay_resistant_auth_enabled", "eq", "true"),
    ("SC.L2-3.13.10", "key_management_established", "eq", "true"),
    ("SI.L2-3.14.3", "security_alert_response_enabled", "eq", "true"),
    ("SI.L2-3.14.6", "network_attack_monitoring_active", "eq", "true"),
)


def lookup(key: Column, table: dict) -> Column:
    """The table's value for ``key``, null for a key it does not hold."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.create_map(*pairs)[key]


def fixed_table(spark: SparkSession, rows, *names: str) -> DataFrame:
    """A fixed table as a local relation: its size is known when joins are planned."""
    columns = zip(*rows)
    return spark.createDataFrame(pa.table({n: pa.array(list(c)) for n, c in zip(names, columns)}))


def rules(spark: SparkSession) -> DataFrame:
    """Built-in rules as a table; append rows to extend them."""
    return fixed_table(spark, RULE_ROWS, "rule_name", "control_id", "marker")


def rule_tokens(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, TOKEN_ROWS, "token", "rule_name")


def clauses(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, CLAUSE_ROWS, "clause", "token")


def criteria(spark: SparkSession) -> DataFrame:
    """Built-in machine criteria as a table; append rows to extend them."""
    return fixed_table(spark, CRITERION_ROWS, "control_id", "metric_key", "comparator", "threshold")


def policy_checks(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, POLICY_CHECK_ROWS, "control_id", "metric_key", "threshold")


def plan_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps, (step, predecessor) and (step, variable) of the procedure."""
    steps = fixed_table(spark, [(s,) for s, _, _ in PLAN_ROWS], "step")
    precedes = fixed_table(
        spark, [(s, p) for s, before, _ in PLAN_ROWS for p in before], "step", "predecessor"
    )
    outputs = fixed_table(spark, [(s, v) for s, _, out in PLAN_ROWS for v in out], "step", "variable")
    return steps, precedes, outputs


def layers(spark: SparkSession) -> DataFrame:
    """The eight lifecycle layers with their display position."""
    return fixed_table(spark, list(enumerate(LAYERS)), "position", "graph")

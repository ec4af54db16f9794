"""Constraint suite: each rule is a filter giving (contract, shape, focus, path, message).

Contract-level tables carry contract_id. Catalog-level rules report a null contract.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import vocab

K, C, E = "contract_id", "control_id", "evidence_id"


def _violations(rows: DataFrame, shape: str, focus: str, path: str, message: str) -> DataFrame:
    contract = F.col(K).cast("string") if K in rows.columns else F.lit(None).cast("string")
    return rows.select(
        contract.alias(K), F.lit(shape).alias("shape"), F.col(focus).cast("string").alias("focus"),
        F.lit(path).alias("path"), F.lit(message).alias("message"),
    )


Check = tuple[Column, str, str]


def _checks(rows: DataFrame, shape: str, focus: str, checks: list[Check]) -> DataFrame:
    """Several checks of one shape in one pass over its rows."""
    return _suite(rows, (shape, focus, checks))


def _suite(rows: DataFrame, *shapes: tuple[str, str, list[Check]]) -> DataFrame:
    """Several shapes (name, focus, checks) in one pass over their rows: all violations of a row as one array."""
    contract = F.col(K).cast("string") if K in rows.columns else F.lit(None).cast("string")
    marks = F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.struct(
            F.lit(shape).alias("shape"), F.col(focus).cast("string").alias("focus"), F.lit(path).alias("path"), F.lit(text).alias("message")))
        for shape, focus, checks in shapes for broken, path, text in checks
    ]))
    return rows.select(contract.alias(K), F.explode(marks).alias("m")).select(K, "m.shape", "m.focus", "m.path", "m.message")


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def control_shape(control_facts: DataFrame) -> DataFrame:
    """``control_facts``: node, control_id, text, weight, poam_eligible; repeats allowed."""
    per = control_facts.groupBy("node").agg(
        F.count_distinct(C).alias("ids"), F.count(F.when(~_blank("text"), 1)).alias("texts"),
        F.count_distinct("weight").alias("weights"),
        F.count(F.when(F.col("weight").isNotNull() & ~F.col("weight").isin(1, 3, 5), 1)).alias("odd"),
        F.count_distinct("poam_eligible").alias("flags"),
    )
    return _checks(per, "ControlShape", "node", [
        (F.col("ids") != 1, "controlId", "exactly one control id"),
        (F.col("texts") < 1, "text", "a non-empty statement"),
        ((F.col("weights") != 1) | (F.col("odd") > 0), "weight", "exactly one weight of 1, 3 or 5"),
        (F.col("flags") != 1, "poamEligible", "exactly one eligibility flag"),
    ])


def poam_legality_shape(poam: DataFrame, control: DataFrame) -> DataFrame:
    heavy = control.filter("weight > 1").select(C)
    return _violations(
        poam.select(K, C).distinct().join(heavy, C, "left_semi"), "PoamLegalityShape", C, "poamItem",
        "only one-point controls may carry a plan-of-action item",
    )


def _with_failed_assertion(attestation: DataFrame, assertion: DataFrame | None) -> DataFrame:
    """Sign-offs with ``_f``: whether the assertion behind one failed."""
    if assertion is None:
        return attestation.withColumn("_f", F.lit(False))
    failed = (
        assertion.filter("outcome = 'failed'")
        .select(K, F.col("assertion").alias("backed_by"), F.lit(True).alias("_f")).distinct()
    )
    return attestation.join(failed, [K, "backed_by"], "left")


def _contradiction() -> tuple[str, str, list[Check]]:
    failed = F.coalesce(F.col("oracle_outcome") == "failed", F.lit(False)) | F.coalesce("_f", F.lit(False))
    overridden = F.col("override_justification").isNotNull() & F.col("override_evidence").isNotNull()
    return "ContradictionShape", "att_id", [
        ((F.col("outcome") == "passed") & failed & ~overridden, "hasOutcome",
         "met over a failed check without justification and evidence"),
        (F.col("override_justification").isNotNull() & F.col("override_evidence").isNull(),
         "overrideEvidence", "override without evidence"),
    ]


def _override_evidence() -> tuple[str, str, list[Check]]:
    return "OverrideEvidenceShape", "att_id", [
        (F.col("override_justification").isNotNull() & F.col("override_evidence").isNull(),
         "overrideEvidence", "justification without evidence"),
    ]


def _passed_adequacy() -> tuple[str, str, list[Check]]:
    return "PassedRequiresAdequacyAndSufficiencyShape", "att_id", [
        ((F.col("outcome") == "passed") & _blank("adequacy"), "inContextOf", "non-empty adequacy text"),
    ]


def contradiction_shape(attestation: DataFrame, assertion: DataFrame | None = None) -> DataFrame:
    """MET over a failed check, stated on the sign-off or on the assertion behind it."""
    return _suite(_with_failed_assertion(attestation, assertion), _contradiction())


def override_evidence_shape(attestation: DataFrame) -> DataFrame:
    return _suite(attestation, _override_evidence())


def sign_off_shapes(attestation: DataFrame, assertion: DataFrame | None = None) -> DataFrame:
    """Contradictions, overrides without evidence and missing adequacy in one pass over the sign-offs."""
    return _suite(_with_failed_assertion(attestation, assertion), _contradiction(), _override_evidence(), _passed_adequacy())


def attestation_shape(attestation: DataFrame) -> DataFrame:
    """Rows of one sign-off may repeat; null columns are absent statements."""
    per = attestation.groupBy(K, "att_id").agg(
        F.count("adequacy").alias("a"), F.count("sufficiency").alias("s"),
        F.count_distinct("outcome").alias("o"), F.count("official").alias("q"), F.count(C).alias("c"),
    )
    return _checks(per, "AttestationShape", "att_id", [
        (F.col("a") < 1, "inContextOf", "an adequacy assumption"),
        (F.col("s") < 1, "inContextOf", "a sufficiency justification"),
        (F.col("o") != 1, "hasOutcome", "exactly one outcome"),
        (F.col("q") < 1, "qualifiedAssociation", "a qualified association"),
        (F.col("c") < 1, "attests", "at least one control"),
    ])


def _activities(activity: DataFrame, steps: DataFrame) -> DataFrame:
    known = steps.select("step", F.lit(1).alias("_k"))
    return activity.join(known, "step", "left").groupBy(F.col("run_id").alias(K), "activity").agg(
        F.count_distinct("step").alias("steps"),
        F.count(F.when(F.col("step").isNotNull() & F.col("_k").isNull(), 1)).alias("unknown"),
        F.count_distinct("started_at").alias("starts"), F.count("agent").alias("agents"),
    )


def _plan_instantiation() -> tuple[str, str, list[Check]]:
    return "PlanInstantiationShape", "activity", [
        ((F.col("steps") != 1) | (F.col("unknown") > 0), "correspondsToStep", "exactly one known step"),
        (F.col("starts") != 1, "startedAtTime", "exactly one start time"),
    ]


def _activity_agent() -> tuple[str, str, list[Check]]:
    return "ActivityAgentShape", "activity", [(F.col("agents") < 1, "wasAssociatedWith", "at least one agent")]


def plan_instantiation_shape(activity: DataFrame, steps: DataFrame) -> DataFrame:
    """``activity``: run_id, activity, step, started_at; repeats are extra values."""
    columns = activity if "agent" in activity.columns else activity.withColumn("agent", F.lit(None).cast("string"))
    return _suite(_activities(columns, steps), _plan_instantiation())


def activity_shapes(activity: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps, start times and agents of activities by one aggregate."""
    return _suite(_activities(activity, steps), _plan_instantiation(), _activity_agent())


def evidence_shape(evidence: DataFrame, addresses: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Hashes, source, summary, one generating activity and an addressed control."""
    linked = addresses.select(K, E).distinct().withColumn("_a", F.lit(True))
    rows = evidence.join(linked, [K, E], "left")
    checks = [
        (F.col("content_hash").isNull(), "contentHash", "a content hash"),
        (F.col("model_hash").isNull(), "modelHash", "a model hash"),
        (F.col("source_file").isNull(), "sourceFile", "a source file"),
        (F.col("summary").isNull(), "resultSummary", "a result summary"),
        (F.col("_a").isNull(), "addresses", "at least one addressed control"),
    ]
    if generated is not None:
        makers = generated.groupBy(K, E).agg(F.count_distinct("activity").alias("_g"))
        rows = rows.join(makers, [K, E], "left")
        checks.append((F.coalesce("_g", F.lit(0)) != 1, "wasGeneratedBy", "exactly one generating activity"))
    return _checks(rows, "EvidenceShape", E, checks)


def requirement_shape(requirement: DataFrame) -> DataFrame:
    return _checks(requirement, "RequirementShape", "requirement", [
        (F.col("declared_name").isNull(), "declaredName", "a declared name"),
        (F.col("text").isNull(), "text", "a text"),
    ])


def strategy_supported_shape(nodes: DataFrame, supports: DataFrame) -> DataFrame:
    """``nodes``: node, kind; ``supports``: node, supported_by."""
    solutions = nodes.filter("kind = 'Solution'").select(F.col("node").alias("supported_by"))
    backed = supports.join(solutions, "supported_by", "left_semi").select("node").distinct()
    return _violations(
        nodes.filter("kind = 'Strategy'").join(backed, "node", "left_anti"), "StrategySupportedShape",
        "node", "supportedBy", "at least one supporting solution",
    )


def goal_supported_shape(nodes: DataFrame, supports: DataFrame) -> DataFrame:
    """A goal needs an incoming support edge."""
    argued = supports.select(F.col("supported_by").alias("node")).distinct()
    return _violations(
        nodes.filter("kind = 'Goal'").join(argued, "node", "left_anti"), "GoalSupportedShape",
        "node", "supportedBy", "at least one incoming support",
    )


def statement_shape(statements: DataFrame) -> DataFrame:
    """``statements``: node, statement (one row per node, null when absent)."""
    return _checks(statements, "GsnTextShape", "node", [
        (_blank("statement"), "statement", "a non-empty statement"),
    ])


def activity_agent_shape(activity: DataFrame) -> DataFrame:
    return _suite(activity.groupBy(F.col("run_id").alias(K), "activity").agg(F.count("agent").alias("agents")), _activity_agent())


def generating_activity_shape(prov_edge: DataFrame) -> DataFrame:
    per = prov_edge.filter("kind = 'generated'").groupBy(F.col("run_id").alias(K), "entity").agg(
        F.count_distinct("activity").alias("_n")
    )
    return _checks(per, "EntityGeneratingActivityShape", "entity", [
        (F.col("_n") > 1, "wasGeneratedBy", "at most one generating activity"),
    ])


def passed_requires_adequacy_shape(attestation: DataFrame) -> DataFrame:
    """A passed sign-off needs adequacy text; sufficiency text is not tested here."""
    return _suite(attestation, _passed_adequacy())


def forward_traceability_shape(
    required: DataFrame, control: DataFrame, attestation: DataFrame, attestation_evidence: DataFrame,
    addresses: DataFrame,
) -> DataFrame:
    """A required control must reach a sign-off whose evidence addresses it."""
    signed = attestation.filter(F.col("outcome").isNotNull()).select(K, "att_id", C)
    reached = (
        attestation_evidence.select(K, "att_id", E).join(signed, [K, "att_id"])
        .join(addresses.select(K, E, C).distinct(), [K, E, C], "left_semi").select(K, C).distinct()
    )
    rows = required.select(K, C).join(reached, [K, C], "left_anti").join(control.select(C), C, "left_semi")
    return _violations(rows, "ForwardTraceabilityShape", C, "requiresControl",
                       "required control reaches no addressing evidence with a sign-off")


def backward_traceability_shape(
    attestation: DataFrame, attestation_evidence: DataFrame, addresses: DataFrame
) -> DataFrame:
    cited = attestation_evidence.select(K, "att_id", E).distinct().join(
        attestation.select(K, "att_id", C), [K, "att_id"]
    )
    rows = cited.join(addresses.select(K, E, C).distinct(), [K, E, C], "left_anti")
    return _violations(rows.select(K, "att_id").distinct(), "BackwardTraceabilityShape", "att_id", "hasEvidence",
                       "evidence does not address the signed control")


def traceability_shapes(
    required: DataFrame, control: DataFrame, attestation: DataFrame, attestation_evidence: DataFrame, addresses: DataFrame,
) -> DataFrame:
    """Both directions from one join of the cited evidence with what it addresses."""
    signed = attestation.select(K, "att_id", C, F.col("outcome").isNotNull().alias("_signed"))
    addressed = addresses.select(K, E, C).distinct().withColumn("_held", F.lit(True))
    cited = attestation_evidence.select(K, "att_id", E).distinct().join(signed, [K, "att_id"]).join(addressed, [K, E, C], "left")
    held = F.coalesce("_held", F.lit(False))
    per = cited.groupBy(K, C, "att_id").agg(F.bool_or(held & F.col("_signed")).alias("_reached"), F.bool_or(~held).alias("_loose"))
    reached = per.filter("_reached").select(K, C, F.lit(True).alias("_reached"), F.lit(False).alias("_required"))
    pairs = reached.unionByName(required.select(K, C, F.lit(False).alias("_reached"), F.lit(True).alias("_required"))).groupBy(K, C).agg(
        F.bool_or("_reached").alias("_reached"), F.bool_or("_required").alias("_required"))
    forward = pairs.filter(F.col("_required") & ~F.col("_reached")).join(control.select(C), C, "left_semi")
    backward = per.filter("_loose").select(K, "att_id").distinct()
    return _violations(forward, "ForwardTraceabilityShape", C, "requiresControl",
                       "required control reaches no addressing evidence with a sign-off").unionByName(
        _violations(backward, "BackwardTraceabilityShape", "att_id", "hasEvidence", "evidence does not address the signed control"))


def validate(*violations: DataFrame) -> DataFrame:
    """All rules' violations as one table."""
    return reduce(DataFrame.unionByName, violations)


def violations_by_shape(violations: DataFrame) -> DataFrame:
    return violations.groupBy("shape").agg(F.count(F.lit(1)).alias("violations"))


def verify_verdict(
    contracts: DataFrame, mismatches: DataFrame, violations: DataFrame, status: DataFrame | None
) -> DataFrame:
    """Tampering always fails; violations fail on real evidence and only advise on mock.

    A contract without a bill of materials (no ``status`` row) counts as mock.
    """
    key = F.col(K).cast("string").alias("_k")
    count = lambda frame, name: frame.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    rows = contracts.select(K, key).join(count(mismatches, "mismatches"), "_k", "left").join(
        count(violations.filter(F.col(K).isNotNull()), "violations"), "_k", "left"
    )
    if status is None:
        rows = rows.withColumn("evidentiary_status", F.lit("mock"))
    else:
        rows = rows.join(status.select(key, "evidentiary_status"), "_k", "left")
    zero = F.lit(0).cast("bigint")
    tampered, broken = F.coalesce("mismatches", zero), F.coalesce("violations", zero)
    weak = F.coalesce(F.col("evidentiary_status").isin(*vocab.WEAK_STATUSES), F.lit(True))
    return rows.select(
        K, tampered.alias("mismatches"), broken.alias("violations"),
        F.when(tampered > 0, "tampered").when((broken > 0) & weak, "advisory")
        .when(broken > 0, "failed").otherwise("intact").alias("verdict"),
    )

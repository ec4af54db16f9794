"""Bidirectional audit, contradictions and scoring, per contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import vocab

K, C, E = "contract_id", "control_id", "evidence_id"


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def met_attestations(attestation: DataFrame) -> DataFrame:
    """Sign-offs with the flags every audit step reads, derived in one pass."""
    justified = F.col("override_justification").isNotNull()
    evidenced = F.col("override_evidence").isNotNull()
    met = F.coalesce(F.col("outcome") == "passed", F.lit(False))
    failed = F.coalesce(F.col("oracle_outcome") == "failed", F.lit(False))
    absent = F.col("backed_by").isNotNull() & F.col("oracle_outcome").isNull()
    return attestation.select(
        K, "att_id", C, "outcome", "oracle_outcome", met.alias("met"),
        F.col("backed_by").isNotNull().alias("backed"),
        (justified & evidenced).alias("override"),
        (justified & ~evidenced).alias("justification_only"),
        (met & ~(justified & evidenced) & (failed | absent)).alias("contradicted"),
    )


def forward_trace(
    required: DataFrame, claim: DataFrame, attestation: DataFrame, addresses: DataFrame
) -> DataFrame:
    """Required controls with no claiming module or no sign-off, and why."""
    claimed = claim.select(C).distinct().withColumn("_m", F.lit(True))
    signed = attestation.select(K, C).distinct().withColumn("_a", F.lit(True))
    held = addresses.select(K, C).distinct().withColumn("_e", F.lit(True))
    rows = (
        required.select(K, C).join(signed, [K, C], "left").join(held, [K, C], "left")
        .join(claimed, C, "left")
    )
    flag = lambda name: F.coalesce(name, F.lit(False))
    reason = (
        F.when(~flag("_m"), "no-claiming-module")
        .when(~flag("_a") & flag("_e"), "evidence-but-no-attestation")
        .when(~flag("_a"), "not-attested")
    )
    return rows.select(
        K, C, reason.alias("reason"), flag("_m").alias("has_module"), flag("_a").alias("attested"),
        flag("_e").alias("has_evidence"),
    ).filter(F.col("reason").isNotNull())


def backward_trace(attestation: DataFrame, attestation_evidence: DataFrame, addresses: DataFrame) -> DataFrame:
    """Cited evidence that does not address the control its sign-off is about."""
    cited = cited_evidence(attestation, attestation_evidence)
    return cited.join(addresses.select(K, E, C).distinct(), [K, E, C], "left_anti")


def cited_evidence(attestation: DataFrame, attestation_evidence: DataFrame) -> DataFrame:
    signed = attestation.select(K, "att_id", C)
    return attestation_evidence.select(K, "att_id", E).distinct().join(signed, [K, "att_id"])


def bidirectional(
    required: DataFrame, claim: DataFrame, attestation: DataFrame, attestation_evidence: DataFrame,
    addresses: DataFrame,
) -> DataFrame:
    """Checked and failed counts of both directions per contract, and the verdict."""
    fields = ("forward_checked", "forward_failures", "backward_checked", "backward_failures")
    one = F.lit(1)

    def counted(rows: DataFrame, **counts) -> DataFrame:
        return rows.select(K, *[counts.get(f, F.lit(0)).cast("bigint").alias(f) for f in fields])

    marks = [
        counted(required, forward_checked=one),
        counted(forward_trace(required, claim, attestation, addresses), forward_failures=one),
        counted(attestation_evidence.select(K, "att_id").distinct(), backward_checked=one),
        counted(backward_trace(attestation, attestation_evidence, addresses), backward_failures=one),
    ]
    totals = reduce(DataFrame.unionByName, marks).groupBy(K).agg(*[F.sum(f).alias(f) for f in fields])
    return totals.select(
        K, *fields,
        (F.col("forward_failures") == 0).alias("forward_passed"),
        (F.col("backward_failures") == 0).alias("backward_passed"),
        ((F.col("forward_failures") == 0) & (F.col("backward_failures") == 0)).alias("passed"),
    )


def contradictions(met: DataFrame) -> DataFrame:
    """Sign-offs of MET over a failed or absent check without a full override."""
    return met.filter("contradicted").select(
        K, "att_id", C,
        F.when(F.col("oracle_outcome") == "failed", "failed").otherwise("absent").alias("oracle_outcome"),
    )


def proven_vs_attested(met: DataFrame) -> DataFrame:
    """Machine-proven and human-only MET sign-offs per contract."""
    proven = F.coalesce(F.col("oracle_outcome") == "passed", F.lit(False))
    return met.filter("met").groupBy(K).agg(
        _count(proven).alias("met_by_machine"), _count(~proven).alias("met_by_human_only")
    )


def proven_split(met: DataFrame) -> DataFrame:
    """The same split, one row per MET control."""
    proven = F.coalesce(F.col("oracle_outcome") == "passed", F.lit(False))
    return met.filter("met").select(K, C, F.when(proven, "machine").otherwise("human-only").alias("kind"))


def coverage_matrix(addresses: DataFrame, attestation: DataFrame) -> DataFrame:
    """One row per (control, addressing evidence) with the sign-off state."""
    outcome = attestation.groupBy(K, C).agg(F.min_by("outcome", "att_id").alias("_o"))
    state = F.coalesce(F.substring_index(F.substring_index("_o", "#", -1), "/", -1), F.lit("unattested"))
    return addresses.select(K, C, E).distinct().join(outcome, [K, C], "left").select(
        K, C, E, F.concat(F.lit("covered+"), state).alias("status")
    )


def orphans(scope: DataFrame, evidence: DataFrame, addresses: DataFrame) -> DataFrame:
    """Controls in scope without evidence, and evidence without a control."""
    bare = scope.select(K, C).join(addresses.select(K, C).distinct(), [K, C], "left_anti")
    loose = evidence.select(K, E).join(addresses.select(K, E).distinct(), [K, E], "left_anti")
    return bare.select(K, F.lit("control-without-evidence").alias("kind"), F.col(C).cast("string").alias("subject")).unionByName(
        loose.select(K, F.lit("evidence-without-control").alias("kind"), F.col(E).cast("string").alias("subject"))
    )


def met_control_ids(met: DataFrame) -> DataFrame:
    """Controls signed MET; contradicted ones are still listed here."""
    return met.filter("met").select(K, C).distinct()


def poam_control_ids(poam: DataFrame) -> DataFrame:
    return poam.select(K, C).distinct()


# -- scoring -----------------------------------------------------------------------


def _met_by_control(met: DataFrame) -> DataFrame:
    """Per (contract, control): counted as MET, and contradicted. One row per pair."""
    return met.groupBy(K, C).agg(
        (F.bool_or("met") & ~F.bool_or("contradicted")).alias("met"),
        F.bool_or("contradicted").alias("contradicted"),
    )


def control_statuses(required: DataFrame, control: DataFrame, met: DataFrame, poam: DataFrame) -> DataFrame:
    """Scorable required controls: weight, met, on a plan of action, eligibility.

    A contradicted control does not count as met. Controls without weight are skipped.
    """
    facts = control.filter(F.col("weight").isNotNull()).select(
        C, "weight", F.coalesce("poam_eligible", F.lit(False)).alias("poam_eligible"),
        F.coalesce("variable_weight", F.lit(False)).alias("variable_weight"), "weight_if_partial",
    )
    planned = poam_control_ids(poam).withColumn("_p", F.lit(True))
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name.strip("_"))
    return (
        required.select(K, C).join(_met_by_control(met), [K, C], "left").join(planned, [K, C], "left")
        .join(facts, C)
        .select(K, C, "weight", flag("met"), flag("contradicted"),
                F.coalesce("_p", F.lit(False)).alias("on_poam"),
                "poam_eligible", "variable_weight", "weight_if_partial")
    )


def _is_illegal() -> Column:
    return F.col("on_poam") & ((F.col("weight") > 1) | ~F.col("poam_eligible"))


def _verdict(totals: DataFrame) -> DataFrame:
    """Score, status and validity from per-contract totals."""
    score = F.lit(vocab.FULL_SCORE) - F.col("deducted")
    status = (
        F.when(score >= vocab.FULL_SCORE, "Final").when(score >= vocab.CONDITIONAL_FLOOR, "Conditional")
        .otherwise("Ineligible")
    )
    return totals.select(
        K, score.cast("bigint").alias("score"), status.alias("status"), "controls", "unmet",
        "illegal_poam", "contradictions",
        ((F.col("illegal_poam") == 0) & (F.col("contradictions") == 0)).alias("valid_submission"),
    )


def score_statuses(statuses: DataFrame) -> DataFrame:
    """110 minus the weights not met, per contract."""
    unmet = ~F.col("met")
    return _verdict(statuses.groupBy(K).agg(
        F.sum(F.when(unmet, F.col("weight")).otherwise(0)).alias("deducted"),
        F.count(F.lit(1)).alias("controls"), _count(unmet).alias("unmet"),
        _count(_is_illegal()).alias("illegal_poam"), _count(F.col("contradicted")).alias("contradictions"),
    ))


def score_findings(statuses: DataFrame) -> DataFrame:
    """The controls behind a score: unmet, illegally planned or contradicted, one row each."""
    kinds = F.array_compact(F.array(
        F.when(~F.col("met"), "unmet"), F.when(_is_illegal(), "illegal-poam"),
        F.when(F.col("contradicted"), "contradiction"),
    ))
    return statuses.select(K, C, "weight", F.explode(kinds).alias("finding"))


def pair_facts(required: DataFrame, met: DataFrame, poam: DataFrame) -> DataFrame:
    """One row per (contract, control) that is required, signed or planned, with all that scores and checks count.

    One aggregate over the rows of the three tables: required, signed, met (not where
    contradicted), contradicted, on_poam, and how many sign-offs are met by machine, by
    humans only, and contradicted.
    """
    flags, counts = ("required", "signed", "_met", "contradicted", "on_poam"), ("machine", "human", "contradictions")

    def tagged(rows: DataFrame, **values: Column) -> DataFrame:
        return rows.select(K, C, *[values.get(f, F.lit(False)).alias(f) for f in flags],
                           *[values.get(n, F.lit(0)).cast("bigint").alias(n) for n in counts])

    proven = F.coalesce(F.col("oracle_outcome") == "passed", F.lit(False))
    yes = F.lit(True)
    rows = reduce(DataFrame.unionByName, (
        tagged(required, required=yes), tagged(poam, on_poam=yes),
        tagged(met, signed=yes, _met=F.col("met"), contradicted=F.col("contradicted"), machine=(F.col("met") & proven).cast("int"),
               human=(F.col("met") & ~proven).cast("int"), contradictions=F.col("contradicted").cast("int"))))
    pairs = rows.groupBy(K, C).agg(*[F.bool_or(f).alias(f) for f in flags], *[F.sum(n).alias(n) for n in counts])
    return pairs.withColumn("met", F.col("_met") & ~F.col("contradicted")).drop("_met")


def _weighed(pairs: DataFrame, control: DataFrame) -> DataFrame:
    """Pairs with the weight of their control, null where it is not scorable, and whether they may be deferred."""
    return pairs.join(control.select(C, "weight", F.coalesce("poam_eligible", F.lit(False)).alias("poam_eligible")), C, "left")


def _score_totals() -> list[Column]:
    """Aggregates per contract over weighed pairs: ``s_`` of required controls, ``w_`` of all that are touched."""
    scorable, unmet = F.col("weight").isNotNull(), ~F.col("met")
    asked, weight = F.col("required") & scorable, F.col("weight")
    return [
        F.bool_or("required").alias("scoped"), _count(asked).alias("s_controls"),
        F.sum(F.when(asked & unmet, weight).otherwise(0)).alias("s_deducted"), _count(asked & unmet).alias("s_unmet"),
        _count(asked & _is_illegal()).alias("s_illegal"), _count(asked & F.col("contradicted")).alias("s_contra"),
        F.sum(F.when(scorable & F.col("met"), weight).otherwise(0)).alias("w_weight"), _count(scorable & F.col("met")).alias("w_met"),
        _count(scorable & _is_illegal()).alias("w_illegal"), _count(scorable & F.col("contradicted")).alias("w_contra"),
    ]


def _scores(order_hdr: DataFrame, control: DataFrame, totals: DataFrame) -> DataFrame:
    """Scores from the totals per contract.

    A contract that requires nothing is scored over the whole catalog: its totals minus
    what the contract has met, so that no contract-by-catalog product is ever formed.
    """
    scorable = control.filter(F.col("weight").isNotNull())
    weights = scorable.select(F.sum("weight")).scalar()
    size = scorable.select(F.count(F.lit(1))).scalar()
    known = order_hdr.select(K).withColumn("_known", F.lit(True))
    rows = known.join(totals, K, "full").withColumn("scoped", F.coalesce("scoped", F.lit(False)))
    pick = lambda scoped, whole: F.when(F.col("scoped"), F.col(scoped)).otherwise(whole)
    part = lambda name: F.coalesce(name, F.lit(0))
    counted = rows.filter(F.col("scoped") | F.col("_known")).select(
        K, pick("s_deducted", weights - part("w_weight")).alias("deducted"), pick("s_controls", size).alias("controls"),
        pick("s_unmet", size - part("w_met")).alias("unmet"), pick("s_illegal", part("w_illegal")).alias("illegal_poam"),
        pick("s_contra", part("w_contra")).alias("contradictions"))
    return _verdict(counted.filter(F.col("controls") > 0))


def score_whole_catalog(contracts: DataFrame, control: DataFrame, met: DataFrame, poam: DataFrame) -> DataFrame:
    """Scores of contracts over the whole catalog, whatever they require."""
    pairs = pair_facts(met.select(K, C).limit(0), met, poam)
    return _scores(contracts, control, _weighed(pairs, control).groupBy(K).agg(*_score_totals()))


def compute_score(
    order_hdr: DataFrame, required: DataFrame, control: DataFrame, met: DataFrame, poam: DataFrame
) -> DataFrame:
    """Score per contract: over its required controls, or the whole catalog without any."""
    pairs = _weighed(pair_facts(required, met, poam), control)
    return _scores(order_hdr, control, pairs.groupBy(K).agg(*_score_totals()))


# -- report ------------------------------------------------------------------------


def audit_report(
    order_hdr: DataFrame, required: DataFrame, control: DataFrame, claim: DataFrame,
    attestation: DataFrame, attestation_evidence: DataFrame, addresses: DataFrame, poam: DataFrame,
) -> DataFrame:
    """One row per contract: both directions, contradictions, MET split and score."""
    claimed = claim.select(C).distinct().withColumn("_claimed", F.lit(True))
    pairs = _weighed(pair_facts(required, met_attestations(attestation), poam), control).join(claimed, C, "left")
    failed = F.col("required") & (F.col("_claimed").isNull() | ~F.col("signed"))
    totals = pairs.groupBy(K).agg(
        *_score_totals(), _count(F.col("required")).alias("forward_checked"), _count(failed).alias("forward_failures"),
        F.sum("machine").alias("met_by_machine"), F.sum("human").alias("met_by_human_only"), F.sum("contradictions").alias("contradiction_count"))
    one, none = F.lit(1).alias("_n"), F.lit(0).alias("_n")
    cited = attestation_evidence.select(K, "att_id").distinct().select(K, one, none.alias("_bad")).unionByName(
        backward_trace(attestation, attestation_evidence, addresses).select(K, none, F.lit(1).alias("_bad")))
    backward = cited.groupBy(K).agg(F.sum("_n").alias("backward_checked"), F.sum("_bad").alias("backward_failures"))
    scores = _scores(order_hdr, control, totals).select(K, "score", "status", "valid_submission", "unmet", "illegal_poam")
    own = totals.select(K, "forward_checked", "forward_failures", "met_by_machine", "met_by_human_only", "contradiction_count")
    rows = order_hdr.select(K).join(own, K, "left").join(backward, K, "left").join(scores, K, "left").withColumns({
        "forward_passed": F.col("forward_failures") == 0, "backward_passed": F.col("backward_failures") == 0})
    rows = rows.withColumn("bidirectional_passed", F.coalesce("forward_passed", F.lit(True)) & F.coalesce("backward_passed", F.lit(True)))
    numbers = ("forward_checked", "forward_failures", "backward_checked", "backward_failures",
               "met_by_machine", "met_by_human_only", "contradiction_count")
    yes = lambda name: F.coalesce(name, F.lit(True)).alias(name)
    passed = F.coalesce("bidirectional_passed", F.lit(True)) & (F.coalesce("contradiction_count", F.lit(0)) == 0)
    return rows.select(
        K, *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in numbers],
        yes("forward_passed"), yes("backward_passed"), yes("bidirectional_passed"),
        "score", "status", "valid_submission", "unmet", "illegal_poam", passed.alias("passed"),
    )


_SUMMARY = ("forward_passed", "backward_passed", "bidirectional_passed", "contradiction_count",
            "met_by_machine", "met_by_human_only", "score", "status", "valid_submission")


def audit_summary_facts(report: DataFrame) -> DataFrame:
    """The report as (contract, fact, value) rows; a contract without score has no score facts."""
    texts = report.select(K, *[F.col(f).cast("string").alias(f) for f in _SUMMARY])
    return texts.unpivot(K, list(_SUMMARY), "fact", "value").filter(F.col("value").isNotNull())


def score_breakdown(required: DataFrame, control: DataFrame, met: DataFrame) -> DataFrame:
    """Per required control: weight, check outcome, sign-off, backing and score impact."""
    per = met.groupBy(K, C).agg(
        F.bool_or("met").alias("_met"),
        F.bool_or(F.col("met") & F.coalesce(F.col("oracle_outcome") == "passed", F.lit(False))).alias("_machine"),
        F.bool_or("contradicted").alias("_contra"),
        F.bool_or(F.col("contradicted") & F.coalesce(F.col("oracle_outcome") == "failed", F.lit(False))).alias("_failed"),
    )
    rows = required.select(K, C).join(per, [K, C], "left").join(control.select(C, "weight"), C, "left")
    flag = lambda name: F.coalesce(name, F.lit(False))
    met_, machine, contra = flag("_met"), flag("_machine"), flag("_contra")
    weight = F.coalesce("weight", F.lit(1).cast("bigint"))
    return rows.select(
        K, C, weight.alias("weight"),
        F.when(machine, "passed").when(contra & flag("_failed"), "failed").when(contra, "absent")
        .otherwise("-").alias("oracle"),
        F.when(met_, "MET").otherwise("NOT MET").alias("attestation"),
        F.when(machine, "machine").when(contra & met_, "override").when(met_, "human-only")
        .otherwise("-").alias("backing"),
        F.when(met_, "0").when(F.col("weight").isNull(), "?").otherwise(F.concat(F.lit("-"), weight))
        .alias("impact"),
        F.when(met_, "PASS").otherwise("FAIL").alias("status"),
    )

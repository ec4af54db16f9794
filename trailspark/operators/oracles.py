"""Machine criteria, freshness and attested references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import vocab
from trailspark.operators.lookups import attested_controls

K, C, E = "contract_id", "control_id", "evidence_id"


# -- criteria ----------------------------------------------------------------------


def comparable(name: str) -> dict[str, Column]:
    """A JSON value (VARIANT column) as a whole number, a number, a text, or else as JSON.

    Truth values count as 1 and 0. Whole numbers keep all their digits.
    """
    kind = F.schema_of_variant(name)
    get = lambda t: F.expr(f"try_variant_get({name}, '$', '{t}')")
    number = kind.rlike("^(BIGINT|DECIMAL|FLOAT|DOUBLE)")
    truth = F.when(kind == "BOOLEAN", get("boolean").cast("bigint"))
    whole = F.coalesce(F.when(kind == "BIGINT", get("bigint")), truth)
    return {
        "whole": whole, "number": F.coalesce(F.when(number, get("double")), truth.cast("double")),
        "text": F.when(kind == "STRING", get("string")), "json": F.to_json(F.col(name)),
    }


def _equal(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Numbers by value, texts by text, anything else by its JSON; never null."""
    return (
        F.when(a["whole"].isNotNull() & b["whole"].isNotNull(), a["whole"] == b["whole"])
        .when(a["number"].isNotNull() & b["number"].isNotNull(), a["number"] == b["number"])
        .when(a["number"].isNotNull() | b["number"].isNotNull(), False)
        .otherwise(F.coalesce(a["json"], F.lit("null")) == F.coalesce(b["json"], F.lit("null")))
    )


def same_value(left: str, right: str) -> Column:
    """Whether two VARIANT columns hold equal values."""
    return _equal(comparable(left), comparable(right))


def _ordered(a: dict[str, Column], b: dict[str, Column], less: bool) -> Column:
    """a <= b or a >= b of two numbers or two texts; null where they have no order."""
    pick = lambda x, y: x <= y if less else x >= y
    return F.coalesce(*[pick(a[k], b[k]) for k in ("whole", "number", "text")])


def evaluate_criteria(evidence: DataFrame, addresses: DataFrame, criterion: DataFrame) -> DataFrame:
    """One result per (evidence, control): passed, failed or needsAction with a reason.

    Summary and threshold are JSON. Numbers compare by value whatever their form, truth
    values as 1 and 0, two texts as text, also for 'le' and 'ge'; values without an order
    (null, text against number) need action.
    """
    rules = criterion.select(C, "metric_key", "comparator", F.parse_json("threshold").alias("_bound"),
                             F.col("threshold"))
    facts = evidence.select(K, E, "summary", "seq")
    rows = (
        addresses.select(K, E, C).join(facts, [K, E]).join(rules, C, "left")
        .withColumn("_all", F.expr("from_json(summary, 'map<string, variant>')"))
        .withColumn("_v", F.try_element_at("_all", F.col("metric_key")))
    )
    rows = rows.withColumns({f"_v_{k}": c for k, c in comparable("_v").items()} | {f"_b_{k}": c for k, c in comparable("_bound").items()})
    value, bound = ({k: F.col(f"_{x}_{k}") for k in ("whole", "number", "text", "json")} for x in "vb")
    comparator = F.col("comparator")
    # Members of a list compare as the whole does; a list's numbers and truth values are told apart by their JSON.
    member = lambda x: F.when(
        value["number"].isNotNull(), F.coalesce(x.try_cast("double"), F.when(x == "true", 1.0).when(x == "false", 0.0)) == value["number"]
    ).otherwise(x == F.coalesce(value["json"], F.lit("null")))
    texts = F.transform(F.expr("try_variant_get(_bound, '$', 'array<variant>')"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
    listed = F.coalesce(F.exists(texts, member), F.lit(False))
    ordered = F.when(comparator == "le", _ordered(value, bound, True)).when(comparator == "ge", _ordered(value, bound, False))
    equal = _equal(value, bound)
    ok = (
        F.when(comparator == "in", listed).when(comparator == "eq", equal).when(comparator == "ne", ~equal).otherwise(ordered)
    )
    orderless = comparator.isin("le", "ge") & ordered.isNull()
    missing_rule = F.col("metric_key").isNull()
    missing_metric = ~F.coalesce(F.map_contains_key("_all", F.col("metric_key")), F.lit(False))
    return rows.select(
        K, E, C, "seq", "metric_key", "comparator", "threshold",
        F.when(missing_rule | missing_metric | orderless, "needsAction").when(ok, "passed").otherwise("failed")
        .alias("outcome"),
        F.when(missing_rule, "no-machine-criterion").when(missing_metric, "metric-absent")
        .when(orderless, "not-comparable").alias("reason"),
        F.expr("cast(_v as string)").alias("metric_value"),
    )


def control_outcomes_last_wins(results: DataFrame) -> DataFrame:
    """One outcome per (contract, control): the evidence latest in sequence decides."""
    return results.groupBy(K, C).agg(F.max_by("outcome", F.struct("seq", E)).alias("outcome"))


def assertions(results: DataFrame) -> DataFrame:
    """What a check asserts about a control; it never says the control is met."""
    return results.select(
        K, F.concat_ws("/", F.lit("controlcheck"), F.col(C).cast("string"), E).alias("assertion"),
        F.col(E).alias("backed_by"), F.col(C).alias("evaluates_against"),
        F.lit("automatic").alias("mode"), "outcome", "reason",
        "metric_key", F.col("threshold").alias("threshold_value"), "metric_value",
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    """Results per outcome, in display order."""
    position = F.array_position(F.array(*[F.lit(o) for o in vocab.OUTCOME_ORDER]), F.col("outcome"))
    return (
        results.groupBy("outcome").agg(F.count(F.lit(1)).alias("results"))
        .orderBy(F.when(position == 0, 99).otherwise(position), "outcome")
    )


# -- freshness ---------------------------------------------------------------------


def freshness(last_verified: Column, days: Column, now: Column) -> tuple[Column, Column, Column]:
    """(is_fresh, reason, age_days). A window of 0 days never goes stale."""
    micros = F.unix_micros(now) - F.unix_micros(last_verified)
    day = 86_400_000_000
    age = F.floor(micros / F.lit(day)).cast("bigint")
    event = days == 0
    fresh = event | (micros <= days.cast("bigint") * day)
    known = last_verified.isNotNull() & (days >= 0)
    reason = F.when(days < 0, "invalid:negative-window").when(event, "event-based").when(fresh, "fresh").when(
        known, F.concat(F.lit("stale:"), age, F.lit("d>"), days, F.lit("d"))
    )
    return (
        F.when(known, fresh), reason, F.when(known & ~event, age)
    )


def check_freshness(reference: DataFrame, now: Column) -> DataFrame:
    fresh, reason, age = freshness(F.col("last_verified"), F.col("freshness_days"), now)
    return reference.select(
        "reference_id", "freshness_days", fresh.alias("is_fresh"), reason.alias("reason"),
        age.alias("age_days"),
    )


# -- attested references -----------------------------------------------------------


def latest_attestation(log: DataFrame) -> DataFrame:
    """Newest record per (covered reference, control); ties go to the first in file order."""
    payload = F.struct(
        F.col("id").alias("att_id"), "signer", "signer_role", F.col("outcome").alias("att_outcome"),
        "adequacy", "sufficiency", "notes", F.col("signed_at").cast("timestamp").alias("signed_at"),
    )
    place = F.struct(-F.unix_micros(F.col("signed_at").cast("timestamp")), F.col("_file"), F.col("_line"))
    return (
        log.select("covers", "controls_attested", payload.alias("r"), place.alias("place"))
        .withColumn("cover_key", F.explode("covers"))
        .withColumn(C, F.explode("controls_attested"))
        .groupBy("cover_key", C).agg(F.min_by("r", "place").alias("r"))
        .select("cover_key", C, "r.*")
    )


def evaluate_attested_reference(
    uses: DataFrame, reference: DataFrame, latest: DataFrame, now: Column
) -> DataFrame:
    """Ordered decision list over each attested control's reference; first hit decides.

    ``uses``: control_id, reference_id (null when none is registered), cover_key,
    required_role. ``reference`` carries resolved_ok and signature_verified as found by
    whoever resolved the document; null means not attempted.
    """
    refs = reference.select(
        "reference_id", F.lit(True).alias("_known"), "uri", "freshness_days", "last_verified",
        "signature", "signature_verified", "resolved_ok",
    )
    rows = uses.join(refs, "reference_id", "left").join(latest, ["cover_key", C], "left")
    fresh, stale_reason, age = freshness(F.col("last_verified"), F.col("freshness_days"), now)
    false = F.lit(False)
    signed = F.col("att_id").isNotNull()
    role_ok = F.col("signer_role").isin(vocab.AFFIRMING_OFFICIAL) | F.col("signer_role").eqNullSafe(
        F.col("required_role")
    )
    unresolvable = (F.trim(F.coalesce("uri", F.lit(""))) == "") | ~F.coalesce("resolved_ok", F.lit(True))
    steps = (
        (F.col("_known").isNull(), F.lit("needsAction"), F.lit("reference-missing")),
        (unresolvable, F.lit("failed"), F.lit("reference-unresolvable")),
        (F.col("last_verified").isNull(), F.lit("needsAction"), F.lit("reference-never-verified")),
        (~F.coalesce(fresh, false), F.lit("failed"), stale_reason),
        (F.col("signature").isNull(), F.lit("needsAction"), F.lit("signature-missing")),
        (~F.coalesce("signature_verified", F.lit(True)), F.lit("failed"), F.lit("signature-invalid")),
        (~signed, F.lit("needsAction"), F.lit("awaiting-attestation")),
        (~role_ok, F.lit("failed"), F.concat(
            F.lit("signer-role-mismatch:"), "signer_role", F.lit("!="), "required_role")),
        (F.col("signed_at") < F.col("last_verified"), F.lit("failed"), F.lit("attestation-predates-reference")),
        (F.col("att_outcome") != "passed", F.col("att_outcome"),
         F.when(F.col("att_outcome") == "needsAction", F.lit("attestation-outcome:needsAction"))),
    )
    outcome = reason = None
    for hit, result, why in steps:
        outcome = F.when(hit, result) if outcome is None else outcome.when(hit, result)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    return rows.select(
        *[c for c in uses.columns],
        outcome.otherwise("passed").alias("outcome"), reason.alias("reason"),
        F.when(signed, F.col("att_id")).alias("att_id"), age.alias("age_days"),
    )


def reference_pass(
    required: DataFrame, claim: DataFrame, module: DataFrame, reference: DataFrame,
    machine_outcomes: DataFrame, log: DataFrame, now: Column,
) -> DataFrame:
    """Reference checks of the required controls no machine check already decided.

    The verdict of a control does not depend on the contract, so it is computed once
    per control and joined to the contracts that need it.
    """
    uses = attested_controls(claim, module, reference).select(
        C, "reference_id", F.col("reference_id").cast("string").alias("cover_key"), "required_role"
    )
    latest = latest_attestation(log)
    keyed = uses.withColumn(C, F.col(C).cast("string"))
    verdicts = evaluate_attested_reference(keyed, reference, latest, now).select(
        C, "reference_id", "outcome", "reason", "att_id"
    )
    decided = machine_outcomes.filter(F.col("outcome").isin("passed", "failed")).select(K, C)
    open_ = required.select(K, C).join(decided, [K, C], "left_anti")
    return open_.withColumn("_c", F.col(C).cast("string")).join(
        verdicts.withColumnRenamed(C, "_c"), "_c"
    ).drop("_c")


def merge_outcomes(machine: DataFrame, references: DataFrame) -> DataFrame:
    """Control outcomes of both tracks; a reference verdict replaces an open machine result."""
    ours = references.select(K, C, "outcome")
    return machine.select(K, C, "outcome").join(ours.select(K, C), [K, C], "left_anti").unionByName(ours)

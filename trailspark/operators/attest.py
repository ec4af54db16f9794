"""Sign-off log validation and the contract-level attestation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.functions import vocab

K, C, E = "contract_id", "control_id", "evidence_id"

_ZONED = r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?)?(Z|[+-]\d{2}(:?\d{2})?(:?\d{2})?)$"


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def reject_reasons() -> Column:
    """Every rule a record breaks, in the order the rules are checked."""
    col = F.col
    outside = lambda name, allowed: ~F.coalesce(col(name).isin(*allowed), F.lit(False))
    empty = lambda name: F.coalesce(F.size(col(name)), F.lit(0)) < 1
    algo = F.coalesce("sig_algo", F.lit(vocab.SIG_ALGO_NONE))
    unsigned = algo == vocab.SIG_ALGO_NONE
    required = ("id", "signer", "signer_role", "signed_at", "covers", "controls_attested", "outcome")
    absent = F.lit(False)
    for name in required:
        absent = absent | col(name).isNull()
    parsed = F.try_to_timestamp("signed_at")
    zoned = F.coalesce(col("signed_at").rlike(_ZONED), F.lit(False))
    rules = (
        (absent, "missing-field"),
        (_blank("id"), "empty-id"),
        (outside("signer_role", vocab.SIGNER_ROLES), "bad-role"),
        (outside("outcome", vocab.RECORD_OUTCOMES), "bad-outcome"),
        (empty("covers"), "empty-covers"),
        (empty("controls_attested"), "empty-controls"),
        (parsed.isNull(), "bad-timestamp"),
        (parsed.isNotNull() & ~zoned, "naive-timestamp"),
        ((col("outcome") == "passed") & (_blank("adequacy") | _blank("sufficiency")), "passed-without-rationale"),
        (outside("sig_algo", vocab.SIG_ALGOS) & col("sig_algo").isNotNull(), "bad-sig-algo"),
        (unsigned & col("sig").isNotNull(), "sig-without-algo"),
        (~unsigned & _blank("sig"), "algo-without-sig"),
        (~_blank("override_justification") & _blank("override_evidence"), "justification-without-evidence"),
    )
    marks = [F.when(F.coalesce(hit, F.lit(False)), reason) for hit, reason in rules]
    return F.array_compact(F.array(*marks))


def validate_attestation_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and rejects (file, line, id, reason) one row per reason.

    A record repeating an id of its file is a duplicate unless it is the first.
    """
    first = log.groupBy("_file", "id").agg(F.min("_line").alias("_first"))
    marked = log.join(first, ["_file", "id"], "left")
    repeated = F.when(F.col("_line") > F.col("_first"), F.array(F.lit("duplicate-id")))
    marked = marked.withColumn(
        "_reasons",
        F.concat(reject_reasons(), F.coalesce(repeated, F.array().cast("array<string>"))),
    ).drop("_first")
    valid = marked.filter(F.size("_reasons") == 0).drop("_reasons")
    rejects = marked.select("_file", "_line", "id", F.explode("_reasons").alias("reason"))
    return valid, rejects


def signing_payload() -> Column:
    """Compact canonical JSON of a record without its signature fields."""
    text = lambda name: tx.json_text(F.col(name))
    or_empty = lambda name: tx.json_text(F.coalesce(F.col(name), F.lit("")))
    return tx.json_object(
        ("adequacy", or_empty("adequacy")),
        ("controls_attested", tx.json_list(F.col("controls_attested"), ",")),
        ("covers", tx.json_list(F.col("covers"), ",")),
        ("id", text("id")),
        ("notes", or_empty("notes")),
        ("outcome", text("outcome")),
        ("override_evidence", text("override_evidence")),
        ("override_justification", text("override_justification")),
        ("signed_at", text("signed_at")),
        ("signer", text("signer")),
        ("signer_role", text("signer_role")),
        ("sufficiency", or_empty("sufficiency")),
        separator=",", colon=":",
    )


def record_hashes(log: DataFrame) -> DataFrame:
    return log.select("_file", "_line", "id", tx.sha256(signing_payload()).alias("record_hash"))


# -- contract-level sign-off -------------------------------------------------------


def auto_attest(
    required: DataFrame, machine: DataFrame, references: DataFrame, inherited: DataFrame
) -> DataFrame:
    """One sign-off per required control, from whatever stands behind it.

    A reference verdict decides first (only 'passed' is MET). A machine outcome signs
    MET and carries that outcome, also a failed one. An inherited control signs MET as
    inherited. Nothing behind it means needsAction.
    """
    refs = references.select(K, C, F.col("outcome").alias("_ref"))
    checks = machine.select(K, C, F.col("outcome").alias("_machine"))
    csp = inherited.select(C, F.lit(True).alias("_csp"))
    rows = required.select(K, C).join(refs, [K, C], "left").join(checks, [K, C], "left").join(csp, C, "left")
    ref, machine_, csp_ = F.col("_ref"), F.col("_machine"), F.coalesce("_csp", F.lit(False))
    outcome = F.when(ref.isNotNull(), ref).when(machine_.isNotNull() | csp_, "passed").otherwise("needsAction")
    oracle = (
        F.when(ref.isNotNull(), ref).when(machine_.isNotNull(), machine_).when(csp_, "inherited")
        .otherwise("needsAction")
    )
    path = (
        F.when(ref.isNotNull(), "reference").when(machine_.isNotNull(), "machine")
        .when(csp_, "inherited").otherwise("none")
    )
    return rows.select(
        K, C, F.concat(F.lit("ATT-"), F.col(C).cast("string")).alias("att_id"),
        outcome.alias("outcome"), oracle.alias("oracle_outcome"), path.alias("path"),
    )


def attach_evidence(
    attestation: DataFrame, addresses: DataFrame, documents: DataFrame | None = None
) -> DataFrame:
    """Every evidence row addressing the signed control, plus its document evidence."""
    signed = attestation.select(K, C, "att_id")
    links = addresses.select(K, C, E).distinct()
    if documents is not None:
        links = links.unionByName(documents.select(K, C, E)).distinct()
    return signed.join(links, [K, C]).select(K, "att_id", E)


def resolve_oracle_outcome(attestation: DataFrame, assertion: DataFrame) -> DataFrame:
    """The stated outcome, else the result of the assertion behind the sign-off."""
    results = assertion.select(
        K, F.col("assertion").alias("backed_by"), F.col("outcome").alias("_asserted")
    )
    return attestation.join(results, [K, "backed_by"], "left").select(
        K, "att_id", C, "outcome", "backed_by",
        F.coalesce("oracle_outcome", "_asserted").alias("oracle_outcome"),
    )


def status_labels(attestation: DataFrame) -> DataFrame:
    return attestation.select(K, "att_id", C, tx.status_label(F.col("outcome"), "NOT MET").alias("status"))


def attestation_detail(attestation: DataFrame, attestation_evidence: DataFrame) -> DataFrame:
    """One row per sign-off and evidence it cites; null evidence where it cites none."""
    cited = attestation_evidence.select(K, "att_id", E).distinct()
    whole = attestation.filter(
        F.col("official").isNotNull() & F.col("adequacy").isNotNull() & F.col("sufficiency").isNotNull()
    )
    return whole.join(cited, [K, "att_id"], "left").select(
        K, "att_id", C, "official", "adequacy", "sufficiency",
        tx.local_name(F.col("outcome")).alias("outcome_short"), "mode", "generated_at",
        F.col("override_justification").alias("override"), "override_evidence", "oracle_outcome",
        "document_evidence", E,
    )

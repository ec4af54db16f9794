"""Filters, projections, lookups, joins and set operations over property tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import vocab

K, C = "contract_id", "control_id"

# -- catalog and evidence views ----------------------------------------------------


def all_controls(control: DataFrame) -> DataFrame:
    return control.select(C, "text", "weight").orderBy(C)


def control_text(control: DataFrame, control_id) -> DataFrame:
    return control.filter(F.col(C) == F.lit(control_id)).select("text")


def controls_full(control: DataFrame) -> DataFrame:
    return control.select(C, "text", "family", "weight", "poam_eligible").orderBy(C)


def _known_subtype() -> Column:
    kind = F.col("subtype")
    return F.when(kind.isin("ConfigExport", "PolicyCheck"), kind).alias("subtype")


def all_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with its subtype where it is one of the two known ones."""
    return evidence.select(K, "evidence_id", _known_subtype(), "content_hash", "summary")


def evidentiary_statuses(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.col("evidentiary_status").alias("status")).distinct()


def evidence_hashes(evidence: DataFrame) -> DataFrame:
    return evidence.select("content_hash").distinct()


def poam_refs(control: DataFrame, poam: DataFrame) -> DataFrame:
    """Catalog controls carrying a plan-of-action item."""
    return poam.join(control.select(C), C).select(K, C, "poam_item")


def mock_statuses_present(evidence: DataFrame) -> DataFrame:
    """Statuses of the mock set found per contract."""
    status = F.col("evidentiary_status")
    return (
        evidence.filter(status.isin(*vocab.MOCK_STATUSES)).select(K, status.alias("status")).distinct()
    )


def query_layer(quads: DataFrame, graph: str) -> DataFrame:
    """One named graph; a partition filter when quads are stored by graph."""
    return quads.filter(F.col("graph") == graph).drop("graph")


# -- joins -------------------------------------------------------------------------


def evidence_for_control(evidence: DataFrame, addresses: DataFrame, control: DataFrame) -> DataFrame:
    known = addresses.join(control.select(C), C, "left_semi")
    facts = evidence.select(K, "evidence_id", _known_subtype(), "content_hash", "summary")
    return known.join(facts, [K, "evidence_id"]).select(
        K, C, "evidence_id", "subtype", "content_hash", "summary"
    )


def evidence_detail(evidence: DataFrame, addresses: DataFrame, control: DataFrame) -> DataFrame:
    known = addresses.join(control.select(C), C, "left_semi")
    facts = evidence.select(
        K, "evidence_id", "content_hash", "model_hash", "summary",
        F.col("evidentiary_status").alias("status"), "generated_at",
    )
    return known.join(facts, [K, "evidence_id"])


def evidence_location(evidence: DataFrame, addresses: DataFrame, control: DataFrame) -> DataFrame:
    """Addressing evidence with hash, status, source file and content reference."""
    known = addresses.join(control.select(C), C, "left_semi")
    facts = evidence.select(
        K, "evidence_id", "content_hash", F.col("evidentiary_status").alias("status"), "source_file",
        F.concat(F.lit("registry://evidence/"), "content_hash").alias("document_ref"),
    )
    return known.join(facts, [K, "evidence_id"])


def control_implementation(control: DataFrame, claim: DataFrame, module: DataFrame) -> DataFrame:
    return (
        claim.join(control.select(C), C, "left_semi")
        .join(module.select("module_id", "label", "method"), "module_id", "left")
        .select(C, "label", "method")
    )


def all_attestations(attestation: DataFrame, control: DataFrame) -> DataFrame:
    """Sign-offs that carry an official and both statements."""
    whole = attestation.filter(
        F.col("official").isNotNull() & F.col("adequacy").isNotNull() & F.col("sufficiency").isNotNull()
    )
    return whole.join(control.select(C), C, "left_semi").select(
        K, "att_id", C, "official", "adequacy", "sufficiency", "outcome", "mode", "generated_at"
    )


def backward_trace_rows(
    attestation: DataFrame, attestation_evidence: DataFrame, evidence: DataFrame, control: DataFrame
) -> DataFrame:
    """Sign-off -> cited evidence, hash, summary, official and outcome."""
    signed = attestation.filter(F.col("official").isNotNull()).join(
        control.select(C), C, "left_semi"
    ).select(K, "att_id", C, "official", "outcome")
    cited = attestation_evidence.select(K, "att_id", "evidence_id").join(signed, [K, "att_id"])
    facts = evidence.select(K, "evidence_id", "content_hash", "summary")
    return cited.join(facts, [K, "evidence_id"]).select(
        K, C, "content_hash", "summary", "official", "outcome"
    )


def unattested_controls(scope: DataFrame, attestation: DataFrame) -> DataFrame:
    """Rows of ``scope`` (contract, control) without any sign-off."""
    return scope.select(K, C).join(attestation.select(K, C).distinct(), [K, C], "left_anti")


def control_outcomes(scope: DataFrame, attestation: DataFrame) -> DataFrame:
    """Every (contract, control) in scope with its sign-off outcome or null."""
    return scope.select(K, C).join(attestation.select(K, C, "outcome"), [K, C], "left")


def satisfy_pairs(claim: DataFrame, module: DataFrame) -> DataFrame:
    return claim.join(module.select("module_id"), "module_id", "left_semi").select("module_id", C).distinct()


def verification_methods(module: DataFrame) -> DataFrame:
    return module.filter(F.col("method").isNotNull()).select("module_id", "method").distinct()


def satisfy_agreement(edges: DataFrame, claims: DataFrame, control: DataFrame) -> DataFrame:
    """Where the satisfy edges, the direct claims and the catalog disagree."""
    pair = ["module_id", C]
    edge, claimed = edges.select(*pair).distinct(), claims.select(*pair).distinct()
    kinds = (
        (edge.join(claimed, pair, "left_anti"), "edge-without-claim"),
        (claimed.join(edge, pair, "left_anti"), "claim-without-edge"),
        (claimed.join(control.select(C), C, "left_anti").select(*pair), "unknown-control"),
    )
    out = None
    for rows, issue in kinds:
        rows = rows.select(*pair, F.lit(issue).alias("issue"))
        out = rows if out is None else out.unionByName(rows)
    return out


def is_attested_method(method: Column) -> Column:
    return F.coalesce(method.endswith(vocab.ATTESTED_METHOD), F.lit(False))


def is_inherited_method(method: Column) -> Column:
    return F.coalesce(method.startswith(vocab.INHERITED_PREFIX), F.lit(False))


def attested_controls(claim: DataFrame, module: DataFrame, reference: DataFrame) -> DataFrame:
    """Control -> document reference behind it, through attested-reference modules.

    The first module (lowest id) claiming a control wins, also when it names no
    reference: then the reference columns are null.
    """
    modules = module.filter(is_attested_method(F.col("method"))).select(
        "module_id", F.col("reference_id").alias("_ref"), F.coalesce("role", F.lit("")).alias("required_role")
    )
    first = (
        claim.join(modules, "module_id")
        .groupBy(C)
        .agg(F.min_by(F.struct("module_id", "_ref", "required_role"), "module_id").alias("w"))
        .select(C, "w.module_id", F.col("w._ref").alias("_ref"), "w.required_role")
    )
    target = reference.select(
        F.col("reference_id").alias("_ref"),
        F.col("reference_id").alias("reference_id"),
        "uri", "custodian", "source_system",
        F.coalesce("freshness_days", F.lit(vocab.DEFAULT_FRESHNESS_DAYS)).alias("freshness_days"),
        "last_verified", "version", "signature",
    )
    return first.join(target, "_ref", "left").drop("_ref")


def control_references(claim: DataFrame, module: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per (control, policy reference) through the modules that name one."""
    sources = module.filter(F.col("reference_id").isNotNull()).select(
        "module_id", "reference_id", F.coalesce(F.col("source_id").cast("string"), F.lit("")).alias("source")
    )
    facts = reference.select(
        "reference_id",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("uri", "version", "signature")],
    )
    return (
        claim.join(sources, "module_id")
        .join(facts, "reference_id", "left")
        .select(C, "module_id", "reference_id", "source",
                *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("uri", "version", "signature")])
    )


def control_reference_map(refs: DataFrame) -> DataFrame:
    """Control -> the distinct policy references behind it, one row each."""
    return refs.select(C, "reference_id", "source", "uri", "version", "signature").distinct()


def policy_inventory(refs: DataFrame) -> DataFrame:
    """Distinct policies by reference, as the last module naming each one states it."""
    row = F.struct("source", "uri", "version", "signature")
    return (
        refs.groupBy("reference_id").agg(F.max_by(row, "module_id").alias("r"))
        .select("reference_id", "r.*")
    )


def inherited_controls(claim: DataFrame, module: DataFrame) -> DataFrame:
    modules = module.filter(is_inherited_method(F.col("method"))).select("module_id")
    return claim.join(modules, "module_id", "left_semi").select(C).distinct()


def reference_chain(
    claim: DataFrame, module: DataFrame, reference: DataFrame, source: DataFrame
) -> DataFrame:
    """Control -> module -> source -> reference -> role, with labels."""
    from trailspark.functions.text import freshness_label

    modules = module.filter(is_attested_method(F.col("method"))).select(
        "module_id", F.coalesce("label", F.col("module_id").cast("string")).alias("module"),
        "source_id", "reference_id", F.coalesce("role", F.lit("")).alias("role"),
    )
    sources = source.select("source_id", F.col("label").alias("_source"))
    refs = reference.select("reference_id", "uri", "freshness_days", "last_verified", "custodian")
    days = F.coalesce("freshness_days", F.lit(0).cast("bigint"))
    linked = (
        modules.join(sources, "source_id", "left").join(refs, "reference_id", "left")
        .select(
            "module_id", "module",
            F.coalesce("_source", F.col("source_id").cast("string"), F.lit("")).alias("source"),
            F.coalesce("uri", F.lit("")).alias("uri"),
            days.alias("freshness_days"), freshness_label(days).alias("freshness"),
            "last_verified", F.coalesce("custodian", F.lit("")).alias("custodian"), "role",
        )
    )
    return claim.join(linked, "module_id").drop("module_id")


def machine_verified(claim: DataFrame, module: DataFrame) -> DataFrame:
    """Per claimed control: does some module check it by machine?"""
    by_machine = F.coalesce("method_is_iri", F.lit(False)) & ~is_attested_method(F.col("method"))
    modules = module.select("module_id", (by_machine & F.col("method").isNotNull()).alias("_m"))
    return claim.join(modules, "module_id").groupBy(C).agg(F.bool_or("_m").alias("machine_verified"))


# -- set operations ----------------------------------------------------------------


def set_union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.distinct()


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def set_intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")


def merge_graphs(quads: DataFrame) -> DataFrame:
    """All graphs seen as one: graph names dropped, repeated triples once."""
    return quads.drop("graph").distinct()

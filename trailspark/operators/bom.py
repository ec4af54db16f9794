"""Bill of materials, traceability matrix and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.functions import vocab
from trailspark.functions.groups import group_digest
from trailspark.operators.lookups import is_attested_method, is_inherited_method

K, C, E, M = "contract_id", "control_id", "evidence_id", "module_id"


# -- rows --------------------------------------------------------------------------


def evidence_backing(
    outcome: Column, oracle: Column, has_evidence: Column, documented: Column
) -> Column:
    """How a sign-off is backed; the first rule that fits decides."""
    met = F.coalesce(outcome == "passed", F.lit(False))
    held = F.coalesce(has_evidence, F.lit(False))
    return (
        F.when(met & F.coalesce(oracle == "failed", F.lit(False)), "override")
        .when(F.coalesce(documented, F.lit(False)) & met & held, "attested-evidenced")
        .when(F.coalesce(oracle == "passed", F.lit(False)) & held, "machine")
        .otherwise("human-only")
    )


def row_evidence(
    required: DataFrame, evidence: DataFrame, addresses: DataFrame, documents: DataFrame | None = None
) -> DataFrame:
    """Distinct evidence hashes per required control, document hashes included."""
    hashes = evidence.filter(F.coalesce("content_hash", F.lit("")) != "").select(K, E, "content_hash")
    links = addresses.select(K, C, E).distinct().join(hashes, [K, E]).select(K, C, "content_hash")
    if documents is not None:
        links = links.unionByName(
            documents.filter(F.col("sha256").isNotNull()).select(K, C, F.col("sha256").alias("content_hash"))
        )
    return links.distinct().join(required.select(K, C), [K, C], "left_semi")


def row_resources(required: DataFrame, resource_control: DataFrame) -> DataFrame:
    """Distinct planned resources per required control."""
    return (
        resource_control.select(K, C, "resource_id").distinct()
        .join(required.select(K, C), [K, C], "left_semi")
    )


def bom_rows(
    required: DataFrame, resources: DataFrame, hashes: DataFrame, outcomes: DataFrame,
    attestation: DataFrame, documents: DataFrame | None = None,
) -> DataFrame:
    """One row per required control; ``resources`` and ``hashes`` list what it counts.

    ``resources``: contract_id, control_id, resource_id; ``hashes``: contract_id,
    control_id, content_hash, both without repeats. ``outcomes``: contract_id,
    control_id, outcome. ``documents``: contract_id, control_id, reference_id, sha256,
    git_commit, git_committed_at, outcome.
    """
    count = lambda rows, out: rows.groupBy(K, C).agg(F.count(F.lit(1)).alias(out))
    rows = (
        required.select(K, C)
        .join(count(resources, "resources"), [K, C], "left")
        .join(count(hashes, "hashes"), [K, C], "left")
        .join(outcomes.select(K, C, F.col("outcome").alias("oracle_outcome")), [K, C], "left")
        .join(attestation.select(K, C, F.col("outcome").alias("attestation_outcome")), [K, C], "left")
    )
    if documents is None:
        none = F.lit(None).cast("string")
        rows = rows.withColumns({
            "reference_id": none, "git_commit": none, "git_committed_at": none,
            "_documented": F.lit(False),
        })
    else:
        found = documents.filter(F.col("sha256").isNotNull()).select(
            K, C, F.col("reference_id").cast("string").alias("reference_id"), "git_commit",
            "git_committed_at", (F.col("outcome") == "passed").alias("_documented"),
        )
        rows = rows.join(found, [K, C], "left")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        K, C, F.coalesce("resources", zero).alias("resources"), F.coalesce("hashes", zero).alias("hashes"),
        "oracle_outcome", "attestation_outcome",
        tx.status_label(F.col("attestation_outcome"), "NOT MET").alias("status"),
        evidence_backing(
            F.col("attestation_outcome"), F.col("oracle_outcome"), F.col("hashes") > 0,
            F.col("_documented"),
        ).alias("evidence_backing"),
        "reference_id", "git_commit", "git_committed_at",
    )


def evidentiary_status(contracts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Weakest status wins: mock when any evidence is weak or there is none."""
    weak = evidence.groupBy(K).agg(
        F.bool_or(F.coalesce(F.col("evidentiary_status").isin(*vocab.WEAK_STATUSES), F.lit(False))).alias("_weak")
    )
    return contracts.select(K).join(weak, K, "left").select(
        K, F.when(F.coalesce("_weak", F.lit(True)), "mock").otherwise("real").alias("evidentiary_status")
    )


def bom_header(
    orders: DataFrame, rows: DataFrame, evidence: DataFrame, gate: DataFrame, outcomes: DataFrame,
    module_hash: DataFrame,
) -> DataFrame:
    """Order facts with the counts and verdicts a bill of materials opens with."""
    count = lambda frame, name: frame.groupBy(K).agg(F.count(F.lit(1)).alias(name))
    per_row = rows.groupBy(K).agg(
        F.count(F.lit(1)).alias("controls"),
        F.count(F.when(F.col("status") == "MET", 1)).alias("met"),
    )
    counts = ("controls", "met", "evidence_items", "oracle_outcomes", "modules", "policy_findings")
    out = (
        evidentiary_status(orders, evidence).join(orders, K)
        .join(per_row, K, "left").join(count(evidence, "evidence_items"), K, "left")
        .join(count(outcomes, "oracle_outcomes"), K, "left").join(count(module_hash, "modules"), K, "left")
        .join(gate.select(K, "passed", F.col("findings").alias("policy_findings")), K, "left")
    )
    return out.select(
        *orders.columns, "evidentiary_status", F.coalesce("passed", F.lit(False)).alias("policy_passed"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
    )


# -- canonical document and its hash -----------------------------------------------


def row_json() -> Column:
    """Canonical JSON of one bill-of-materials row."""
    text = lambda name: tx.json_text(F.col(name))
    return tx.json_object(
        ("attestation_outcome", text("attestation_outcome")),
        ("control_id", text(C)),
        ("evidence_backing", text("evidence_backing")),
        ("git_commit", text("git_commit")),
        ("git_committed_at", text("git_committed_at")),
        ("oracle_outcome", text("oracle_outcome")),
        ("reference_id", text("reference_id")),
        ("status", text("status")),
    )


def bom_document(
    orders: DataFrame, rows: DataFrame, resources: DataFrame, hashes: DataFrame, attestation: DataFrame,
    evidence: DataFrame, outcomes: DataFrame, module_hash: DataFrame, planned: DataFrame,
    findings: DataFrame, gate: DataFrame,
) -> DataFrame:
    """The bill of materials of each contract as distinct rows (contract, section, key, value).

    ``orders``: contract_id, order_hash, state_hash, tier, impact_level, standard.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    part = lambda frame, section, key, value: frame.select(
        K, F.lit(section).alias("section"), key.alias("key"), value.alias("value"))
    signoff = tx.json_object(
        ("official", tx.json_text(F.coalesce("official", F.lit("")))),
        ("outcome", tx.json_text(F.coalesce("outcome", F.lit("")))),
        ("override_evidence", tx.json_text(F.col("override_evidence"))),
        ("override_justification", tx.json_text(F.col("override_justification"))),
        ("role", F.lit(f'"{vocab.BOM_ROLE}"')),
    )
    head = orders.join(evidentiary_status(orders, evidence), K).join(gate.select(K, "passed"), K, "left")
    shown = F.create_map(*[x for name in ("order_hash", "state_hash", "tier", "impact_level", "standard", "evidentiary_status")
                           for x in (F.lit(name), text(name))],
                         F.lit("schema"), F.lit(vocab.BOM_SCHEMA),
                         F.lit("policy_passed"), tx.json_bool(F.coalesce("passed", F.lit(False))))
    parts = (
        head.select(K, F.lit("order").alias("section"), F.explode(shown).alias("key", "value")),
        part(attestation, "attestation", text(C), signoff),
        part(rows, "control", text(C), row_json()),
        part(resources.join(rows.select(K, C), [K, C], "left_semi"), "control_resource", text(C), text("resource_id")),
        part(hashes, "control_evidence", text(C), text("content_hash")),
        part(evidence, "evidence", text("content_hash"), F.lit("")),
        part(module_hash, "module", text(M), text("module_hash")),
        part(outcomes, "oracle", text(C), text("outcome")),
        part(planned, "plan", text("resource_id"), F.lit("")),
        part(findings, "finding", text("resource_id"), text("finding")),
    )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def document_hash(document: DataFrame) -> DataFrame:
    """The hash of each contract's bill of materials, from its rows in any order."""
    return group_digest(document, [K], F.concat_ws("\t", "section", "key", "value"), "bom_hash")


def artifact_hashes(orders: DataFrame, evidence: DataFrame, module_hash: DataFrame, hashes: DataFrame) -> DataFrame:
    """Every distinct hash a bill of materials refers to."""
    one = lambda frame, name: frame.select(K, F.col(name).alias("hash"))
    parts = (one(orders, "order_hash"), one(orders, "state_hash"), one(evidence, "content_hash"),
             one(module_hash, "module_hash"), one(hashes, "content_hash"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.coalesce("hash", F.lit("")) != "").distinct()


def verify_bom(boms: DataFrame, stored: DataFrame, artifacts: DataFrame, blobs: DataFrame) -> DataFrame:
    """A stored document must re-hash, and so must each artifact that is stored at all.

    ``boms``: contract_id, bom_hash; ``stored``: rows of the stored documents;
    ``artifacts``: contract_id, hash; ``blobs``: hash, content BINARY.
    """
    checked = blobs.groupBy("hash").agg(F.bool_and(F.sha2("content", 256) == F.col("hash")).alias("_ok"))
    found = document_hash(stored).select(K, F.col("bom_hash").alias("_found"))
    bad = artifacts.join(checked.filter(~F.col("_ok")), "hash", "left_semi").groupBy(K).agg(
        F.count(F.lit(1)).alias("_bad")
    )
    same = F.coalesce(F.col("bom_hash") == F.col("_found"), F.lit(False))
    return boms.select(K, "bom_hash").join(found, K, "left").join(bad, K, "left").select(
        K, (same & F.col("_bad").isNull()).alias("verified"),
        same.alias("document_ok"), F.coalesce("_bad", F.lit(0)).alias("tampered_artifacts"),
    )


def bom_facts(boms: DataFrame, orders: DataFrame, status: DataFrame, artifacts: DataFrame, rows: DataFrame,
              resources: DataFrame, hashes: DataFrame) -> DataFrame:
    """The bill of materials as (contract, subject, fact, value) rows.

    ``boms``: contract_id, bom_hash; ``orders``: contract_id, order_hash, state_hash;
    ``status``: contract_id, evidentiary_status; ``artifacts``: contract_id, hash.
    """
    head = boms.select(K, "bom_hash", F.concat(F.lit("BOM/"), "bom_hash").alias("_bom"))
    text = lambda c: F.col(c).cast("string")
    own = orders.join(status, K, "left").join(head, K).select(K, "_bom", F.explode(F.create_map(
        F.lit("type"), F.lit("BillOfMaterials"), F.lit("bomHash"), F.col("bom_hash"), F.lit("forContract"), text(K),
        F.lit("derivedFromOrder"), text("order_hash"), F.lit("stateHash"), text("state_hash"),
        F.lit("evidentiaryStatus"), text("evidentiary_status"))).alias("fact", "value")).filter(F.col("value").isNotNull())
    shown = F.create_map(F.lit("type"), F.lit("ControlMapping"), F.lit("control"), text(C), F.lit("bomStatus"), F.col("status"),
                         F.lit("evidenceBacking"), F.col("evidence_backing"))
    listed = lambda frame, fact, value: frame.select(
        K, C, F.lit(fact).alias("fact"), text(value).alias("value")
    )
    # All per-control facts first, so that the document hash is joined once.
    facts = (
        rows.select(K, C, F.explode(shown).alias("fact", "value"))
        .unionByName(listed(resources, "resource", "resource_id"))
        .unionByName(listed(hashes, "evidenceHash", "content_hash"))
        .unionByName(rows.select(K, C, F.lit("hasControlMapping").alias("fact"), F.lit(None).cast("string").alias("value")))
        .unionByName(artifacts.select(K, F.lit(None).cast(rows.schema[C].dataType).alias(C), F.lit("referencesArtifact").alias("fact"),
                                      F.col("hash").alias("value")))
    )
    mapping = F.concat("_bom", F.lit("/mapping/"), text(C))
    upward = F.col("fact").isin("hasControlMapping", "referencesArtifact")
    return own.select(K, F.col("_bom").alias("subject"), "fact", "value").unionByName(facts.join(head, K).select(
        K, F.when(upward, F.col("_bom")).otherwise(mapping).alias("subject"), "fact",
        F.when(F.col("fact") == "hasControlMapping", mapping).otherwise(F.col("value")).alias("value")))


# -- matrix ------------------------------------------------------------------------


def vcrm_matrix(
    scope: DataFrame, claim: DataFrame, module: DataFrame, attestation: DataFrame,
    attestation_evidence: DataFrame, evidence: DataFrame, addresses: DataFrame, poam: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """The traceability matrix as rows (contract, control, item, value), and who implements each control.

    Items: status, backing, official, override, gap, location, hash, poam. A control
    without sign-off reads PLANNED. Implementations (control, label) are the same for
    every contract and stay a list of their own.
    """
    pair = [K, C]
    labels = claim.join(module.select(M, "label"), M).select(C, "label").distinct()
    located = addresses.select(K, C, E).distinct().join(
        evidence.select(
            K, E, F.coalesce("source_file", F.concat(F.lit("registry://evidence/"), "content_hash")).alias("location"),
            F.substring("content_hash", 1, 12).alias("hash"),
        ), [K, E],
    ).join(scope.select(*pair), pair, "left_semi")
    cited = attestation_evidence.select(K, "att_id").distinct().withColumn("_cited", F.lit(True))
    escaped = F.replace(tx.one_line(F.col("override_justification")), F.lit("|"), F.lit("\\|"))
    status = tx.status_or_name(F.col("outcome"))
    held = attestation.join(cited, [K, "att_id"], "left").select(
        *pair, "official", status.alias("status"),
        evidence_backing(
            F.col("outcome"), tx.local_name(F.col("oracle_outcome")), F.col("_cited"),
            F.col("document_evidence").isNotNull(),
        ).alias("backing"),
        F.when(F.coalesce("override_justification", F.lit("")) != "", escaped).alias("override"),
        F.when(status != "MET", F.concat(F.lit("attested "), status)).alias("gap"),
    )
    signed = scope.select(*pair).join(held.withColumn("_signed", F.lit(True)), pair, "left").withColumns({
        "status": F.coalesce("status", F.lit("PLANNED")),
        "gap": F.when(F.col("_signed").isNull(), "not attested (planned)").otherwise(F.col("gap")),
    })
    items = lambda frame, *names: frame.select(*pair, F.explode(F.create_map(
        *[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])).alias("item", "value"))
    listed = poam.join(scope.select(*pair), pair, "left_semi").select(*pair, tx.local_name(F.col("poam_item")).alias("poam"))
    rows = (
        items(signed, "status", "backing", "official", "override", "gap")
        .unionByName(items(located, "location", "hash")).unionByName(items(listed, "poam"))
    )
    return rows.filter(F.coalesce("value", F.lit("")) != "").distinct(), labels


def control_detail(control: DataFrame, attestation: DataFrame) -> DataFrame:
    """Signed controls with statement, determination and rationale."""
    return attestation.join(control.select(C, "text", "family", "weight", "poam_eligible"), C).select(
        K, C, "att_id", tx.one_line(F.col("text")).alias("statement"), "family", "weight", "poam_eligible",
        tx.status_or_name(F.col("outcome")).alias("status"), F.coalesce("official", F.lit("-")).alias("official"),
        F.col("generated_at"), tx.one_line(F.col("adequacy")).alias("adequacy"),
        tx.one_line(F.col("sufficiency")).alias("sufficiency"),
        F.when(F.coalesce("override_justification", F.lit("")) != "",
               tx.one_line(F.col("override_justification"))).alias("override"),
    )


def document_date(contracts: DataFrame, attestation: DataFrame, evidence: DataFrame) -> DataFrame:
    """Latest generation time in a contract's data, '-' without any."""
    times = attestation.select(K, "generated_at").unionByName(evidence.select(K, "generated_at"))
    latest = times.groupBy(K).agg(F.max("generated_at").alias("t"))
    shown = F.date_format("t", "yyyy-MM-dd HH:mm:ss")
    return contracts.select(K).join(latest, K, "left").select(K, F.coalesce(shown, F.lit("-")).alias("document_date"))


# -- roll-ups ----------------------------------------------------------------------


def family_rollup(rows: DataFrame, family: Column) -> DataFrame:
    """Bill-of-materials rows per family: met and how each is backed, numeric family order."""
    count = lambda cond: F.count(F.when(cond, 1))
    backing = F.col("evidence_backing")
    out = rows.groupBy(family.alias("family")).agg(
        F.count(F.lit(1)).alias("total"), count(F.col("status") == "MET").alias("met"),
        count(backing == "machine").alias("machine"), count(backing == "attested-evidenced").alias("attested"),
        count(~backing.isin("machine", "attested-evidenced", "override")).alias("human"),
        count(backing == "override").alias("override"),
    )
    number = F.regexp_extract("family", r"^3\.(\d+)", 1).try_cast("int")
    return out.orderBy(number.asc_nulls_last(), "family")


def module_kind(method: Column) -> Column:
    return F.when(is_attested_method(method), "attested").when(is_inherited_method(method), "inherited").otherwise("machine")


def catalog_coverage(control: DataFrame, claim: DataFrame, module: DataFrame) -> DataFrame:
    """Every catalog control with how it is verified and whether it may be deferred."""
    kinds = claim.join(module.select(M, module_kind(F.col("method")).alias("_kind")), M).groupBy(C).agg(
        F.bool_or(F.col("_kind") == "attested").alias("_attested"),
        F.bool_and(F.col("_kind") == "inherited").alias("_inherited"),
    )
    kind = (
        F.when(F.col("_attested").isNull(), "unclaimed").when(F.col("_attested"), "attested")
        .when(F.col("_inherited"), "inherited").otherwise("machine")
    )
    weight = F.coalesce("weight", F.lit(1).cast("bigint"))
    fixed = F.col(C).cast("string").isin(*vocab.NON_DEFERRABLE_ONE_POINTERS)
    return control.join(kinds, C, "left").select(
        C, "family", weight.alias("weight"), kind.alias("kind"), ((weight > 1) | fixed).alias("non_deferrable"),
        (kind == "inherited").alias("inherited"),
    )


def family_kind_tally(coverage: DataFrame) -> DataFrame:
    """Weight at stake per family and kind, one column per kind."""
    kinds = ["machine", "attested", "inherited", "unclaimed"]
    wide = coverage.groupBy("family").pivot("kind", kinds).agg(F.sum("weight"))
    return wide.select("family", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds])


def authoritative_sources(chain: DataFrame) -> DataFrame:
    """How many controls draw on each source, most used first."""
    return chain.groupBy("source").agg(F.count(F.lit(1)).alias("controls")).orderBy(F.desc("controls"), "source")


def report_facts(rows: DataFrame, met: DataFrame) -> DataFrame:
    """Headline counts per contract."""
    count = lambda cond: F.count(F.when(cond, 1))
    heads = rows.groupBy(K).agg(
        F.count(F.lit(1)).alias("total"), count(F.col("status") == "MET").alias("met"),
        count(F.col("status") != "MET").alias("not_met"),
        count(F.col("evidence_backing") == "override").alias("override"),
    )
    proven = F.coalesce(F.col("oracle_outcome") == "passed", F.lit(False))
    split = met.groupBy(K).agg(
        count(F.col("met") & proven).alias("machine"), count(F.col("met") & ~proven).alias("human"),
        count(F.col("contradicted")).alias("contradictions"),
    )
    return heads.join(split, K, "left").select(
        *heads.columns,
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("machine", "human", "contradictions")],
    )


def family_exposure(scope: DataFrame, control: DataFrame, claim: DataFrame) -> DataFrame:
    """Per family: required controls, points at risk and how many some module covers."""
    covered = claim.select(C).distinct().withColumn("_c", F.lit(1))
    facts = control.select(C, "family", "weight").join(covered, C, "left")
    return scope.select(C).groupBy(C).agg(F.count(F.lit(1)).alias("_n")).join(facts, C).groupBy("family").agg(
        F.sum("_n").alias("controls"), F.sum(F.col("weight") * F.col("_n")).alias("points_at_risk"),
        F.sum(F.when(F.col("_c").isNotNull(), F.col("_n")).otherwise(0)).alias("covered"),
    )


def vcrm_drift(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """Controls of the matrix that are added, removed or changed against a stored matrix."""
    digest = lambda frame, out: group_digest(frame, [K, C], F.concat_ws("\t", "item", "value"), out)
    drift = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
    )
    return digest(rebuilt, "_new").join(digest(stored, "_old"), [K, C], "full").select(
        K, C, drift.alias("drift")).filter(F.col("drift").isNotNull())


def explain_control(
    rows: DataFrame, control: DataFrame, hashes: DataFrame, resources: DataFrame
) -> DataFrame:
    """The evidence trail of each row as (contract, control, item, value) lines."""
    weight = rows.join(control.select(C, "weight"), C, "left")
    shown = F.create_map(
        F.lit("oracle outcome"), F.coalesce("oracle_outcome", F.lit("not run")),
        F.lit("attestation"), F.col("status"),
        F.lit("weight"), F.coalesce(F.col("weight").cast("string"), F.lit("?")),
        F.lit("backing"), F.col("evidence_backing"),
        F.lit("reference"), F.coalesce("reference_id", F.lit("-")),
    )
    facts = weight.select(K, C, F.explode(shown).alias("item", "value"))
    held = rows.select(K, C)
    listed = lambda frame, item, value: frame.join(held, [K, C], "left_semi").select(
        K, C, F.lit(item).alias("item"), F.col(value).cast("string").alias("value")
    )
    return facts.unionByName(listed(hashes, "evidence", "content_hash")).unionByName(
        listed(resources, "resource", "resource_id")
    )

"""Evidence: overlays, derived checks, plan evidence, binding and hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.functions import vocab
from trailspark.functions.groups import group_digest
from trailspark.operators.oracles import same_value

K, C, E, M = "contract_id", "control_id", "evidence_id", "module_id"


def overlay_by_key(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """``over`` layered on ``base``: same key replaces, other base rows stay."""
    replaced = over.select(*keys).distinct()
    return base.join(replaced, keys, "left_anti").unionByName(over.select(*base.columns))


# -- derived policy checks ---------------------------------------------------------


def derive_policy_checks(evidence: DataFrame, addresses: DataFrame, checks: DataFrame) -> DataFrame:
    """PASS/FAIL check rows for the checked controls whose metric the export carries.

    ``checks``: control_id, metric_key, threshold (JSON); a metric passes when it equals
    the threshold by value.
    """
    facts = evidence.select(K, E, "summary")
    rows = (
        addresses.select(K, E, C).join(checks, C).join(facts, [K, E])
        .withColumn("_all", F.expr("from_json(summary, 'map<string, variant>')"))
        .withColumn("_v", F.try_element_at("_all", F.col("metric_key")))
        .withColumn("_bound", F.parse_json("threshold"))
        .withColumn("_value", F.coalesce(F.to_json("_v"), F.lit("null")))
        .filter(F.map_contains_key("_all", F.col("metric_key")))
    )
    status = F.when(same_value("_v", "_bound"), "PASS").otherwise("FAIL")
    return rows.select(
        K, E, C, "metric_key", F.lit(vocab.POLICY_TOOL).alias("tool"), status.alias("status"),
        F.concat("metric_key", F.lit("="), "_value", F.lit(" eq "), "threshold").alias("detail"),
        F.concat(F.lit('{"'), "metric_key", F.lit('": '), "_value", F.lit("}")).alias("summary"),
    )


# -- plan evidence -----------------------------------------------------------------


def region_signals(planned: DataFrame) -> DataFrame:
    """All residency signals of a plan: tag regions, store locations, allowed locations.

    ``planned``: contract_id, address, type, tag_region, location, allowed_values ARRAY.
    Every row is read once and gives zero or more signals.
    """
    tag = F.when(F.col("type") == "terraform_data", F.col("tag_region"))
    store = F.when(
        F.col("type").isin("google_kms_key_ring", "google_storage_bucket"), F.col("location")
    )
    policy = F.when(F.col("address").endswith("resource_locations"), F.col("allowed_values"))
    one = lambda c: F.array(F.nullif(c, F.lit("")))
    signals = F.array_compact(F.concat(one(tag), one(store), F.coalesce(policy, F.array().cast("array<string>"))))
    return planned.select(K, "address", F.explode(signals).alias("signal"))


def plan_evidence(tags: DataFrame, tag_controls: DataFrame, signals: DataFrame) -> DataFrame:
    """Evidence rows of tagged, not inherited plan resources.

    Only a module addressing the residency control can fail, and it fails on any non-US
    signal anywhere in its contract's plan. ``tags``: contract_id, module_id, inherited;
    ``tag_controls``: contract_id, module_id, control_id.
    """
    abroad = (
        signals.filter(~tx.is_us_location(F.col("signal"))).select(K).distinct()
        .withColumn("_abroad", F.lit(True))
    )
    scoped = (
        tag_controls.filter(F.col(C).cast("string") == vocab.RESIDENCY_CONTROL).select(K, M).distinct()
        .withColumn("_scoped", F.lit(True))
    )
    return plan_verdicts(tags, scoped, abroad)


def plan_verdicts(tags: DataFrame, scoped: DataFrame, abroad: DataFrame) -> DataFrame:
    """Verdict per tag, given the residency-scoped modules and the contracts with a non-US signal."""
    in_scope, bad = F.coalesce("_scoped", F.lit(False)), F.coalesce("_abroad", F.lit(False))
    rows = (
        tags.filter(~F.coalesce("inherited", F.lit(False)))
        .join(scoped, [K, M], "left").join(abroad, K, "left")
    )
    return rows.select(
        K, M,
        F.when(in_scope & bad, "FAIL").otherwise("PASS").alias("status"),
        F.when(in_scope, "terraform-plan-residency").otherwise("terraform-plan-presence").alias("check"),
        F.when(in_scope, F.when(bad, "NON-US").otherwise("US")).alias("data_region"),
        F.lit(vocab.PLAN_STATUS).alias("evidentiary_status"),
        F.lit(vocab.PLAN_TOOL).alias("tool"),
    )


# -- hash chain --------------------------------------------------------------------


def chained_hash(model_hash: Column) -> Column:
    """Content hash of evidence from its model hash."""
    null = F.lit("null")
    return tx.sha256(tx.json_object(
        ("model_hash", tx.json_text(model_hash)), ("proof_hash", null), ("sim_hash", null)
    ))


def export_hash(source: Column, first_control: Column, config_json: Column) -> Column:
    """Model hash of a configuration export; ``config_json`` is canonical JSON text."""
    return tx.sha256(tx.json_object(
        ("config", config_json), ("control", tx.json_text(first_control)), ("source", tx.json_text(source))
    ))


def check_hash(tool: Column, first_control: Column, result_json: Column) -> Column:
    """Model hash of a policy check result; ``result_json`` is canonical JSON text."""
    return tx.sha256(tx.json_object(
        ("control", tx.json_text(first_control)), ("result", result_json), ("tool", tx.json_text(tool))
    ))


def evidence_hash_chain(artifacts: DataFrame) -> DataFrame:
    """Add model_hash and content_hash to artifacts.

    ``artifacts``: method ('policy-check' or other), origin (source system or tool),
    first_control, payload (canonical JSON).
    """
    control = F.coalesce("first_control", F.lit(""))
    model = F.when(
        F.col("method") == "policy-check", check_hash(F.col("origin"), control, F.col("payload"))
    ).otherwise(export_hash(F.col("origin"), control, F.col("payload")))
    return artifacts.withColumn("model_hash", model).withColumn(
        "content_hash", chained_hash(F.col("model_hash"))
    )


def reverify_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence whose stored content hash is not the one its model hash gives."""
    actual = chained_hash(F.col("model_hash"))
    return evidence.filter(
        F.col("content_hash").isNotNull() & F.col("model_hash").isNotNull() & (actual != F.col("content_hash"))
    ).select(K, E, F.col("content_hash").alias("expected"), actual.alias("actual"))


def bind_evidence(artifacts: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts -> evidence rows, addresses bridge, collection activities.

    Ids come from the content hash, so binding the same artifact again gives the same
    rows. ``artifacts`` as for the hash chain plus contract_id, artifact_id, subtype,
    summary, source_file, evidentiary_status, collected_at; ``controls``: contract_id,
    artifact_id, control_id.
    """
    hashed = evidence_hash_chain(artifacts)
    ident = F.substring("content_hash", 1, 16)
    bound = hashed.withColumn(E, F.concat(F.lit("evidence/"), ident)).withColumn(
        "activity", F.concat(F.lit("exec/CollectEvidence-"), ident)
    )
    columns = ["subtype", "summary", "source_file", "evidentiary_status", "collected_at",
               "model_hash", "content_hash", "activity"]
    # Equal artifacts share an id; one row of them is the evidence, chosen by artifact id.
    evidence = (
        bound.groupBy(K, E)
        .agg(F.min_by(F.struct(*columns, "origin"), "artifact_id").alias("r"))
        .select(K, E, "r.*")
        .withColumn("document_ref", F.concat(F.lit("registry://evidence/"), "content_hash"))
    )
    addresses = (
        controls.join(bound.select(K, "artifact_id", E), [K, "artifact_id"]).select(K, E, C).distinct()
    )
    activity = evidence.select(
        K, "activity", F.lit("CollectEvidence").alias("step"), F.col("collected_at").alias("started_at"),
        F.concat(F.lit("collector/"), tx.slug(F.col("origin"))).alias("agent"), E,
    )
    return evidence.drop("origin", "activity"), addresses, activity


# -- module descriptions -----------------------------------------------------------


def module_description_hash(facts: DataFrame, node_facts: DataFrame) -> DataFrame:
    """Hash of each module's description, owned nodes inlined.

    ``facts``: module_id, s, p, o as written terms ('_:x' for an owned node);
    ``node_facts``: node, p, o. A fact on an owned node reads 's p/p2 value .'; two
    nodes giving the same line give it twice.
    """
    owned = F.col("o").startswith("_:")
    direct = facts.filter(~owned).select(M, F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line"))
    inner = node_facts.filter(~owned).select(
        F.col("node").alias("o"), F.col("p").alias("_p"), F.col("o").alias("_o")
    )
    inlined = facts.filter(owned).join(inner, "o").select(
        M, F.concat_ws(" ", "s", F.concat("p", F.lit("/"), "_p"), "_o", F.lit(".")).alias("line")
    )
    lines = direct.unionByName(inlined)
    return group_digest(lines, [M], F.col("line"), "module_hash", repeats=True)


# -- documents ---------------------------------------------------------------------


def document_evidence(reference: DataFrame, documents: DataFrame) -> DataFrame:
    """Each reference with the stored document its URI resolves to.

    ``documents``: path, priority (0 before 1), content BINARY, git_commit, git_author.
    A reference nothing resolves stays, as a dead link.
    """
    relative = F.regexp_replace(F.regexp_replace("uri", "^file:(//)?", ""), "^/+", "")
    digest = F.struct(
        F.sha2("content", 256).alias("sha256"), "git_commit", "git_author", F.col("priority").alias("base")
    )
    found = (
        documents.select("path", "priority", digest.alias("d"))
        .groupBy("path").agg(F.min_by("d", "priority").alias("d")).select("path", "d.*")
    )
    path = F.when(relative != "", relative)
    return (
        reference.select("reference_id", "uri", "custodian", path.alias("path"))
        .join(found, "path", "left")
        .select(
            F.concat(F.lit("DE-"), F.col("reference_id").cast("string")).alias(E),
            "reference_id", "uri", F.when(F.col("sha256").isNotNull(), F.col("path")).alias("resolved_path"),
            F.col("sha256").isNotNull().alias("exists"), "sha256", "git_commit", "git_author", "base",
            F.coalesce(F.nullif("custodian", F.lit("")), F.lit(vocab.BOM_ROLE)).alias("uploaded_by"),
        )
    )

"""Planning gate, order compilation and verification, residency gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.functions import vocab
from trailspark.functions.groups import dealt, group_digest, group_digests

K, C, M = "contract_id", "control_id", "module_id"

#: Fan-out of a row up to which a contract's modules and controls are paired with each other.
PAIRED = 16

#: Members of the lists of claiming modules that a contract holds at most.
LISTED = 8192


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# -- planning gate -----------------------------------------------------------------


def gate_forward(required: DataFrame, claim: DataFrame, control: DataFrame) -> DataFrame:
    """Required controls no module claims, with their weight."""
    return (
        required.select(K, C).join(claim.select(C).distinct(), C, "left_anti")
        .join(control.select(C, "weight"), C, "left").select(K, C, "weight")
    )


def gate_backward(required: DataFrame, claim: DataFrame, included: DataFrame) -> DataFrame:
    """Included modules that claim no required control of their contract."""
    traced = included_controls(required, claim, included).select(K, M).distinct()
    return included.select(K, M).distinct().join(traced, [K, M], "left_anti")


def included_controls(required: DataFrame, claim: DataFrame, included: DataFrame) -> DataFrame:
    """(contract, module, control): the required controls each included module claims.

    A contract with at most ``PAIRED`` modules or ``PAIRED`` controls has all its pairs
    looked up among the claims. In others each claim is followed from its rarer end: from
    the included module when the module claims no more controls than modules claim the
    control, else from the required control. No row fans out by more than ``PAIRED`` or
    the root of the number of claims, however popular one module or one control is.
    """
    edges = claim if "_narrow" in claim.columns else claim_edges(claim)
    modules, controls = included.select(K, M).distinct(), required.select(K, C).distinct()
    count = lambda rows, name: rows.groupBy(K).agg(F.count(F.lit(1)).alias(name))
    wide = count(modules, "_m").join(count(controls, "_c"), K).filter(F.least("_m", "_c") > PAIRED).select(K)
    pairs = modules.join(wide, K, "left_anti").join(controls, K).join(edges.select(M, C), [M, C], "left_semi")
    modules, controls = modules.join(wide, K, "left_semi"), controls.join(wide, K, "left_semi")
    by_module = edges.filter("_narrow").select(M, C)
    by_control = edges.filter("NOT _narrow").select(M, C)
    return dealt(
        pairs.select(K, M, C)
        .unionByName(modules.join(by_module, M).join(controls, [K, C], "left_semi").select(K, M, C))
        .unionByName(controls.join(by_control, C).join(modules, [K, M], "left_semi").select(K, M, C)), K
    )


def claim_edges(claim: DataFrame) -> DataFrame:
    """Distinct claims, with ``_narrow`` where the module claims no more controls than modules claim the control.

    The same for every contract; pass it for ``claim`` where several steps follow claims.
    """
    claims = claim.select(M, C).distinct()
    degree = lambda key, name: claims.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return claims.join(degree(M, "_m"), M).join(degree(C, "_c"), C).select(M, C, (F.col("_m") <= F.col("_c")).alias("_narrow"))


def gate_paper_claims(required: DataFrame, claim: DataFrame, module: DataFrame) -> DataFrame:
    """Modules that claim a required control but name no verification method."""
    bare = module.filter(F.col("method").isNull()).select(M)
    claims = claim.select(M, C).distinct().join(bare, M, "left_semi")
    return required.select(K, C).join(claims, C).select(K, M).distinct()


def gate_maps(required: DataFrame, claim: DataFrame, included: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Required control -> number and digest of its claiming modules; included module -> its required controls.

    The modules of a control are the same for every contract: ``claim`` lists them, and
    the digest ties a contract's row to that list. Backward there is a row per control,
    or one with a null control.
    """
    modules_of = claim.select(M, C).distinct()
    modules_of = modules_of.groupBy(C).agg(F.count(F.lit(1)).alias("modules")).join(_claimers(claim), C)
    forward = required.select(K, C).join(modules_of, C, "left").select(
        K, C, F.coalesce("modules", F.lit(0).cast("bigint")).alias("modules"), "modules_digest")
    traced = included_controls(required, claim, included)
    return forward, included.select(K, M).distinct().join(traced, [K, M], "left").select(K, M, C)


def _claimers(claim: DataFrame) -> DataFrame:
    """The digest of each control's claiming modules."""
    return group_digest(dealt(claim.select(M, C), C), [C], F.col(M).cast("string"), "modules_digest")


def gate_report(
    required: DataFrame, claim: DataFrame, module: DataFrame, control: DataFrame, included: DataFrame
) -> DataFrame:
    """Pass flags, checked counts and failure counts of the three checks per contract."""
    fields = ("required", "gaps", "included", "orphans", "claiming", "paper_claims")

    def counted(rows: DataFrame, **counts) -> DataFrame:
        values = [counts.get(f, F.lit(0)).cast("bigint").alias(f) for f in fields]
        return rows.select(K, *values)

    one = F.lit(1)
    marks = _union([
        counted(required, required=one),
        counted(gate_forward(required, claim, control), gaps=one),
        counted(included.select(K, M).distinct(), included=one),
        counted(gate_backward(required, claim, included), orphans=one),
        counted(claiming_modules(required, claim, module), claiming=F.col("_modules"), paper_claims=F.col("_bare")),
    ])
    totals = marks.groupBy(K).agg(*[F.sum(f).alias(f) for f in fields])
    return totals.select(
        K, *fields,
        (F.col("gaps") == 0).alias("forward_passed"),
        (F.col("orphans") == 0).alias("backward_passed"),
        (F.col("paper_claims") == 0).alias("methods_passed"),
        ((F.col("gaps") == 0) & (F.col("orphans") == 0) & (F.col("paper_claims") == 0)).alias("passed"),
    )


def claiming_modules(required: DataFrame, claim: DataFrame, module: DataFrame) -> DataFrame:
    """Per contract: how many modules claim a required control, as ``_modules``, and how many of them name no method, as ``_bare``.

    A control brings its modules as one list, and a contract counts the members of its lists.
    Contracts that would hold over ``LISTED`` members, or require a control that more modules
    claim, or have no key, get a row for each module instead. A module's further records count again.
    """
    claims = claim.select(M, C).distinct()
    records = module.groupBy(M).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("method").isNull(), 1)).alias("_b"))
    claims = claims.join(records, M, "left").select(C, M, *[F.coalesce(c, F.lit(1).cast("bigint")).alias(c) for c in ("_n", "_b")])
    sizes = claims.groupBy(C).agg(F.count(F.lit(1)).alias("_size"))
    pairs = required.select(K, C).distinct()
    heavy = pairs.join(sizes, C).groupBy(K).agg(F.sum("_size").alias("_size")).filter(F.col("_size") > LISTED).select(K)
    # A module with one record is its id; the others, and those that are bare, bring their counts.
    plain = (F.col("_n") == 1) & (F.col("_b") == 0) & F.col(M).isNotNull()
    lists = claims.join(sizes.filter(F.col("_size") <= LISTED), C, "left_semi").groupBy(C).agg(
        F.collect_list(F.when(plain, F.col(M))).alias("_plain"), F.collect_list(F.when(~plain, F.struct(M, "_n", "_b"))).alias("_odd"))
    joined = lambda name: F.array_distinct(F.flatten(F.collect_list(name)))
    total = lambda field: F.aggregate("_odd", F.lit(0).cast("bigint"), lambda a, e: a + e[field])
    few = dealt(pairs.filter(F.col(K).isNotNull()).join(heavy, K, "left_anti").join(lists, C).select(K, "_plain", "_odd"), K).groupBy(K).agg(
        joined("_plain").alias("_plain"), joined("_odd").alias("_odd")).select(
        K, (F.size("_plain") + total("_n")).alias("_modules"), total("_b").alias("_bare"))
    others = pairs.join(heavy, K, "left_semi").unionByName(pairs.filter(F.col(K).isNull()))
    many = others.join(claims, C).select(K, M, "_n", "_b").distinct().groupBy(K).agg(
        F.sum("_n").alias("_modules"), F.sum("_b").alias("_bare"))
    return few.unionByName(many)


# -- order compilation -------------------------------------------------------------


def control_set_hash(required: DataFrame) -> DataFrame:
    """Hash of a contract's required controls."""
    return group_digest(required, [K], F.col(C).cast("string"), "control_set_hash")


def coverage_proof_hash(
    required: DataFrame, claim: DataFrame, module: DataFrame, included: DataFrame
) -> DataFrame:
    """Hash of the forward map, the backward map and the methods of included modules.

    One line for each entry: a required control with the digest of its claiming modules,
    an included module, a control that it claims, its method.
    """
    return group_digest(proof_lines(required, claim, module, included), [K], F.col("line"), "coverage_proof_hash")


def proof_lines(required: DataFrame, claim: DataFrame, module: DataFrame, included: DataFrame) -> DataFrame:
    """The lines that ``coverage_proof_hash`` hashes."""
    line = lambda frame, kind, *cols: frame.select(
        K, F.concat_ws(" ", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]).alias("line"))
    pairs = included.select(K, M).distinct()
    return _union([
        line(dealt(required.select(K, C).join(_claimers(claim), C, "left").select(K, C, "modules_digest"), K), "forward", C, "modules_digest"),
        line(pairs, "included", M),
        line(included_controls(required, claim, included), "backward", M, C),
        line(dealt(pairs.join(module.filter(F.col("method").isNotNull()).select(M, "method").distinct(), M), K), "method", M, "method"),
    ])


def order_hash(facts: DataFrame, module_hash: DataFrame) -> DataFrame:
    """Order hash over scope, controls, module hashes and the part hashes.

    ``facts``: contract_id, scope_hash, cop_hash, control_set_hash, coverage_proof_hash.
    ``module_hash``: contract_id, module_id, module_hash.
    """
    modules = group_digest(module_hash, [K], _module_line(), "_modules")
    return facts.join(modules, K, "left").select(K, _order_hash().alias("order_hash"))


def _module_line() -> Column:
    return F.concat_ws(" ", F.col(M).cast("string"), "module_hash")


def _order_hash() -> Column:
    return tx.sha256(tx.json_object(
        ("contract", tx.json_text(F.col(K))),
        ("control_set_hash", tx.json_text(F.col("control_set_hash"))),
        ("cop_hash", tx.json_text(F.col("cop_hash"))),
        ("coverage_proof_hash", tx.json_text(F.col("coverage_proof_hash"))),
        ("impact_level", F.lit(f'"{vocab.IMPACT_LEVEL}"')),
        ("module_hashes", tx.json_text(F.col("_modules"))),
        ("scope", tx.json_text(F.col("scope_hash"))),
        ("standard", F.lit(f'"{vocab.STANDARD}"')),
        ("tier", F.lit(f'"{vocab.TARGET_TIER}"')),
    ))


def order_hashes(
    required: DataFrame, claim: DataFrame, module: DataFrame, included: DataFrame, profile: DataFrame, scope: DataFrame,
    module_hash: DataFrame,
) -> DataFrame:
    """All hashes of an order by one grouped digest: its parts' and, over them, the order's own.

    ``profile``: the lines of ``obligations.profile_lines``; ``scope``: contract_id, item,
    value. Contracts that lack a part have no order.
    """
    parts = {"control": required.select(K, F.col(C).cast("string").alias("line")),
             "profile": profile, "proof": proof_lines(required, claim, module, included),
             "scope": scope.select(K, F.concat_ws(" ", "item", "value").alias("line")),
             "module": module_hash.select(K, _module_line().alias("line"))}
    lines = _union([frame.select(K, F.lit(name).alias("part"), "line") for name, frame in parts.items()])
    outs = {"control": "control_set_hash", "profile": "cop_hash", "proof": "coverage_proof_hash", "scope": "scope_hash", "module": "_modules"}
    facts = group_digests(lines, [K], "part", F.col("line"), outs)
    whole = [name for name in outs.values() if name != "_modules"]
    return facts.dropna(subset=whole).select(K, *whole, _order_hash().alias("order_hash"))


def order_flaws(order_hdr: DataFrame, required: DataFrame, claim: DataFrame, module: DataFrame, included: DataFrame) -> DataFrame:
    """(contract, flaw) of attested contracts: whether each check fails, not how often."""
    attested = order_hdr.filter("attested").select(K)
    only = lambda frame: frame.join(attested, K, "left_semi")
    required, included = only(required.select(K, C)), only(included.select(K, M))
    flaw = lambda frame, name: frame.select(K, F.lit(name).alias("flaw"))
    # A module without a record has no method either.
    bare = claim.select(M, C).join(module.filter(F.col("method").isNotNull()).select(M), M, "left_anti").select(C).distinct()
    return _union([
        flaw(required.join(claim.select(C).distinct(), C, "left_anti"), 1),
        flaw(gate_backward(required, claim, included), 2),
        flaw(required.join(bare, C, "left_semi"), 3),
    ])


def order_decisions(order_hdr: DataFrame, flaws: DataFrame) -> DataFrame:
    """Per contract: compiled, or refused with the first reason that applies."""
    first = flaws.groupBy(K).agg(F.min("flaw").alias("_flaw"))
    reason = (
        F.when(~F.coalesce("attested", F.lit(False)), "profile-not-attested")
        .when(F.col("_flaw") == 1, "control-without-module")
        .when(F.col("_flaw") == 2, "orphan-module")
        .when(F.col("_flaw") == 3, "claim-without-method")
    )
    return order_hdr.join(first, K, "left").select(K, reason.alias("reason"))


def compile_orders(
    order_hdr: DataFrame, required: DataFrame, included: DataFrame, flaws: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders, their controls, their modules, and the refusals with a reason."""
    decided = order_decisions(order_hdr, flaws)
    emitted = decided.filter(F.col("reason").isNull()).select(K)
    headers = emitted.select(
        K, F.lit(vocab.TARGET_TIER).alias("tier"), F.lit(vocab.IMPACT_LEVEL).alias("impact_level"),
        F.lit(vocab.STANDARD).alias("standard"),
    )
    keep = lambda rows, *cols: rows.select(*cols).join(emitted, K, "left_semi")
    refusals = decided.filter(F.col("reason").isNotNull())
    return headers, keep(required, K, C), keep(included, K, M), refusals


# -- order verification ------------------------------------------------------------


def verify_orders(stated: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Refuse unattested orders and name the first hash that does not recompute.

    ``stated``: contract_id, attested, control_set_hash, order_hash.
    ``recomputed``: contract_id, control_set_hash, order_hash.
    """
    fresh = recomputed.select(
        K, F.col("control_set_hash").alias("_csh"), F.col("order_hash").alias("_oh")
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    reason = (
        F.when(~F.coalesce("attested", F.lit(False)), "not-attested")
        .when(~same("control_set_hash", "_csh"), "control-set-hash-mismatch")
        .when(~same("order_hash", "_oh"), "order-hash-mismatch")
    )
    return stated.join(fresh, K, "left").select(K, reason.isNull().alias("verified"), reason.alias("reason"))


def verify_modules(stated: DataFrame, actual: DataFrame) -> DataFrame:
    """Stated vs recomputed description hash of every included module."""
    fresh = actual.select(M, F.col("module_hash").alias("actual_hash"))
    return stated.join(fresh, M, "left").select(
        K, M, "stated_hash", "actual_hash",
        F.col("stated_hash").eqNullSafe(F.col("actual_hash")).alias("verified"),
    )


# -- residency ---------------------------------------------------------------------


def residency_findings(planned: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Findings of the residency gate.

    A non-US resource gives two: the region itself and the failed criterion. A plan
    without any region gives one of its own; ``contracts`` names contracts whose plan
    has no resource at all.
    """
    bad = planned.filter(F.col("region").isNotNull() & ~tx.is_us_region(F.col("region")))
    kinds = F.array(F.lit("region-not-us"), F.lit(f"criterion-failed:{vocab.RESIDENCY_CRITERION}"))
    per_resource = bad.select(K, "resource_id", F.explode(kinds).alias("finding"), "region")
    rows = planned.select(K, F.col("region").isNotNull().cast("int").alias("_seen"))
    if contracts is not None:
        rows = rows.unionByName(contracts.select(K, F.lit(0).alias("_seen")))
    silent = rows.groupBy(K).agg(F.max("_seen").alias("_seen")).filter("_seen = 0").select(
        K, F.lit("<none>").alias("resource_id"), F.lit("no-region-signal").alias("finding"),
        F.lit(None).cast("string").alias("region"),
    )
    return per_resource.unionByName(silent)


def residency_gate(planned: DataFrame) -> DataFrame:
    """Gate verdict per contract from one pass over its planned resources."""
    bad = F.col("region").isNotNull() & ~tx.is_us_region(F.col("region"))
    counts = planned.groupBy(K).agg(
        F.count(F.lit(1)).alias("resources"),
        F.count("region").alias("region_signals"),
        F.count(F.when(bad, 1)).alias("non_us"),
    )
    findings = F.col("non_us") * 2 + F.when(F.col("region_signals") == 0, 1).otherwise(0)
    return counts.withColumn("findings", findings).withColumn("passed", F.col("findings") == 0)


def halted_contracts(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of the contracts the gate let through."""
    return rows.join(gate.filter(~F.col("passed")).select(K), K, "left_anti")


def plan_conformance(planned: DataFrame) -> DataFrame:
    """Plan rows whose resource id is missing or not unique in its plan."""
    blank = F.coalesce("resource_id", F.lit("")) == ""
    issues = planned.groupBy(K, "resource_id").agg(F.count(F.lit(1)).alias("rows")).select(
        K, "resource_id", "rows",
        F.when(blank, "resource-id-missing").when(F.col("rows") > 1, "resource-id-repeated").alias("issue"),
    )
    return issues.filter(F.col("issue").isNotNull())

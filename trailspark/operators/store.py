"""Graph hashes, content-addressed blobs, versioned snapshots and term checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.functions import vocab
from trailspark.functions.groups import group_digest, leaf_digests, leaf_of, root_digest

K = "contract_id"


# -- graph hashes and counts -------------------------------------------------------


def quad_line() -> Column:
    """N-Triples line of a quad's triple."""
    return F.concat_ws(" ", "s", "p", "o", F.lit("."))


def graph_hash(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of each graph's lines. ``lines``: the keys and one ``line`` per triple."""
    return group_digest(lines, keys, F.col("line"), "graph_hash")


def tokenise(term: Column) -> Column:
    """Blank nodes as one constant token: their labels change with every parse."""
    return F.when(term.startswith("_:"), "_:b").otherwise(term)


def dataset_fingerprint(quads: DataFrame) -> DataFrame:
    """Hash of a contract's distinct quads, blank nodes tokenised."""
    line = F.concat_ws("\t", tokenise(F.col("s")), "p", tokenise(F.col("o")), "graph")
    return group_digest(quads, [K], line, "fingerprint")


def triples_by_graph(quads: DataFrame) -> DataFrame:
    return quads.groupBy("graph").agg(F.count(F.lit(1)).alias("triples"))


def quad_counts(quads: DataFrame, layers: DataFrame) -> DataFrame:
    """Triples per layer, empty layers as zero, unknown graphs kept."""
    counts = triples_by_graph(quads)
    return layers.join(counts, "graph", "full").select(
        "graph", F.coalesce("triples", F.lit(0).cast("bigint")).alias("triples"), "position"
    ).orderBy(F.col("position").asc_nulls_last(), "graph").drop("position")


# -- blobs -------------------------------------------------------------------------


def put_blobs(incoming: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blobs to append, and rejects.

    ``incoming``: content BINARY, kind, and optionally the ``hash`` it claims. Known
    bytes are a no-op. A blob is rejected when its bytes do not have the hash it
    claims, or the store holds other bytes under its hash.
    """
    actual = F.sha2("content", 256)
    claimed = F.coalesce(F.col("hash"), actual) if "hash" in incoming.columns else actual
    rows = incoming.select(claimed.alias("hash"), actual.alias("actual"), "content", "kind")
    held = store.groupBy("hash").agg(F.min(F.sha2("content", 256)).alias("stored"))
    # Equal hashes mean equal bytes; of the copies' kinds the first by name stays. Copies
    # combine before their bytes are shuffled.
    unique = rows.filter(F.col("actual") == F.col("hash")).groupBy("hash").agg(
        F.min("kind").alias("kind"), F.any_value("content").alias("content"))
    fresh = unique.join(held.select("hash"), "hash", "left_anti").select("hash", "kind", "content")
    names = rows.select("hash", "actual", "kind").distinct().join(held, "hash", "left")
    wrong = (F.col("actual") != F.col("hash")) | F.coalesce(F.col("stored") != F.col("actual"), F.lit(False))
    return fresh, names.filter(wrong).select("hash", "actual", "kind")


def verify_blobs(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Whether each wanted hash is stored and its bytes still have that hash."""
    held = blobs.groupBy("hash").agg(F.bool_and(F.sha2("content", 256) == F.col("hash")).alias("_ok"))
    return wanted.select("hash").distinct().join(held, "hash", "left").select(
        "hash", F.coalesce("_ok", F.lit(False)).alias("verified")
    )


def read_through(local: DataFrame, remote: DataFrame, key: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Everything readable, and the remote rows to copy into the local tier."""
    missing = remote.dropDuplicates([key]).join(local.select(key).distinct(), key, "left_anti")
    return local.unionByName(missing.select(*local.columns)), missing


def latest_bom(index: DataFrame) -> DataFrame:
    """Newest bill of materials per contract. ``index``: contract_id, seq, bom_hash."""
    return index.groupBy(K).agg(F.max_by("bom_hash", "seq").alias("bom_hash"))


def bom_artifacts(latest: DataFrame, artifact_index: DataFrame) -> DataFrame:
    """Contract -> artifacts of its newest bill of materials."""
    return latest.join(artifact_index.select("bom_hash", "hash"), "bom_hash").select(K, "bom_hash", "hash")


def bom_signature(latest: DataFrame, signatures: DataFrame) -> DataFrame:
    """Contract -> signature blob of its newest bill of materials, null when unsigned."""
    return latest.join(signatures.select("bom_hash", "sig_hash"), "bom_hash", "left")


# -- versions ----------------------------------------------------------------------


def commit_manifest(graph_hashes: DataFrame, project: str) -> DataFrame:
    """Version id per (ref, seq): hash of the manifest of its graph hashes.

    ``graph_hashes``: ref, seq, graph, graph_hash. Equal content gives an equal id.
    """
    graphs = group_digest(graph_hashes, ["ref", "seq"], F.concat_ws(" ", "graph", "graph_hash"), "_graphs")
    manifest = tx.json_object(
        ("graphs", tx.json_text(F.col("_graphs"))),
        ("project", F.lit(f'"{project}"')),
        ("ref", tx.json_text(F.col("ref"))),
    )
    return graphs.select("ref", "seq", tx.sha256(manifest).alias("version"))


def commit_snapshot(
    snapshot: DataFrame, project: str, history: DataFrame | None = None,
    objects: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New commit rows and new object lines of a snapshot.

    ``snapshot``: ref, seq, graph, line. With ``history`` the new sequence numbers
    follow the ref's last one; graphs whose hash ``objects`` already holds add no lines.
    """
    keys = ["ref", "seq", "graph"]
    lines = snapshot.select(*keys, "line").distinct()
    hashes = graph_hash(lines, keys)
    versions = commit_manifest(hashes, project)
    if history is not None:
        last = history.groupBy("ref").agg((F.max("seq") + 1).alias("_next"))
        versions = versions.join(last, "ref", "left").withColumn(
            "_seq", F.col("seq") + F.coalesce("_next", F.lit(0))
        ).drop("_next")
    else:
        versions = versions.withColumn("_seq", F.col("seq"))
    commits = hashes.join(versions, ["ref", "seq"]).select(
        "ref", F.col("_seq").alias("seq"), "version", "graph", "graph_hash"
    )
    # A graph unchanged between versions is stored once.
    first = hashes.groupBy("graph_hash").agg(F.min(F.struct("ref", "seq", "graph")).alias("_at"))
    if objects is not None:
        first = first.join(objects.select("graph_hash").distinct(), "graph_hash", "left_anti")
    stored = first.select("graph_hash", "_at.*")
    return commits, lines.join(stored, keys).select("graph_hash", "line")


def resolve_version(
    commits: DataFrame, objects: DataFrame, version: str | None = None
) -> DataFrame:
    """Lines of every graph at a version, or at each ref's latest one.

    An unknown version gives no rows; ``unknown_version`` tells which refs lack it.
    """
    if version is None:
        last = commits.groupBy("ref").agg(F.max("seq").alias("seq"))
        chosen = commits.join(last, ["ref", "seq"], "left_semi")
    else:
        chosen = commits.filter(F.col("version") == version)
    wanted = chosen.select("ref", "version", "graph", "graph_hash").distinct()
    return wanted.join(objects, "graph_hash").select("ref", "version", "graph", "line")


def unknown_version(commits: DataFrame, version: str) -> DataFrame:
    """Refs that never committed the version."""
    known = commits.filter(F.col("version") == version).select("ref")
    return commits.select("ref").distinct().join(known.distinct(), "ref", "left_anti")


def history(commits: DataFrame) -> DataFrame:
    """Versions of each ref, oldest first."""
    return commits.select("ref", "seq", "version").distinct().orderBy("ref", "seq")


def graph_hash_at(commits: DataFrame, graph: str, version: str | None = None) -> DataFrame:
    """Hash of one graph at a version, or at each ref's latest one that has commits."""
    if version is None:
        last = commits.groupBy("ref").agg(F.max("seq").alias("seq"))
        chosen = commits.join(last, ["ref", "seq"], "left_semi")
    else:
        chosen = commits.filter(F.col("version") == version)
    return chosen.filter(F.col("graph") == graph).select("ref", "version", "graph_hash").distinct()


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Lines only one of two snapshots has. Blank nodes must be tokenised or inlined."""
    columns = [*keys, "line"]
    old, new = before.select(*columns).distinct(), after.select(*columns).distinct()
    return (
        new.join(old, columns, "left_anti").withColumn("change", F.lit("added"))
        .unionByName(old.join(new, columns, "left_anti").withColumn("change", F.lit("removed")))
    )


# -- versions kept as leaves ---------------------------------------------------------


def commit_leaves(snapshot: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The leaves of every graph of a snapshot, and the lines of leaves that the store lacks.

    ``snapshot``: ref, seq, graph, line. Leaves: ref, seq, graph, leaf, digest. Stored
    lines: digest, line; a leaf that any graph of any version holds is stored once.
    """
    keys = ["ref", "seq", "graph"]
    lines = snapshot.select(*keys, "line").distinct()
    leaves = leaf_digests(lines, keys, F.col("line"))
    return leaves, _leaf_lines(lines, leaves, keys, stored)


def _leaf_lines(lines: DataFrame, leaves: DataFrame, keys: list[str], stored: DataFrame | None) -> DataFrame:
    """Rows (digest, line) of one graph's copy of each leaf that is not stored yet."""
    one = leaves.groupBy("digest").agg(F.min(F.struct(*keys, "leaf")).alias("_at"))
    if stored is not None:
        one = one.join(stored.select("digest").distinct(), "digest", "left_anti")
    return lines.withColumn("leaf", leaf_of(F.col("line"))).join(one.select("digest", "_at.*"), [*keys, "leaf"]).select("digest", "line")


def commit_change(leaves: DataFrame, stored: DataFrame, change: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves of the next version, and the lines to store, from what changes.

    ``leaves``: ref, graph, leaf, digest of the version before; ``change``: ref, graph,
    line, change ('added' or 'removed'; a line that is both is there afterwards). Only
    leaves that a changed line is dealt to are read from the store and hashed anew; a
    leaf left without lines is gone, and with its last leaf a graph.
    """
    keys = ["ref", "graph"]
    change = change.select(*keys, "line", "change", leaf_of(F.col("line")).alias("leaf"))
    touched = change.select(*keys, "leaf").distinct()
    old = leaves.select(*keys, "leaf", "digest").join(touched, [*keys, "leaf"], "left_semi")
    held = old.join(stored, "digest").select(*keys, "line")
    only = lambda kind: change.filter(F.col("change") == kind).select(*keys, "line")
    lines = held.join(only("removed"), [*keys, "line"], "left_anti").unionByName(only("added")).distinct()
    fresh = leaf_digests(lines, keys, F.col("line"))
    kept = leaves.select(*keys, "leaf", "digest").join(touched, [*keys, "leaf"], "left_anti")
    return kept.unionByName(fresh), _leaf_lines(lines, fresh, keys, stored)


def leaf_graph_hash(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """The hash of each graph from its leaves: the same as ``graph_hash`` of its lines."""
    return root_digest(leaves, keys, "graph_hash")


def leaf_lines(leaves: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The lines that leaves stand for."""
    return leaves.select(*keys, "digest").join(stored, "digest").select(*keys, "line")


def leaf_diff(before: DataFrame, after: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Lines only one of two versions has, from their leaves.

    Equal leaves are skipped by their digests: only the lines of unequal ones are read.
    """
    at = [*keys, "leaf"]
    sides = before.select(*at, F.col("digest").alias("_old")).join(after.select(*at, F.col("digest").alias("_new")), at, "full")
    unequal = sides.filter(~F.col("_old").eqNullSafe(F.col("_new")))
    digests = F.array_compact(F.array(
        F.when(F.col("_old").isNotNull(), F.struct(F.col("_old").alias("digest"), F.lit(-1).alias("_n"))),
        F.when(F.col("_new").isNotNull(), F.struct(F.col("_new").alias("digest"), F.lit(1).alias("_n")))))
    lines = unequal.select(*keys, F.explode(digests).alias("_d")).select(*keys, "_d.*").join(stored, "digest")
    # A line lies in one leaf of a graph: once on each side, or on one alone.
    return lines.groupBy(*keys, "line").agg(F.sum("_n").alias("_n")).filter("_n <> 0").select(
        *keys, "line", F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"))


# -- vocabulary checks -------------------------------------------------------------


def undefined_terms(quads: DataFrame, imported: DataFrame, namespace: str) -> DataFrame:
    """Terms of a namespace the graph uses and the imported vocabulary does not define.

    Terms are written ``<iri>``; a term is defined where it is a subject.
    """
    def inside(frame: DataFrame) -> DataFrame:
        iri = F.regexp_replace("term", "^<|>$", "")
        name = F.substring(iri, len(namespace) + 1, F.lit(2_147_483_647))
        return frame.filter(F.col("term").startswith("<" + namespace)).select(name.alias("term")).filter("term <> ''")

    used = inside(quads.select(F.explode(F.array("s", "p", "o")).alias("term")))
    uses = used.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    defined = inside(imported.select(F.col("s").alias("term"))).distinct()
    return uses.join(defined, "term", "left_anti")


def size_budget(quads: DataFrame, budget: int) -> DataFrame:
    """Distinct triples against a budget."""
    total = quads.select("s", "p", "o").distinct().agg(F.count(F.lit(1)).alias("triples"))
    return total.select(
        "triples", F.lit(budget).cast("bigint").alias("budget"),
        (F.lit(budget) - F.col("triples")).alias("headroom"), (F.col("triples") <= budget).alias("within"),
    )


_AXIOMS = {
    "<http://www.w3.org/2000/01/rdf-schema#subClassOf>": "subclass",
    "<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>": "subproperty",
}


def axiom_counts(quads: DataFrame) -> DataFrame:
    axiom = vocab.lookup(F.col("p"), _AXIOMS)
    return quads.filter(F.col("p").isin(*_AXIOMS)).select("s", "p", "o").distinct().groupBy(
        axiom.alias("axiom")
    ).agg(F.count(F.lit(1)).alias("axioms"))

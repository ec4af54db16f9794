"""File sources and sinks: graph snapshots, exports, plans, sign-off logs, blobs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark import schemas
from trailspark.functions import text as tx
from trailspark.sources.sinks import write_raw_files

_FILE_NAME = r"([^/]+)$"

# Subject, predicate, object of an N-Triples line.
_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*$'


def _file() -> Column:
    return F.col("_metadata.file_path")


# -- graph snapshots ---------------------------------------------------------------


def read_quads(spark: SparkSession, path: str, graph: Column | None = None) -> DataFrame:
    """N-Triples files as quads; the graph defaults to the file name without suffix.

    Files split at any line, so many tasks read one large file.
    """
    name = F.regexp_replace(F.regexp_extract(_file(), _FILE_NAME, 1), r"\.nt(\.gz)?$", "")
    return parse_quad_lines(spark.read.text(path).select(
        (graph if graph is not None else name).alias("graph"), F.col("value").alias("line")
    ))


def parse_quad_lines(lines: DataFrame) -> DataFrame:
    """``lines``: line and any other columns, which are kept. Blank lines and comments go.

    A line that is no triple comes back with null terms, next to its text.
    """
    kept = [c for c in lines.columns if c != "line"]
    lines = lines.filter((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    term = lambda i: F.nullif(F.regexp_extract("line", _TRIPLE, i), F.lit(""))
    o = F.col("o")
    return lines.select(*kept, term(1).alias("s"), term(2).alias("p"), term(3).alias("o"), "line").withColumns({
        "o_kind": F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "blank").when(o.isNotNull(), "literal"),
        "o_datatype": F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit("")),
    })


def snapshot_rows(quads: DataFrame, *, union: bool = False) -> DataFrame:
    """The triples of all graphs by name, or of their flat union."""
    return quads.select(*([] if union else ["graph"]), "s", "p", "o").distinct()


def write_snapshot(quads: DataFrame, path: str, *, union: bool = False, mode: str = "errorifexists") -> None:
    """All graphs partitioned by name, or the flat union without graph names."""
    writer = snapshot_rows(quads, union=union).write.mode(mode)
    (writer if union else writer.partitionBy("graph")).parquet(path)


def literal_value(term: Column) -> Column:
    """Text of a literal term, its simple escapes undone; IRIs give their local name."""
    inner = F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        inner, r'\\n', "\n"), r'\\t', "\t"), r'\\(["\\])', "$1")
    iri = F.regexp_extract(term, r"^<([^>]*)>$", 1)
    return F.when(term.startswith('"'), plain).when(term.startswith("<"), tx.local_name(iri)).otherwise(term)


def quads_to_table(
    quads: DataFrame, type_iri: str, single: dict[str, str], multi: dict[str, str] | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Pivot the subjects of one type into a property table and bridge tables.

    ``single`` maps column -> predicate IRI (one value per subject; the greatest when a
    subject has several), ``multi`` maps bridge column -> predicate IRI.
    """
    rdf_type = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    subjects = quads.filter((F.col("p") == rdf_type) & (F.col("o") == f"<{type_iri}>")).select("s").distinct()
    facts = quads.join(subjects, "s", "left_semi")
    value = literal_value(F.col("o"))
    wanted = facts.filter(F.col("p").isin(*[f"<{p}>" for p in single.values()], rdf_type))
    table = wanted.groupBy("s").agg(*[
        F.max(F.when(F.col("p") == f"<{p}>", value)).alias(name) for name, p in single.items()
    ])
    bridges = {
        name: facts.filter(F.col("p") == f"<{p}>").select("s", value.alias(name)).distinct()
        for name, p in (multi or {}).items()
    }
    return table, bridges


# -- exports and plans -------------------------------------------------------------


def _variant_text(column: str) -> Column:
    """JSON text of a variant, object keys in sorted order."""
    return F.to_json(F.col(column))


def _canonical_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_file, text) of documents to (source_file, envelope, raw, summary), each canonical JSON.

    Numbers keep their kind and form (24.0 stays 24.0), which no built-in function does. A
    file that holds a list gives a row per member; text that is no JSON gives nulls.
    """
    for batch in batches:
        rows = []
        for name, content in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                found = json.loads(content)
                for e in found if isinstance(found, list) else [found]:
                    member = lambda key, e=e: json.dumps(e[key], sort_keys=True) if isinstance(e, dict) and key in e else "{}"
                    rows.append((name, json.dumps(e, sort_keys=True), member("raw"), member("summary")))
            except (ValueError, RecursionError):
                rows.append((name, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["source_file", "envelope", "raw", "summary"])


def read_config_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evidence envelopes, one JSON document per file, and their addressed controls.

    ``raw_canonical`` and ``summary_canonical`` are the texts that the hashes of
    ``operators.evidence`` take; ``raw`` and ``summary`` are compact. Text that is no JSON
    has null canonical texts.
    """
    documents = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(_file(), _FILE_NAME, 1).alias("source_file"), F.col("value").alias("content"))
    texts = documents.mapInArrow(_canonical_members, "source_file string, envelope string, raw string, summary string")
    return split_envelopes(texts.select(
        "source_file", F.from_json("envelope", schemas.EVIDENCE_ENVELOPE).alias("e"),
        F.col("raw").alias("raw_canonical"), F.col("summary").alias("summary_canonical"),
    ).select("source_file", "e.*", "raw_canonical", "summary_canonical"))


def split_envelopes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelope rows with defaults filled, and the (artifact, control) bridge.

    Canonical texts are kept where ``raw`` has them; a variant no longer has its numbers'.
    """
    kept = [c for c in ("raw_canonical", "summary_canonical") if c in raw.columns]
    envelopes = raw.select(
        F.col("source_file").alias("artifact_id"), "source_file",
        F.coalesce("source_system", F.lit("unknown")).alias("source_system"),
        F.coalesce("export_command", F.lit("")).alias("export_command"),
        F.coalesce("collected_at", F.lit("")).alias("collected_at"),
        F.coalesce("collector_version", F.lit("mock-0.1.0")).alias("collector_version"),
        F.coalesce("evidentiary_status", F.lit("mock")).alias("evidentiary_status"),
        F.coalesce(F.get("controls", F.lit(0)), F.lit("")).alias("first_control"),
        F.coalesce(_variant_text("raw"), F.lit("{}")).alias("raw"),
        F.coalesce(_variant_text("summary"), F.lit("{}")).alias("summary"), *kept,
    )
    controls = raw.select(F.col("source_file").alias("artifact_id"), F.explode("controls").alias("control_id"))
    return envelopes, controls


def plan_resources(plans: DataFrame) -> DataFrame:
    """Planned resources of plan documents, with their labels read.

    Labels come from ``values.input``, else ``values.triggers``; the region from the
    label, else ``values.region``, else ``values.location``; the id from the label, else
    the address.
    """
    got = lambda path, kind="string": F.expr(f"try_variant_get(r.values, '{path}', '{kind}')")
    tagged = F.schema_of_variant(F.expr("try_variant_get(r.values, '$.input', 'variant')")).startswith("OBJECT<")
    filled = tagged & (F.schema_of_variant(F.expr("try_variant_get(r.values, '$.input', 'variant')")) != "OBJECT<>")
    label = lambda name: F.when(F.coalesce(filled, F.lit(False)), got(f"$.input.{name}")).otherwise(
        got(f"$.triggers.{name}"))
    some = lambda c: F.nullif(c, F.lit(""))
    words = F.split(F.regexp_replace(F.coalesce(label("cmmc_control"), F.lit("")), ",", " "), r"\s+")
    return plans.select(
        "contract_id", F.explode("planned_values.root_module.resources").alias("r")
    ).select(
        "contract_id",
        F.coalesce(some(label("cmmc_module")), F.col("r.address"), F.lit("")).alias("resource_id"),
        F.coalesce("r.address", F.lit("")).alias("address"), F.coalesce("r.type", F.lit("")).alias("type"),
        F.filter(words, lambda w: w != "").alias("controls"),
        F.coalesce(some(label("region")), some(got("$.region")), some(got("$.location"))).alias("region"),
        got("$.input.region").alias("tag_region"), got("$.location").alias("location"),
        got("$.spec[0].rules[0].values[0].allowed_values", "array<string>").alias("allowed_values"),
        got("$.input.module").alias("tag_module"),
        got("$.input.controls", "array<string>").alias("tag_controls"),
        F.coalesce(got("$.input.inherited", "boolean"), F.lit(False)).alias("inherited"),
        F.to_json("r.values").alias("values"),
    )


def read_plan_json(spark: SparkSession, path: str, contract: Column | None = None) -> DataFrame:
    """Plan documents, one per file; the contract defaults to the file name without suffix."""
    name = F.regexp_replace(F.regexp_extract(_file(), _FILE_NAME, 1), r"\.json$", "")
    documents = spark.read.schema(schemas.PLAN_DOCUMENT).option("multiLine", True).json(path)
    return plan_resources(documents.withColumn(
        "contract_id", contract if contract is not None else F.coalesce("contract_id", name)
    ))


# -- sign-off log ------------------------------------------------------------------


def parse_attestation_lines(lines: DataFrame) -> DataFrame:
    """``lines``: _file, _line, value. Blank lines and '#' comments are no records.

    Text that is no JSON object gives a record of nulls, which validation rejects.
    """
    body = F.trim("value")
    record = F.from_json("value", schemas.ATTESTATION_RECORD)
    return lines.filter((body != "") & ~body.startswith("#")).select(
        "_file", "_line", record.alias("r")
    ).select("_file", "_line", "r.*")


def read_attestation_log(spark: SparkSession, path: str) -> DataFrame:
    """JSONL sign-offs in file and line order.

    The line position is the byte-order position Spark gives rows of one file, which
    grows with the line number: read order within a file split, splits in file order.
    """
    start = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(
        _file().alias("_file"), start.alias("_block"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    # Split position first, then the row's place inside the split.
    place = F.struct("_block", "_id")
    return parse_attestation_lines(lines.select("_file", place.alias("_line"), "value"))


def attestation_lines(records: DataFrame) -> DataFrame:
    """The log line of each record: JSON with all fields, null ones too."""
    names = [f.name for f in schemas.ATTESTATION_RECORD.fields]
    return records.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def write_attestation_log(records: DataFrame, path: str) -> None:
    """Append records; what is already logged is never rewritten."""
    attestation_lines(records).write.mode("append").text(path)


# -- documents and blobs -----------------------------------------------------------


def read_documents(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Stored documents with path relative to their folder; earlier folders win."""
    out = None
    for priority, folder in enumerate(folders):
        root = folder.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
            F.lit(priority).cast("bigint").alias("priority"),
            F.regexp_replace("path", "^.*?" + _escaped(root) + "/", "").alias("path"), "content",
            F.lit(None).cast("string").alias("git_commit"), F.lit(None).cast("string").alias("git_author"),
        )
        out = files if out is None else out.unionByName(files)
    return out


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Append blobs, fanned out by the first two digits of their hash."""
    blobs.withColumn("prefix", F.substring("hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def export_blobs(blobs: DataFrame, path: str) -> None:
    """Every blob as a file of its own, ``<first two digits>/<hash>``, written once and all or none."""
    name = F.concat_ws("/", F.substring("hash", 1, 2), "hash")
    write_raw_files(blobs.select(name.alias("name"), "content"), path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("hash", "kind", "content")

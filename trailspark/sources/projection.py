"""Property tables over the star-schema test tables.

The operators read property tables (contracts, controls, modules, evidence, ...).
``Projection`` derives them from the star schema so that every operator can run on
data of any scale: orders are contracts, parts are controls, suppliers are modules,
line items are the facts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import text as tx
from trailspark.functions import vocab
from trailspark.functions.groups import deal_for, dealt, partitions
from trailspark.session import durable_buckets

_NOW = "2025-01-15 00:00:00"
# What the property tables read of a line item.
_LINE = ("contract_id", "control_id", "module_id", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
         "l_linestatus", "l_shipdate")


def _rem(column: str, n: int) -> Column:
    return F.col(column) % n


def _pick(index: Column, values: tuple) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _greatest(flag: str) -> Column:
    """Greatest of one-letter flags, compared as numbers so that the aggregate hashes."""
    return F.char(F.max(F.ascii(flag)))


class Projection:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.gathered = False
        deal_for(spark, 0)

    def gather(self) -> None:
        """Deal the line items out by contract, before any table is derived from them.

        What is then grouped, joined or united by contract, with or without further keys,
        needs no other exchange. The lines of one contract are read by one task, as a stream.
        The number of partitions grows with the lines, so that the many sorts of a stage don't spill.
        """
        self.gathered = True
        deal_for(self.spark, self._lines.count())
        self.__dict__["_lines"] = self.by_contract(self._lines.select(*_LINE))

    def store_lines(self) -> None:
        """Write the gathered lines once, in buckets of the contract.

        Otherwise each derived table prunes other columns and deals the lines again.
        """
        self.__dict__["_lines"] = self.stored(self._lines)

    def stored(self, frame: DataFrame) -> DataFrame:
        """``frame`` written in buckets of the contract, dealt out as the lines are."""
        kept = durable_buckets(frame, "contract_id", buckets=partitions(self.spark))
        # Marked, the key has no table's name before it: unions compare the partitioning with that name and would not find it.
        found = kept.withMetadata("contract_id", {"dealt": True})
        found._cut = kept._cut
        return found

    def by_contract(self, frame: DataFrame) -> DataFrame:
        """``frame`` dealt out as the lines are, where they are gathered."""
        return dealt(frame, "contract_id") if self.gathered else frame

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def now(self) -> Column:
        return F.to_timestamp(F.lit(_NOW))

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem").withColumnsRenamed(
            {"l_orderkey": "contract_id", "l_partkey": "control_id", "l_suppkey": "module_id"}
        )

    # -- dimensions -----------------------------------------------------------------

    @cached_property
    def control(self) -> DataFrame:
        size = _rem("p_size", 5)
        return self.table("part").select(
            F.col("p_partkey").alias("control_id"),
            F.col("p_name").alias("text"),
            F.col("p_type").alias("family"),
            F.when(size == 0, 5).when(size == 1, 3).otherwise(1).cast("bigint").alias("weight"),
            ((size > 1) & (_rem("p_partkey", 10) != 0)).alias("poam_eligible"),
            ((size == 0) & (_rem("p_partkey", 7) == 0)).alias("variable_weight"),
            F.when((size == 0) & (_rem("p_partkey", 7) == 0), F.lit(3).cast("bigint"))
            .alias("weight_if_partial"),
        )

    @cached_property
    def module(self) -> DataFrame:
        kind = _rem("s_suppkey", 10)
        return self.table("supplier").select(
            F.col("s_suppkey").alias("module_id"),
            F.col("s_name").alias("label"),
            F.when(kind == 0, F.lit(None).cast("string"))
            .when(kind == 1, "inherited:csp")
            .when(kind <= 4, vocab.ATTESTED_METHOD)
            .otherwise("oracle-config-check").alias("method"),
            (kind >= 2).alias("method_is_iri"),
            F.when(kind.isin(2, 3), F.col("s_suppkey")).alias("reference_id"),
            _pick(_rem("s_suppkey", 4), vocab.SIGNER_ROLES).alias("role"),
            F.col("s_nationkey").cast("bigint").alias("source_id"),
        )

    @cached_property
    def module_claim(self) -> DataFrame:
        return (
            self._lines.filter(_rem("control_id", 20) != 7)
            .select("module_id", "control_id").distinct()
        )

    @cached_property
    def order_pairs(self) -> DataFrame:
        return self._lines.select("module_id", "control_id").distinct()

    @cached_property
    def source(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("source_id"), F.col("n_name").alias("label")
        )

    @cached_property
    def reference(self) -> DataFrame:
        d = "doc_id"
        verified = F.to_timestamp(
            F.date_add(F.lit("2024-01-01").cast("date"), _rem(d, 400).cast("int"))
        )
        return self.table("documents").select(
            F.col(d).alias("reference_id"),
            F.when(_rem(d, 17) == 0, "")
            .otherwise(F.concat(F.lit("file://documents/"), F.col(d), F.lit(".md"))).alias("uri"),
            F.col("source").alias("source_system"),
            F.when(F.col("lang") == "en", 365).when(F.col("lang") == "de", 180)
            .when(F.col("lang") == "fr", 90).otherwise(0).cast("bigint").alias("freshness_days"),
            F.when(_rem(d, 19) != 0, verified).alias("last_verified"),
            F.concat(F.lit("custodian-"), _rem(d, 5)).alias("custodian"),
            tx.sha256(F.col("text")).alias("version"),
            F.when(_rem(d, 23) != 0, F.concat(F.lit("sig-"), F.col(d))).alias("signature"),
            (_rem(d, 31) != 0).alias("resolved_ok"),
            (_rem(d, 29) != 0).alias("signature_verified"),
        )

    @cached_property
    def document(self) -> DataFrame:
        """Stored documents: a repository copy of most, a package copy of some."""
        d = "doc_id"
        base = self.table("documents").filter(_rem(d, 31) != 0)
        commit = tx.sha256(F.concat(F.lit("commit-"), F.col(d)))
        columns = lambda where, body: [
            F.lit(where).cast("bigint").alias("priority"),
            F.concat(F.lit("documents/"), F.col(d), F.lit(".md")).alias("path"),
            F.encode(body, "UTF-8").alias("content"),
            F.when(_rem(d, 3) != 0, commit).alias("git_commit"),
            F.concat(F.lit("author-"), _rem(d, 4)).alias("git_author"),
        ]
        package = base.filter(_rem(d, 2) == 0).select(*columns(0, F.col("text")))
        repository = base.filter(_rem(d, 5) != 0).select(
            *columns(1, F.concat(F.col("text"), F.lit("\n")))
        )
        return package.unionByName(repository)

    @cached_property
    def criterion(self) -> DataFrame:
        comparators = ("eq", "ne", "le", "ge", "in")
        size = F.col("p_size")
        return self.table("part").filter(_rem("p_partkey", 3) != 0).select(
            F.col("p_partkey").alias("control_id"),
            F.lit("qty").alias("metric_key"),
            _pick(_rem("p_partkey", 5), comparators).alias("comparator"),
            F.when(_rem("p_partkey", 5) == 4,
                   F.concat(F.lit("["), size, F.lit(", "), size + 1, F.lit("]")))
            .otherwise(size.cast("string")).alias("threshold"),
        )

    # -- contracts -------------------------------------------------------------------

    @cached_property
    def order_hdr(self) -> DataFrame:
        # Dealt while it is narrow; hashes of it are made afterwards.
        return self.by_contract(self.table("orders").select(
            F.col("o_orderkey").alias("contract_id"),
            (F.col("o_orderstatus") != "P").alias("attested"),
            F.col("o_custkey").alias("owner"),
            F.col("o_orderpriority").alias("priority"),
        ))

    @cached_property
    def order_control(self) -> DataFrame:
        return self._lines.select("contract_id", "control_id").distinct()

    @cached_property
    def order_module(self) -> DataFrame:
        return self._lines.select("contract_id", "module_id").distinct()

    @cached_property
    def obligation(self) -> DataFrame:
        """One obligation per (order, line number)."""
        line, flag = F.col("l_linenumber"), F.col("_flag")
        return (
            self._lines.groupBy("contract_id", "l_linenumber")
            .agg(_greatest("l_returnflag").alias("_flag"))
            .select(
                "contract_id",
                F.concat(F.lit("OBL-"), line).alias("name"),
                _pick(line % 6, vocab.OBLIGATION_TYPES).alias("obligation_type"),
                F.when(flag == "A", "CUI").when(flag == "R", "ITAR").alias("data_marker"),
                F.concat(F.lit("clause-"), line).alias("source_ref"),
                (F.col("contract_id") % 4 == 0).alias("acknowledged"),
            )
        )

    @cached_property
    def obligation_derive(self) -> DataFrame:
        """What each obligation derives: the part ids, a marker, and on some the whole catalog."""
        name = F.concat(F.lit("OBL-"), F.col("l_linenumber")).alias("name")
        base = self._lines.select(
            "contract_id", name, F.col("control_id").cast("string").alias("control"), "l_returnflag"
        )
        cited = base.select("contract_id", "name", F.col("control").alias("token"))
        marker = base.filter("l_returnflag = 'R'").select(
            "contract_id", "name", F.lit("US-PERSON").alias("token")
        )
        whole = base.filter(F.col("contract_id") % 40 == 0).select(
            "contract_id", "name", F.lit("ALL-110-NIST-800-171").alias("token")
        )
        return cited.unionByName(marker).unionByName(whole).distinct()

    @cached_property
    def cited_clause(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("contract_id"), F.col("o_orderpriority").alias("clause")
        )

    @cached_property
    def clause_rule(self) -> DataFrame:
        rows = [("1-URGENT", "A"), ("1-URGENT", "R"), ("2-HIGH", "R"), ("3-MEDIUM", "A"),
                ("3-MEDIUM", "N"), ("3-MEDIUM", "R"), ("5-LOW", "N")]
        return vocab.fixed_table(self.spark, rows, "clause", "token")

    @cached_property
    def present_token(self) -> DataFrame:
        return self._lines.select("contract_id", F.col("l_returnflag").alias("token")).distinct()

    # -- evidence --------------------------------------------------------------------

    @cached_property
    def evidence(self) -> DataFrame:
        grouped = self._lines.groupBy("contract_id", "control_id", "module_id").agg(
            F.max(F.col("l_quantity").cast("int")).alias("_qty"),
            F.max("l_shipdate").alias("_shipped"),
        )
        module = F.col("module_id")
        evidence_id = F.concat_ws("-", "contract_id", "control_id", "module_id")
        model_hash = tx.sha256(evidence_id)
        claimed = F.when(
            (F.col("control_id") + module) % 97 == 0, F.concat(F.lit("x"), model_hash)
        ).otherwise(model_hash)
        chained = F.concat(
            F.lit('{"model_hash": "'), claimed, F.lit('", "proof_hash": null, "sim_hash": null}')
        )
        key = F.when(module % 11 == 0, "other").otherwise("qty")
        return grouped.select(
            "contract_id",
            evidence_id.alias("evidence_id"),
            F.col("control_id").alias("source_control"),
            module.alias("source_module"),
            F.when(module % 3 == 0, "ConfigExport").when(module % 3 == 1, "PolicyCheck")
            .otherwise("Other").alias("subtype"),
            module.alias("seq"),
            F.concat(F.lit('{"'), key, F.lit('": '), F.col("_qty"), F.lit("}")).alias("summary"),
            F.when(F.col("contract_id") % 10 == 0, "mock").otherwise("real")
            .alias("evidentiary_status"),
            F.when(module % 6 != 0, F.concat(F.lit("exports/"), module, F.lit(".json")))
            .alias("source_file"),
            F.col("_shipped").cast("timestamp").alias("generated_at"),
            model_hash.alias("model_hash"),
            tx.sha256(chained).alias("content_hash"),
        )

    @cached_property
    def addresses(self) -> DataFrame:
        control = F.col("source_control")
        return self.evidence.filter(F.col("source_module") % 9 != 0).select(
            "contract_id", "evidence_id",
            F.when(control % 13 == 0, control + 1).otherwise(control).alias("control_id"),
        )

    # -- sign-offs -------------------------------------------------------------------

    @cached_property
    def attestation(self) -> DataFrame:
        grouped = (
            self._lines.groupBy("contract_id", "control_id")
            .agg(_greatest("l_returnflag").alias("f"), _greatest("l_linestatus").alias("s"),
                 F.max("l_linenumber").alias("n"), F.max("l_tax").alias("t"),
                 F.max("l_discount").alias("d"), F.max("l_shipdate").alias("_shipped"))
            .filter(F.col("n") % 7 != 0)
        )
        f, s, n = F.col("f"), F.col("s"), F.col("n")
        control = F.col("control_id")
        return grouped.select(
            "contract_id",
            F.concat_ws("-", F.lit("ATT"), "contract_id", "control_id").alias("att_id"),
            "control_id",
            F.when(f.isin("A", "N"), "passed").when(n % 2 == 0, "failed")
            .otherwise("needsAction").alias("outcome"),
            F.when(n == 1, F.lit(None).cast("string")).when((s == "F") & (f == "N"), "failed")
            .when(n == 2, "inherited").otherwise("passed").alias("oracle_outcome"),
            F.when(n.isin(1, 3), F.concat(F.lit("assert-"), control)).alias("backed_by"),
            F.when(F.col("t") > 0.05, F.concat(F.lit("why | "), control)).alias("override_justification"),
            F.when(F.col("d") > 0.05, F.concat(F.lit("proof-"), control)).alias("override_evidence"),
            F.when(control % 6 == 0, F.concat(F.lit("DE-"), control)).alias("document_evidence"),
            F.concat(F.lit("Official "), F.col("contract_id") % 3).alias("official"),
            F.when(n % 2 == 0, "manual").otherwise("semiAuto").alias("mode"),
            F.col("_shipped").cast("timestamp").alias("generated_at"),
            F.when(control % 50 == 0, "").otherwise(F.concat(F.lit("adequate "), control))
            .alias("adequacy"),
            F.when(control % 40 != 0, F.concat(F.lit("sufficient "), control)).alias("sufficiency"),
        )

    @cached_property
    def attestation_evidence(self) -> DataFrame:
        signed = self.attestation.select("contract_id", "control_id", "att_id")
        held = self.evidence.select(
            "contract_id", F.col("source_control").alias("control_id"), "evidence_id"
        )
        return signed.join(held, ["contract_id", "control_id"])

    @cached_property
    def poam(self) -> DataFrame:
        met = self.attestation.filter("outcome = 'passed'").select("contract_id", "control_id")
        return (
            self.order_control.filter(_rem("control_id", 4) == 0)
            .join(met, ["contract_id", "control_id"], "left_anti")
            .select("contract_id", "control_id",
                    F.concat_ws("-", F.lit("poam/POAM"), "contract_id", "control_id").alias("poam_item"))
        )

    @cached_property
    def attestation_log(self) -> DataFrame:
        """Sign-off records; a record covers the key its conversation number names."""
        conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
        signed = F.date_add(
            F.lit("2024-03-01").cast("date"), (turn * 60 + conv % 20).cast("int")
        )
        outcome = F.when(conv % 7 == 3, "failed").when(conv % 7 == 4, "needsAction").otherwise("passed")
        return self.table("conversations").select(
            F.concat_ws("-", F.lit("log"), conv, turn).alias("id"),
            F.concat(F.lit("Signer "), conv % 9).alias("signer"),
            F.when(conv % 3 == 0, vocab.AFFIRMING_OFFICIAL)
            .when(role == "user", "Role_SecurityOfficer")
            .when(role == "assistant", "Role_ITAdmin").otherwise("Role_OPs").alias("signer_role"),
            F.concat(signed.cast("string"), F.lit("T00:00:00+00:00")).alias("signed_at"),
            F.array(F.when(conv % 6 == 5, F.concat(F.lit("conv-"), conv)).otherwise(conv.cast("string"))).alias("covers"),
            F.filter(F.sequence(F.lit(0), F.lit(49)), lambda x: x % 7 != conv % 7)
            .cast("array<string>").alias("controls_attested"),
            outcome.alias("outcome"),
            F.when(conv % 11 != 0, F.lit("reviewed")).otherwise("").alias("adequacy"),
            F.when(turn % 5 != 4, F.lit("enough")).otherwise("").alias("sufficiency"),
            F.when(conv % 4 == 0, F.concat(F.lit("sig"), conv)).alias("sig"),
            F.when(conv % 8 == 0, "ed25519-v1").otherwise("none").alias("sig_algo"),
            F.col("text").alias("notes"),
            F.when(conv % 5 == 0, F.lit("override")).alias("override_justification"),
            F.when(conv % 10 == 0, F.lit("artifact")).alias("override_evidence"),
            F.lit("log").alias("_file"),
            (conv * 1000 + turn).alias("_line"),
        )

    @cached_property
    def attested_use(self) -> DataFrame:
        """One attested control per document: the key it is covered by and the role it needs."""
        d = F.col("doc_id")
        return self.table("documents").select(
            d.alias("reference_id"),
            (d % 20).cast("string").alias("cover_key"),
            (d % 50).cast("string").alias("control_id"),
            _pick(d % 4, vocab.SIGNER_ROLES).alias("required_role"),
            (d % 37 == 0).alias("unregistered"),
        )

    # -- provisioning ----------------------------------------------------------------

    @cached_property
    def planned_resource(self) -> DataFrame:
        """One resource per (order, supplier), located where the supplier's region is."""
        place = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("module_id"),
                F.when(F.col("s_suppkey") % 7 == 0, F.lit(None).cast("string"))
                .when(F.col("r_name") == "AMERICA", "us-east1")
                .otherwise(F.lower("r_name")).alias("region"),
            )
        )
        return self.by_contract(self.order_module.join(place, "module_id").select("contract_id", "module_id", "region")).select(
            "contract_id",
            F.concat(F.lit("res-"), F.col("module_id")).alias("resource_id"),
            "module_id",
            F.when(F.col("module_id") % 4 == 0, "google_storage_bucket")
            .otherwise("terraform_data").alias("type"),
            "region",
        )

    @cached_property
    def module_use(self) -> DataFrame:
        return self._lines.select("contract_id", "module_id", "control_id").distinct()

    @cached_property
    def resource_control(self) -> DataFrame:
        return self._lines.select(
            "contract_id", F.concat(F.lit("res-"), F.col("module_id")).alias("resource_id"),
            "control_id",
        ).distinct()

    # -- runs ------------------------------------------------------------------------

    @cached_property
    def activity(self) -> DataFrame:
        return self.table("events").select(
            F.expr("event_id div 5").alias("run_id"),
            F.concat(F.lit("act-"), F.col("event_id")).alias("activity"),
            F.col("event_type").alias("step"),
            F.when(F.col("event_id") % 43 != 0, F.col("ts").cast("timestamp")).alias("started_at"),
            F.when(F.col("event_id") % 41 != 0, F.concat(F.lit("user-"), F.col("user_id"))).alias("agent"),
            (F.col("value") > 50).alias("_realised"),
        )

    @cached_property
    def realized(self) -> DataFrame:
        return self.activity.filter("_realised").select(
            "run_id", F.concat(F.lit("var-"), F.col("step")).alias("variable")
        ).distinct()

    @cached_property
    def prov_edge(self) -> DataFrame:
        """Each activity generates its own entity and uses the one before it in the run."""
        event = F.col("event_id")
        run = F.expr("event_id div 5").alias("run_id")
        act = F.concat(F.lit("act-"), event).alias("activity")
        base = self.table("events")
        made = base.select(
            run, F.lit("generated").alias("kind"), act, F.concat(F.lit("ent-"), event).alias("entity")
        )
        used = base.filter(event % 5 != 0).select(
            run, F.lit("used").alias("kind"), act, F.concat(F.lit("ent-"), event - 1).alias("entity")
        )
        return made.unionByName(used)

    @cached_property
    def plan(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The procedure the events follow: signup -> view -> click -> purchase."""
        steps = ("signup", "view", "click", "purchase")
        spark = self.spark
        return (
            vocab.fixed_table(spark, [(s,) for s in steps], "step"),
            vocab.fixed_table(spark, list(zip(steps[1:], steps[:-1])), "step", "predecessor"),
            vocab.fixed_table(spark, [(s, f"var-{s}") for s in steps], "step", "variable"),
        )

    # -- raw graph -------------------------------------------------------------------

    @cached_property
    def quads(self) -> DataFrame:
        """Orders, required controls and evidence links as quads of three layers."""
        kid = F.col("contract_id")
        iri = lambda kind, c: F.concat(F.lit(f"<urn:{kind}/"), c, F.lit(">"))
        order = self.order_hdr.select(
            kid, F.lit("order").alias("graph"), iri("order", kid).alias("s"),
            F.lit("<urn:term#priority>").alias("p"),
            F.concat(F.lit('"'), F.col("priority"), F.lit('"')).alias("o"),
        )
        needs = self.order_control.select(
            kid, F.lit("order").alias("graph"), iri("order", kid).alias("s"),
            F.lit("<urn:term#requiresControl>").alias("p"), iri("control", F.col("control_id")).alias("o"),
        )
        links = self.addresses.select(
            kid, F.lit("evidence").alias("graph"), iri("evidence", F.col("evidence_id")).alias("s"),
            F.lit("<urn:term#addresses>").alias("p"), iri("control", F.col("control_id")).alias("o"),
        )
        notes = self.attestation.select(
            kid, F.lit("attestations").alias("graph"), iri("attestation", F.col("att_id")).alias("s"),
            F.lit("<urn:term#association>").alias("p"), F.concat(F.lit("_:b"), F.col("control_id")).alias("o"),
        )
        return order.unionByName(needs).unionByName(links).unionByName(notes)

    @cached_property
    def snapshots(self) -> DataFrame:
        """Two versions of each owner's order graph: orders leave, arrive and change."""
        key = F.col("o_orderkey")
        line = lambda status: F.concat(
            F.lit("<urn:order/"), key, F.lit('> <urn:term#status> "'), status, F.lit('" .')
        )
        base = self.table("orders")
        keep = [F.col("o_custkey").alias("ref"), F.lit("order").alias("graph")]
        first = base.filter(key % 5 != 0).select(
            *keep, F.lit(0).cast("bigint").alias("seq"), line(F.col("o_orderstatus")).alias("line")
        )
        second = base.filter(key % 7 != 0).select(
            *keep, F.lit(1).cast("bigint").alias("seq"),
            line(F.when(key % 3 == 0, "closed").otherwise(F.col("o_orderstatus"))).alias("line"),
        )
        static = base.select(
            F.col("o_custkey").alias("ref"), F.lit("structural").alias("graph"),
            F.concat(F.lit("<urn:owner/"), F.col("o_custkey"),
                     F.lit('> <urn:term#priority> "'), F.col("o_orderpriority"), F.lit('" .')).alias("line"),
        ).distinct().withColumn("seq", F.explode(F.array(*[F.lit(v).cast("bigint") for v in (0, 1)])))
        return first.unionByName(second).unionByName(static)

    # -- inputs of single operators ----------------------------------------------------

    @cached_property
    def policy_check(self) -> DataFrame:
        return self.table("part").filter(_rem("p_partkey", 4) == 1).select(
            F.col("p_partkey").alias("control_id"), F.lit("qty").alias("metric_key"),
            F.col("p_size").cast("string").alias("threshold"),
        )

    @cached_property
    def artifact(self) -> DataFrame:
        """Collected artifacts behind the evidence rows; equal ones repeat within a contract."""
        return self.evidence.select(
            "contract_id", F.col("evidence_id").alias("artifact_id"),
            F.when(F.col("subtype") == "PolicyCheck", "policy-check").otherwise("config-export")
            .alias("method"),
            F.concat(F.lit("sys."), F.col("source_module") % 2).alias("origin"),
            F.when(F.col("source_module") % 9 != 0, (F.col("source_control") % 3).cast("string"))
            .alias("first_control"),
            F.col("summary").alias("payload"), "subtype", "summary", "source_file",
            "evidentiary_status", F.col("generated_at").alias("collected_at"),
        )

    @cached_property
    def artifact_control(self) -> DataFrame:
        return self.addresses.withColumnRenamed("evidence_id", "artifact_id")

    @cached_property
    def module_fact(self) -> DataFrame:
        """Written facts of each module; every tenth claim hangs on a node of its own."""
        m = F.col("module_id")
        subject = F.concat(F.lit("<urn:module/"), m, F.lit(">"))
        labels = self.module.select(
            "module_id", subject.alias("s"), F.lit("<urn:term#label>").alias("p"),
            F.concat(F.lit('"'), "label", F.lit('"')).alias("o"),
        )
        methods = self.module.filter("method is not null").select(
            "module_id", subject.alias("s"), F.lit("<urn:term#method>").alias("p"),
            F.concat(F.lit('"'), "method", F.lit('"')).alias("o"),
        )
        own_node = F.col("control_id") % 10 == 0
        claims = self.module_claim.select(
            "module_id", subject.alias("s"),
            F.when(own_node, "<urn:term#owns>").otherwise("<urn:term#claims>").alias("p"),
            F.when(own_node, F.concat(F.lit("_:n"), m, F.lit("-"), "control_id"))
            .otherwise(F.concat(F.lit("<urn:control/"), F.col("control_id"), F.lit(">"))).alias("o"),
        )
        return labels.unionByName(methods).unionByName(claims)

    @cached_property
    def node_fact(self) -> DataFrame:
        owned = self.module_claim.filter(F.col("control_id") % 10 == 0)
        node = F.concat(F.lit("_:n"), F.col("module_id"), F.lit("-"), "control_id")
        kind = owned.select(node.alias("node"), F.lit("<urn:term#type>").alias("p"),
                            F.lit("<urn:term#Satisfy>").alias("o"))
        target = owned.select(node.alias("node"), F.lit("<urn:term#requirement>").alias("p"),
                              F.concat(F.lit("<urn:control/"), F.col("control_id"), F.lit(">")).alias("o"))
        return kind.unionByName(target)

    @cached_property
    def region_input(self) -> DataFrame:
        """Planned resources with the places a region can be read from."""
        m = F.col("module_id")
        lists = m % 10 == 4
        return self.planned_resource.select(
            "contract_id", "module_id",
            F.when(lists, F.concat(F.lit("policy.m"), m, F.lit(".resource_locations")))
            .otherwise(F.concat(F.lit("res.m"), m)).alias("address"),
            "type", F.col("region").alias("tag_region"), F.col("region").alias("location"),
            F.when(lists & F.col("region").isNotNull(),
                   F.array(F.concat(F.lit("in:"), "region"), F.lit("in:us-locations")))
            .alias("allowed_values"),
        )

    @cached_property
    def bom_order(self) -> DataFrame:
        key = F.col("contract_id")
        return self.order_hdr.select(
            "contract_id", tx.sha256(F.concat(F.lit("order-"), key)).alias("order_hash"),
            F.when(key % 5 != 0, tx.sha256(F.concat(F.lit("state-"), key))).alias("state_hash"),
            F.lit(vocab.TARGET_TIER).alias("tier"), F.lit(vocab.IMPACT_LEVEL).alias("impact_level"),
            F.lit(vocab.STANDARD).alias("standard"),
        )

    @cached_property
    def module_hash(self) -> DataFrame:
        """Module hashes an order states."""
        m = F.col("module_id")
        return self.order_module.select(
            "contract_id", "module_id", tx.sha256(F.concat(F.lit("module-"), m)).alias("module_hash")
        )

    @cached_property
    def document_use(self) -> DataFrame:
        """Document evidence behind some required controls."""
        return self.attestation.filter("document_evidence is not null").select(
            "contract_id", "control_id", F.concat(F.lit("REF-"), F.col("control_id")).alias("reference_id"),
            F.when(F.col("control_id") % 4 != 2, tx.sha256(F.concat(F.lit("doc-"), F.col("control_id"))))
            .alias("sha256"),
            F.concat(F.lit("commit-"), F.col("control_id")).alias("git_commit"),
            F.lit("2024-06-01").alias("git_committed_at"),
            F.when(F.col("control_id") % 9 != 0, "passed").otherwise("failed").alias("outcome"),
        )

    @cached_property
    def assertion(self) -> DataFrame:
        """Assertions behind sign-offs, with the outcome each one reports."""
        return self.attestation.filter("backed_by is not null").select(
            "contract_id", F.col("backed_by").alias("assertion"),
            F.when(F.col("control_id") % 3 == 0, "failed").otherwise("passed").alias("outcome"),
        ).distinct()

    @cached_property
    def blob(self) -> DataFrame:
        """Document texts as bytes; some claim a hash that is not theirs."""
        own = tx.sha256(F.col("text"))
        return self.table("documents").select(
            F.encode("text", "UTF-8").alias("content"), F.lit("document").alias("kind"),
            F.when(F.col("doc_id") % 41 == 0, tx.sha256(F.concat(F.lit("x"), own))).otherwise(own)
            .alias("hash"), "doc_id",
        )

    @cached_property
    def bom_index(self) -> DataFrame:
        """Bills of materials per owner in the order they were stored."""
        return self.table("orders").select(
            F.col("o_custkey").alias("contract_id"), F.col("o_orderkey").alias("seq"),
            tx.sha256(F.concat(F.lit("bom-"), F.col("o_orderkey"))).alias("bom_hash"),
        )

    @cached_property
    def artifact_index(self) -> DataFrame:
        return self.evidence.select(
            tx.sha256(F.concat(F.lit("bom-"), F.col("contract_id"))).alias("bom_hash"),
            F.col("content_hash").alias("hash"),
        )

    @cached_property
    def argument(self) -> tuple[DataFrame, DataFrame]:
        """Assurance argument: parts are goals, strategies and solutions, line items support."""
        kind = F.when(F.col("p_partkey") % 3 == 0, "Goal").when(F.col("p_partkey") % 3 == 1, "Strategy").otherwise("Solution")
        nodes = self.table("part").select(F.col("p_partkey").alias("node"), kind.alias("kind"))
        supports = self.table("lineitem").select(
            F.col("l_partkey").alias("node"),
            (F.col("l_partkey") + F.col("l_suppkey")).alias("supported_by"),
        ).distinct()
        return nodes, supports

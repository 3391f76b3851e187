"""Derived artifacts of source records: class, identity, duplicates, assembly, and their provenance.

Each producer is a projection or a window over the records of one key; artifacts are tables whose
rows carry their content address. Rows that a producer must refuse go to a table of rejects with a
reason, they never fail the job and never vanish.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions import identity as I
from codexmill.functions import text as X
from codexmill.operators.skew import join_by_weight, numbered_in_group
from codexmill.operators.workspace import written

# What a document type says of class and role, and what a key's prefix expects.
GUIDANCE_TYPES = ("guidance", "guideline", "administrative_guidance", "ruling", "faq", "memorandum", "enforcement_action", "irs_notice", "irs_rev_proc", "irs_rev_rul", "irs_announcement")
LAW_TYPES = ("statute", "regulation", "constitution", "court_rule")
EXPECTED = {"USC": "statute", "CFR": "regulation", "FR": "regulation", "SCONST": "constitution", "CONST": "constitution", "SREGS": "regulation", "SRULES": "court_rule", "FRULES": "court_rule"}
PRODUCERS = {
    "classification": ("document_classification_deterministic", "2"),
    "duplicates": ("quality_duplicate_row", "2"),
    "assembly": ("source_assembly_trivial_single_record", "2"),
}
STRATEGY_VERSION = "1"
USC, STATE, CONSTITUTION = "usc_act_id_v1", "state_statute_act_id_v1", "constitution_act_id_v1"
CFR, FEDERAL_REGISTER, STATE_REGULATION = "cfr_identity_v1", "federal_register_document_v1", "state_regulation_v1"


def _evidence(kind: str, detail: Column, confidence: Column) -> Column:
    return F.struct(confidence.cast("double").alias("confidence"), detail.alias("detail"), F.lit(kind).alias("kind"))


def _quoted(value: Column) -> Column:
    """As a Python literal: in single quotes, or None."""
    return F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))


def classify(document_type: Column, act_id: Column) -> Column:
    """(doc_class, role, confidence, evidence) from the document type, refined or contradicted by the key.

    An unmapped type, or a prefix that expects another class, gives ``unknown`` at 0.0 and keeps both
    signals as evidence.
    """
    prefix = X.act_id_prefix(act_id)
    broad = F.when(document_type.isin(*LAW_TYPES), document_type).when(document_type.isin(*GUIDANCE_TYPES), "guidance")
    expected = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])[prefix]
    mapped = broad.isNotNull()
    clash = mapped & F.coalesce(expected != broad, F.lit(False))
    refined = ~clash & (broad == "regulation") & prefix.isin("CFR", "FR")
    codified = prefix == "CFR"
    doc_class = F.when(~mapped | clash, "unknown").when(refined & codified, "codified_cfr").when(refined, "federal_register").otherwise(broad)
    role = F.when(~mapped | clash, "unknown").when(broad == "guidance", "guidance").when(refined & ~codified, "promulgation_record").otherwise("operative_primary_law")
    none, sure = F.lit(None), F.lit(1.0)
    # These sentences enter payload digests.
    said = F.concat(F.lit("document_type "), _quoted(document_type))
    type_detail = F.when(~mapped, F.concat(said, F.lit(" has no broad-class mapping; abstaining"))).otherwise(F.concat(said, F.lit(" => "), broad))
    of = F.concat(F.lit("prefix "), _quoted(prefix))
    key_detail = (
        F.when(~mapped, F.concat(F.lit("act_id prefix="), _quoted(prefix)))
        .when(clash, F.concat(of, F.lit(" expects "), expected, F.lit("; contradiction -> abstain")))
        .when(refined, F.concat(of, F.lit(" refines regulation => "), doc_class, F.lit("/"), role))
        .when(expected.isNotNull(), F.concat(of, F.lit(" confirms "), broad))
        .otherwise(F.concat(of, F.lit(" is non-refining/ambiguous; document_type alone set the class")))
    )
    settled = mapped & ~clash
    evidence = F.array(
        _evidence("document_type", type_detail, F.when(settled, sure).otherwise(none)),
        _evidence("act_id_prefix", key_detail, F.when(settled & (refined | expected.isNotNull()), sure).otherwise(none)),
    )
    return F.struct(doc_class.alias("doc_class"), role.alias("role"), F.when(settled, 1.0).otherwise(0.0).alias("confidence"), evidence.alias("evidence"))


def classification_payload() -> Column:
    """The digest of a classification's conclusion, from its columns."""
    body = F.struct(F.col("role").alias("authority_role"), "confidence", F.col("doc_class").alias("document_class"), "evidence", F.col("source_record_id").alias("target_source_record_id"))
    return I.payload_hash("document_classification_annotation", body)


def classified(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Classification artifacts: one per record, addressed and with its payload's digest. ``keep``
    names columns of the records to carry along."""
    name, version = PRODUCERS["classification"]
    kind = "document_classification_annotation"
    out = records.select(*keep, "source_record_id", classify(F.col("document_type"), F.col("act_id")).alias("c")).select(*keep, "source_record_id", "c.*")
    return out.withColumns(
        {
            "artifact_id": I.artifact_id(kind, F.array(I.edge(I.SOURCE_RECORD, F.col("source_record_id"))), name, version),
            "payload_hash": classification_payload(),
            "default_off": F.col("doc_class") == "federal_register",
        }
    )


# --------------------------------------------------------------------------- identity


def strategy(document_type: Column, act_id: Column) -> Column:
    """Which identity strategy a record falls under; null where none applies.

    The type decides; the prefix only refines within it.
    """
    prefix = X.act_id_prefix(act_id)
    return (
        F.when(document_type == "constitution", CONSTITUTION)
        .when(document_type == "statute", F.when(prefix == "USC", USC).otherwise(STATE))
        .when(document_type == "regulation", F.when(prefix == "FR", FEDERAL_REGISTER).when(prefix == "CFR", CFR).otherwise(STATE_REGULATION))
    )


_WANTED = {USC: ("USC",), STATE: ("STATE",), CONSTITUTION: ("CONST", "SCONST"), CFR: ("CFR",), FEDERAL_REGISTER: ("FR",), STATE_REGULATION: ("STATE",)}
_CORPUS = {USC: "statutes", STATE: "statutes", CONSTITUTION: "constitutions", CFR: "regulations", FEDERAL_REGISTER: "regulations", STATE_REGULATION: "regulations"}


def reject_reason(chosen: Column, corpus: Column, act_id: Column, state: Column) -> Column:
    """Why a strategy must refuse a record, or null."""
    prefix, reason = X.act_id_prefix(act_id), F.lit(None).cast("string")
    for name in _WANTED:
        reason = F.when((chosen == name) & ~F.coalesce(prefix.isin(*_WANTED[name]), F.lit(False)), "prefix").when((chosen == name) & (corpus != _CORPUS[name]), "corpus").otherwise(reason)
    blank = [F.coalesce(c == "", F.lit(True)) for c in (state, corpus, act_id)]
    return F.when(chosen.isNotNull() & (blank[0] | blank[1] | blank[2]), "missing key").otherwise(reason)


def identity_members(records: DataFrame, file: list[str], ordinal: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Members of identity groups: strategy, key, place in the group, occurrence of its text, fingerprint.

    A record under a strategy that must refuse it has a ``reject`` reason and no place. The order is
    physical and only observed; ties break by record id. A key that holds a large share of all rows
    is numbered block by block. The members, without their texts, are written first, so that texts
    are read and hashed once.
    """
    chosen = strategy(F.col("document_type"), F.col("act_id"))
    base = records.select(
        *file, *keep, "source_record_id", "row_id", "state", "corpus", "act_id", "raw_text_hash", F.col(ordinal).alias("ordinal"), chosen.alias("strategy")
    ).where(F.col("strategy").isNotNull()).withColumn("reject", reject_reason(F.col("strategy"), F.col("corpus"), F.col("act_id"), F.col("state")))
    base = written(base, "identity")
    good = base.where(F.col("reject").isNull())
    group = [*file, "state", "corpus", "act_id", "strategy"]
    good = numbered_in_group(good, group, "ordinal", ["source_record_id"], "segment_ordinal", "group_size")
    good = numbered_in_group(good, [*group, "raw_text_hash"], "ordinal", ["source_record_id"], "occurrence_index", "copies")
    good = good.withColumns(
        {
            "segment_ordinal": F.col("segment_ordinal").cast("int"),
            "occurrence_index": F.col("occurrence_index").cast("int"),
            "source_identity_key": I.source_identity_key(F.col("state"), F.col("corpus"), F.col("act_id")),
            "fingerprint": I.segment_fingerprint(F.col("act_id"), F.col("raw_text_hash"), F.col("occurrence_index")),
            "duplicate_row": F.col("raw_text_hash").isNotNull() & (F.col("copies") > 1),
        }
    ).drop("copies")
    refused = base.where(F.col("reject").isNotNull()).withColumn("duplicate_row", F.lit(False))
    return good.unionByName(refused, allowMissingColumns=True)


def group_status(chosen: Column, size: Column) -> Column:
    """(scope, status) of a group: one record is resolved; more of a Federal Register number are
    ambiguous; more of a regulation are provisional segments."""
    scope = F.when(size == 1, "document").when(chosen == FEDERAL_REGISTER, "numbering_bucket").when(chosen.isin(CFR, STATE_REGULATION), "segment").otherwise("document")
    status = F.when(size == 1, "resolved").when(chosen == FEDERAL_REGISTER, "ambiguous").when(chosen.isin(CFR, STATE_REGULATION), "provisional").otherwise("resolved")
    return F.struct(scope.alias("scope"), status.alias("status"))


def _keyed(members: DataFrame) -> DataFrame:
    """Members that are in a group; ``part`` is the record where each record is a group of its own."""
    one_each = F.col("strategy").isin(USC, STATE, CONSTITUTION)
    return members.where(F.col("reject").isNull()).withColumn("part", F.when(one_each, F.col("source_record_id")))


def _group_key(file: list[str]) -> Column:
    """A group's key as one value, in which a null is a value."""
    return F.struct(*file, "source_identity_key", "strategy", "part")


def group_sizes(members: DataFrame, file: list[str]) -> DataFrame:
    """Key, strategy, scope, status, size and duplicates of each group, without its address."""
    grouped = _keyed(members).groupBy(*file, "source_identity_key", "strategy", "part").agg(
        F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("duplicate_row") & F.col("part").isNull(), 1)).alias("duplicate_rows")
    )
    return grouped.withColumn("s", group_status(F.col("strategy"), F.col("size"))).select(*file, "source_identity_key", "strategy", "part", "s.*", "size", "duplicate_rows")


class _Digests:
    """Addresses of a group and of its duplicate scope, from its record ids in order.

    The scope's address begins with the group's, so the edges are kept for a second reading, beyond a
    size on disk.
    """

    def __init__(self, strategy_name: str):
        self.size, self.distinct, self.duplicates, self.complete, self.latest = 0, 0, 0, True, None
        self.digest = hashlib.sha256(I.FIELD.join(("source_identity_group", strategy_name, STRATEGY_VERSION, "", "")).encode())
        self.edges = tempfile.SpooledTemporaryFile(max_size=4 << 20)

    def add(self, record: str | None, duplicate: bool | None) -> None:
        self.size += 1
        self.duplicates += bool(duplicate)
        if record is None:
            self.complete = False
            return
        part = f"{I.RECORD if self.latest is not None else ''}{I.SOURCE_RECORD}{I.UNIT}{record}".encode()
        self.distinct += record != self.latest
        self.latest = record
        self.digest.update(part)
        self.edges.write(part)

    def row(self) -> tuple:
        group = scope = None
        if self.complete:
            group = f"art:sha256:{self.digest.hexdigest()}"
            name, version = PRODUCERS["duplicates"]
            digest = hashlib.sha256(I.FIELD.join(("duplicate_scope", name, version, "", f"{I.ANNOTATION}{I.UNIT}{group}{I.RECORD}")).encode())
            self.edges.seek(0)
            while part := self.edges.read(1 << 20):
                digest.update(part)
            scope = f"art:sha256:{digest.hexdigest()}"
        self.edges.close()
        return self.size, self.distinct, self.duplicates, group, scope


def _shared_groups(keyed: DataFrame, file: list[str]) -> DataFrame:
    """The groups of strategies that put records together. Their records are sorted, which spills,
    and hashed as they pass by, so a group of any size needs the memory of a batch."""
    key = [*file, "source_identity_key", "strategy"]
    rows = keyed.where(F.col("part").isNull()).select(*key, "source_record_id", "duplicate_row")
    schema = T.StructType(
        [
            *rows.schema.fields[: len(key)],
            *(T.StructField(n, T.LongType()) for n in ("size", "distinct_members", "duplicate_rows")),
            *(T.StructField(n, T.StringType()) for n in ("artifact_id", "scope_id")),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_ = None, None
        for batch in batches:
            out = []
            for *at, record, duplicate in zip(*(c.to_pylist() for c in batch.columns)):
                if at != group:
                    if open_ is not None:
                        out.append((*group, *open_.row()))
                    group, open_ = at, _Digests(at[-1])
                open_.add(record, duplicate)
            yield as_batch(out, batch)
        if open_ is not None:
            yield as_batch([(*group, *open_.row())], batch)

    def as_batch(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        types = [*(f.type for f in list(like.schema)[: len(key)]), *[pa.int64()] * 3, *[pa.string()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=schema.names)

    return rows.repartition(*key).sortWithinPartitions(*key, "source_record_id").mapInArrow(run, schema)


def identity_groups(members: DataFrame, file: list[str], with_members: bool = True) -> DataFrame:
    """Group artifacts: key, strategy, scope, status, size, addresses and, if asked for, members.

    One-to-one strategies make a group per record, also under a repeated key; ``part`` is then the
    record. A group's address covers all of its members, however many; ``scope_id`` is the address
    of its duplicate scope. The list of members is one value, as large as the group: leave it out
    where groups may be large, :func:`member_annotations` doesn't need it.
    """
    keyed = _keyed(members)
    name, version = PRODUCERS["duplicates"]
    record = F.array_repeat(I.edge(I.SOURCE_RECORD, F.col("part")), F.col("size").cast("int"))
    alone = (
        keyed.where(F.col("part").isNotNull()).groupBy(*file, "source_identity_key", "strategy", "part")
        .agg(F.count(F.lit(1)).alias("size")).withColumns({"distinct_members": F.lit(1).cast("long"), "duplicate_rows": F.lit(0).cast("long")})
        .withColumn("artifact_id", I.artifact_id("source_identity_group", record, F.col("strategy"), STRATEGY_VERSION))
        .withColumn("scope_id", I.artifact_id("duplicate_scope", F.concat(F.array(I.edge(I.ANNOTATION, F.col("artifact_id"))), record), name, version))
    )
    groups = alone.unionByName(_shared_groups(keyed, file).withColumn("part", F.lit(None).cast("string")))
    columns = [*file, "source_identity_key", "strategy", "part", "s.*", "size", "distinct_members", "duplicate_rows", "artifact_id", "scope_id"]
    groups = groups.withColumn("s", group_status(F.col("strategy"), F.col("size"))).select(*columns)
    if not with_members:
        return groups
    lists = keyed.groupBy(_group_key(file).alias("__g")).agg(F.array_sort(F.collect_list("source_record_id")).alias("members"))
    return groups.withColumn("__g", _group_key(file)).join(lists, "__g").drop("__g")


def member_annotations(members: DataFrame, groups: DataFrame, file: list[str]) -> DataFrame:
    """Member artifacts, each an edge to its group and its record, and the duplicate scope's address.

    Every member meets its group by the group's key. Both are read more than once: pass written tables.
    """
    name, version = PRODUCERS["duplicates"]
    of = groups.select(_group_key(file).alias("__g"), "size", F.col("artifact_id").alias("group_id"), "scope_id")
    rows = _keyed(members).select(_group_key(file).alias("__g"), *file, "strategy", "source_record_id", "segment_ordinal", "fingerprint", "duplicate_row")
    out = join_by_weight(rows, of, ["__g"], "size").select(
        "source_record_id", *file, "strategy", "size", "group_id", "scope_id", "segment_ordinal", "fingerprint", "duplicate_row"
    )
    pair = lambda to: F.array(I.edge(I.ANNOTATION, F.col(to)), I.edge(I.SOURCE_RECORD, F.col("source_record_id")))
    return out.withColumns(
        {
            "order_method": F.when(F.col("size") == 1, "single_record").otherwise("physical_row_order"),
            "order_confidence": F.when(F.col("size") == 1, "not_applicable").otherwise("snapshot_observed"),
            "artifact_id": I.artifact_id("source_identity_member_annotation", pair("group_id"), F.col("strategy"), STRATEGY_VERSION),
            "quality_id": I.artifact_id("quality_annotation", pair("scope_id"), name, version),
        }
    )


def _same_text(file: list[str]) -> Column:
    return F.struct(*file, "source_identity_key", "strategy", "raw_text_hash")


def duplicate_evidence(members: DataFrame, file: list[str]) -> DataFrame:
    """(source_record_id, set_id, shared_by) of each row whose text another row of its group has.

    A set is what shares a text; its id is the least record id of its rows, and each row has one link
    to it, so sets of any size cost a row each. The members are read more than once: pass a written table.
    """
    shared = members.where("duplicate_row").select(_same_text(file).alias("__s"), "source_record_id")
    sets = shared.groupBy("__s").agg(F.min("source_record_id").alias("set_id"), F.count(F.lit(1)).alias("shared_by"))
    return join_by_weight(shared, sets, ["__s"], "shared_by").select("source_record_id", "set_id", "shared_by")


def duplicate_details(evidence: DataFrame, most: int = 1000) -> DataFrame:
    """(source_record_id, detail): the evidence as a sentence that lists all rows of the set.

    The sentence is as long as its set and stands at each of its rows, so it is a view for sets of up
    to ``most`` rows; larger ones are in :func:`duplicate_evidence`.
    """
    small = evidence.where(F.col("shared_by") <= most)
    lists = small.groupBy("set_id", "shared_by").agg(F.array_sort(F.collect_list("source_record_id")).alias("ids"))
    # Fixed value: the sentence enters payload digests.
    detail = F.concat(F.lit("raw_text_hash shared by "), F.col("shared_by").cast("string"), F.lit(" rows in identity group: "), F.array_join("ids", ", "))
    return lists.select(F.explode("ids").alias("source_record_id"), detail.alias("detail"))


# --------------------------------------------------------------------------- assembly


def assembly_address(record: Column) -> Column:
    name, version = PRODUCERS["assembly"]
    return I.artifact_id("source_document_assembly", F.array(I.edge(I.SOURCE_RECORD, record)), name, version)


def assembled(records: DataFrame, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The one-record assembly: the text as it is. Null can't be composed, empty is complete."""
    return records.select(
        *keep,
        "source_record_id",
        F.when(F.col("text").isNull(), "noncomposable").otherwise("complete").alias("status"),
        *([F.col("text").alias("assembled_text")] if with_text else []),
        I.raw_text_hash(F.col("text")).alias("assembled_text_hash"),
        assembly_address(F.col("source_record_id")).alias("artifact_id"),
    )


def association_address(key: Column, legal_id: Column, assembly: Column, strategy_name: str, strategy_version: str) -> Column:
    config = F.sha2(F.concat(key, F.lit(I.FIELD), F.coalesce(legal_id, F.lit(""))), 256)
    return I.artifact_id("assembly_identity_association", F.array(I.edge(I.ASSEMBLY, assembly)), strategy_name, strategy_version, config)


def associated(keys: DataFrame, strategy_name: str, strategy_version: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Links of identity keys (and an optional ``legal_id``) to assemblies. The key is configuration,
    never an edge, so one assembly may have many. ``assembly_id`` names the assembly; without that
    column it is the record's own, whose address follows from the record's."""
    legal = F.col("legal_id") if "legal_id" in keys.columns else F.lit(None).cast("string")
    target = F.col("assembly_id") if "assembly_id" in keys.columns else assembly_address(F.col("source_record_id"))
    linked = keys.select(*keep, "source_record_id", "source_identity_key", legal.alias("legal_id"), target.alias("assembly_id"))
    address = association_address(F.col("source_identity_key"), F.col("legal_id"), F.col("assembly_id"), strategy_name, strategy_version)
    return linked.withColumn("artifact_id", address).drop("legal_id")


# --------------------------------------------------------------------------- checks


def address_conflicts(artifacts: DataFrame) -> DataFrame:
    """Addresses under which different payloads are stored: must be empty."""
    return artifacts.groupBy("artifact_id").agg(F.count_distinct("payload_hash").alias("payloads")).where("payloads > 1")


def violations(df: DataFrame, rules: dict[str, Column], key: Column) -> DataFrame:
    """(key, rule) of every row that breaks a rule; a rule is a condition that must hold, and one
    that is null doesn't. Must be empty."""
    broken = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return df.select(key.alias("key"), F.explode(broken).alias("rule")).where(F.col("rule").isNotNull())


# Closed vocabularies of stored artifacts.
VOCABULARIES = {
    "doc_class": ("codified_cfr", "federal_register", "statute", "regulation", "constitution", "court_rule", "guidance", "unknown"),
    "role": ("operative_primary_law", "promulgation_record", "editorial_material", "guidance", "unknown"),
    "scope": ("document", "segment", "numbering_bucket"),
    "status": ("resolved", "provisional", "ambiguous"),
    "assembly_status": ("complete", "partial", "noncomposable", "ambiguous"),
    "order_method": ("single_record", "physical_row_order"),
    "order_confidence": ("not_applicable", "snapshot_observed"),
}


def classification_rules() -> dict[str, Column]:
    return {
        "class": F.col("doc_class").isin(*VOCABULARIES["doc_class"]),
        "role": F.col("role").isin(*VOCABULARIES["role"]),
        "confidence": F.col("confidence").between(0.0, 1.0),
        "evidence": F.size("evidence") > 0,
        "target": F.col("source_record_id") != "",
        "address": F.col("artifact_id") == I.artifact_id("document_classification_annotation", F.array(I.edge(I.SOURCE_RECORD, F.col("source_record_id"))), *PRODUCERS["classification"]),
        "payload": F.col("payload_hash") == classification_payload(),
    }


def record_rules(snapshot: str = "snapshot_version", checksum: str = "checksum") -> dict[str, Column]:
    """Rules of source records beside ``recomputed_hash``, the digest of their text as it is."""
    return {
        "ordinal": F.col("ordinal") >= 0,
        "snapshot": F.col(snapshot) != "",
        "file": F.col("source_file") != "",
        "checksum": F.col(checksum) != "",
        "id": F.col("source_record_id") == I.source_record_id(F.col(snapshot), F.col(checksum), F.col("ordinal")),
        "hash": F.col("raw_text_hash").eqNullSafe(F.col("recomputed_hash")),
    }


def member_rules() -> dict[str, Column]:
    """Rules of the rows of :func:`member_annotations`; an annotation's edges are its group, or scope, and its record."""
    pair = lambda to: F.array(I.edge(I.ANNOTATION, F.col(to)), I.edge(I.SOURCE_RECORD, F.col("source_record_id")))
    return {
        "target": F.col("source_record_id") != "",
        "group": F.col("group_id") != "",
        "scope": F.col("scope_id") != "",
        "order": F.col("order_method").isin(*VOCABULARIES["order_method"]),
        "confidence": F.col("order_confidence").isin(*VOCABULARIES["order_confidence"]),
        "ordinal": F.col("segment_ordinal").isNull() | (F.col("segment_ordinal") >= 0),
        "address": F.col("artifact_id") == I.artifact_id("source_identity_member_annotation", pair("group_id"), F.col("strategy"), STRATEGY_VERSION),
        "quality address": F.col("quality_id") == I.artifact_id("quality_annotation", pair("scope_id"), *PRODUCERS["duplicates"]),
    }


def association_rules(strategy_name: str, strategy_version: str) -> dict[str, Column]:
    legal = F.lit(None).cast("string")
    return {
        "key": F.col("source_identity_key") != "",
        "assembly": F.col("assembly_id") != "",
        "key is no edge": F.col("source_identity_key") != F.col("assembly_id"),
        "address": F.col("artifact_id") == association_address(F.col("source_identity_key"), legal, F.col("assembly_id"), strategy_name, strategy_version),
    }


def group_rules() -> dict[str, Column]:
    edges = F.transform("members", lambda m: I.edge(I.SOURCE_RECORD, m))
    return {
        "scope": F.col("scope").isin(*VOCABULARIES["scope"]),
        "status": F.col("status").isin(*VOCABULARIES["status"]),
        "key": F.col("source_identity_key") != "",
        "members sorted": F.array_sort("members") == F.col("members"),
        "members unique": F.size(F.array_distinct("members")) == F.size("members"),
        "members complete": F.size("members") == F.col("size"),
        "address": F.col("artifact_id") == I.artifact_id("source_identity_group", edges, F.col("strategy"), STRATEGY_VERSION),
    }


def checked_groups(members: DataFrame, groups: DataFrame, file: list[str]) -> DataFrame:
    """Groups beside what their members say now: ``counted``, ``distinct_members`` and ``address``."""
    again = identity_groups(members, file, with_members=False).select(_group_key(file).alias("__g"), F.col("size").alias("counted"), "distinct_members", F.col("artifact_id").alias("address"))
    return groups.drop("distinct_members").withColumn("__g", _group_key(file)).join(again, "__g", "full_outer").drop("__g")


def checked_group_rules() -> dict[str, Column]:
    """:func:`group_rules` for the rows of :func:`checked_groups`, which have no lists of members."""
    rules = group_rules()
    return {n: rules[n] for n in ("scope", "status", "key")} | {
        "members unique": F.col("distinct_members") == F.col("size"),
        "members complete": F.col("counted") == F.col("size"),
        "address": F.col("artifact_id") == F.col("address"),
    }


def assembly_rules() -> dict[str, Column]:
    has = F.col("assembled_text").isNotNull()
    return {
        "status": F.col("status").isin(*VOCABULARIES["assembly_status"]),
        "text": F.when(F.col("status").isin("complete", "partial"), has).otherwise(~has),
        "hash": F.col("assembled_text_hash").eqNullSafe(I.raw_text_hash(F.col("assembled_text"))),
        "address": F.col("artifact_id") == assembly_address(F.col("source_record_id")),
    }


def provenance_rules() -> dict[str, Column]:
    """Rules of an artifact row with artifact_type, producer, version, config, inputs, artifact_id."""
    ids = F.transform("inputs", lambda e: e["input_id"])
    same = F.concat(F.lit("art:sha256:"), F.sha2(F.concat_ws(I.FIELD, "artifact_type", "producer", "version", "config", F.array_join(F.array_sort(F.transform("inputs", lambda e: F.concat(e["input_type"], F.lit(I.UNIT), e["input_id"]))), I.RECORD)), 256))
    return {
        "producer": F.col("producer") != "",
        "version": F.col("version") != "",
        "edge type": F.forall("inputs", lambda e: e["input_type"].isin(*I.INPUT_TYPES)),
        "edge id": F.forall(ids, lambda i: i != ""),
        "edges unique": F.size(F.array_distinct("inputs")) == F.size("inputs"),
        "address": F.col("artifact_id") == same,
    }


def unlinked_members(members: DataFrame, groups: DataFrame, annotations: DataFrame, file: list[str]) -> DataFrame:
    """(group_id, problem) of groups whose members don't have exactly one annotation that names the
    group: ``missing``, ``repeated``, ``missing and repeated``, or ``unknown`` for one of no group.

    Counts alone are compared: members, annotations and distinct annotated records of each group.
    """
    named = annotations.groupBy("group_id", "source_record_id").agg(F.count(F.lit(1)).alias("n")).groupBy("group_id").agg(F.count(F.lit(1)).alias("annotated"), F.max("n").alias("most"))
    both = groups.select(F.col("artifact_id").alias("group_id"), "distinct_members").join(named, "group_id", "full_outer")
    missing, repeated = F.coalesce("annotated", F.lit(0)) < F.col("distinct_members"), F.coalesce("most", F.lit(1)) > 1
    problem = F.when(F.col("distinct_members").isNull(), "unknown").when(missing & repeated, "missing and repeated").when(missing, "missing").when(repeated, "repeated")
    return both.select("group_id", problem.alias("problem")).where("problem IS NOT NULL")


def incomplete_groups(named: DataFrame, records: DataFrame) -> DataFrame:
    """Members of groups, a row each, without a record, and records without a group: must be empty."""
    named = named.select("source_record_id").withColumn("named", F.lit(1))
    there = records.select("source_record_id").withColumn("there", F.lit(1))
    return named.join(there, "source_record_id", "full_outer").where("named IS NULL OR there IS NULL")

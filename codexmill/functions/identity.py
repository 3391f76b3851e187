"""Content addresses as Column expressions; equal to their published formulas byte for byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of hashed fields, of edges, and of an edge's parts.
FIELD, RECORD, UNIT = "\x00", "\x1e", "\x1f"
SOURCE_RECORD, ASSEMBLY, ANNOTATION, ORACLE_EDITION = "source_record", "assembly", "annotation", "oracle_edition"
INPUT_TYPES = (SOURCE_RECORD, ASSEMBLY, ANNOTATION, ORACLE_EDITION)


def source_record_id(snapshot: Column, checksum: Column, ordinal: Column) -> Column:
    """Id of a physical row: digest of snapshot, file checksum and ordinal."""
    return F.concat(F.lit("srr:sha256:"), F.sha2(F.concat(snapshot, F.lit(FIELD), checksum, F.lit(FIELD), ordinal.cast("string")), 256))


def raw_text_hash(text: Column) -> Column:
    """Digest of a text's UTF-8; null stays null, the empty text has a digest."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def edge(input_type: str, input_id: Column) -> Column:
    return F.struct(F.lit(input_type).alias("input_type"), input_id.alias("input_id"))


def canonical_inputs(inputs: Column) -> Column:
    """Edges in the order of their canonical form."""
    keyed = F.transform(inputs, lambda e: F.struct(F.concat(e["input_type"], F.lit(UNIT), e["input_id"]).alias("k"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def artifact_id(artifact_type: str, inputs: Column, producer: Column | str, version: str, config: Column | str = "") -> Column:
    """Address of a derived artifact: independent of the order of its inputs and of when it was made."""
    canonical = F.array_join(F.array_sort(F.transform(inputs, lambda e: F.concat(e["input_type"], F.lit(UNIT), e["input_id"]))), RECORD)
    name = F.lit(producer) if isinstance(producer, str) else producer
    conf = F.lit(config) if isinstance(config, str) else config
    return F.concat(F.lit("art:sha256:"), F.sha2(F.concat_ws(FIELD, F.lit(artifact_type), name, F.lit(version), conf, canonical), 256))


def payload_hash(artifact_type: str, body: Column) -> Column:
    """Address of a conclusion. ``body`` is a struct whose fields, and those of structs in it, are in
    alphabetical order; nulls are written, and control characters escaped in small letters."""
    text = F.to_json(F.struct(body.alias("p"), F.lit(artifact_type).alias("t")), {"ignoreNullFields": "false"})
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # those whose escape has a letter
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u00{code:02X}", rf"$1\\u00{code:02x}")
    return F.concat(F.lit("pay:sha256:"), F.sha2(text, 256))


def source_identity_key(state: Column, corpus: Column, act_id: Column) -> Column:
    return F.concat(state, F.lit("|"), corpus, F.lit("|"), act_id)


def segment_fingerprint(act_id: Column, text_hash: Column, occurrence: Column) -> Column:
    """A missing digest is written ``None``."""
    return F.concat(act_id, F.lit("|"), F.coalesce(text_hash, F.lit("None")), F.lit("|"), occurrence.cast("string"))

"""The fixed 24-column snapshot contract and the closed vocabularies of the derived artifacts."""

from __future__ import annotations

from pyspark.sql import types as T

#: The snapshot row, in contract order.
SNAPSHOT_COLUMNS = (
    "act_id", "citation", "citation_short", "state", "jurisdiction", "document_type",
    "title_number", "title_name", "chapter", "chapter_name", "section_number", "section_title",
    "breadcrumb", "display_path", "act_status", "text", "word_count", "source_url",
    "last_amended_year", "subsection_count", "cross_references_usc", "cross_references_cfr",
    "public_laws_referenced", "year",
)
INTEGER_COLUMNS = ("word_count", "last_amended_year", "subsection_count", "year")
STRING_COLUMNS = tuple(c for c in SNAPSHOT_COLUMNS if c not in INTEGER_COLUMNS)

SNAPSHOT_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c in INTEGER_COLUMNS else T.StringType()) for c in SNAPSHOT_COLUMNS]
)

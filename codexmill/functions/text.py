"""Scalar rules on citation keys, statuses and bodies, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and vocabularies of the snapshot contract.
NAMESPACE = "^[A-Za-z]+"
PREFIX = "^([A-Z]+(?:_[A-Z]{2})?)_"
POINTER = r"(?i)(Renumbered|Transferred|Omitted|Repealed|Recodified|See)\s+§+\s*([0-9A-Za-z.\-]+)"
SUCCESSOR = r"(?i)(Renumbered|Transferred|Recodified)\s+§+\s*([0-9A-Za-z.\-]+)"
NOTES = "\n(?:Editorial Notes|Statutory Notes|Amendments)\n"
LINEAGE_STATUSES = ("renumbered", "transferred", "recodified", "superseded", "omitted")
POINTER_STATUSES = (*LINEAGE_STATUSES, "repealed")
MOVE_STATUSES = ("renumbered", "transferred", "recodified")
HIERARCHY_FIELDS = ("title_number", "chapter", "section_number")
CROSSWALK_COLUMNS = ("formerly_cited_as", "renumbered_from", "renumbered_to", "transferred_from", "transferred_to", "predecessor", "successor", "former_citation", "history")
SHA256, SHA1, RECORD_HASH = "^[0-9a-f]{64}$", "^[0-9a-f]{40}$", "^sha256:[0-9a-f]{64}$"


#: Decimal digits of all scripts but ASCII, and what they stand for.
_DIGITS = "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isdecimal())
_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def namespace(act_id: Column) -> Column:
    """Leading letters; none gives an empty string, null stays null."""
    return F.regexp_extract(act_id, NAMESPACE, 0)


def prefix(act_id: Column) -> Column:
    """Namespace with its state, or ``<no-prefix>``."""
    found = F.regexp_extract(act_id, PREFIX, 1)
    return F.when(found == "", F.lit("<no-prefix>")).otherwise(found)


def act_id_prefix(act_id: Column) -> Column:
    """What stands before the first underscore; null for a null or empty id."""
    return F.when(act_id != "", F.substring_index(act_id, "_", 1))


def has_pointer(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(POINTER)), F.lit(False))


def successor_number(text: Column) -> Column:
    """The section to which a moved section points, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), SUCCESSOR, 2), F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def left_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def operative(text: Column) -> Column:
    """The body before its first notes heading; null counts as empty."""
    return stripped(F.element_at(F.split(F.coalesce(text, F.lit("")), NOTES, 2), 1))


def list_filled(value: Column) -> Column:
    """Whether a column that holds a JSON array as text has an element; null counts as no."""
    return F.coalesce((value != "") & (value != "[]"), F.lit(False))


def list_size(value: Column) -> Column:
    """Elements of such a column, counted by their separators."""
    return F.when(list_filled(value), F.regexp_count(value, F.lit('", "')) + 1).otherwise(0)


def text_slice(text: Column, start: int, end: int) -> Column:
    """Code points from ``start`` to before ``end``, both from 0 on."""
    return F.substring(text, start + 1, end - start)


def numeric_id(identifier: Column) -> Column:
    """Whether an identifier is digits but for dots and hyphens; null and empty aren't."""
    return F.coalesce(F.rlike(F.translate(identifier, ".-", ""), F.lit(r"(?U)^\d+$")), F.lit(False))


def natural_key(identifier: Column) -> Column:
    """Sort key under which 6.10 follows 6.9, digits precede letters, and null is last.

    Runs of digits become their length and their digits behind a 0, others stand behind a 1, so that
    comparing arrays of strings compares them as numbers, however long, and as text. Digits of all
    scripts are digits.
    """
    runs = F.regexp_extract_all(F.translate(identifier, _DIGITS, _DIGIT_VALUES), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda t: F.regexp_replace(t, "^0+(?=[0-9])", "")
    keyed = F.transform(runs, lambda t: F.when(F.rlike(t, F.lit("^[0-9]")), F.concat(F.lit("0"), F.lpad(F.length(bare(t)).cast("string"), 10, "0"), bare(t))).otherwise(F.concat(F.lit("1"), t)))
    return F.struct(identifier.isNull().alias("last"), keyed.alias("runs"))


def corpus_of_file(name: Column, strict: bool = True) -> Column:
    """``us_{juris}_{corpus}.parquet`` to its corpus. ``strict`` demands the leading ``us``; without,
    any three parts do. A name of another form gives itself without its suffix."""
    stem = F.regexp_replace(name, r"\.parquet$", "")
    parts = F.split(stem, "_")
    fits = (F.size(parts) >= 3) & ((parts[0] == "us") if strict else F.lit(True))
    return F.when(fits, F.array_join(F.slice(parts, 3, 1000), "_")).otherwise(stem)


def juris_of_file(name: Column) -> Column:
    parts = F.split(F.regexp_replace(name, r"\.parquet$", ""), "_")
    return F.when((F.size(parts) >= 3) & (parts[0] == "us"), parts[1]).otherwise("?")

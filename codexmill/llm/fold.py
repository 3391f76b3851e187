"""Records that differ only in white space, case, punctuation or the order of labelled fields.

Columns are dictionary-encoded: each distinct value that a task reads is canonicalised once (its
letters and digits, case folded), a text being taken apart into its labelled fields and its body; to
do so once for all tasks would mean to shuffle the texts. The distinct canonical values of all tasks
form one dictionary per column, which gives each an integer. A record then is a sorted tuple of
(column, integer) pairs, and copies are records with equal tuples.

Scale: values leave the first stage as 128-bit digests, never as text. Values that only one record
has can't be shared, so such records are dropped before their tuple is built. Joins with the
dictionary and with the groups go by :func:`join_by_weight`, so a value or a group of copies that
holds a third of all records doesn't meet in one task; grouping itself is pre-aggregated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.llm.words import find_words
from codexmill.operators.batches import by_bytes
from codexmill.operators.skew import join_by_weight
from codexmill.operators.workspace import discard, written

#: Labels of the fields that may open a text. Their place is their column in tuples.
LABELS = ("authority", "source", "effective", "agency")
KEY, BODY, FIRST_FIELD = 0, 1, 2

_LONGEST_LABEL = max(map(len, LABELS))
_word = re.compile(r"[^\W_]+").finditer
_BLANK_LINE = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)")
_SEPARATOR = re.compile(r"[|;\r\n]")
_FIELD = re.compile(rf"\s*({'|'.join(LABELS)})\s*:(.*)", re.IGNORECASE | re.DOTALL)


def letters(text: str | None) -> str:
    """The letters and digits of a text, case folded."""
    return "".join(find_words(text.casefold())) if text else ""


def labelled_fields(text: str) -> tuple[list[tuple[int, str]], str]:
    """The fields that open a text, as (column, value), and the rest; no fields if it has no such opening.

    The opening is in square brackets or ends at an empty line, and consists of fields only.
    """
    bare = text.lstrip()
    if bare[:1] == "[":
        head, end, rest = bare[1:].partition("]")
        if not end:
            return [], text
    elif _FIELD.match(bare) and (m := _BLANK_LINE.search(bare)):
        head, rest = bare[: m.start()], bare[m.end() :]
    else:
        return [], text
    parts = [_FIELD.fullmatch(p) for p in _SEPARATOR.split(head) if p.strip()]
    if not parts or None in parts:
        return [], text
    return [(FIRST_FIELD + LABELS.index(p[1].lower()), p[2]) for p in parts], rest


def _digest(value: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(value.encode("utf-8", "surrogatepass"))
    high, low = d >> 64, d & ((1 << 64) - 1)
    return high - ((high >> 63) << 64), low - ((low >> 63) << 64)


def _text_entries(text: str | None, min_words: int) -> list[tuple[int, int, int]] | None:
    if not text or len(find_words(text)) < min_words:
        return None
    fields, body = labelled_fields(text)
    return [(BODY, *_digest(letters(body))), *((c, *_digest(letters(v))) for c, v in fields)]


def _opening(text: str | None) -> bool:
    """Whether the letters of a text begin with a label, whatever stands before and between them."""
    first = ""
    for m in _word(text or ""):
        first += m[0].casefold()
        if len(first) >= _LONGEST_LABEL:
            break
    return first.startswith(LABELS)


class Canonical(dict):
    """What a function makes of each distinct value, by the value's digest; it starts anew when full."""

    def __init__(self, of: Callable, most: int = 100_000):
        self.of, self.most = of, most

    def value(self, raw: str | None):
        if raw is None:
            return self.of(None)
        key = xxhash.xxh3_128_digest(raw.encode("utf-8", "surrogatepass"))
        found = self.get(key, self)
        if found is self:
            if len(self) >= self.most:
                self.clear()
            found = self[key] = self.of(raw)
        return found


_ENTRY = pa.list_(pa.struct([("column", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))


def encode_values(df: DataFrame, row_id: str, key: str, text: str, min_words: int) -> DataFrame:
    """One row per record with enough words: its number, id, and the digests of its canonical values.

    ``plain`` is the digest of key and text as they stand, for texts that begin with a label.
    """
    schema = T.StructType([T.StructField("row_id", df.schema[row_id].dataType), T.StructField("plain", T.LongType()), T.StructField("fields", T.IntegerType()),
                           T.StructField("entries", T.ArrayType(T.StructType([T.StructField("column", T.IntegerType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_key = Canonical(lambda v: (v := letters(v), (KEY, *_digest(v))))
        of_text = Canonical(lambda v: (e := _text_entries(v, min_words), e is not None and _opening(v)))
        for batch in by_bytes(batches, 2):
            take, plain, fields, entries = [], [], [], []
            for i, (k, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                parts, opens = of_text.value(t)
                if parts is None:
                    continue
                key, entry = of_key.value(k)
                take.append(i)
                entries.append([entry, *parts])
                fields.append(len(parts) - 1)
                plain.append(_digest(f"{key} {letters(t)}")[0] if opens else None)
            rows = [[{"column": c, "high": h, "low": low} for c, h, low in e] for e in entries]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(plain, pa.int64()), pa.array(fields, pa.int32()), pa.array(rows, _ENTRY)],
                names=schema.names,
            )

    source = df.select(F.col(row_id), F.col(key).cast("string").alias("__key"), F.col(text).cast("string").alias("__text"))
    return source.mapInArrow(run, schema).withColumn("number", F.monotonically_increasing_id())


def encoded_records(df: DataFrame, row_id: str, key: str, text: str, min_words: int) -> DataFrame:
    """A written table of :func:`encode_values`. A text that begins with a label but isn't set off as
    fields takes the entries of a record with the same letters that is, if there is one."""
    records = written(encode_values(df, row_id, key, text, min_words), "fold-records")
    loose = records.where(F.col("plain").isNotNull() & (F.col("fields") == 0))
    if not loose.take(1):
        return records
    parsed = records.where(F.col("plain").isNotNull() & (F.col("fields") > 0)).groupBy("plain").agg(F.min("entries").alias("better"))
    # One row per digest with its number of rows, so that one that many have doesn't meet in one task.
    known = written(loose.groupBy("plain").agg(F.count(F.lit(1)).alias("__n")).join(parsed, "plain", "left"), "fold-openings")
    mended = join_by_weight(loose, known, ["plain"], "__n").withColumn("entries", F.coalesce("better", "entries")).drop("better", "__n")
    out = written(records.where(~(F.col("plain").isNotNull() & (F.col("fields") == 0))).unionByName(mended), "fold-mended")
    discard(records, known)
    return out


def record_tuples(records: DataFrame) -> DataFrame:
    """(row_id, number, tuple) of the records all of whose values another record has too, a written table."""
    values = records.select("number", F.explode("entries").alias("e")).select("number", "e.*")
    dictionary = written(
        values.groupBy("column", "high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("id", F.monotonically_increasing_id()),
        "fold-dictionary",
    )
    coded = join_by_weight(values, dictionary, ["column", "high", "low"], "n").groupBy("number").agg(
        F.sort_array(F.collect_list(F.struct("column", "id"))).alias("tuple")
    )
    tuples = written(records.join(coded, "number").where(F.size("tuple") == F.size("entries")).select("row_id", "number", "tuple"), "fold-tuples")
    discard(dictionary)
    return tuples


def formatting_groups(df: DataFrame, row_id: str = "row_id", key: str = "act_id", text: str = "text", min_words: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, tuples and groups (tuple, kept, copies) of two or more copies, all written tables."""
    records = encoded_records(df, row_id, key, text, min_words)
    tuples = record_tuples(records)
    groups = written(
        tuples.groupBy("tuple").agg(F.min(F.struct("row_id", "number")).alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "fold-groups"
    )
    return records, tuples, groups


def formatting_copies(df: DataFrame, row_id: str = "row_id", key: str = "act_id", text: str = "text", min_words: int = 30) -> DataFrame:
    """(kept_row_id, row_id): each record but the first, by id, of a group of copies.

    Defined cases: texts with fewer than ``min_words`` words, null and empty ones included, are no
    one's copies. A null key has no letters. Repeated rows are copies of each other, also under one
    id. Other columns are never read. An empty table gives no rows.
    """
    records, tuples, groups = formatting_groups(df, row_id, key, text, min_words)
    discard(records)
    return (
        join_by_weight(tuples, groups, ["tuple"], "copies")
        .where(F.col("number") != F.col("kept.number"))
        .select(F.col("kept.row_id").alias("kept_row_id"), "row_id")
    )


def collapsed_records(df: DataFrame, row_id: str = "row_id", key: str = "act_id", text: str = "text", min_words: int = 30) -> DataFrame:
    """(row_id, copies): one row per record that stays, with the number of records it stands for.

    Records with fewer than ``min_words`` words aren't compared and don't appear.
    """
    records, tuples, groups = formatting_groups(df, row_id, key, text, min_words)
    shared = join_by_weight(tuples, groups, ["tuple"], "copies").select("number")
    return groups.select("kept.row_id", "copies").unionByName(
        records.join(shared, "number", "left_anti").select("row_id", F.lit(1).cast("long").alias("copies"))
    )

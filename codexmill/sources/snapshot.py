"""Snapshot files: validated lossless scan, manifest, checksums and pinned revisions.

Physical place is ``_metadata.row_index``, which filters and splits leave alone. Footers are read and
file bytes are hashed on the executors, in chunks, one file per row. Paths may be local or URIs of any
file system that pyarrow opens.
"""

from __future__ import annotations

import fnmatch
import glob
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions import identity as I
from codexmill.functions import text as X
from codexmill.operators.skew import small_side
from codexmill.schema import INTEGER_COLUMNS, SNAPSHOT_COLUMNS, SNAPSHOT_SCHEMA


class SchemaMismatch(ValueError):
    """A file that doesn't have the contract's columns, in order and type."""


def schema_problem(schema: pa.Schema) -> str | None:
    """What of a file's schema breaks the contract, or None."""
    names = list(schema.names)
    missing, extra = [c for c in SNAPSHOT_COLUMNS if c not in names], [c for c in names if c not in SNAPSHOT_COLUMNS]
    if missing or extra:
        return f"missing {missing}, extra {extra}"
    if names != list(SNAPSHOT_COLUMNS):
        return "columns out of order"
    for f in schema:
        if f.name in INTEGER_COLUMNS:
            if not pa.types.is_integer(f.type):
                return f"{f.name} is {f.type}, not an integer"
        elif not (pa.types.is_string(f.type) or pa.types.is_large_string(f.type)):
            return f"{f.name} is {f.type}, not a string"
    return None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def expand(pattern: str | list[str]) -> list[str]:
    """Files of globs or literal paths, sorted, each once; a relative path starts from the working
    directory. A pattern or path that no file fits is an error."""
    found: set[str] = set()
    for p in [pattern] if isinstance(pattern, str) else pattern:
        hits = [h for h in _matches(p) if h.endswith(".parquet")]
        if not hits:
            raise FileNotFoundError(f"no Parquet file fits {p}")
        found.update(hits)
    return sorted(found)


def _matches(pattern: str) -> list[str]:
    wild = re.search(r"[*?\[]", pattern)
    if "://" not in pattern:
        return [os.path.abspath(x) for x in glob.glob(pattern, recursive=True)] if wild else [os.path.abspath(pattern)] * os.path.exists(pattern)
    system, path = _opened(pattern[: wild.start()].rpartition("/")[0] if wild else pattern)
    root = pattern[: pattern.index("://") + 3]
    if not wild:
        return [pattern] if system.get_file_info(path).type != fs.FileType.NotFound else []
    tail = pattern[wild.start() :]
    below = system.get_file_info(fs.FileSelector(path, recursive="/" in tail, allow_not_found=True))
    named = {i.path: root + i.path for i in below if i.type == fs.FileType.File}
    rest = pattern[len(pattern[: wild.start()].rpartition("/")[0]) + 1 :]
    return [uri for at, uri in named.items() if fnmatch.fnmatchcase(at[len(path) :].lstrip("/"), rest)]


_FOOTER = "path string, columns array<string>, problem string, n_rows bigint, row_groups int, checksum string"


def read_footers(spark: SparkSession, paths: list[str], hashed: bool = True, chunk: int = 1 << 20) -> DataFrame:
    """Per file its columns, what breaks the contract, rows, row groups and, if asked for, checksum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                system, at = _opened(p)
                with system.open_input_file(at) as f:
                    file = pq.ParquetFile(f)
                    schema, meta = file.schema_arrow, file.metadata
                    out.append((p, list(schema.names), schema_problem(schema), meta.num_rows, meta.num_row_groups))
                digest = hashlib.sha256()
                if hashed:
                    with system.open_input_stream(at) as f:
                        while block := f.read(chunk):
                            digest.update(block)
                out[-1] += (digest.hexdigest() if hashed else None,)
            yield pd.DataFrame(out, columns=["path", "columns", "problem", "n_rows", "row_groups", "checksum"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths), 10_000)), "path").mapInPandas(run, _FOOTER)


def file_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, checksum) of files, hashed on the executors without loading any whole."""
    return read_footers(spark, paths).select("path", "checksum")


def _columns(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, list[str]]]:
    return [(r["path"].rpartition("/")[2], r["columns"]) for r in read_footers(spark, expand(paths), hashed=False).orderBy("path").collect()]


def schema_groups(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the columns that they have, in order; one group if all agree."""
    out: dict[tuple[str, ...], list[str]] = {}
    for name, columns in _columns(spark, paths):
        out.setdefault(tuple(columns), []).append(name)
    return out


def column_differences(spark: SparkSession, paths: str | list[str]) -> dict[str, tuple[list[str], list[str]]]:
    """Per file the columns of the contract that it lacks and those that it has besides."""
    return {name: ([c for c in SNAPSHOT_COLUMNS if c not in columns], [c for c in columns if c not in SNAPSHOT_COLUMNS]) for name, columns in _columns(spark, paths)}


def crosswalk_columns(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Columns of any file that would state a predecessor or successor."""
    found = {c for _, columns in _columns(spark, paths) for c in columns}
    return [c for c in X.CROSSWALK_COLUMNS if c in found]


def scan_snapshot(spark: SparkSession, paths: str | list[str], snapshot: str, verify: dict[str, str] | None = None) -> DataFrame:
    """Every row of the files with file, checksum, ordinal, record id and digest of its text.

    A pattern that fits no file, a file that breaks the contract, two files of one name, or a checksum
    that differs from ``verify`` is an error before anything is read. An empty list of paths gives an
    empty table. Null and empty texts stay what they are.
    """
    files = expand(paths)
    if not files:
        return with_record_ids(spark.createDataFrame([], T.StructType([*SNAPSHOT_SCHEMA, *(T.StructField(n, k) for n, k in (("source_file", T.StringType()), ("ordinal", T.LongType()), ("checksum", T.StringType())))])), snapshot)
    read = read_footers(spark, files).orderBy("path").collect()  # a row per file
    for r in read:
        if r["problem"]:
            raise SchemaMismatch(f"{r['path'].rpartition('/')[2]}: {r['problem']}")
    sums = {r["path"].rpartition("/")[2]: r["checksum"] for r in read}
    if len(sums) < len(read):
        raise ValueError("two files of one name")
    for name, want in (verify or {}).items():
        if name in sums and sums[name] != want:
            raise ValueError(f"{name}: checksum differs")
    rows = spark.read.schema(SNAPSHOT_SCHEMA).parquet(*files).select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("ordinal"))
    known = spark.createDataFrame(list(sums.items()), "source_file string, checksum string")
    return with_record_ids(rows.join(small_side(known), "source_file"), snapshot)


def with_record_ids(rows: DataFrame, snapshot: str) -> DataFrame:
    return rows.withColumns(
        {
            "snapshot_version": F.lit(snapshot),
            "corpus": X.corpus_of_file(F.col("source_file"), strict=False),
            "source_record_id": I.source_record_id(F.lit(snapshot), F.col("checksum"), F.col("ordinal")),
            "raw_text_hash": I.raw_text_hash(F.col("text")),
        }
    )


def build_manifest(spark: SparkSession, paths: str | list[str], snapshot: str) -> list[dict]:
    """Per file: rows, row groups, checksum, whether schema and listed checksum fit, first and last id."""
    files = expand(paths)
    listed = listed_checksums(files)
    out = []
    for r in read_footers(spark, files).orderBy("path").collect() if files else []:
        name, n = r["path"].rpartition("/")[2], r["n_rows"]
        ids = [_record_id(snapshot, r["checksum"], i) for i in ((0, n - 1) if n else ())]
        out.append(
            {"file": name, "rows": n, "row_groups": r["row_groups"], "checksum": r["checksum"], "schema_ok": r["problem"] is None,
             "checksum_ok": r["checksum"] == listed[name] if name in listed else None, "first_id": ids[0] if ids else None, "last_id": ids[-1] if ids else None}
        )
    return out


def _record_id(snapshot: str, checksum: str, ordinal: int) -> str:
    return "srr:sha256:" + hashlib.sha256(f"{snapshot}{I.FIELD}{checksum}{I.FIELD}{ordinal}".encode()).hexdigest()


def listed_checksums(files: list[str]) -> dict[str, str]:
    """The first ``SHA256SUMS.json`` beside the files; none or a damaged one lists nothing."""
    for folder in dict.fromkeys(p.rpartition("/")[0] for p in files):
        system, at = _opened(f"{folder}/SHA256SUMS.json")
        if system.get_file_info(at).type == fs.FileType.File:
            try:
                with system.open_input_stream(at) as f:
                    return {e["file"]: e["sha256"] for e in json.loads(f.read())}
            except (ValueError, KeyError, TypeError):
                return {}
    return {}


def resolve_revision(ref: str, pinned: str | None, resolver: Callable[[str], str]) -> str:
    """An immutable 40-digit revision for a ref, which must be the pinned one if there is one."""
    found = ref if re.fullmatch(X.SHA1, ref) else resolver(ref)
    if not re.fullmatch(X.SHA1, found or ""):
        raise ValueError(f"{ref!r} doesn't resolve to a revision")
    if pinned is not None and found != pinned:
        raise ValueError(f"{ref!r} is {found}, pinned is {pinned}")
    return found


def checksum_problems(staged: DataFrame, manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, problem): staged files that the manifest lacks or lists otherwise, expected ones missing."""
    m = manifest.select("file", F.col("sha256").alias("listed"))
    wrong = staged.join(m, "file", "left").select("file", F.when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("sha256"), "differs").alias("problem")).where("problem IS NOT NULL")
    return wrong.unionByName(expected.join(staged, "file", "left_anti").select("file", F.lit("missing").alias("problem")))


def matching_revision(staged: dict[str, str], revisions: list[str], manifest_of: Callable[[str], dict[str, str]]) -> str | None:
    """The first revision whose manifest lists every staged file with its checksum."""
    return next((r for r in revisions if staged.items() <= manifest_of(r).items()), None)


def write_download_metadata(path: str, snapshot: str, revision: str, files: dict[str, str]) -> None:
    Path(path).write_text(json.dumps({"snapshot": snapshot, "dataset_revision": revision, "files": [{"file": f, "sha256": s} for f, s in sorted(files.items())]}, indent=2) + "\n")

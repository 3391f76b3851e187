"""Queries of the snapshot files, their manifests and pins, the registry and the reports, and their SQL.

The files are made from the loads of ``law_rows``, one file per load, in the contract's order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as X
from codexmill.operators import artifacts as A
from codexmill.operators.workspace import temporary_path
from codexmill.plans import audit_queries as Q
from codexmill.plans import reports
from codexmill.schema import SNAPSHOT_COLUMNS
from codexmill.sources import registry, snapshot
from codexmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# --------------------------------------------------------------------------- files

_files: dict[tuple[str, str], dict[str, list[str]]] = {}


def snapshot_files(spark: SparkSession, d: str) -> dict[str, list[str]]:
    """By snapshot version, the files of its loads, rows in physical order; written once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _files:
        rows = Q.law(spark, d).withColumn("__file", F.concat("snapshot", F.lit("="), "source_file"))
        # A file is one task's work: its rows are sorted, which spills, and written as they pass by.
        base = temporary_path(spark, "files")
        rows.repartition("load_id").sortWithinPartitions("load_id", "row_ordinal").select("__file", *SNAPSHOT_COLUMNS).write.partitionBy("__file").parquet(base)
        path = spark._jvm.org.apache.hadoop.fs.Path
        system = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
        out: dict[str, list[str]] = {}
        for folder in system.listStatus(path(base)):  # a folder per load
            name = folder.getPath().getName()
            if name.startswith("__file="):
                version, _, file = name.removeprefix("__file=").replace("%3D", "=").partition("=")
                part = next(s.getPath() for s in system.listStatus(folder.getPath()) if s.getPath().getName().endswith(".parquet"))
                to = path(f"{base}/{version}/{file}")
                system.mkdirs(to.getParent())
                system.rename(part, to)
                out.setdefault(version, []).append(f"{base}/{version}/{file}")
        _files[key] = {v: sorted(p) for v, p in sorted(out.items())}
    return _files[key]


_PLACES = (
    Q._LAW
    + ", placed AS (SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY row_ordinal) - 1 AS ordinal, count(*) OVER (PARTITION BY load_id) AS n_rows FROM law)"
)


@query(_PLACES + " SELECT snapshot AS snapshot_version, source_file, ordinal, act_id, word_count, year, 'sha256:' || sha256(text) AS raw_text_hash, regexp_extract(source_file, '^us_[^_]+_(.*)\\.parquet$', 1) AS corpus FROM placed")
def scanned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every file, by its physical place."""
    out = None
    for version, files in snapshot_files(spark, d).items():
        rows = snapshot.scan_snapshot(spark, files, version).select("snapshot_version", "source_file", "ordinal", "act_id", "word_count", "year", "raw_text_hash", "corpus")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_PLACES + " SELECT snapshot AS snapshot_version, any_value(source_file) AS file, count(*) AS n_rows, true AS schema_ok, true AS checksum_ok, true AS ids_ok FROM placed GROUP BY load_id, snapshot")
def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of the files: rows, contract, checksums as hashed twice, first and last record id."""
    out = []
    for version, files in snapshot_files(spark, d).items():
        sums = {r["path"]: r["checksum"] for r in snapshot.file_checksums(spark, files).collect()}
        by_name = {p.rpartition("/")[2]: s for p, s in sums.items()}
        edges = snapshot.scan_snapshot(spark, files, version, by_name).groupBy("source_file").agg(F.min_by("source_record_id", "ordinal").alias("a"), F.max_by("source_record_id", "ordinal").alias("b"))
        ends = {r["source_file"]: (r["a"], r["b"]) for r in edges.collect()}  # a row per file
        for m in snapshot.build_manifest(spark, files, version):
            out.append((version, m["file"], m["rows"], m["schema_ok"], m["checksum"] == by_name[m["file"]], (m["first_id"], m["last_id"]) == ends[m["file"]]))
    return spark.createDataFrame(out, "snapshot_version string, file string, n_rows long, schema_ok boolean, checksum_ok boolean, ids_ok boolean")


_TABLES = ("law_rows", "source_records", "snapshot_rows", "file_loads", "documents")
_WANTED = ", ".join(f"'{c}'" for c in SNAPSHOT_COLUMNS)


@query(
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS name, column_name FROM (DESCRIBE {t})" for t in _TABLES)
    + f"), w AS (SELECT unnest([{_WANTED}]) AS column_name), n AS (SELECT unnest([{', '.join(repr(t) for t in _TABLES)}]) AS name)"
    + """ SELECT name, column_name, 'missing' AS problem FROM n, w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.name = n.name AND c.column_name = w.column_name)
UNION ALL SELECT name, column_name, 'besides' FROM c WHERE column_name NOT IN (SELECT column_name FROM w)"""
)
def contract_differences(spark: SparkSession, d: str) -> DataFrame:
    """What the columns of the given tables lack of the contract, and have besides."""
    out = []
    for name in _TABLES:
        columns = table(spark, d, name).columns
        out += [(name, c, "missing") for c in SNAPSHOT_COLUMNS if c not in columns] + [(name, c, "besides") for c in columns if c not in SNAPSHOT_COLUMNS]
    return spark.createDataFrame(out, "name string, column_name string, problem string")


@query("SELECT DISTINCT source_file, regexp_extract(source_file, '^us_[^_]+_(.*)\\.parquet$', 1) AS corpus, regexp_extract(source_file, '^us_([^_]+)_', 1) AS juris FROM file_loads")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("source_file")
    return table(spark, d, "file_loads").select("source_file", X.corpus_of_file(name).alias("corpus"), X.juris_of_file(name).alias("juris")).distinct()


@query("SELECT row_id, substring(text, 11, 20) AS part FROM law_rows")
def text_slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_rows").select("row_id", X.text_slice(F.col("text"), 10, 30).alias("part"))


# --------------------------------------------------------------------------- pins


_VERSIONS = """WITH v AS (SELECT snapshot_version, row_number() OVER (ORDER BY snapshot_version DESC) AS k FROM (SELECT DISTINCT snapshot_version FROM file_loads)),
f AS (SELECT f.source_file AS file, f.sha256, v.k FROM file_loads f JOIN v USING (snapshot_version))"""


def _listed(spark: SparkSession, d: str) -> tuple[list[str], Callable[[str], DataFrame]]:
    loads = table(spark, d, "file_loads")
    versions = sorted((r[0] for r in loads.select("snapshot_version").distinct().collect()), reverse=True)  # a row per snapshot
    return versions, lambda v: loads.where(F.col("snapshot_version") == v).select(F.col("source_file").alias("file"), "sha256")


@query(
    _VERSIONS
    + """ SELECT a.file, CASE WHEN b.file IS NULL THEN 'unlisted' ELSE 'differs' END AS problem FROM f a LEFT JOIN f b ON b.file = a.file AND b.k = 2 WHERE a.k = 1 AND b.sha256 IS DISTINCT FROM a.sha256
UNION ALL SELECT e.file, 'missing' FROM f e WHERE e.k = 3 AND e.file NOT IN (SELECT file FROM f WHERE k = 1)"""
)
def staged_files(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot's files against the manifest of the one before, and the expected ones of the one before that."""
    versions, listed = _listed(spark, d)
    return snapshot.checksum_problems(listed(versions[0]), listed(versions[1]), listed(versions[2]))


@query(_VERSIONS + " SELECT snapshot_version AS staged, snapshot_version AS revision, 40::INTEGER AS digits FROM v")
def pinned_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Which revision each snapshot's files are of, by their checksums; a ref resolves to it and must be pinned."""
    versions, listed = _listed(spark, d)
    manifests = {v: {r["file"]: r["sha256"] for r in listed(v).collect()} for v in versions}  # a row per file
    out = []
    for v in versions:
        found = snapshot.matching_revision(manifests[v], versions, manifests.__getitem__)
        sha1 = hashlib.sha1(found.encode()).hexdigest()
        out.append((v, found, len(snapshot.resolve_revision("main", sha1, lambda ref: sha1))))  # noqa: B023
    return spark.createDataFrame(out, "staged string, revision string, digits int")


# --------------------------------------------------------------------------- registry

_EDITIONS = """WITH e AS (SELECT CASE WHEN declared_rows IS NULL THEN '' ELSE 'oracle:' END || source_file || '@' || snapshot_version AS id, CASE WHEN corpus = 'guidance' THEN 'http' ELSE 'https' END || '://' || juris || '.example/' AS url,
  CASE WHEN corpus <> 'court_rules' THEN source_file END AS path, sha256, strftime(delivered_at, '%Y-%m-') || CASE WHEN corpus = 'statutes' THEN '32' ELSE '01' END AS day, corpus, snapshot_version FROM file_loads)"""


@query(
    _EDITIONS
    + """ SELECT id AS key, 'id' AS rule FROM e WHERE id NOT LIKE 'oracle:%' UNION ALL SELECT id, 'date' FROM e WHERE day LIKE '%-32' UNION ALL SELECT id, 'https' FROM e WHERE url NOT LIKE 'https:%'
UNION ALL SELECT id, 'path and digest' FROM e WHERE (path IS NULL) <> (sha256 IS NULL) UNION ALL SELECT id, 'digest' FROM e WHERE NOT regexp_matches(sha256, '^[0-9a-f]{64}$')
UNION ALL SELECT DISTINCT corpus, 'known edition' FROM e UNION ALL SELECT DISTINCT corpus, 'skew is established' FROM e WHERE corpus <> 'statutes'"""
)
def registry_problems(spark: SparkSession, d: str) -> DataFrame:
    """The rules of a registry made of the loads: statutes have impossible dates, guidance no https, court
    rules a digest without a path, undeclared loads an id without its mark, corpora an edition that none knows."""
    loads = table(spark, d, "file_loads")
    on = lambda c, yes, no: F.when(F.col("corpus") == c, yes).otherwise(no)
    editions = loads.select(
        F.concat(F.when(F.col("declared_rows").isNull(), F.lit("")).otherwise(F.lit("oracle:")), "source_file", F.lit("@"), "snapshot_version").alias("oracle_edition"),
        F.concat(F.date_format("delivered_at", "yyyy-MM-"), on("statutes", F.lit("32"), F.lit("01"))).alias("edition_date"),
        F.concat(on("guidance", F.lit("http"), F.lit("https")), F.lit("://"), "juris", F.lit(".example/")).alias("source_url"),
        F.when(F.col("corpus") != "court_rules", F.col("source_file")).alias("local_path"),
        "sha256",
    )
    corpora = loads.select("corpus").distinct().select(
        "corpus",
        on("statutes", F.lit("2026-01-01"), F.lit(None)).alias("snapshot_content_cutoff"),
        on("statutes", F.lit("established"), F.lit("unresolved")).alias("cutoff_status"),
        F.lit("notice").alias("basis"),
        F.lit("oracle:none").alias("comparison_oracle_edition"),
        F.lit(1).cast("long").alias("residual_skew_days"),
    )
    head = spark.createDataFrame([("v1", "r", "2026-02-01", False)], "snapshot string, dataset_revision string, repository_commit_date string, repository_commit_date_is_content_cutoff boolean")
    return registry.registry_violations(head, editions, corpora)


@query(Q._LAW + Q._MEMBERS + ", n AS (SELECT id, act_status FROM k) SELECT id AS source_record_id, 'no record' AS problem FROM n WHERE act_status = 'omitted' UNION ALL SELECT id, 'no group' FROM (SELECT " + Q._SRR + " AS id, act_status FROM law) a WHERE act_status IS DISTINCT FROM 'omitted' AND id NOT IN (SELECT id FROM n)")
def group_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Members without a record, those of omitted records being taken away, and records without a group."""
    rows = Q.records(spark, d)
    there = rows.where(~F.coalesce(F.col("act_status") == "omitted", F.lit(False)))
    found = A.incomplete_groups(Q._members(spark, d).where("reject IS NULL"), there)
    return found.select("source_record_id", F.when(F.col("there").isNull(), "no record").otherwise("no group").alias("problem"))


# --------------------------------------------------------------------------- reports


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "line_no int, line string")


@query(
    Q._LAW
    + """, p AS (SELECT corpus, count(*) AS n, count(*) FILTER (WHERE title_number <> '' AND chapter <> '' AND section_number <> '') AS whole, count(*) FILTER (WHERE act_status IS NULL) AS nulls FROM law GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY corpus) AS k, '| ' || corpus || ' | ' || format('{:,}', n) || ' | ' || printf('%.1f%%', 100 * whole / n) || ' | ' || CASE WHEN nulls > 0 THEN 'yes' ELSE 'no' END || ' |' AS line FROM p)
SELECT (k + 3)::INTEGER AS line_no, line FROM r UNION ALL SELECT unnest([0, 1, 2, 3])::INTEGER, unnest(['## Corpora', '', '| corpus | n_rows | complete_rate | without_status |', '|---|---|---|---|'])"""
)
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """A report's table as its lines: thousands, percentages, and yes or no."""
    whole = F.lit(True)
    for c in X.HIERARCHY_FIELDS:
        whole &= F.coalesce(F.col(c) != "", F.lit(False))
    rows = Q.law(spark, d).groupBy("corpus").agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.when(whole, 1)) / F.count(F.lit(1))).alias("complete_rate"), (F.count(F.when(F.col("act_status").isNull(), 1)) > 0).alias("without_status"))
    return _lines(spark, reports.table("Corpora", rows, ["corpus"]))

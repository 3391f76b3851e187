"""The registry of editions that snapshots are compared with: loading and its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import identity as I
from codexmill.functions.text import SHA256
from codexmill.operators.artifacts import violations

_EDITION = "oracle_edition string, kind string, edition_date string, source_url string, local_path string, sha256 string"
_CORPUS = "corpus string, snapshot_content_cutoff string, cutoff_status string, basis string, comparison_oracle_edition string, residual_skew_days bigint"
_REGISTRY = f"snapshot string, dataset_revision string, repository_commit_date string, repository_commit_date_is_content_cutoff boolean, oracle_editions array<struct<{_EDITION.replace(' string', ':string')}>>, corpora array<struct<{_CORPUS.replace(' string', ':string').replace(' bigint', ':bigint')}>>"


def load_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Head, editions and corpora of a registry file."""
    head = spark.read.schema(_REGISTRY).json(path, multiLine=True)
    editions = head.select(F.explode("oracle_editions").alias("e")).select("e.*").withColumn("provenance_input", I.edge(I.ORACLE_EDITION, F.col("oracle_edition"))).withColumn("staged", F.col("local_path").isNotNull())
    return head.drop("oracle_editions", "corpora"), editions, head.select(F.explode("corpora").alias("c")).select("c.*")


def _iso(c: str) -> Column:
    return F.rlike(F.col(c), F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(F.col(c), "yyyy-MM-dd").isNotNull()


def registry_violations(head: DataFrame, editions: DataFrame, corpora: DataFrame) -> DataFrame:
    """(key, rule) of everything in the registry that breaks a rule."""
    established = F.col("cutoff_status") == "established"
    dated = F.col("snapshot_content_cutoff").isNotNull()
    of_head = violations(head, {"commit date": _iso("repository_commit_date"), "commit date is no cutoff": ~F.col("repository_commit_date_is_content_cutoff")}, F.col("snapshot"))
    of_editions = violations(
        editions,
        {
            "id": F.startswith("oracle_edition", F.lit("oracle:")),
            "date": _iso("edition_date"),
            "https": F.startswith("source_url", F.lit("https://")),
            "path and digest": F.col("local_path").isNull() == F.col("sha256").isNull(),
            "digest": F.col("sha256").isNull() | F.rlike("sha256", F.lit(SHA256)),
        },
        F.col("oracle_edition"),
    )
    of_corpora = violations(
        corpora,
        {
            "named": (F.col("corpus") != "") & (F.col("basis") != ""),
            "cutoff date": ~dated | _iso("snapshot_content_cutoff"),
            "established is dated": F.coalesce(established, F.lit(False)) == dated,
            "skew is established": F.col("residual_skew_days").isNull() | established,
        },
        F.col("corpus"),
    )
    repeated = editions.groupBy("oracle_edition").count().where("count > 1").select(F.col("oracle_edition").alias("key"), F.lit("unique").alias("rule"))
    unknown = corpora.join(editions.select(F.col("oracle_edition").alias("comparison_oracle_edition")), "comparison_oracle_edition", "left_anti").select(F.col("corpus").alias("key"), F.lit("known edition").alias("rule"))
    return of_head.unionByName(of_editions).unionByName(of_corpora).unionByName(repeated).unionByName(unknown)

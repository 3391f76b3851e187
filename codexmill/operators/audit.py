"""Per-file audits as shared aggregates: profile, key collisions, segments, manifest.

Every operator takes ``file``, the columns that identify a file, and works on all files at once. A
row's ``ordinal`` is its place in its file. Texts are hashed, or their heads taken, where they are
read and before any join, so no shuffle carries one. Whether a column varies within a group is a
minimum and a maximum of its hashes, so a group needs at most one set of distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codexmill.functions import text as X
from codexmill.operators.skew import numbered_in_group
from codexmill.operators.workspace import written

STRUCTURE = ("section_number", "display_path", "breadcrumb", "citation", "subsection_count")
SAMPLE, HEAD = 300, 30


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def file_profile(rows: DataFrame, file: list[str]) -> DataFrame:
    """Counts, key uniqueness, completeness, sizes and reference coverage, one row per file."""
    filled = F.col("act_id") != ""
    whole = reduce(Column.__and__, [F.coalesce(F.col(c) != "", F.lit(False)) for c in X.HIERARCHY_FIELDS])
    words = F.coalesce("word_count", F.lit(0))
    return rows.groupBy(*file).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _n(filled).alias("act_id_filled"),
        F.count_distinct(F.when(filled, F.col("act_id"))).alias("act_id_distinct"),
        (_n(F.col("text").isNull()) + _n(F.col("text") == "")).alias("empty_text_rows"),
        _n(whole).alias("hierarchy_complete"),
        F.min(words).alias("words_min"),
        F.max(words).alias("words_max"),
        F.sum(words).alias("words_sum"),
        _n(X.list_filled(F.col("cross_references_usc"))).alias("usc_rows"),
        F.sum(X.list_size(F.col("cross_references_usc"))).alias("usc_edges"),
        _n(X.list_filled(F.col("cross_references_cfr"))).alias("cfr_rows"),
        _n(X.list_filled(F.col("public_laws_referenced"))).alias("public_law_rows"),
        _n(F.col("act_status").isin(*X.LINEAGE_STATUSES)).alias("lineage_rows"),
    )


def word_quantiles(rows: DataFrame, file: list[str]) -> DataFrame:
    """Median (interpolated) and nearest-rank 95th percentile of word counts, null counting 0.

    The ranks are running sums over distinct counts, so a file of any size sorts only those.
    """
    counted = rows.groupBy(*file, F.coalesce("word_count", F.lit(0)).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy(*file).orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(by_size)).withColumn("total", F.sum("n").over(Window.partitionBy(*file)))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("w")))
    below, above = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    near = F.floor((F.col("total") - 1) * 0.95 + 0.5)
    return ranked.groupBy(*file).agg(((at(below) + at(above)) / 2).alias("words_p50"), at(near).cast("double").alias("words_p95"))


def prefix_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.where(F.col("act_id") != "").groupBy(*by, X.prefix(F.col("act_id")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, F.coalesce("act_status", F.lit("<null>")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def corpus_statuses(rows: DataFrame, corpus: str) -> DataFrame:
    """The statuses that occur in each corpus, sorted; a null one as ``<null>``. A status is a word of a
    small vocabulary, so the set is small."""
    each = rows.select(corpus, F.coalesce("act_status", F.lit("<null>")).alias("status")).distinct()
    return each.groupBy(corpus).agg(F.array_join(F.array_sort(F.collect_list("status")), ", ").alias("statuses"))


def first_with(rows: DataFrame, by: list[str], cond: Column, ordinal: str, text: str = "text", head: int = 160) -> DataFrame:
    """The first row of each group, in physical order, that meets a condition: key and head of its text."""
    opened = F.substring(F.col(text), 1, head)
    return rows.where(cond).groupBy(*by).agg(F.min_by(F.struct("act_id", opened.alias("text_head")), ordinal).alias("e")).select(*by, "e.*")


def lineage_pointers(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the statuses that move a section, repealed ones included, and those that say where."""
    return (
        rows.where(F.col("act_status").isin(*X.POINTER_STATUSES))
        .groupBy(*by, "act_status")
        .agg(F.count(F.lit(1)).alias("n_rows"), _n(X.has_pointer(F.col("text"))).alias("with_pointer"))
    )


def first_rows(rows: DataFrame, file: list[str], ordinal: str, n: int, columns: list[str]) -> DataFrame:
    """The first ``n`` rows of each file: examples, in physical order."""
    w = Window.partitionBy(*file).orderBy(ordinal)
    return rows.select(*file, ordinal, *columns).withColumn("example_no", F.row_number().over(w)).where(F.col("example_no") <= n).drop(ordinal)


def lineage_examples(rows: DataFrame, file: list[str], ordinal: str, n: int = 4) -> DataFrame:
    moved = rows.where(F.col("act_status").isin(*X.LINEAGE_STATUSES)).select(
        *file, ordinal, "act_id", "citation", "act_status", F.coalesce(F.col("text") != "", F.lit(False)).alias("has_text"), F.substring(F.coalesce("text", F.lit("")), 1, 160).alias("text_head")
    )
    return first_rows(moved, file, ordinal, n, ["act_id", "citation", "act_status", "has_text", "text_head"])


def citation_samples(rows: DataFrame, file: list[str], ordinal: str, n: int = 6) -> DataFrame:
    return first_rows(rows.where(F.col("citation").isNotNull()), file, ordinal, n, ["citation"])


def repeated_key_examples(rows: DataFrame, file: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` repeated keys of each file, by key."""
    repeated = rows.where(F.col("act_id") != "").groupBy(*file, "act_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    w = Window.partitionBy(*file).orderBy("act_id")
    return repeated.withColumn("example_no", F.row_number().over(w)).where(F.col("example_no") <= n)


def corpus_summary(profile: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Files of a corpus together: sizes, whether keys are filled, upper median of completeness, edges."""
    rate = F.coalesce(F.col("hierarchy_complete") / F.col("n_rows"), F.lit(0.0))
    sorted_rates = F.array_sort(F.collect_list(rate))  # a value per file
    usc = F.bround(F.col("usc_rows") / F.col("n_rows") * F.col("n_rows")).cast("long")
    return profile.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("n_rows").alias("n_rows"),
        F.min(F.col("act_id_filled") / F.col("n_rows") > 0.999).alias("keys_filled"),
        F.element_at(sorted_rates, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median_complete"),
        F.sum("usc_edges").alias("usc_edges"),
        F.sum(usc).alias("usc_rows"),
        F.sum("lineage_rows").alias("lineage_rows"),
    )


def completeness_outliers(profile: DataFrame, file: list[str], below: float = 0.90, more_than: int = 50, n: int = 40) -> DataFrame:
    """The ``n`` files whose flat hierarchy is least complete: a report."""
    rate = F.col("hierarchy_complete") / F.col("n_rows")
    return profile.where((rate < below) & (F.col("n_rows") > more_than)).select(*file, "n_rows", rate.alias("complete_rate")).orderBy("complete_rate", *file).limit(n)


# --------------------------------------------------------------------------- collisions


def collision_summary(rows: DataFrame, file: list[str]) -> DataFrame:
    """Rows, distinct and null keys per file. Null keys count as colliding, and are shown beside."""
    return rows.groupBy(*file).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("act_id").alias("distinct_ids"),
        _n(F.col("act_id").isNull()).alias("null_ids"),
        (F.count(F.lit(1)) - F.count_distinct("act_id")).alias("collision_rows"),
    )


def collision_namespaces(rows: DataFrame, file: list[str]) -> DataFrame:
    """Groups of rows with one key, a null key being a group too, classified by their texts.

    A missing text is no text here: a group of nothing else is in no class, and one text beside
    missing ones is *identical*.
    """
    keyed = rows.select(*file, X.namespace(F.col("act_id")).alias("ns"), "act_id", F.md5("text").alias("h"), "word_count", _hash(rows, "source_url").alias("u"))
    one = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(False))
    groups = (
        keyed.groupBy(*file, "ns", "act_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("texts"), one("word_count").alias("one_size"), one("u").alias("one_url"))
        .where("n > 1")
    )
    return groups.groupBy(*file, "ns").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n_rows"),
        _n(F.col("texts") == 1).alias("all_identical"),
        _n(F.col("texts") == F.col("n")).alias("all_distinct"),
        _n((F.col("texts") > 1) & (F.col("texts") < F.col("n"))).alias("partly_distinct"),
        _n(F.col("one_url")).alias("same_url"),
        _n(F.col("one_size")).alias("same_word_count"),
        F.max("n").alias("max_group"),
        F.min(F.when(F.col("texts") == 1, F.col("act_id"))).alias("example_identical"),
        F.min(F.when(F.col("texts") == F.col("n"), F.col("act_id"))).alias("example_distinct"),
    )


def _hash(rows: DataFrame, column: str) -> Column:
    """A number for a value: itself, or 64 bits of it; null for null."""
    c = F.col(column)
    return c if isinstance(rows.schema[column].dataType, (T.IntegerType, T.LongType)) else F.when(c.isNotNull(), F.xxhash64(c))


def group_sizes(rows: DataFrame, file: list[str]) -> DataFrame:
    return rows.groupBy(*file, "act_id").agg(F.count(F.lit(1)).alias("size"))


def group_size_histogram(rows: DataFrame, by: list[str], file: list[str]) -> DataFrame:
    return group_sizes(rows, [*by, *[f for f in file if f not in by]]).groupBy(*by, "size").agg(F.count(F.lit(1)).alias("groups"))


def corpus_groups(rows: DataFrame, corpus: str, file: list[str]) -> DataFrame:
    """Files, rows and groups of each corpus; a group is a key within a file."""
    sizes = rows.groupBy(corpus, *file, "act_id").agg(F.count(F.lit(1)).alias("size"))
    per_file = sizes.groupBy(corpus, *file).agg(
        F.sum("size").alias("n_rows"),
        F.count(F.lit(1)).alias("groups"),
        _n(F.col("size") == 1).alias("single"),
        F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).alias("collision_rows"),
        F.max("size").alias("max_group"),
    )
    return per_file.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("groups").alias("groups"),
        F.sum("single").alias("single_groups"),
        (F.sum("groups") - F.sum("single")).alias("multi_groups"),
        F.sum("collision_rows").alias("collision_rows"),
        F.max("max_group").alias("max_group"),
    )


def colliding_rows(rows: DataFrame, file: list[str], ordinal: str, row_id: str) -> DataFrame:
    """Rows whose non-null key repeats within their file, with the digest of their text, their place
    among the rows of the key, and among those of the same text.

    All rows are numbered by key, block by block, and those that are alone are left out: a join with
    the repeated keys would bring the rows of a frequent one together.
    """
    slim = rows.where(F.col("act_id").isNotNull()).select(row_id, *file, "act_id", F.col(ordinal).alias("ordinal"), X.namespace(F.col("act_id")).alias("ns"), F.md5("text").alias("text_md5"))
    numbered = numbered_in_group(written(slim, "colliding"), [*file, "act_id"], "ordinal", [row_id], "segment_ordinal", "group_size").where("group_size > 1")
    numbered = numbered_in_group(written(numbered, "numbered"), [*file, "act_id", "text_md5"], "ordinal", [row_id], "occurrence_index", "copies")
    return numbered.select(row_id, *file, "act_id", "ns", "text_md5", *[F.col(c).cast("int").alias(c) for c in ("segment_ordinal", "occurrence_index")])


def segment_groups(rows: DataFrame, file: list[str], ordinal: str) -> DataFrame:
    """Per repeated key: size, distinct texts (a missing one is a value here), span, and whether any
    structural column tells its rows apart."""
    hashed = rows.where(F.col("act_id").isNotNull()).select(
        *file, X.namespace(F.col("act_id")).alias("ns"), "act_id", F.col(ordinal).alias("at"), F.coalesce(F.md5("text"), F.lit("")).alias("h"), *[_hash(rows, c).alias(f"s{i}") for i, c in enumerate(STRUCTURE)]
    )
    n = F.count(F.lit(1))
    varies = [F.coalesce(F.min(c) < F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < n)) for c in (f"s{i}" for i in range(len(STRUCTURE)))]
    return (
        hashed.groupBy(*file, "ns", "act_id")
        .agg(n.alias("n"), F.count_distinct("h").alias("texts"), (F.max("at") - F.min("at") == n - 1).alias("contiguous"), reduce(Column.__or__, varies).alias("discriminated"))
        .where("n > 1")
    )


def segment_namespaces(rows: DataFrame, file: list[str], ordinal: str) -> DataFrame:
    identical, distinct = F.col("texts") == 1, (F.col("texts") == F.col("n")) & (F.col("texts") > 1)
    near, told = F.col("contiguous"), F.col("discriminated")
    # A group of one text is identical, also if it has one row; repeated keys have two at least.
    return segment_groups(rows, file, ordinal).groupBy(*file, "ns").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n_rows"),
        _n(identical).alias("all_identical"),
        _n(distinct).alias("all_distinct"),
        _n(~identical & ~distinct).alias("partly_distinct"),
        _n(near).alias("contiguous"),
        _n(distinct & near).alias("distinct_contiguous"),
        _n(identical & ~near).alias("identical_scattered"),
        _n(told).alias("discriminated"),
        _n(distinct & ~told).alias("distinct_untold"),
    )


def segment_seams(rows: DataFrame, file: list[str], ordinal: str, sample: int = SAMPLE) -> DataFrame:
    """Whether groups of distinct texts read on: over the first ``sample`` such keys per file and
    namespace (a sample by definition of the report), shared openings and seams that begin small."""
    picks = (
        segment_groups(rows, file, ordinal)
        .where((F.col("texts") == F.col("n")) & (F.col("texts") > 1))
        .withColumn("pick", F.row_number().over(Window.partitionBy(*file, "ns").orderBy("act_id")))
        .where(F.col("pick") <= sample)
        .select(*file, "ns", "act_id")
    )
    body = X.left_stripped(F.coalesce("text", F.lit("")))
    small = F.rlike(body, F.lit(r"^\p{javaLowerCase}")).cast("int").alias("small")
    heads = rows.where(F.col("act_id").isNotNull()).select(*file, "act_id", ordinal, F.substring(body, 1, HEAD).alias("head"), small)
    opened = heads.join(picks, [*file, "act_id"])
    per_key = opened.groupBy(*file, "ns", "act_id").agg(
        F.count_distinct("head").alias("heads"), (F.count(F.lit(1)) - 1).alias("seams"), (F.sum("small") - F.min_by("small", ordinal)).alias("reads_on")
    )
    return per_key.groupBy(*file, "ns").agg(F.count(F.lit(1)).alias("sampled_groups"), _n(F.col("heads") == 1).alias("shared_head"), F.sum("seams").alias("seams"), F.sum("reads_on").alias("continuations"))


def shared_content(rows: DataFrame) -> DataFrame:
    """Texts under more than one key: their digest and number of distinct keys, null being one."""
    return (
        rows.where(F.col("text").isNotNull())
        .groupBy(F.sha2("text", 256).alias("text_hash"))
        .agg((F.count_distinct("act_id") + F.max(F.col("act_id").isNull().cast("int"))).alias("act_ids"))
        .where("act_ids > 1")
    )

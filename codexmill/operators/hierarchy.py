"""Breadcrumbs as trees: levels, paths, round trips to the displayed path, and topology.

The tree of a corpus is the set of distinct path prefixes, exploded and counted; siblings compare by
natural order. One Arrow pass reads the JSON strictly; everything after it is DataFrame operations on
short keys. Windows are per parent, whose children are distinct, so no repeated row inflates one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codexmill.functions import text as X

# The closed vocabulary of level kinds.
KINDS = ("code", "title", "subtitle", "division", "subdivision", "part", "subpart", "chapter", "subchapter", "article", "subarticle", "section", "subsection", "paragraph", "agency", "rule", "group", "regulation", "appendix", "other")
EXACT, PREFIX, LENGTH, LABEL, NO_DISPLAY = "exact", "prefix", "length_mismatch", "label_mismatch", "no_display"


def _refuse(name: str) -> None:
    raise ValueError(name)


_FIELDS = ("type", "num", "label", "name")
_LEVEL = T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS])


def raw_levels(text: str | None) -> list[dict] | None:
    """The members of a breadcrumb as text, or None if it isn't a JSON array of objects."""
    if not text or not text.strip():
        return None
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        return None
    clean = lambda v: v.encode("utf-8", "replace").decode() if isinstance(v, str) else None
    return [{f: clean(x.get(f)) for f in _FIELDS} for x in value]


def with_levels(df: DataFrame, breadcrumb: str = "breadcrumb", output: str = "levels") -> DataFrame:
    """Adds the levels of each breadcrumb: kind, identifier, label, name, raw_kind, confidence.

    An unknown kind becomes ``other`` at half confidence and keeps its raw form, a missing one at
    0.3; an empty ``num`` gives no identifier and half of that. A breadcrumb that is null, blank or
    damaged, or has an element that isn't an object, has no levels (an empty array).
    """

    return df.withColumn(output, F.transform(_parse_levels()(F.col(breadcrumb)), _level))


def _parse_levels():
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(f, pa.string()) for f in _FIELDS]))
        for t in texts:
            yield pa.array([raw_levels(x) or [] for x in t.to_pylist()], kind)

    return F.arrow_udf(run, T.ArrayType(_LEVEL))


def _level(e: Column) -> Column:
    usual = F.lower(X.stripped(e["type"]))
    missing = F.coalesce(e["type"] == "", F.lit(True))
    known = ~missing & usual.isin(*KINDS)
    kind = F.when(known, usual).otherwise("other")
    num = X.stripped(e["num"])
    identifier = F.when(num != "", num)
    name = F.when(e["name"] != "", e["name"])
    label = F.coalesce(F.when(e["label"] != "", e["label"]), name, F.concat(kind, F.lit(" "), identifier), kind)
    sure = F.when(known, 1.0).when(missing, 0.3).otherwise(0.5)
    return F.struct(
        kind.alias("kind"), identifier.alias("identifier"), label.alias("label"), name.alias("name"),
        F.when(~known & ~missing, e["type"]).alias("raw_kind"), F.round(F.when(identifier.isNull(), sure * 0.5).otherwise(sure), 4).alias("confidence"),
    )


def local_keys(levels: Column) -> Column:
    """(kind, identifier or label) of each level."""
    return F.transform(levels, lambda n: F.struct(n["kind"].alias("kind"), F.coalesce(n["identifier"], n["label"]).alias("ident")))


def structural_path(levels: Column) -> Column:
    return F.array_join(F.transform(local_keys(levels), lambda k: F.concat(k["kind"], F.lit(":"), k["ident"])), "/")


def display_segments(path: Column) -> Column:
    """Segments of a displayed path without its root, stripped; a null or blank path has none."""
    parts = F.transform(F.split(path, " / "), X.stripped)
    return F.when(X.stripped(path) != "", F.slice(parts, 2, 100_000)).otherwise(F.array().cast("array<string>"))


def round_trip(levels: Column, display_path: Column) -> Column:
    """Whether the labels give the displayed path: exactly, as prefixes of its segments, or not."""
    segments, labels = display_segments(display_path), F.transform(levels, lambda n: n["label"])
    fits = F.forall(F.zip_with(segments, labels, lambda s, n: (s == n) | F.startswith(s, F.concat(n, F.lit(" ")))), lambda x: x)
    none = F.coalesce(F.size(segments), F.lit(0)) <= 0
    return F.when(none, NO_DISPLAY).when(F.size(segments) != F.size(levels), LENGTH).when(segments == labels, EXACT).when(fits, PREFIX).otherwise(LABEL)


def corpus_levels(rows: DataFrame, corpus: str) -> DataFrame:
    """One row per corpus: how many breadcrumbs parse, levels, identifiers, depth, repeats in a path."""
    n = lambda c: F.count(F.when(c, 1))
    keys, levels = local_keys(F.col("levels")), F.col("levels")
    ok = F.size("levels") > 0
    return rows.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("n_rows"),
        n(ok).alias("parse_ok"),
        F.sum(F.size("levels")).cast("long").alias("nodes"),
        F.sum(F.size(F.filter(levels, lambda x: x["identifier"].isNotNull()))).cast("long").alias("identified"),
        F.max(F.size("levels")).alias("deepest"),
        n(F.size(F.array_distinct(keys)) < F.size(keys)).alias("cyclic"),
    )


def level_histogram(rows: DataFrame, corpus: str) -> DataFrame:
    """Levels by kind, and unknown kinds by their raw form."""
    each = rows.select(corpus, F.explode("levels").alias("n"))
    return each.groupBy(corpus, F.col("n.kind").alias("kind"), F.col("n.raw_kind").alias("raw_kind")).agg(F.count(F.lit(1)).alias("n"))


def leaf_kinds(rows: DataFrame, corpus: str) -> DataFrame:
    """Breadcrumbs by the kind of their last level."""
    return rows.where(F.size("levels") > 0).groupBy(corpus, F.element_at("levels", -1)["kind"].alias("leaf_kind")).agg(F.count(F.lit(1)).alias("n"))


def probe_paths(rows: DataFrame, corpus: str) -> DataFrame:
    """Of the breadcrumbs that parse: rows, distinct keys and paths, and leaves that aren't numbers."""
    return rows.where(F.size("levels") > 0).groupBy(corpus).agg(
        F.count(F.lit(1)).alias("parsed"),
        F.count_distinct("act_id").alias("act_ids"),
        F.count_distinct(structural_path(F.col("levels"))).alias("paths"),
        F.count(F.when(~X.numeric_id(F.element_at("levels", -1)["identifier"]), 1)).alias("nonnumeric_leaves"),
    )


def deepest_paths(rows: DataFrame, corpus: str, ordinal: str) -> DataFrame:
    """The first of the deepest breadcrumbs of each corpus."""
    first = F.struct(F.size("levels").alias("depth"), (-F.col(ordinal)).alias("order"))
    return rows.where(F.size("levels") > 0).groupBy(corpus).agg(F.max_by("act_id", first).alias("act_id"), F.max(F.size("levels")).alias("depth"))


def depth_histogram(rows: DataFrame, corpus: str) -> DataFrame:
    return rows.where(F.size("levels") > 0).groupBy(corpus, F.size("levels").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


def round_trip_counts(rows: DataFrame, corpus: str) -> DataFrame:
    return rows.where(F.size("levels") > 0).groupBy(corpus, round_trip(F.col("levels"), F.col("display_path")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def tree_nodes(rows: DataFrame, corpus: str, ordinal: str) -> DataFrame:
    """Distinct nodes by absolute path, with parent path (null at the root) and place first seen."""
    keys = local_keys(F.col("levels"))
    text = lambda ks: F.to_json(ks)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("levels")), lambda i: F.struct(text(F.slice(keys, F.lit(1), i)).alias("path"), F.when(i > 1, text(F.slice(keys, F.lit(1), i - 1))).alias("parent"), F.element_at(keys, i).alias("key"), i.alias("level")))
    each = rows.where(F.size("levels") > 0).select(corpus, F.col(ordinal).alias("at"), F.explode(prefixes).alias("p")).select(corpus, "at", "p.*")
    return each.groupBy(corpus, "path", "parent", "key", "level").agg(F.min(F.struct("at", "level")).alias("first"))


def sibling_order(nodes: DataFrame, corpus: str, block: int = 1_000_000) -> DataFrame:
    """Parents with two or more children, and those whose children were first seen in natural order.

    Naturally sorted is the same as: no child's key is below that of the one seen before it. The
    children of a parent are compared in blocks of ordinals; a block is in order within itself, and
    its least key is not below the greatest of the block before. So no parent's children meet in one
    task, however many they are.
    """
    keyed = nodes.select(corpus, F.struct("parent").alias("p"), F.floor(F.col("first.at") / block).alias("b"), "first", "path", X.natural_key(F.col("key.ident")).alias("k"))
    before = F.lag("k").over(Window.partitionBy(corpus, "p", "b").orderBy("first", "path"))
    fine = before.isNull() | (before <= F.col("k"))
    blocks = keyed.withColumn("fine", fine).groupBy(corpus, "p", "b").agg(F.count(F.lit(1)).alias("kids"), F.min("fine").alias("fine"), F.min("k").alias("least"), F.max("k").alias("most"))
    last = F.lag("most").over(Window.partitionBy(corpus, "p").orderBy("b"))
    per = blocks.withColumn("fits", last.isNull() | (last <= F.col("least"))).groupBy(corpus, "p").agg(F.sum("kids").alias("kids"), F.min(F.col("fine") & F.col("fits")).alias("fine")).where("kids > 1")
    return per.groupBy(corpus).agg(F.count(F.lit(1)).alias("parents"), F.count(F.when(F.col("fine"), 1)).alias("in_order"))


def leaf_ambiguity(rows: DataFrame, corpus: str) -> DataFrame:
    """Leaf keys, and those found under more than one parent; having none is a parent too."""
    keys = local_keys(F.col("levels"))
    parent = F.when(F.size("levels") > 1, F.to_json(F.slice(keys, F.lit(1), F.size("levels") - 1))).otherwise("<root>")
    leaves = rows.where(F.size("levels") > 0).select(corpus, F.element_at(keys, -1).alias("leaf"), parent.alias("parent"))
    per = leaves.groupBy(corpus, "leaf").agg(F.count_distinct("parent").alias("parents"))
    return per.groupBy(corpus).agg(F.count(F.lit(1)).alias("leaves"), F.count(F.when(F.col("parents") > 1, 1)).alias("ambiguous"))

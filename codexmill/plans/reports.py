"""Reports: small aggregates as Markdown, byte-stable for equal results.

Only aggregates whose size is bounded by files, corpora, namespaces or steps are brought to the
driver; a table of more than ``most`` rows is cut there and says so. ``--rows`` of the command line
sets that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as X
from codexmill.operators import artifacts, audit, difference, hierarchy
from codexmill.schema import SNAPSHOT_COLUMNS
from codexmill.sources import snapshot


def cell(value: object, rate: bool = False) -> str:
    if value is None:
        return "—"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{100 * value:.1f}%" if rate else f"{value:,.4g}"
    if isinstance(value, int):
        return f"{value:,}"
    return str(value).replace("|", "\\|").replace("\n", " ")


#: Rows of a table that are shown.
SHOWN = 2000


def table(title: str, df: DataFrame, order: list, most: int | None = None) -> str:
    """A Markdown table of an aggregate, in a total order; columns named ``..._rate`` or ``..._share`` are
    percentages."""
    most = SHOWN if most is None else most
    rows = df.orderBy(*order).limit(most + 1).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rates = [c.endswith(("_rate", "_share")) for c in df.columns]
    lines += ["| " + " | ".join(map(cell, r, rates)) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\n_Only the first {most:,} rows are shown._")
    return "\n".join(lines) + "\n"


def report(title: str, *parts: str) -> str:
    return "\n".join([f"# {title}\n", *parts])


FILE = ["source_file"]


def schema_report(spark: SparkSession, paths: list[str]) -> str:
    """The sets of columns that files have, what they lack of the contract or have besides, and columns
    that would state a successor."""
    footers = snapshot.read_footers(spark, snapshot.expand(paths), hashed=False)
    name, contract = F.substring_index("path", "/", -1), F.array(*map(F.lit, SNAPSHOT_COLUMNS))
    sets = footers.groupBy(F.array_join("columns", ", ").alias("columns")).agg(F.count(F.lit(1)).alias("files"), F.min(name).alias("first_file"))
    odd = footers.select(name.alias("source_file"), F.array_join(F.array_except(contract, "columns"), ", ").alias("missing"), F.array_join(F.array_except("columns", contract), ", ").alias("besides")).where("missing <> '' OR besides <> ''")
    cross = footers.select(name.alias("source_file"), F.explode("columns").alias("column_name")).where(F.col("column_name").isin(*X.CROSSWALK_COLUMNS))
    return "\n".join([table("Sets of columns", sets, [F.desc("files"), "columns"]), table("Files off the contract", odd, FILE), table("Columns that state a successor", cross, [*FILE, "column_name"])])


def profile_report(rows: DataFrame) -> str:
    """Files, corpora, namespaces, statuses, pointers, references, examples and outliers."""
    per_file = audit.file_profile(rows, ["corpus", *FILE])
    return report(
        "Snapshot profile",
        table("Corpora", audit.corpus_summary(per_file), [F.desc("n_rows"), "corpus"]),
        table("Files", per_file.join(audit.word_quantiles(rows, FILE), "source_file"), FILE),
        table("Namespaces", audit.prefix_counts(rows, []), [F.desc("n"), "prefix"]),
        table("Statuses", audit.status_counts(rows, ["corpus"]), ["corpus", F.desc("n"), "status"]),
        table("Statuses that point to a successor", audit.lineage_pointers(rows, ["corpus"]), ["corpus", "act_status"]),
        table("Statuses of all corpora", audit.lineage_pointers(rows, []), ["act_status"]),
        table("References", per_file.groupBy().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "usc_rows", "usc_edges", "cfr_rows", "public_law_rows", "lineage_rows")]), ["n_rows"]),
        table("Examples of moved rows", audit.lineage_examples(rows, FILE, "ordinal"), [*FILE, "example_no"]),
        table("Citations", audit.citation_samples(rows, FILE, "ordinal", 1), FILE),
        table("Least complete hierarchies", audit.completeness_outliers(per_file, FILE), ["complete_rate", *FILE]),
    )


def collision_report(rows: DataFrame) -> str:
    return report("Key collisions", table("Files", audit.collision_summary(rows, FILE), FILE), table("Namespaces", audit.collision_namespaces(rows, FILE), [*FILE, F.desc("n_rows"), "ns"]))


def segment_report(rows: DataFrame) -> str:
    return report("Segments", table("Order and discriminators", audit.segment_namespaces(rows, FILE, "ordinal"), [*FILE, "ns"]), table("Whether groups read on", audit.segment_seams(rows, FILE, "ordinal"), [*FILE, "ns"]))


def manifest_report(rows: DataFrame) -> str:
    """Sizes of all identity groups; of those that share a key, what the strategies make of them."""
    members = artifacts.identity_members(rows.withColumn("row_id", F.col("ordinal")), FILE, "ordinal")
    groups = artifacts.group_sizes(members, FILE).where("size > 1")
    outcomes = groups.groupBy("strategy", "status").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("n_rows"), F.sum("duplicate_rows").alias("duplicate_rows"), F.max("size").alias("max_group"))
    rejects = members.where("reject IS NOT NULL").groupBy("strategy", "reject").agg(F.count(F.lit(1)).alias("n_rows"))
    return report(
        "Identity manifest",
        table("Corpora", audit.corpus_groups(rows, "corpus", FILE), ["corpus"]),
        table("Group sizes", audit.group_size_histogram(rows, ["corpus"], FILE), ["corpus", "size"]),
        table("Strategies", outcomes, ["strategy", "status"]),
        table("Refused rows", rejects, ["strategy", "reject"]),
    )


def hierarchy_report(rows: DataFrame) -> str:
    levelled = hierarchy.with_levels(rows.select("corpus", "ordinal", "act_id", "breadcrumb", "display_path"))
    nodes = hierarchy.tree_nodes(levelled, "corpus", "ordinal")
    corpora = hierarchy.corpus_levels(levelled, "corpus")
    rates = corpora.select(
        "corpus",
        F.coalesce(F.try_divide("parse_ok", "n_rows"), F.lit(0.0)).alias("parse_rate"),
        F.coalesce(F.try_divide("identified", "nodes"), F.lit(0.0)).alias("identifier_rate"),
    )
    siblings = hierarchy.sibling_order(nodes, "corpus")
    orders = corpora.select("corpus").join(siblings, "corpus", "left").select("corpus", F.coalesce(F.try_divide("in_order", "parents"), F.lit(1.0)).alias("sibling_rate"))
    return report(
        "Hierarchy",
        table("Corpora", corpora, ["corpus"]),
        table("Rates", rates.join(orders, "corpus"), ["corpus"]),
        table("Kinds", hierarchy.level_histogram(levelled, "corpus"), ["corpus", F.desc("n"), "kind", "raw_kind"]),
        table("Depths", hierarchy.depth_histogram(levelled, "corpus"), ["corpus", "depth"]),
        table("Round trips", hierarchy.round_trip_counts(levelled, "corpus"), ["corpus", "status"]),
        table("Leaves", hierarchy.leaf_ambiguity(levelled, "corpus"), ["corpus"]),
    )


def probe_report(rows: DataFrame) -> str:
    """Every producer over one corpus: classes, identity, assembly, paths, shared content."""
    rows = rows.withColumn("row_id", F.col("ordinal"))
    members = artifacts.identity_members(rows, FILE, "ordinal")
    texts = audit.shared_content(rows)
    shared = texts.agg(F.count(F.lit(1)).alias("shared_texts"), F.sum("act_ids").alias("act_ids"), F.max_by("text_hash", F.struct("act_ids", "text_hash")).alias("most_shared"))
    levelled = hierarchy.with_levels(rows.select("corpus", "ordinal", "act_id", "breadcrumb", "display_path"))
    repealed = audit.first_with(rows, FILE, (F.col("act_status") == "repealed") & (F.col("text") != ""), "ordinal")
    count = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return report(
        "Probe",
        table("Statuses", audit.status_counts(rows, []), [F.desc("n"), "status"]),
        table("Classes", count(artifacts.classified(rows), "doc_class", "role"), ["doc_class", "role"]),
        table("Identity", count(members, "strategy", "reject"), ["strategy", "reject"]),
        table("Assemblies", count(artifacts.assembled(rows), "status"), ["status"]),
        table("Texts under more than one key", shared, ["shared_texts"]),
        table("Keys and paths", hierarchy.probe_paths(levelled, "corpus"), ["corpus"]),
        table("Last levels", hierarchy.leaf_kinds(levelled, "corpus"), ["corpus", F.desc("n"), "leaf_kind"]),
        table("Repealed records", repealed, FILE),
        hierarchy_report(rows),
    )


def difference_report(old: DataFrame, new: DataFrame, examples: int = 8) -> str:
    changes = difference.compare_snapshots(old.withColumn("row_id", F.col("ordinal")), new.withColumn("row_id", F.col("ordinal")), FILE, ["ordinal"])
    moved = difference.moved_rows(old, new.withColumn("row_id", F.col("ordinal")), FILE)
    firsts = [table(f"First {c}", changes.where(F.col("change") == c).select(*FILE, "act_id").orderBy(*FILE, "act_id").limit(examples), [*FILE, "act_id"]) for c in ("amended", "added", "removed")]
    return report("Difference", table("Files", difference.difference_totals(changes, FILE), FILE), *firsts, table("Moved rows", moved.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("self_in_old"), 1)).alias("self_in_old"), F.count("successor").alias("with_successor")), ["status"]))


REPORTS = {"profile": profile_report, "collisions": collision_report, "segments": segment_report, "identity-manifest": manifest_report, "hierarchy": hierarchy_report, "probe": probe_report}


def file_report(spark: SparkSession, name: str, paths: list[str], version: str) -> str:
    text = REPORTS[name](snapshot.scan_snapshot(spark, paths, version))
    return "\n".join([text, schema_report(spark, paths)]) if name == "profile" else text

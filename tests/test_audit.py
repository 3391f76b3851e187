from __future__ import annotations

import hashlib
import json
import os
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions import identity as I
from codexmill.functions import text as X
from codexmill.operators import artifacts as A
from codexmill.operators import audit, difference, hierarchy, workspace
from codexmill.operators.skew import join_by_weight, numbered_in_group
from codexmill.operators.workspace import written
from codexmill.schema import INTEGER_COLUMNS, SNAPSHOT_COLUMNS, SNAPSHOT_SCHEMA
from codexmill.sources import registry, snapshot

LAW = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), *SNAPSHOT_SCHEMA])


def law(spark, rows):
    """rows of (file, ordinal, values by column)."""
    return spark.createDataFrame([(i, f, o, *[v.get(c) for c in SNAPSHOT_COLUMNS]) for i, (f, o, v) in enumerate(rows)], LAW)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_collision_traps(spark):
    df = law(spark, [("f", 0, {"act_id": None}), ("f", 1, {"act_id": None}), ("f", 2, {"act_id": "CFR_1"}), ("f", 3, {"act_id": "CFR_1"}), ("f", 4, {"act_id": "FR_1"}), ("f", 5, {"act_id": "FR_1", "text": "t"}), ("f", 6, {"act_id": "9", "text": "t"})])
    s = audit.collision_summary(df, ["file"]).first()
    assert (s["total_rows"], s["distinct_ids"], s["null_ids"], s["collision_rows"]) == (7, 3, 2, 4)
    n = {r["ns"]: r for r in audit.collision_namespaces(df, ["file"]).collect()}
    assert {*n} == {None, "CFR", "FR"}
    assert [n["CFR"][c] for c in ("all_identical", "all_distinct", "partly_distinct")] == [0, 0, 0] and n["FR"]["all_identical"] == 1
    g = {r["ns"]: r for r in audit.segment_namespaces(df, ["file"], "ordinal").collect()}
    assert {*g} == {"CFR", "FR"} and g["CFR"]["all_identical"] == 1 and g["FR"]["all_distinct"] == 1


def test_seams(spark):
    rows = [("f", i, {"act_id": "FR_1", "text": t}) for i, t in enumerate(["Head of all", "  and on", None, "élan", "X"])] + [("f", 9, {"act_id": "FR_2", "text": "same opening of thirty letters a1"}), ("f", 10, {"act_id": "FR_2", "text": "same opening of thirty letters a2"})]
    r = audit.segment_seams(law(spark, rows), ["file"], "ordinal").first()
    assert (r["sampled_groups"], r["shared_head"], r["seams"], r["continuations"]) == (2, 1, 5, 3)


def test_profile_of_odd_files(spark):
    assert audit.file_profile(law(spark, []), ["file"]).count() == 0
    rows = [("f", i, {"word_count": w, "act_id": "", "cross_references_usc": x}) for i, (w, x) in enumerate([(1, None), (2, ""), (3, "[]"), (4, '["a", "b", "c"]'), (10, '["a"]')])]
    df = law(spark, rows)
    p = audit.file_profile(df, ["file"]).first()
    assert (p["act_id_filled"], p["usc_rows"], p["usc_edges"], p["words_max"]) == (0, 2, 4, 10)
    q = audit.word_quantiles(df, ["file"]).first()
    assert (q["words_p50"], q["words_p95"]) == (3.0, 10.0)


def test_numbering_in_blocks(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i * 7 % 50, i) for i in range(50)], "g int, o long, t long")
    got = numbered_in_group(df, ["g"], "o", ["t"], "n", "size", block=5).collect()
    for g in (None, 1, 2):
        mine = sorted((r["o"], r["t"], r["n"]) for r in got if r["g"] == g)
        assert [n for *_, n in mine] == list(range(len(mine))) and {r["size"] for r in got if r["g"] == g} == {len(mine)}


def test_join_with_hot_keys(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 20_000, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_by_weight(rows, keyed, ["k"], "n", most_hot=10)
    assert got.count() == 30_000 and got.where("k = 0").count() == 20_000 and got.select("id").distinct().count() == 30_000


# ------------------------------------------------------------------ addresses


def sha(*parts):
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()


def test_addresses(spark):
    assert value(spark, I.source_record_id(F.lit("v"), F.lit("c"), F.lit(3))) == "srr:sha256:" + sha("v", "c", "3")
    assert value(spark, I.raw_text_hash(F.lit(""))) == "sha256:" + hashlib.sha256(b"").hexdigest()
    assert value(spark, I.raw_text_hash(F.lit(None).cast("string"))) is None
    edges = [("source_record", "b"), ("annotation", "z"), ("source_record", "a")]
    joined = "\x1e".join(sorted(f"{t}\x1f{i}" for t, i in edges))
    column = F.array(*[I.edge(t, F.lit(i)) for t, i in edges])
    assert value(spark, I.artifact_id("t", column, "p", "1", "c")) == "art:sha256:" + sha("t", "p", "1", "c", joined)
    assert [e["input_id"] for e in value(spark, I.canonical_inputs(column))] == ["z", "a", "b"]
    assert value(spark, I.segment_fingerprint(F.lit("a"), F.lit(None).cast("string"), F.lit(0))) == "a|None|0"


@pytest.mark.parametrize("detail", ["plain", 'q"\\/', "é🜚 ", "tab\tline\n\x1f\x0b\x00"])
def test_payload_digest(spark, detail):
    body = {"confidence": 1.0, "document_class": detail, "evidence": [{"confidence": None, "detail": detail, "kind": "k"}]}
    blob = json.dumps({"t": "x", "p": body}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    evidence = F.array(F.struct(F.lit(None).cast("double").alias("confidence"), F.lit(detail).alias("detail"), F.lit("k").alias("kind")))
    column = F.struct(F.lit(1.0).alias("confidence"), F.lit(detail).alias("document_class"), evidence.alias("evidence"))
    assert value(spark, I.payload_hash("x", column)) == "pay:sha256:" + hashlib.sha256(blob.encode()).hexdigest()


def test_text_rules(spark):
    s = lambda v: F.lit(v).cast("string")
    assert value(spark, X.successor_number(s("(Section 12 was renumbered  §§ 47a-2.)"))) == "47a-2."
    assert value(spark, X.has_pointer(s(None))) is False and value(spark, X.has_pointer(s("see §§ 4"))) is True
    assert value(spark, X.operative(s("  a \n\nAmendments\nb"))) == "a"
    assert value(spark, X.stripped(s(" \n x　"))) == "x"
    assert [value(spark, X.act_id_prefix(s(v))) for v in (None, "", "USC_1", "x")] == [None, None, "USC", "x"]
    assert [value(spark, X.numeric_id(s(v))) for v in (None, "", "1.2-3", "1a", ".")] == [False, False, True, False, False]
    assert value(spark, X.corpus_of_file(s("us_ca_court_rules.parquet"))) == "court_rules" and value(spark, X.juris_of_file(s("other.parquet"))) == "?"
    assert value(spark, X.corpus_of_file(s("xx_ca_statutes.parquet"))) == "xx_ca_statutes" and value(spark, X.corpus_of_file(s("xx_ca_statutes.parquet"), strict=False)) == "statutes"
    assert value(spark, X.text_slice(s("a🜚bc"), 1, 3)) == "🜚b"
    order = spark.createDataFrame([(v,) for v in ["3.20", None, "3.4", "3.1", "x", "3.5", "3b", "12", "٣.١٩", "9" * 70, "1" + "0" * 70]], "v string").orderBy(X.natural_key(F.col("v")))
    assert [r["v"] for r in order.collect()] == ["3.1", "3.4", "3.5", "٣.١٩", "3.20", "3b", "12", "9" * 70, "1" + "0" * 70, "x", None]


# ------------------------------------------------------------------ artifacts


def test_classification(spark):
    cases = [("statute", "USC_1", "statute"), ("regulation", "CFR_1", "codified_cfr"), ("regulation", "FR_1", "federal_register"), ("regulation", "STATE_1", "regulation"), ("statute", "STATE_1", "statute"), ("irs_notice", "X_1", "guidance"),
             ("statute", "CFR_1", "unknown"), ("treaty", "USC_1", "unknown"), (None, "USC_1", "unknown"), ("court_rule", None, "court_rule"), ("constitution", "SRULES_1", "unknown")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, d string, a string, want string")
    for r in df.select("want", A.classify(F.col("d"), F.col("a")).alias("c")).collect():
        assert r["c"]["doc_class"] == r["want"] and r["c"]["confidence"] == (0.0 if r["want"] == "unknown" else 1.0) and len(r["c"]["evidence"]) == 2


def test_identity_and_duplicates(spark):
    base = {"state": "US", "document_type": "regulation"}
    rows = [("f", o, base | {"act_id": a, "text": t}) for o, a, t in [(20, "CFR_1", "s"), (5, "CFR_1", "s"), (12, "CFR_1", "t"), (1, "FR_1", None), (2, "FR_1", None), (3, "CFR_2", "x"), (4, "SREGS_1", "x"), (6, None, "x")]]
    rows += [("f", 30, {"state": "US", "document_type": "statute", "act_id": "CFR_9"}), ("f", 31, {"document_type": "guidance", "act_id": "G"})]
    df = law(spark, rows).withColumns({"corpus": F.lit("regulations"), "source_record_id": F.concat(F.lit("r"), F.col("row_id")), "raw_text_hash": I.raw_text_hash(F.col("text"))})
    m = {r["row_id"]: r for r in A.identity_members(df, ["file"], "ordinal").collect()}
    assert [m[i]["segment_ordinal"] for i in (0, 1, 2)] == [2, 0, 1] and [m[i]["occurrence_index"] for i in (0, 1, 2)] == [1, 0, 0]
    assert [m[i]["duplicate_row"] for i in (0, 1, 2, 3, 4)] == [True, True, False, False, False]
    assert m[4]["fingerprint"] == "FR_1|None|1" and (m[6]["reject"], m[7]["reject"], m[8]["reject"]) == ("prefix", "missing key", "prefix") and 9 not in m
    members = A.identity_members(df, ["file"], "ordinal")
    groups = A.identity_groups(members, ["file"])
    g = {r["source_identity_key"]: r for r in groups.collect()}
    assert (g["US|regulations|CFR_1"]["status"], g["US|regulations|FR_1"]["scope"], g["US|regulations|CFR_2"]["status"]) == ("provisional", "numbering_bucket", "resolved")
    assert g["US|regulations|CFR_1"]["members"] == ["r0", "r1", "r2"] and g["US|regulations|CFR_1"]["duplicate_rows"] == 2
    assert A.violations(groups, A.group_rules(), F.col("source_identity_key")).count() == 0
    bad = groups.withColumn("members", F.reverse("members")).withColumn("status", F.lit("made_up"))
    assert {r["rule"] for r in A.violations(bad, A.group_rules(), F.col("source_identity_key")).collect()} >= {"status", "members sorted"}
    assert A.member_annotations(members, groups, ["file"]).select("artifact_id").distinct().count() == 6
    named = groups.select(F.explode("members").alias("source_record_id"))
    assert A.incomplete_groups(named, df.where("row_id < 6")).count() == 0 and A.incomplete_groups(named, df.where("row_id < 5")).count() == 1


def test_groups_of_any_size(spark):
    n = 100_001
    members = spark.range(n, numPartitions=4).select(
        F.lit(None).cast("string").alias("file"), F.format_string("r%06d", "id").alias("source_record_id"), F.lit("US|regulations|FR_1").alias("source_identity_key"),
        F.lit(A.FEDERAL_REGISTER).alias("strategy"), F.lit(None).cast("string").alias("reject"), F.lit(n).cast("long").alias("group_size"),
        F.col("id").cast("int").alias("segment_ordinal"), F.lit("f").alias("fingerprint"), F.lit(False).alias("duplicate_row"),
    )
    groups = A.identity_groups(members, ["file"])
    edges = "\x1e".join(f"source_record\x1fr{i:06d}" for i in range(n))
    group = "art:sha256:" + hashlib.sha256(f"source_identity_group\0{A.FEDERAL_REGISTER}\x001\0\0{edges}".encode()).hexdigest()
    g = groups.select("size", "artifact_id", F.size("members").alias("listed")).first()
    assert (g["size"], g["artifact_id"], g["listed"]) == (n, group, n)
    name, version = A.PRODUCERS["duplicates"]
    scope = "art:sha256:" + hashlib.sha256(f"duplicate_scope\0{name}\0{version}\0\0annotation\x1f{group}\x1e{edges}".encode()).hexdigest()
    quality = "art:sha256:" + hashlib.sha256(f"quality_annotation\0{name}\0{version}\0\0annotation\x1f{scope}\x1esource_record\x1fr000007".encode()).hexdigest()
    out = A.member_annotations(members, groups, ["file"])
    assert out.count() == n and out.where("source_record_id = 'r000007'").first()["quality_id"] == quality
    assert A.violations(A.checked_groups(members, groups, ["file"]), A.checked_group_rules(), F.col("artifact_id")).count() == 0


def test_assembly_and_conflicts(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "t")], "source_record_id string, text string")
    asm = {r["source_record_id"]: r for r in A.assembled(df).collect()}
    assert [asm[k]["status"] for k in "abc"] == ["noncomposable", "complete", "complete"] and asm["a"]["assembled_text_hash"] is None
    full = A.assembled(df).join(df.withColumnRenamed("text", "assembled_text"), "source_record_id")
    assert A.violations(full, A.assembly_rules(), F.col("source_record_id")).count() == 0
    assert A.violations(full.withColumn("status", F.lit("partial")), A.assembly_rules(), F.col("source_record_id")).count() == 1
    clash = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("y", "1")], "artifact_id string, payload_hash string")
    assert [r["artifact_id"] for r in A.address_conflicts(clash).collect()] == ["x"]
    keys = spark.createDataFrame([("a", "k1"), ("a", "k2")], "source_record_id string, source_identity_key string")
    linked = A.associated(keys, "s", "1")
    assert linked.select("artifact_id").distinct().count() == 2 and linked.first()["assembly_id"] == asm["a"]["artifact_id"]
    assert A.violations(linked, A.association_rules("s", "1"), F.col("source_record_id")).count() == 0
    assert A.violations(linked.withColumn("source_identity_key", F.lit("")), A.association_rules("s", "1"), F.col("source_record_id")).count() == 4


def test_duplicate_evidence(spark):
    """A row each for sets of any size; the sentence is a view of small ones; null files and keys are values."""
    rows = [(None, "k", "s", f"r{i:03d}", "h", True) for i in range(30)] + [(None, "k", "s", "x", "i", False), (None, "k", "s", "y", None, False), ("f", "k", "s", "b", "h", True), ("f", "k", "s", "a", "h", True)]
    members = spark.createDataFrame(rows, "file string, source_identity_key string, strategy string, source_record_id string, raw_text_hash string, duplicate_row boolean")
    got = A.duplicate_evidence(members, ["file"])
    assert {tuple(r) for r in got.collect()} == {(f"r{i:03d}", "r000", 30) for i in range(30)} | {("a", "a", 2), ("b", "a", 2)}
    assert {tuple(r) for r in A.duplicate_details(got, 10).collect()} == {(k, "raw_text_hash shared by 2 rows in identity group: a, b") for k in "ab"}
    assert A.duplicate_evidence(members.limit(0), ["file"]).count() == 0


def test_unlinked_members(spark):
    groups = spark.createDataFrame([("g", 2), ("h", 1), ("i", 1)], "artifact_id string, distinct_members long")
    notes = spark.createDataFrame([("g", "a"), ("g", "a"), ("h", "b"), ("j", "z")], "group_id string, source_record_id string")
    assert {tuple(r) for r in A.unlinked_members(None, groups, notes, []).collect()} == {("g", "missing and repeated"), ("i", "missing"), ("j", "unknown")}


def test_no_shuffle_carries_a_text(spark, tmp_path):
    """With broadcasts out of reach, no exchange of the audits and artifacts has a column of texts."""
    from codexmill.plans import audit_queries as Q

    law(spark, [("f", 1, {"act_id": "CFR_1", "text": "a", "document_type": "regulation"})]).withColumns({"load_id": F.lit(1).cast("long"), "row_ordinal": F.col("ordinal"), "ingested_at": F.current_timestamp()}).drop("file", "ordinal").write.parquet(f"{tmp_path}/law_rows.parquet")
    assert "text" in spark.read.parquet(f"{tmp_path}/law_rows.parquet").columns
    spark.createDataFrame([(1, None, "us_x_regulations.parquet", "x", "regulations", "v1", "s")], "load_id long, prev_load_id long, source_file string, juris string, corpus string, snapshot_version string, sha256 string").write.parquet(f"{tmp_path}/file_loads.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in Q.QUERIES:
            if name in ("difference_totals", "difference_keys", "moved_rows"):  # other tables
                continue
            root = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan()
            todo = [root.initialPlan() if root.nodeName() == "AdaptiveSparkPlan" else root]
            while todo:
                node = todo.pop()
                if "Exchange" in node.nodeName():
                    names = [node.output().apply(i).name() for i in range(node.output().size())]
                    assert "text" not in names and "assembled_text" not in names, (name, names)
                todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_provenance_rules(spark):
    edge = "array<struct<input_type:string,input_id:string>>"
    good = [("source_record", "a")]
    ok = "art:sha256:" + sha("t", "p", "1", "", "source_record\x1fa")
    rows = [("t", "p", "1", "", good, ok), ("t", "p", "1", "", good, "art:x"), ("t", "", "1", "", good * 2, ok), ("t", "p", "1", "", [("made_up", "")], ok)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], f"k string, artifact_type string, producer string, version string, config string, inputs {edge}, artifact_id string")
    got = {}
    for r in A.violations(df, A.provenance_rules(), F.col("k")).collect():
        got.setdefault(r["key"], set()).add(r["rule"])
    assert got == {"1": {"address"}, "2": {"producer", "edges unique", "address"}, "3": {"edge type", "edge id", "address"}}


# ------------------------------------------------------------------ difference and hierarchy


def test_difference(spark):
    schema = "row_id long, row_ordinal long, act_id string, act_status string, text string"
    old = spark.createDataFrame([(1, 0, "A", "s", None), (2, 0, "B", "s", "x"), (3, 0, None, "s", "n"), (4, 0, "D", "s", "a\nAmendments\nz"), (5, 0, "E", "s", "old"), (6, 1, "E", "s", "last"), (7, 0, "N", None, None)], schema)
    new = spark.createDataFrame([(1, 0, "A", "s", ""), (2, 0, "C", "renumbered", "Renumbered § 88."), (3, 0, None, "s", "n"), (4, 0, "D", "s", "a\nAmendments\nzz"), (5, 0, "E", "s", "last"), (7, 0, "N", None, None)], schema)
    got = {r["act_id"]: r for r in difference.compare_snapshots(old, new, [], ["row_ordinal", "row_id"]).collect()}
    assert {k: r["change"] for k, r in got.items()} == {"A": "amended", "B": "removed", "C": "added", None: "unchanged", "D": "amended", "E": "unchanged", "N": "unchanged"}
    assert got["D"]["same_operative"] and got["D"]["grew"] and not got["A"]["grew"] and got["A"]["same_operative"]
    t = difference.difference_totals(difference.compare_snapshots(old, new, [], ["row_ordinal", "row_id"]), []).first()
    assert (t["amended"], t["grew"], t["shrank"], t["old_chars"], t["new_chars"]) == (2, 1, 0, 14, 15)
    m = difference.moved_rows(old, new, []).collect()
    assert [(r["act_id"], r["self_in_old"], r["successor"]) for r in m] == [("C", False, "88.")]
    assert difference.compare_snapshots(old.limit(0), new.limit(0), [], ["row_ordinal", "row_id"]).count() == 0


def test_hierarchy(spark):
    ca = '[{"type": "code", "num": "hw", "label": "Harbours"}, {"type": " Division ", "num": "2"}, {"type": "chapter", "num": "4.1", "label": "Ch 4.1", "name": "X"}, {"type": "wing", "num": "", "name": "W"}, {"type": null, "num": 5}]'
    bad = [None, "", " \t", "Title 4", '{"type": "part"}', '[{"type": "part"}, 7]', "true", "[{type: 1}]", '[{"type": "part"}],', '[{"type": NaN}]']
    df = spark.createDataFrame([(0, "c", ca, "R / Harbours / division 2 / Ch 4.1 X / W / other")] + [(i + 1, "c", b, None) for i, b in enumerate(bad)], "at long, corpus string, breadcrumb string, display_path string")
    rows = hierarchy.with_levels(df)
    lv = rows.where("at = 0").first()["levels"]
    assert [(x["kind"], x["identifier"], x["label"], x["confidence"], x["raw_kind"]) for x in lv] == [("code", "hw", "Harbours", 1.0, None), ("division", "2", "division 2", 1.0, None), ("chapter", "4.1", "Ch 4.1", 1.0, None), ("other", None, "W", 0.25, "wing"), ("other", None, "other", 0.15, None)]
    assert rows.where("size(levels) > 0").count() == 1
    assert rows.where("at = 0").select(hierarchy.structural_path(F.col("levels"))).first()[0] == "code:hw/division:2/chapter:4.1/other:W/other:other"
    assert {r["status"]: r["n"] for r in hierarchy.round_trip_counts(rows, "corpus").collect()} == {"prefix": 1}


def test_tree(spark):
    path = lambda *p: json.dumps([{"type": "part", "num": n, "label": n} for n in p])
    df = hierarchy.with_levels(spark.createDataFrame([(i, "c", path(*p), None) for i, p in enumerate([("1", "4.8"), ("1", "4.11"), ("2", "9"), ("2", "10"), ("2", "8"), ("2", "9"), ("8",), ("3", "3")])], "at long, corpus string, breadcrumb string, display_path string"))
    nodes = hierarchy.tree_nodes(df, "corpus", "at")
    assert nodes.count() == 10
    for block in (1, 2, 3, 1000):
        s = hierarchy.sibling_order(nodes, "corpus", block).first()
        assert (s["parents"], s["in_order"]) == (3, 1)
    a = hierarchy.leaf_ambiguity(df, "corpus").first()
    assert (a["leaves"], a["ambiguous"]) == (6, 1)
    assert hierarchy.corpus_levels(df, "corpus").first()["cyclic"] == 1


# ------------------------------------------------------------------ sources


def write(path, rows, **kw):
    schema = pa.schema([(c, pa.int64() if c in INTEGER_COLUMNS else pa.string()) for c in SNAPSHOT_COLUMNS])
    pq.write_table(pa.Table.from_pylist([{c: r.get(c) for c in SNAPSHOT_COLUMNS} for r in rows], schema), path, **kw)


def test_scan(spark, tmp_path):
    p = tmp_path / "us_ak_statutes.parquet"
    write(p, [{"act_id": f"a{i}", "text": t} for i, t in enumerate(["§é🜚", None, "", "same", "same"])], row_group_size=2)
    digest = hashlib.sha256(p.read_bytes()).hexdigest()
    rows = snapshot.scan_snapshot(spark, str(tmp_path / "*.parquet"), "v1").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(5)) and [r["text"] for r in rows] == ["§é🜚", None, "", "same", "same"]
    assert rows[4]["source_record_id"] == "srr:sha256:" + sha("v1", digest, "4") and rows[0]["corpus"] == "statutes"
    assert rows[3]["raw_text_hash"] == rows[4]["raw_text_hash"] and rows[1]["raw_text_hash"] is None
    (tmp_path / "SHA256SUMS.json").write_text(json.dumps([{"file": p.name, "sha256": digest}]))
    m = snapshot.build_manifest(spark, str(p), "v1")[0]
    assert (m["rows"], m["row_groups"], m["schema_ok"], m["checksum_ok"], m["last_id"]) == (5, 3, True, True, rows[4]["source_record_id"])
    with pytest.raises(ValueError):
        snapshot.scan_snapshot(spark, str(p), "v1", {p.name: "0" * 64})
    pq.write_table(pa.table({c: pa.array(["x"]) for c in SNAPSHOT_COLUMNS}), tmp_path / "bad.parquet")
    with pytest.raises(snapshot.SchemaMismatch):
        snapshot.scan_snapshot(spark, str(tmp_path / "bad.parquet"), "v1")
    assert "out of order" in snapshot.schema_problem(pa.schema([(c, pa.string()) for c in reversed(SNAPSHOT_COLUMNS)]))


def test_paths(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "us_a_statutes.parquet", [{"act_id": "a"}])
    write(tmp_path / "in" / "us_b_statutes.parquet", [{"act_id": "b"}, {}])
    monkeypatch.chdir(tmp_path)
    both = [str(tmp_path / "in" / f"us_{x}_statutes.parquet") for x in "ab"]
    assert snapshot.expand("in/*.parquet") == snapshot.expand(["in/us_?_statutes.parquet", both[0]]) == snapshot.expand("**/*.parquet") == both
    uris = [f"file://{p}" for p in both]
    assert snapshot.expand(f"file://{tmp_path}/in/*.parquet") == snapshot.expand(f"file://{tmp_path}/i*/us_*.parquet") == uris and snapshot.expand(uris[1]) == uris[1:]
    assert snapshot.scan_snapshot(spark, uris, "v").count() == 3 and [m["rows"] for m in snapshot.build_manifest(spark, uris, "v")] == [1, 2]
    for nothing in ("in/x*.parquet", "in/none.parquet", f"file://{tmp_path}/in/x*.parquet", f"file://{tmp_path}/none.parquet"):
        with pytest.raises(FileNotFoundError):
            snapshot.scan_snapshot(spark, nothing, "v")
    assert snapshot.scan_snapshot(spark, [], "v").count() == 0


def test_workspace(spark, tmp_path, monkeypatch):
    kept = written(spark.range(5), "kept")
    assert workspace.shared_dir(spark) in kept.inputFiles()[0] and kept.count() == 5
    with workspace.scope(spark):
        inner = written(spark.range(3), "inner")
        path = inner.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
        assert inner.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)
    path = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    workspace.discard(kept, kept, spark.range(1))
    assert not os.path.exists(path)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        workspace.shared_dir(cluster)


def test_columns_of_files(spark, tmp_path):
    write(tmp_path / "us_a_statutes.parquet", [{}])
    write(tmp_path / "us_b_statutes.parquet", [{}])
    pq.write_table(pa.table({"act_id": ["x"], "successor": ["y"]}), tmp_path / "us_c_statutes.parquet")
    at = str(tmp_path / "*.parquet")
    assert sorted(map(sorted, snapshot.schema_groups(spark, at).values())) == [["us_a_statutes.parquet", "us_b_statutes.parquet"], ["us_c_statutes.parquet"]]
    assert snapshot.crosswalk_columns(spark, at) == ["successor"]
    lacks, besides = snapshot.column_differences(spark, at)["us_c_statutes.parquet"]
    assert len(lacks) == 23 and besides == ["successor"]


def test_pins_and_checksums(spark):
    sha1 = "a" * 40
    assert snapshot.resolve_revision("main", sha1, lambda r: sha1) == sha1
    for ref, pin, to in (("main", "b" * 40, sha1), ("main", None, "short")):
        with pytest.raises(ValueError):
            snapshot.resolve_revision(ref, pin, lambda r: to)
    f = lambda rows: spark.createDataFrame(rows, "file string, sha256 string")
    got = snapshot.checksum_problems(f([("a", "1"), ("b", "2"), ("c", "3")]), f([("a", "1"), ("b", "9")]), f([("a", "1"), ("d", "4")])).collect()
    assert {(r["file"], r["problem"]) for r in got} == {("b", "differs"), ("c", "unlisted"), ("d", "missing")}
    assert snapshot.matching_revision({"a": "1"}, ["r1", "r2"], {"r1": {"a": "2"}, "r2": {"a": "1", "b": "2"}}.get) == "r2"


def test_registry(spark, tmp_path):
    edition = {"oracle_edition": "oracle:x", "kind": "code", "edition_date": "2026-01-31", "source_url": "https://e.example", "local_path": None, "sha256": None}
    corpus = {"corpus": "statutes", "snapshot_content_cutoff": "2026-01-01", "cutoff_status": "established", "basis": "b", "comparison_oracle_edition": "oracle:x", "residual_skew_days": 3}
    head = {"snapshot": "v1", "dataset_revision": "r", "repository_commit_date": "2026-02-01", "repository_commit_date_is_content_cutoff": False}

    def broken(editions, corpora, **kw):
        (tmp_path / "r.json").write_text(json.dumps(head | kw | {"oracle_editions": editions, "corpora": corpora}))
        return {(r["key"], r["rule"]) for r in registry.registry_violations(*registry.load_registry(spark, str(tmp_path / "r.json"))).collect()}

    assert broken([edition], [corpus]) == set()
    assert broken([edition | {"oracle_edition": "x", "edition_date": "2026-02-30", "source_url": "http://e", "sha256": "zz"}], []) == {("x", r) for r in ("id", "date", "https", "path and digest", "digest")}
    assert broken([edition, edition], [corpus | {"cutoff_status": "unresolved", "basis": ""}]) == {("oracle:x", "unique"), ("statutes", "named"), ("statutes", "established is dated"), ("statutes", "skew is established")}
    assert broken([edition], [corpus | {"comparison_oracle_edition": "oracle:y"}], repository_commit_date_is_content_cutoff=True) == {("statutes", "known edition"), ("v1", "commit date is no cutoff")}

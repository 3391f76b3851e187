"""Queries of the audits and derived artifacts over the snapshot tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import identity as I
from codexmill.functions import text as X
from codexmill.operators import artifacts as A
from codexmill.operators import audit, difference, hierarchy
from codexmill.operators.skew import small_side
from codexmill.operators.snapshots import version_steps
from codexmill.operators.workspace import written
from codexmill.sources.tables import table

FILE = ["load_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LAW = "WITH law AS (SELECT l.*, f.source_file, f.corpus, f.juris, f.snapshot_version AS snapshot, f.sha256 FROM law_rows l JOIN file_loads f USING (load_id))"
_NS = "regexp_extract(act_id, '^[A-Za-z]+', 0)"
_LINEAGE = "('renumbered','transferred','recodified','superseded','omitted')"
_POINTER = r"'(Renumbered|Transferred|Omitted|Repealed|Recodified|See)\s+§+\s*([0-9A-Za-z.\-]+)', 'i'"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def law(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all loads with their file's attributes."""
    files = table(spark, d, "file_loads").select("load_id", "source_file", "corpus", "juris", F.col("snapshot_version").alias("snapshot"), "sha256")
    return table(spark, d, "law_rows").join(small_side(files), "load_id")


# --------------------------------------------------------------------------- profile


@query(
    _LAW
    + """ SELECT load_id, count(*) AS n_rows, count(*) FILTER (WHERE act_id <> '') AS act_id_filled,
  count(DISTINCT act_id) FILTER (WHERE act_id <> '') AS act_id_distinct,
  count(*) FILTER (WHERE text IS NULL OR text = '') AS empty_text_rows,
  count(*) FILTER (WHERE title_number <> '' AND chapter <> '' AND section_number <> '') AS hierarchy_complete,
  min(coalesce(word_count, 0)) AS words_min, max(coalesce(word_count, 0)) AS words_max, sum(coalesce(word_count, 0))::BIGINT AS words_sum,
  count(*) FILTER (WHERE cross_references_usc <> '' AND cross_references_usc <> '[]') AS usc_rows,
  coalesce(sum((length(cross_references_usc) - length(replace(cross_references_usc, '", "', ''))) // 4 + 1)
    FILTER (WHERE cross_references_usc <> '' AND cross_references_usc <> '[]'), 0)::BIGINT AS usc_edges,
  count(*) FILTER (WHERE cross_references_cfr <> '' AND cross_references_cfr <> '[]') AS cfr_rows,
  count(*) FILTER (WHERE public_laws_referenced <> '' AND public_laws_referenced <> '[]') AS public_law_rows,
  count(*) FILTER (WHERE act_status IN """
    + _LINEAGE
    + ") AS lineage_rows FROM law GROUP BY 1"
)
def file_profile(spark: SparkSession, d: str) -> DataFrame:
    return audit.file_profile(law(spark, d), FILE)


@query(
    _LAW
    + """, w AS (SELECT load_id, coalesce(word_count, 0) AS w, row_number() OVER (PARTITION BY load_id ORDER BY coalesce(word_count, 0)) - 1 AS r,
  count(*) OVER (PARTITION BY load_id) AS n FROM law)
SELECT load_id, (max(w) FILTER (WHERE r = (n - 1) // 2) + max(w) FILTER (WHERE r = n // 2)) / 2.0 AS words_p50,
  (max(w) FILTER (WHERE r = floor((n - 1) * 0.95 + 0.5)))::DOUBLE AS words_p95 FROM w GROUP BY 1"""
)
def word_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return audit.word_quantiles(law(spark, d), FILE)


@query(_LAW + r" SELECT load_id, CASE WHEN p = '' THEN '<no-prefix>' ELSE p END AS prefix, count(*) AS n FROM (SELECT load_id, regexp_extract(act_id, '^([A-Z]+(?:_[A-Z]{2})?)_', 1) AS p FROM law WHERE act_id <> '') GROUP BY 1, 2")
def act_id_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return audit.prefix_counts(law(spark, d), FILE)


@query(_LAW + " SELECT load_id, coalesce(act_status, '<null>') AS status, count(*) AS n FROM law GROUP BY 1, 2")
def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return audit.status_counts(law(spark, d), FILE)


@query(
    _LAW
    + f" SELECT corpus, act_status, count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches(text, {_POINTER})) AS with_pointer FROM law "
    "WHERE act_status IN ('renumbered','transferred','recodified','superseded','omitted','repealed') GROUP BY 1, 2"
)
def lineage_pointers(spark: SparkSession, d: str) -> DataFrame:
    return audit.lineage_pointers(law(spark, d), ["corpus"])


@query(_LAW + r" SELECT CASE WHEN p = '' THEN '<no-prefix>' ELSE p END AS prefix, count(*) AS n FROM (SELECT regexp_extract(act_id, '^([A-Z]+(?:_[A-Z]{2})?)_', 1) AS p FROM law WHERE act_id <> '') GROUP BY 1")
def prefix_totals(spark: SparkSession, d: str) -> DataFrame:
    return audit.prefix_counts(law(spark, d), [])


@query(_LAW + " SELECT corpus, string_agg(s, ', ' ORDER BY s) AS statuses FROM (SELECT DISTINCT corpus, coalesce(act_status, '<null>') AS s FROM law) GROUP BY 1")
def corpus_statuses(spark: SparkSession, d: str) -> DataFrame:
    return audit.corpus_statuses(law(spark, d), "corpus")


@query(_LAW + " SELECT load_id, act_id, substring(text, 1, 160) AS text_head FROM law WHERE act_status = 'repealed' AND text <> '' QUALIFY row_number() OVER (PARTITION BY load_id ORDER BY row_ordinal) = 1")
def repealed_examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.first_with(law(spark, d), FILE, (F.col("act_status") == "repealed") & (F.col("text") != ""), "row_ordinal")


@query(
    _LAW
    + f""" SELECT load_id, example_no, act_id, citation, act_status, has_text, text_head FROM (SELECT load_id, act_id, citation, act_status,
  coalesce(text <> '', false) AS has_text, substring(coalesce(text, ''), 1, 160) AS text_head,
  row_number() OVER (PARTITION BY load_id ORDER BY row_ordinal)::INTEGER AS example_no FROM law WHERE act_status IN {_LINEAGE}) WHERE example_no <= 4"""
)
def lineage_examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.lineage_examples(law(spark, d), FILE, "row_ordinal")


@query(
    _LAW
    + " SELECT load_id, citation, example_no FROM (SELECT load_id, citation, row_number() OVER (PARTITION BY load_id ORDER BY row_ordinal)::INTEGER AS example_no FROM law WHERE citation IS NOT NULL) WHERE example_no <= 6"
)
def citation_samples(spark: SparkSession, d: str) -> DataFrame:
    return audit.citation_samples(law(spark, d), FILE, "row_ordinal")


@query(
    _LAW
    + """ SELECT * FROM (SELECT load_id, act_id, count(*) AS n, row_number() OVER (PARTITION BY load_id ORDER BY act_id)::INTEGER AS example_no
  FROM law WHERE act_id <> '' GROUP BY 1, 2 HAVING count(*) > 1) WHERE example_no <= 5"""
)
def repeated_key_examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.repeated_key_examples(law(spark, d), FILE)


_PER_FILE = (
    _LAW
    + """, p AS (SELECT load_id, corpus, count(*) AS n_rows, count(*) FILTER (WHERE act_id <> '') AS filled,
  count(*) FILTER (WHERE title_number <> '' AND chapter <> '' AND section_number <> '') AS whole,
  count(*) FILTER (WHERE cross_references_usc <> '' AND cross_references_usc <> '[]') AS usc_rows,
  coalesce(sum((length(cross_references_usc) - length(replace(cross_references_usc, '", "', ''))) // 4 + 1)
    FILTER (WHERE cross_references_usc <> '' AND cross_references_usc <> '[]'), 0)::BIGINT AS usc_edges,
  count(*) FILTER (WHERE act_status IN """
    + _LINEAGE
    + ") AS lineage_rows FROM law GROUP BY 1, 2)"
)


@query(
    _PER_FILE
    + """ SELECT corpus, count(*) AS files, sum(n_rows)::BIGINT AS n_rows, bool_and(filled / n_rows > 0.999) AS keys_filled,
  list_sort(list(whole / n_rows))[count(*) // 2 + 1] AS median_complete, sum(usc_edges)::BIGINT AS usc_edges, sum(usc_rows)::BIGINT AS usc_rows, sum(lineage_rows)::BIGINT AS lineage_rows
FROM p GROUP BY 1"""
)
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = law(spark, d)
    return audit.corpus_summary(audit.file_profile(rows, ["corpus", *FILE]))


@query(_PER_FILE + " SELECT load_id, n_rows, whole / n_rows AS complete_rate FROM p WHERE whole / n_rows < 0.9 AND n_rows > 50 ORDER BY complete_rate, load_id LIMIT 40")
def completeness_outliers(spark: SparkSession, d: str) -> DataFrame:
    return audit.completeness_outliers(audit.file_profile(law(spark, d), FILE), FILE)


# --------------------------------------------------------------------------- collisions


@query(_LAW + " SELECT load_id, count(*) AS total_rows, count(DISTINCT act_id) AS distinct_ids, count(*) FILTER (WHERE act_id IS NULL) AS null_ids, count(*) - count(DISTINCT act_id) AS collision_rows FROM law GROUP BY 1")
def collision_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.collision_summary(law(spark, d), FILE)


@query(
    _LAW
    + f""", f AS (SELECT load_id, {_NS} AS ns, act_id, count(*) OVER k AS n, row_number() OVER (k ORDER BY row_id) = 1 AS head,
  text IS NOT NULL AND row_number() OVER (PARTITION BY load_id, act_id, text ORDER BY row_id) = 1 AS new_text,
  max(word_count) OVER k = min(word_count) OVER k AS w, max(source_url) OVER k = min(source_url) OVER k AS u FROM law WINDOW k AS (PARTITION BY load_id, act_id)),
e AS (SELECT *, sum(new_text::INTEGER) OVER (PARTITION BY load_id, act_id) AS t FROM f WHERE n > 1)
SELECT load_id, ns, count(*) FILTER (WHERE head) AS groups, count(*) AS n_rows, count(*) FILTER (WHERE head AND t = 1) AS all_identical, count(*) FILTER (WHERE head AND t = n) AS all_distinct,
  count(*) FILTER (WHERE head AND t BETWEEN 2 AND n - 1) AS partly_distinct, count(*) FILTER (WHERE head AND u) AS same_url, count(*) FILTER (WHERE head AND w) AS same_word_count,
  max(n) AS max_group, min(CASE WHEN t = 1 THEN act_id END) AS example_identical, min(CASE WHEN t = n THEN act_id END) AS example_distinct FROM e GROUP BY 1, 2"""
)
def collision_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return audit.collision_namespaces(law(spark, d), FILE)


@query(_LAW + ", g AS (SELECT corpus, load_id, act_id, count(*) AS size FROM law GROUP BY 1, 2, 3) SELECT corpus, size, count(*) AS groups FROM g GROUP BY 1, 2")
def group_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return audit.group_size_histogram(law(spark, d), ["corpus"], FILE)


@query(
    _LAW
    + """, g AS (SELECT corpus, load_id, act_id, count(*) AS size FROM law GROUP BY 1, 2, 3)
SELECT corpus, count(DISTINCT load_id) AS files, sum(size)::BIGINT AS n_rows, count(*) AS groups, count(*) FILTER (WHERE size = 1) AS single_groups,
  count(*) FILTER (WHERE size > 1) AS multi_groups, coalesce(sum(size) FILTER (WHERE size > 1), 0)::BIGINT AS collision_rows, max(size) AS max_group FROM g GROUP BY 1"""
)
def corpus_groups(spark: SparkSession, d: str) -> DataFrame:
    return audit.corpus_groups(law(spark, d), "corpus", FILE)


_DUP = ", dup AS (SELECT load_id, act_id FROM law WHERE act_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1), c AS (SELECT law.* FROM law JOIN dup USING (load_id, act_id))"


@query(
    _LAW
    + _DUP
    + f"""SELECT row_id, {_NS} AS ns, md5(text) AS text_md5,
  row_number() OVER (PARTITION BY load_id, act_id ORDER BY row_ordinal, row_id)::INTEGER - 1 AS segment_ordinal,
  row_number() OVER (PARTITION BY load_id, act_id, md5(text) ORDER BY row_ordinal, row_id)::INTEGER - 1 AS occurrence_index FROM c"""
)
def colliding_members(spark: SparkSession, d: str) -> DataFrame:
    return audit.colliding_rows(law(spark, d), FILE, "row_ordinal", "row_id").select("row_id", "ns", "text_md5", "segment_ordinal", "occurrence_index")


_VARIES = " OR ".join(f"count(DISTINCT {c}) + max(({c} IS NULL)::INTEGER) > 1" for c in audit.STRUCTURE)
_GROUPS = f""", g AS (SELECT load_id, {_NS} AS ns, act_id, count(*) AS n, count(DISTINCT coalesce(md5(text), '')) AS t,
  max(row_ordinal) - min(row_ordinal) = count(*) - 1 AS near, {_VARIES} AS told FROM c GROUP BY 1, 2, 3)"""


@query(
    _LAW
    + _DUP
    + _GROUPS
    + """SELECT load_id, ns, count(*) AS groups, sum(n)::BIGINT AS n_rows, count(*) FILTER (WHERE t = 1) AS all_identical, count(*) FILTER (WHERE t = n) AS all_distinct,
  count(*) FILTER (WHERE t > 1 AND t < n) AS partly_distinct, count(*) FILTER (WHERE near) AS contiguous, count(*) FILTER (WHERE t = n AND near) AS distinct_contiguous,
  count(*) FILTER (WHERE t = 1 AND NOT near) AS identical_scattered, count(*) FILTER (WHERE told) AS discriminated, count(*) FILTER (WHERE t = n AND NOT told) AS distinct_untold FROM g GROUP BY 1, 2"""
)
def segment_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return audit.segment_namespaces(law(spark, d), FILE, "row_ordinal")


# Keys cut to their first two parts: all sections of a title under one key, as where a source repeats its keys.
_STEMS = _LAW + ", stem AS (SELECT * REPLACE (regexp_replace(act_id, '^([^_]*_[^_]*)_.*$', '\\1') AS act_id) FROM law)"


def stems(rows: DataFrame) -> DataFrame:
    return rows.withColumn("act_id", F.regexp_replace("act_id", "^([^_]*_[^_]*)_.*$", "$1"))


@query(
    _STEMS
    + _DUP.replace("law", "stem")
    + _GROUPS
    + f""", s AS (SELECT load_id, ns, act_id FROM g WHERE t = n QUALIFY row_number() OVER (PARTITION BY load_id, ns ORDER BY act_id) <= 300),
r AS (SELECT s.*, row_ordinal, regexp_replace(coalesce(text, ''), '^\\s+', '') AS b FROM stem JOIN s USING (load_id, act_id)),
h AS (SELECT load_id, ns, act_id, substring(b, 1, 30) AS head, regexp_matches(b, '^\\p{{Ll}}') AS small, row_number() OVER (PARTITION BY load_id, act_id ORDER BY row_ordinal) > 1 AS seam FROM r),
k AS (SELECT load_id, ns, act_id, count(DISTINCT head) AS heads, count(*) FILTER (WHERE seam) AS seams, count(*) FILTER (WHERE seam AND small) AS cont FROM h GROUP BY 1, 2, 3)
SELECT load_id, ns, count(*) AS sampled_groups, count(*) FILTER (WHERE heads = 1) AS shared_head, sum(seams)::BIGINT AS seams, sum(cont)::BIGINT AS continuations FROM k GROUP BY 1, 2"""
)
def segment_seams(spark: SparkSession, d: str) -> DataFrame:
    return audit.segment_seams(stems(law(spark, d)), FILE, "row_ordinal")


@query("SELECT sha256(text) AS text_hash, count(DISTINCT act_id) + max((act_id IS NULL)::INTEGER) AS act_ids FROM law_rows WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT act_id) + max((act_id IS NULL)::INTEGER) > 1")
def shared_content(spark: SparkSession, d: str) -> DataFrame:
    return audit.shared_content(table(spark, d, "law_rows")).withColumn("act_ids", F.col("act_ids").cast("long"))


# --------------------------------------------------------------------------- records and artifacts

_SRR = "'srr:sha256:' || sha256(snapshot || chr(0) || sha256 || chr(0) || row_ordinal::VARCHAR)"


def records(spark: SparkSession, d: str) -> DataFrame:
    """Law rows as source records: id and digest, the file's checksum being its load's."""
    return law(spark, d).withColumns({"source_record_id": I.source_record_id(F.col("snapshot"), F.col("sha256"), F.col("row_ordinal")), "raw_text_hash": I.raw_text_hash(F.col("text"))})


@query(_LAW + f" SELECT row_id, {_SRR} AS source_record_id, 'sha256:' || sha256(text) AS raw_text_hash FROM law")
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("row_id", "source_record_id", "raw_text_hash")


_GUIDANCE = ", ".join(f"'{t}'" for t in A.GUIDANCE_TYPES)
_BROAD = f"CASE WHEN document_type IN ('statute','regulation','constitution','court_rule') THEN document_type WHEN document_type IN ({_GUIDANCE}) THEN 'guidance' END"
_PFX = "CASE WHEN act_id <> '' THEN split_part(act_id, '_', 1) END"
_EXPECT = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.EXPECTED.items()) + " END"
_CLASS = (
    f", b AS (SELECT row_id, {_SRR} AS id, {_BROAD} AS broad, {_PFX} AS p FROM law), e AS (SELECT *, {_EXPECT} AS expected FROM b), "
    "c AS (SELECT *, broad IS NULL OR coalesce(expected <> broad, false) AS unsure FROM e) "
)


@query(
    _LAW
    + _CLASS
    + """SELECT row_id, CASE WHEN unsure THEN 'unknown' WHEN broad = 'regulation' AND p = 'CFR' THEN 'codified_cfr' WHEN broad = 'regulation' AND p = 'FR' THEN 'federal_register' ELSE broad END AS doc_class,
  CASE WHEN unsure THEN 'unknown' WHEN broad = 'guidance' THEN 'guidance' WHEN broad = 'regulation' AND p = 'FR' THEN 'promulgation_record' ELSE 'operative_primary_law' END AS role,
  CASE WHEN unsure THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, NOT unsure AND broad = 'regulation' AND coalesce(p = 'FR', false) AS default_off,
  'art:sha256:' || sha256('document_classification_annotation' || chr(0) || 'document_classification_deterministic' || chr(0) || '2' || chr(0) || chr(0) || 'source_record' || chr(31) || id) AS artifact_id FROM c"""
)
def classification(spark: SparkSession, d: str) -> DataFrame:
    return A.classified(records(spark, d), keep=("row_id",)).select("row_id", "doc_class", "role", "confidence", "artifact_id", "default_off")


_QUOTE = "coalesce(chr(39) || {0} || chr(39), 'None')"
_BODIES = (
    _LAW
    + _CLASS.replace("SELECT row_id,", "SELECT row_id, document_type, act_status,")
    + f""", k AS (SELECT *, CASE WHEN unsure THEN 'unknown' WHEN broad = 'regulation' AND p = 'CFR' THEN 'codified_cfr' WHEN broad = 'regulation' AND p = 'FR' THEN 'federal_register' ELSE broad END AS cls,
  CASE WHEN unsure THEN 'unknown' WHEN broad = 'guidance' THEN 'guidance' WHEN broad = 'regulation' AND p = 'FR' THEN 'promulgation_record' ELSE 'operative_primary_law' END AS role,
  NOT unsure AND broad = 'regulation' AND p IN ('CFR', 'FR') AS refined FROM c),
y AS (SELECT *, [{{'confidence': CASE WHEN NOT unsure THEN 1.0::DOUBLE END, 'detail': 'document_type ' || {_QUOTE.format("document_type")} || CASE WHEN broad IS NULL THEN ' has no broad-class mapping; abstaining' ELSE ' => ' || broad END, 'kind': 'document_type'}},
  {{'confidence': CASE WHEN NOT unsure AND (coalesce(refined, false) OR expected IS NOT NULL) THEN 1.0::DOUBLE END, 'detail': CASE WHEN broad IS NULL THEN 'act_id prefix=' || {_QUOTE.format("p")}
    WHEN unsure THEN 'prefix ' || {_QUOTE.format("p")} || ' expects ' || expected || '; contradiction -> abstain' WHEN refined THEN 'prefix ' || {_QUOTE.format("p")} || ' refines regulation => ' || cls || '/' || role
    WHEN expected IS NOT NULL THEN 'prefix ' || {_QUOTE.format("p")} || ' confirms ' || broad ELSE 'prefix ' || {_QUOTE.format("p")} || ' is non-refining/ambiguous; document_type alone set the class' END, 'kind': 'act_id_prefix'}}] AS ev FROM k),
pay AS (SELECT *, 'pay:sha256:' || sha256(to_json({{'p': {{'authority_role': role, 'confidence': CASE WHEN unsure THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 'document_class': cls, 'evidence': ev, 'target_source_record_id': id}}, 't': 'document_classification_annotation'}})::VARCHAR) AS payload,
  'art:sha256:' || sha256('document_classification_annotation' || chr(0) || 'document_classification_deterministic' || chr(0) || '2' || chr(0) || chr(0) || 'source_record' || chr(31) || id) AS art FROM y)"""
)


@query(_BODIES + " SELECT id AS source_record_id, payload AS payload_hash, ev[1].detail AS type_detail, ev[2].detail AS key_detail FROM pay")
def classification_payloads(spark: SparkSession, d: str) -> DataFrame:
    return A.classified(records(spark, d)).select("source_record_id", "payload_hash", F.col("evidence")[0]["detail"].alias("type_detail"), F.col("evidence")[1]["detail"].alias("key_detail"))


_STRATEGY = f"""CASE WHEN document_type = 'constitution' THEN 'constitution_act_id_v1'
  WHEN document_type = 'statute' THEN CASE WHEN {_PFX} = 'USC' THEN 'usc_act_id_v1' ELSE 'state_statute_act_id_v1' END
  WHEN document_type = 'regulation' THEN CASE WHEN {_PFX} = 'FR' THEN 'federal_register_document_v1' WHEN {_PFX} = 'CFR' THEN 'cfr_identity_v1' ELSE 'state_regulation_v1' END END"""
_MEMBERS = f""", m0 AS (SELECT *, {_SRR} AS id, 'sha256:' || sha256(text) AS h, {_STRATEGY} AS strategy, {_PFX} AS p FROM law),
m AS (SELECT *, CASE WHEN coalesce(state = '', true) OR coalesce(corpus = '', true) OR coalesce(act_id = '', true) THEN 'missing key'
  WHEN NOT coalesce(CASE strategy WHEN 'usc_act_id_v1' THEN p = 'USC' WHEN 'constitution_act_id_v1' THEN p IN ('CONST', 'SCONST') WHEN 'cfr_identity_v1' THEN p = 'CFR'
    WHEN 'federal_register_document_v1' THEN p = 'FR' ELSE p = 'STATE' END, false) THEN 'prefix'
  WHEN corpus <> CASE WHEN strategy IN ('usc_act_id_v1', 'state_statute_act_id_v1') THEN 'statutes' WHEN strategy = 'constitution_act_id_v1' THEN 'constitutions' ELSE 'regulations' END THEN 'corpus' END AS reject
  FROM m0 WHERE strategy IS NOT NULL),
k AS (SELECT *, row_number() OVER g - 1 AS ord, row_number() OVER t - 1 AS occ, count(*) OVER (PARTITION BY load_id, state, corpus, act_id, strategy) AS size,
  h IS NOT NULL AND count(*) OVER (PARTITION BY load_id, state, corpus, act_id, strategy, h) > 1 AS dup FROM m WHERE reject IS NULL
  WINDOW g AS (PARTITION BY load_id, state, corpus, act_id, strategy ORDER BY row_ordinal, id), t AS (PARTITION BY load_id, state, corpus, act_id, strategy, h ORDER BY row_ordinal, id)) """


@query(
    _LAW
    + _MEMBERS
    + """SELECT row_id, strategy, NULL AS reject, ord::INTEGER AS segment_ordinal, occ::INTEGER AS occurrence_index, state || '|' || corpus || '|' || act_id AS source_identity_key,
  act_id || '|' || coalesce(h, 'None') || '|' || occ::VARCHAR AS fingerprint, dup AS duplicate_row FROM k
UNION ALL SELECT row_id, strategy, reject, NULL, NULL, NULL, NULL, false FROM m WHERE reject IS NOT NULL"""
)
def identity_members(spark: SparkSession, d: str) -> DataFrame:
    return A.identity_members(records(spark, d), FILE, "row_ordinal").select("row_id", "strategy", "reject", "segment_ordinal", "occurrence_index", "source_identity_key", "fingerprint", "duplicate_row")


_GROUP_ROWS = """, q AS (SELECT load_id, strategy, state || '|' || corpus || '|' || act_id AS source_identity_key, CASE WHEN strategy IN ('usc_act_id_v1', 'state_statute_act_id_v1', 'constitution_act_id_v1') THEN id END AS part, id, ord,
  act_id || '|' || coalesce(h, 'None') || '|' || occ::VARCHAR AS fingerprint, dup AS row_dup, act_status, dup AND part IS NULL AS dup FROM k),
r AS (SELECT load_id, source_identity_key, strategy, part, count(*) AS size, count(*) FILTER (WHERE dup) AS duplicate_rows, array_to_string(list_sort(list('source_record' || chr(31) || id)), chr(30)) AS edges FROM q GROUP BY 1, 2, 3, 4),
z AS (SELECT *, CASE WHEN size = 1 THEN 'document' WHEN strategy = 'federal_register_document_v1' THEN 'numbering_bucket' ELSE 'segment' END AS scope,
  CASE WHEN size = 1 THEN 'resolved' WHEN strategy = 'federal_register_document_v1' THEN 'ambiguous' ELSE 'provisional' END AS status,
  'art:sha256:' || sha256('source_identity_group' || chr(0) || strategy || chr(0) || '1' || chr(0) || chr(0) || edges) AS artifact_id FROM r),
zz AS (SELECT *, 'art:sha256:' || sha256('duplicate_scope' || chr(0) || 'quality_duplicate_row' || chr(0) || '2' || chr(0) || chr(0) || 'annotation' || chr(31) || artifact_id || chr(30) || edges) AS scope_id FROM z)"""
_GROUP_COLUMNS = " SELECT load_id, source_identity_key, strategy, scope, status, size, duplicate_rows, artifact_id FROM zz"


@query(_LAW + _MEMBERS + _GROUP_ROWS + _GROUP_COLUMNS)
def identity_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = A.identity_groups(A.identity_members(records(spark, d), FILE, "row_ordinal"), FILE, with_members=False)
    return groups.drop("part", "distinct_members", "scope_id")


@query(_STEMS + _MEMBERS.replace("FROM law", "FROM stem") + _GROUP_ROWS + _GROUP_COLUMNS)
def stem_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of records under keys cut to a title: many members in every strategy that allows them."""
    groups = A.identity_groups(A.identity_members(stems(records(spark, d)), FILE, "row_ordinal"), FILE, with_members=False)
    return groups.drop("part", "distinct_members", "scope_id")


@query(
    _STEMS
    + _MEMBERS.replace("FROM law", "FROM stem")
    + """, r AS (SELECT load_id, state, corpus, act_id, strategy, count(*) AS size, count(*) FILTER (WHERE dup) AS dups FROM k WHERE strategy IN ('cfr_identity_v1', 'federal_register_document_v1', 'state_regulation_v1') GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1)
SELECT strategy, count(*) AS multi_groups, sum(size)::BIGINT AS multi_rows, sum(dups)::BIGINT AS duplicate_rows, max(size) AS max_group,
  count(*) FILTER (WHERE strategy = 'federal_register_document_v1') / count(*) AS ambiguous_share FROM r GROUP BY 1"""
)
def strategy_outcomes(spark: SparkSession, d: str) -> DataFrame:
    groups = A.group_sizes(A.identity_members(stems(records(spark, d)), FILE, "row_ordinal"), FILE).where("size > 1 AND part IS NULL")
    return groups.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("multi_groups"),
        F.sum("size").alias("multi_rows"),
        F.sum("duplicate_rows").alias("duplicate_rows"),
        F.max("size").alias("max_group"),
        (F.count(F.when(F.col("status") == "ambiguous", 1)) / F.count(F.lit(1))).alias("ambiguous_share"),
    )


def _members(spark: SparkSession, d: str) -> DataFrame:
    members = A.identity_members(records(spark, d), FILE, "row_ordinal")
    return written(members.select(*FILE, "source_identity_key", "strategy", "reject", "source_record_id", "segment_ordinal", "occurrence_index", "fingerprint", "raw_text_hash", "duplicate_row"), "members")


_SETS = """, x AS (SELECT id, count(*) OVER q AS n, min(id) OVER q AS set_id, string_agg(id, ', ' ORDER BY id) OVER (PARTITION BY load_id, state, corpus, act_id, strategy, h ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ids FROM k WHERE dup
  WINDOW q AS (PARTITION BY load_id, state, corpus, act_id, strategy, h))"""


@query(_LAW + _MEMBERS + _SETS + " SELECT id AS source_record_id, set_id, n AS shared_by FROM x")
def duplicate_evidence(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_evidence(_members(spark, d), FILE)


@query(_LAW + _MEMBERS + _SETS + " SELECT id AS source_record_id, 'raw_text_hash shared by ' || n || ' rows in identity group: ' || ids AS detail FROM x WHERE n <= 1000")
def duplicate_details(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_details(A.duplicate_evidence(_members(spark, d), FILE))


_ANNOTATED = _GROUP_ROWS + """, ann AS (SELECT q.*, size, artifact_id AS group_id, scope_id, 'annotation' || chr(31) || artifact_id || chr(30) || 'source_record' || chr(31) || id AS g_edges, 'annotation' || chr(31) || scope_id || chr(30) || 'source_record' || chr(31) || id AS s_edges
  FROM q JOIN zz ON zz.load_id = q.load_id AND zz.source_identity_key = q.source_identity_key AND zz.strategy = q.strategy AND zz.part IS NOT DISTINCT FROM q.part)"""


@query(
    _LAW
    + _MEMBERS
    + _ANNOTATED
    + """ SELECT id AS source_record_id, load_id, strategy, size, group_id, scope_id, ord::INTEGER AS segment_ordinal, fingerprint, row_dup AS duplicate_row, CASE WHEN size = 1 THEN 'single_record' ELSE 'physical_row_order' END AS order_method,
  CASE WHEN size = 1 THEN 'not_applicable' ELSE 'snapshot_observed' END AS order_confidence,
  'art:sha256:' || sha256('source_identity_member_annotation' || chr(0) || strategy || chr(0) || '1' || chr(0) || chr(0) || g_edges) AS artifact_id,
  'art:sha256:' || sha256('quality_annotation' || chr(0) || 'quality_duplicate_row' || chr(0) || '2' || chr(0) || chr(0) || s_edges) AS quality_id FROM ann"""
)
def member_artifacts(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    return A.member_annotations(members, written(A.identity_groups(members, FILE, with_members=False), "groups"), FILE)


_ASM = "'art:sha256:' || sha256('source_document_assembly' || chr(0) || 'source_assembly_trivial_single_record' || chr(0) || '2' || chr(0) || chr(0) || 'source_record' || chr(31) || id)"


@query(_LAW + f" SELECT id AS source_record_id, CASE WHEN text IS NULL THEN 'noncomposable' ELSE 'complete' END AS status, 'sha256:' || sha256(text) AS assembled_text_hash, {_ASM} AS artifact_id FROM (SELECT *, {_SRR} AS id FROM law)")
def assemblies(spark: SparkSession, d: str) -> DataFrame:
    return A.assembled(records(spark, d))


@query(
    _LAW
    + _MEMBERS
    + f""", a AS (SELECT id, state || '|' || corpus || '|' || act_id AS key, {_ASM} AS asm, strategy FROM k)
SELECT id AS source_record_id, key AS source_identity_key, asm AS assembly_id, 'art:sha256:' || sha256('assembly_identity_association' || chr(0) || 'key_to_assembly' || chr(0) || '1' || chr(0) || sha256(key || chr(0)) || chr(0) || 'assembly' || chr(31) || asm) AS artifact_id FROM a"""
)
def associations(spark: SparkSession, d: str) -> DataFrame:
    keys = A.identity_members(records(spark, d), FILE, "row_ordinal").where("source_identity_key IS NOT NULL")
    return A.associated(keys, "key_to_assembly", "1")


# The checks run over a damaged store: what is stored of records in some statuses is changed, and each
# change must be reported, no more.


def _status(*names: str) -> Column:
    return F.coalesce(F.col("act_status").isin(*names), F.lit(False))


@query(_BODIES + " SELECT art AS artifact_id, 2::BIGINT AS payloads FROM pay WHERE act_status = 'repealed'")
def address_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Two runs whose payloads differ for repealed records."""
    runs = A.classified(records(spark, d), keep=("act_status",))
    return A.address_conflicts(runs.unionByName(runs.withColumn("payload_hash", F.when(_status("repealed"), F.lit("pay:other")).otherwise(F.col("payload_hash")))))


@query(
    _BODIES
    + """ SELECT id AS key, unnest(CASE act_status WHEN 'repealed' THEN ['class', 'payload'] WHEN 'omitted' THEN ['confidence', 'payload'] WHEN 'renumbered' THEN ['role', 'payload']
  WHEN 'reserved' THEN ['evidence', 'payload'] WHEN 'transferred' THEN ['address'] END) AS rule FROM pay"""
)
def classification_violations(spark: SparkSession, d: str) -> DataFrame:
    stored = A.classified(records(spark, d), keep=("act_status",)).withColumns(
        {
            "doc_class": F.when(_status("repealed"), F.lit("made_up")).otherwise(F.col("doc_class")),
            "role": F.when(_status("renumbered"), F.lit("made_up")).otherwise(F.col("role")),
            "confidence": F.when(_status("omitted"), F.lit(1.5)).otherwise(F.col("confidence")),
            "evidence": F.when(_status("reserved"), F.slice("evidence", 1, 0)).otherwise(F.col("evidence")),
            "artifact_id": F.when(_status("transferred"), F.reverse("artifact_id")).otherwise(F.col("artifact_id")),
        }
    )
    return A.violations(stored, A.classification_rules(), F.col("source_record_id"))


@query(
    _LAW
    + f""" SELECT {_SRR} AS key, unnest(CASE act_status WHEN 'repealed' THEN ['id'] WHEN 'omitted' THEN ['ordinal', 'id'] WHEN 'renumbered' THEN ['hash'] WHEN 'transferred' THEN ['file'] WHEN 'reserved' THEN ['snapshot', 'id'] END) AS rule FROM law"""
)
def record_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).select("source_record_id", "act_status", "snapshot", "source_file", "sha256", F.col("row_ordinal").alias("ordinal"), "raw_text_hash", I.raw_text_hash(F.col("text")).alias("recomputed_hash"))
    stored = rows.withColumn("key", F.col("source_record_id")).withColumns(
        {
            "source_record_id": F.when(_status("repealed"), F.reverse("source_record_id")).otherwise(F.col("source_record_id")),
            "ordinal": F.when(_status("omitted"), -1 - F.col("ordinal")).otherwise(F.col("ordinal")),
            "raw_text_hash": F.when(_status("renumbered"), F.lit("sha256:0")).otherwise(F.col("raw_text_hash")),
            "source_file": F.when(_status("transferred"), F.lit("")).otherwise(F.col("source_file")),
            "snapshot": F.when(_status("reserved"), F.lit("")).otherwise(F.col("snapshot")),
        }
    )
    return A.violations(stored, A.record_rules("snapshot", "sha256"), F.col("key"))


@query(
    _LAW
    + _MEMBERS
    + _GROUP_ROWS
    + """ SELECT artifact_id AS key, unnest(CASE scope WHEN 'numbering_bucket' THEN ['members complete', 'members unique', 'status'] WHEN 'segment' THEN ['scope'] ELSE CASE WHEN strategy = 'constitution_act_id_v1' THEN ['key'] ELSE [] END END) AS rule FROM zz"""
)
def group_violations(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    stored = A.checked_groups(members, written(A.identity_groups(members, FILE, with_members=False), "groups"), FILE)
    bucket = F.col("scope") == "numbering_bucket"
    damaged = stored.withColumns(
        {
            "size": F.when(bucket, F.col("size") + 1).otherwise(F.col("size")),
            "status": F.when(bucket, F.lit("settled")).otherwise(F.col("status")),
            "scope": F.when(F.col("scope") == "segment", F.lit("chapter")).otherwise(F.col("scope")),
            "source_identity_key": F.when(F.col("strategy") == A.CONSTITUTION, F.lit("")).otherwise(F.col("source_identity_key")),
        }
    )
    return A.violations(damaged, A.checked_group_rules(), F.col("artifact_id"))


@query(
    _LAW
    + _MEMBERS
    + _ANNOTATED
    + """ SELECT id AS key, unnest(CASE act_status WHEN 'repealed' THEN ['order'] WHEN 'omitted' THEN ['ordinal'] WHEN 'renumbered' THEN ['address', 'quality address'] WHEN 'transferred' THEN ['group', 'address'] WHEN 'reserved' THEN ['scope', 'quality address'] WHEN 'superseded' THEN ['confidence'] END) AS rule FROM ann"""
)
def member_violations(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    stored = A.member_annotations(members, written(A.identity_groups(members, FILE, with_members=False), "groups"), FILE)
    status = records(spark, d).select("source_record_id", "act_status")
    damaged = stored.join(status, "source_record_id").withColumns(
        {
            "order_method": F.when(_status("repealed"), F.lit("alphabetical")).otherwise(F.col("order_method")),
            "order_confidence": F.when(_status("superseded"), F.lit("sure")).otherwise(F.col("order_confidence")),
            "segment_ordinal": F.when(_status("omitted"), -1).otherwise(F.col("segment_ordinal")),
            "artifact_id": F.when(_status("renumbered"), F.reverse("artifact_id")).otherwise(F.col("artifact_id")),
            "quality_id": F.when(_status("renumbered"), F.reverse("quality_id")).otherwise(F.col("quality_id")),
            "group_id": F.when(_status("transferred"), F.lit("")).otherwise(F.col("group_id")),
            "scope_id": F.when(_status("reserved"), F.lit("")).otherwise(F.col("scope_id")),
        }
    )
    return A.violations(damaged, A.member_rules(), F.col("source_record_id"))


@query(
    _LAW
    + _MEMBERS
    + _ANNOTATED
    + """ SELECT group_id, CASE WHEN count(*) FILTER (WHERE act_status = 'repealed') > 0 AND count(*) FILTER (WHERE act_status = 'omitted') > 0 THEN 'missing and repeated' WHEN count(*) FILTER (WHERE act_status = 'repealed') > 0 THEN 'missing' ELSE 'repeated' END AS problem
FROM ann WHERE act_status IN ('repealed', 'omitted') GROUP BY 1"""
)
def annotation_links(spark: SparkSession, d: str) -> DataFrame:
    """Groups of which a member has no annotation (those of repealed records are left out) or two (omitted)."""
    members = _members(spark, d)
    groups = written(A.identity_groups(members, FILE, with_members=False), "groups")
    notes = A.member_annotations(members, groups, FILE).join(records(spark, d).select("source_record_id", "act_status"), "source_record_id").where(~_status("repealed"))
    return A.unlinked_members(members, groups, notes.unionByName(notes.where(_status("omitted"))), FILE)


@query(
    _LAW
    + f""", a AS (SELECT {_SRR} AS id, text, act_status FROM law)
SELECT id AS key, unnest(list_concat(CASE WHEN text IS NULL OR text = '' THEN ['text'] ELSE [] END, CASE WHEN act_status = 'repealed' THEN ['hash'] WHEN act_status = 'omitted' THEN ['status', 'text'] WHEN act_status = 'renumbered' THEN ['address'] ELSE [] END)) AS rule FROM a"""
)
def assembly_violations(spark: SparkSession, d: str) -> DataFrame:
    """Missing texts are said to be complete and empty ones to be none; digests of repealed records are lost."""
    rows = records(spark, d)
    stored = A.assembled(rows.select("source_record_id", "text", "act_status"), with_text=True, keep=("act_status",))
    text = F.col("assembled_text")
    damaged = stored.withColumns(
        {
            "status": F.when(_status("omitted"), F.lit("whole")).when(text.isNull(), F.lit("complete")).when(text == "", F.lit("noncomposable")).otherwise(F.col("status")),
            "assembled_text_hash": F.when(_status("repealed"), F.lit(None)).otherwise(F.col("assembled_text_hash")),
            "artifact_id": F.when(_status("renumbered"), F.reverse("artifact_id")).otherwise(F.col("artifact_id")),
        }
    )
    return A.violations(damaged, A.assembly_rules(), F.col("source_record_id"))


@query(
    _LAW
    + _MEMBERS
    + """ SELECT id AS key, unnest(CASE act_status WHEN 'repealed' THEN ['key', 'address'] WHEN 'omitted' THEN ['assembly', 'address'] WHEN 'renumbered' THEN ['key is no edge', 'address'] WHEN 'transferred' THEN ['address'] END) AS rule FROM k"""
)
def association_violations(spark: SparkSession, d: str) -> DataFrame:
    keys = A.identity_members(records(spark, d), FILE, "row_ordinal", keep=("act_status",)).where("source_identity_key IS NOT NULL")
    stored = A.associated(keys, "key_to_assembly", "1", keep=("act_status",))
    damaged = stored.withColumns(
        {
            "source_identity_key": F.when(_status("repealed"), F.lit("")).when(_status("renumbered"), F.col("assembly_id")).otherwise(F.col("source_identity_key")),
            "assembly_id": F.when(_status("omitted"), F.lit("")).otherwise(F.col("assembly_id")),
            "artifact_id": F.when(_status("transferred"), F.reverse("artifact_id")).otherwise(F.col("artifact_id")),
        }
    )
    return A.violations(damaged, A.association_rules("key_to_assembly", "1"), F.col("source_record_id"))


# --------------------------------------------------------------------------- difference


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each snapshot and of the one before, under the later one's version (``step``)."""
    rows = table(spark, d, "snapshot_rows")
    steps = version_steps(rows, "snapshot_version")
    old = rows.join(steps.select(F.col("before").alias("snapshot_version"), F.col("version").alias("step")), "snapshot_version")
    return old, rows.join(steps.select(F.col("version").alias("snapshot_version"), F.col("version").alias("step")), "snapshot_version")


_STEPS = """WITH s AS (SELECT version AS step, lag(version) OVER (ORDER BY version) AS before FROM (SELECT DISTINCT snapshot_version AS version FROM snapshot_rows WHERE snapshot_version IS NOT NULL)),
o AS (SELECT step, source_file, r.* EXCLUDE (source_file) FROM snapshot_rows r JOIN s ON r.snapshot_version = s.before), n AS (SELECT step, source_file, r.* EXCLUDE (source_file) FROM snapshot_rows r JOIN s ON r.snapshot_version = s.step WHERE s.before IS NOT NULL),
"""
_STRIP = r"regexp_replace(regexp_extract(x, '(?s)^(.*?)(\n(Editorial Notes|Statutory Notes|Amendments)\n.*)?$', 1), '^\s+|\s+$', '', 'g')"
_CHANGES = (
    _STEPS
    + """ok AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY step, source_file, act_id ORDER BY row_ordinal DESC, row_id DESC) = 1),
nk AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY step, source_file, act_id ORDER BY row_ordinal DESC, row_id DESC) = 1),
j AS (SELECT coalesce(ok.step, nk.step) AS step, coalesce(ok.source_file, nk.source_file) AS source_file, coalesce(ok.act_id, nk.act_id) AS act_id, ok.row_id AS oi, nk.row_id AS ni,
  ok.text AS ot, nk.text AS nt, coalesce(ok.text, '') AS a, coalesce(nk.text, '') AS b FROM ok FULL JOIN nk ON ok.step = nk.step AND ok.source_file IS NOT DISTINCT FROM nk.source_file AND ok.act_id IS NOT DISTINCT FROM nk.act_id),
d AS (SELECT *, CASE WHEN oi IS NULL THEN 'added' WHEN ni IS NULL THEN 'removed' WHEN ot IS NOT DISTINCT FROM nt THEN 'unchanged' ELSE 'amended' END AS change,
  """
    + _STRIP.replace("(x,", "(a,")
    + " = "
    + _STRIP.replace("(x,", "(b,")
    + " AS op FROM j)"
)


@query(
    _CHANGES
    + """ SELECT step, source_file, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'amended') AS amended, count(*) FILTER (WHERE change = 'added') AS added,
  count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'amended' AND length(b) > length(a)) AS grew, count(*) FILTER (WHERE change = 'amended' AND length(b) < length(a)) AS shrank,
  count(*) FILTER (WHERE change = 'amended' AND op) AS same_operative, coalesce(sum(length(a)) FILTER (WHERE change = 'amended'), 0)::BIGINT AS old_chars, coalesce(sum(length(b)) FILTER (WHERE change = 'amended'), 0)::BIGINT AS new_chars
FROM d GROUP BY 1, 2"""
)
def difference_totals(spark: SparkSession, d: str) -> DataFrame:
    changes = difference.compare_snapshots(*_pairs(spark, d), ["step", "source_file"], ["row_ordinal", "row_id"])
    return difference.difference_totals(changes, ["step", "source_file"])


@query(_CHANGES + " SELECT step, source_file, act_id, change FROM d WHERE change <> 'unchanged'")
def difference_keys(spark: SparkSession, d: str) -> DataFrame:
    changes = difference.compare_snapshots(*_pairs(spark, d), ["step", "source_file"], ["row_ordinal", "row_id"])
    return changes.where("change <> 'unchanged'").select("step", "source_file", "act_id", "change")


@query(
    _STEPS
    + r"""k AS (SELECT DISTINCT step, source_file, act_id FROM o) SELECT n.step, n.source_file, n.row_id, n.act_id, n.act_status AS status, k.step IS NOT NULL AS self_in_old,
  nullif(regexp_extract(coalesce(n.text, ''), '(Renumbered|Transferred|Recodified)\s+§+\s*([0-9A-Za-z.\-]+)', 2, 'i'), '') AS successor FROM n LEFT JOIN k ON k.step = n.step AND k.source_file IS NOT DISTINCT FROM n.source_file AND k.act_id IS NOT DISTINCT FROM n.act_id
WHERE n.act_status IN ('renumbered', 'transferred', 'recodified')"""
)
def moved_rows(spark: SparkSession, d: str) -> DataFrame:
    return difference.moved_rows(*_pairs(spark, d), ["step", "source_file"])


# --------------------------------------------------------------------------- hierarchy


def levels(spark: SparkSession, d: str) -> DataFrame:
    rows = law(spark, d).select("row_id", "load_id", "corpus", "row_ordinal", "breadcrumb", "display_path", "act_id")
    return hierarchy.with_levels(rows)


_OK = "json_valid(breadcrumb) AND json_type(breadcrumb) = 'ARRAY'"
_KINDS = ", ".join(f"'{k}'" for k in hierarchy.KINDS)
_NODES = (
    _LAW
    + f""", r AS (SELECT row_id, load_id, corpus, row_ordinal, display_path, CASE WHEN {_OK} THEN from_json(breadcrumb, '["JSON"]') END AS els FROM law),
r2 AS (SELECT * REPLACE (CASE WHEN len(list_filter(els, lambda x: json_type(x) <> 'OBJECT')) = 0 THEN els END AS els) FROM r),
e AS (SELECT row_id, load_id, corpus, row_ordinal, display_path, unnest(els) AS x, unnest(range(1, len(els) + 1)) AS lvl, len(els) AS depth FROM r2 WHERE len(els) > 0),
f AS (SELECT *, CASE WHEN json_type(x, '$.type') = 'VARCHAR' THEN x->>'$.type' END AS ty, CASE WHEN json_type(x, '$.num') = 'VARCHAR' THEN nullif(trim(x->>'$.num'), '') END AS ident,
  CASE WHEN json_type(x, '$.label') = 'VARCHAR' THEN nullif(x->>'$.label', '') END AS lb, CASE WHEN json_type(x, '$.name') = 'VARCHAR' THEN nullif(x->>'$.name', '') END AS nm FROM e),
g AS (SELECT *, CASE WHEN lower(trim(ty)) IN ({_KINDS}) THEN lower(trim(ty)) ELSE 'other' END AS kind, CASE WHEN ty <> '' AND NOT lower(trim(ty)) IN ({_KINDS}) THEN ty END AS raw FROM f),
h AS (SELECT *, coalesce(lb, nm, kind || ' ' || ident, kind) AS label FROM g),
p AS (SELECT row_id, load_id, corpus, row_ordinal, display_path, depth, list(kind ORDER BY lvl) AS kinds, list(ident ORDER BY lvl) AS idents, list(label ORDER BY lvl) AS labels, list(kind || ':' || coalesce(ident, label) ORDER BY lvl) AS keys FROM h GROUP BY ALL)"""
)


@query(
    _NODES
    + """ SELECT l.corpus, count(*) AS n_rows, count(p.row_id) AS parse_ok, coalesce(sum(p.depth), 0)::BIGINT AS nodes, coalesce(sum(len(list_filter(p.idents, lambda x: x IS NOT NULL))), 0)::BIGINT AS identified, coalesce(max(p.depth), 0) AS deepest,
  count(*) FILTER (WHERE len(list_distinct(p.keys)) < len(p.keys)) AS cyclic FROM law l LEFT JOIN p USING (row_id) GROUP BY 1"""
)
def hierarchy_corpora(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.corpus_levels(levels(spark, d), "corpus")


@query(_NODES + " SELECT corpus, kind, raw AS raw_kind, count(*) AS n FROM h GROUP BY 1, 2, 3")
def hierarchy_kinds(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.level_histogram(levels(spark, d), "corpus")


@query(_NODES + " SELECT p.corpus, l.act_id, p.depth FROM p JOIN law l USING (row_id) QUALIFY row_number() OVER (PARTITION BY p.corpus ORDER BY p.depth DESC, p.row_id) = 1")
def deepest_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.deepest_paths(levels(spark, d), "corpus", "row_id")


@query(_NODES + " SELECT corpus, depth, count(*) AS n FROM p GROUP BY 1, 2")
def hierarchy_depths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.depth_histogram(levels(spark, d), "corpus")


@query(_NODES + " SELECT row_id, array_to_string(keys, '/') AS path FROM p")
def structural_paths(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, d).where(F.size("levels") > 0).select("row_id", hierarchy.structural_path(F.col("levels")).alias("path"))


@query(
    _NODES
    + """, t AS (SELECT corpus, labels, CASE WHEN trim(display_path) <> '' THEN list_transform(string_split(display_path, ' / ')[2:], lambda x: trim(x)) ELSE [] END AS segs FROM p),
v AS (SELECT corpus, CASE WHEN len(segs) = 0 THEN 'no_display' WHEN len(segs) <> len(labels) THEN 'length_mismatch' WHEN segs = labels THEN 'exact'
  WHEN len(list_filter(list_zip(segs, labels), lambda z: NOT (z[1] = z[2] OR starts_with(z[1], z[2] || ' ')))) = 0 THEN 'prefix' ELSE 'label_mismatch' END AS status FROM t)
SELECT corpus, status, count(*) AS n FROM v GROUP BY 1, 2"""
)
def round_trips(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.round_trip_counts(levels(spark, d), "corpus")


@query(
    _NODES
    + """, q AS (SELECT DISTINCT corpus, keys[depth] AS leaf, CASE WHEN depth > 1 THEN array_to_string(keys[:depth - 1], '/') ELSE '<root>' END AS parent FROM p), c AS (SELECT corpus, leaf, count(*) AS n FROM q GROUP BY 1, 2)
SELECT corpus, count(*) AS leaves, count(*) FILTER (WHERE n > 1) AS ambiguous FROM c GROUP BY 1"""
)
def leaf_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.leaf_ambiguity(levels(spark, d), "corpus")


@query(
    _NODES
    + """, x AS (SELECT corpus, unnest(range(1, depth + 1)) AS i, keys FROM p) SELECT corpus, count(DISTINCT array_to_string(keys[:i], '/')) AS tree_nodes, 0::BIGINT AS multi_parent FROM x GROUP BY 1"""
)
def tree_sizes(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.tree_nodes(levels(spark, d), "corpus", "row_id")
    return nodes.groupBy("corpus").agg(F.count(F.lit(1)).alias("tree_nodes"), F.lit(0).cast("long").alias("multi_parent"))


@query(
    _NODES
    + r""", x AS (SELECT corpus, row_id, unnest(range(1, depth + 1)) AS i, keys, idents, labels FROM p),
n AS (SELECT corpus, array_to_string(keys[:i], '/') AS path, array_to_string(keys[:i - 1], '/') AS parent, i, any_value(coalesce(idents[i], labels[i])) AS ident, min(row_id) AS first FROM x GROUP BY 1, 2, 3, 4),
t AS (SELECT *, list_transform(regexp_extract_all(ident, '[0-9]+|[^0-9]+'), lambda y: CASE WHEN y[1] BETWEEN '0' AND '9' THEN '0' || lpad(y, 40, '0') ELSE '1' || y END) AS k FROM n),
o AS (SELECT *, coalesce(k >= lag(k) OVER (PARTITION BY corpus, parent, i ORDER BY first, path), true) AS fine FROM t),
sib AS (SELECT corpus, parent, i, count(*) AS kids, bool_and(fine) AS fine FROM o GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT corpus, count(*) AS parents, count(*) FILTER (WHERE fine) AS in_order FROM sib GROUP BY 1"""
)
def sibling_order(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.sibling_order(hierarchy.tree_nodes(levels(spark, d), "corpus", "row_id"), "corpus")


@query(
    _NODES
    + r""" SELECT p.corpus, count(*) AS parsed, count(DISTINCT l.act_id) AS act_ids, count(DISTINCT array_to_string(keys, '/')) AS paths,
  count(*) FILTER (WHERE NOT coalesce(regexp_matches(replace(replace(idents[depth], '.', ''), '-', ''), '^\d+$'), false)) AS nonnumeric_leaves FROM p JOIN law l USING (row_id) GROUP BY 1"""
)
def probe_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.probe_paths(levels(spark, d), "corpus")


@query(_NODES + " SELECT corpus, kinds[depth] AS leaf_kind, count(*) AS n FROM p GROUP BY 1, 2")
def leaf_kinds(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.leaf_kinds(levels(spark, d), "corpus")


@query(
    _NODES
    + """ SELECT corpus, kind, identifier IS NOT NULL AS identified, raw IS NOT NULL AS raw, CASE WHEN kind <> 'other' OR lower(trim(ty)) = 'other' THEN 1.0 WHEN coalesce(ty, '') = '' THEN 0.3 ELSE 0.5 END * CASE WHEN identifier IS NULL THEN 0.5 ELSE 1.0 END AS confidence,
  count(*) AS n FROM (SELECT *, ident AS identifier FROM h) GROUP BY ALL"""
)
def level_confidences(spark: SparkSession, d: str) -> DataFrame:
    each = levels(spark, d).select("corpus", F.explode("levels").alias("n"))
    return each.groupBy("corpus", "n.kind", F.col("n.identifier").isNotNull().alias("identified"), F.col("n.raw_kind").isNotNull().alias("raw"), "n.confidence").agg(F.count(F.lit(1)).alias("n"))

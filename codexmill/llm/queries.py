"""Queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.llm.fold import collapsed_records, formatting_copies
from codexmill.llm.leaks import find_leaks
from codexmill.llm.packing import pack_texts, packing_report
from codexmill.llm.sentences import split_sentences
from codexmill.llm.similar import class_links, similar_classes, similar_pairs
from codexmill.operators.workspace import written
from codexmill.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_copies(table(spark, d, "source_records"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed_records(table(spark, d, "source_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(*similar_classes(table(spark, d, "source_records"), width=3, threshold=Fraction(3, 5), min_words=30))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every record's class and the links of its class, at five words and a similarity of 0.8."""
    return class_links(*similar_classes(table(spark, d, "source_records"), family_members=500_000))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), table(spark, d, "pack_budgets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must keep, per budget. Near the least number of containers means within 2 %;
    neighbours are alike if texts in a container have one language a quarter more often than any two."""
    docs, budgets = table(spark, d, "documents"), table(spark, d, "pack_budgets")
    report = packing_report(written(pack_texts(docs, budgets), "packed"), docs, budgets, "lang")
    near = F.col("containers") <= F.ceil(F.col("least_containers") * 1.02) + 1
    return report.select("budget_id", "texts", "overfull", "gaps", "split", near.alias("near_least"), (F.col("alike_inside") > 1.25 * F.col("alike_among_all")).alias("neighbours_alike"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), paraphrases=True)
    return found.where("run_words = 0").select("doc_id", "item_id", "common_words")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents"))


_SIMILAR_SQL = """
WITH w AS (SELECT row_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM source_records),
s AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
      FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 30)),
n AS (SELECT row_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.row_id < b.row_id GROUP BY 1, 2)
SELECT a AS row_id_a, b AS row_id_b FROM o JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b
WHERE o * 5 >= 3 * (x.n + y.n - o)
"""

_CLASSES_SQL = """
WITH w AS (SELECT row_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM source_records WHERE row_id IS NOT NULL),
s AS (SELECT DISTINCT row_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
n AS (SELECT row_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS h FROM s GROUP BY 1),
c AS (SELECT row_id, n, min(row_id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS copies FROM n),
k AS (SELECT s.row_id, s.s, c.n FROM s JOIN c USING (row_id) WHERE c.row_id = c.class_id),
o AS (SELECT a.row_id AS a, b.row_id AS b FROM k a JOIN k b ON a.s = b.s AND a.row_id <> b.row_id GROUP BY 1, 2 HAVING count(*) * 5 >= 4 * (any_value(a.n) + any_value(b.n) - count(*)))
SELECT row_id, class_id, copies, (SELECT count(*) FROM o WHERE o.a = c.class_id) AS links FROM c
"""

_BARE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_END = "(\\r\\n|\\r|\\n)[ \\t\\f\\v]*(\\r\\n|\\r|\\n)"
_COPIES_SQL = f"""
WITH b AS (SELECT row_id, act_id, regexp_replace(text, '^\\s+', '') AS b FROM source_records WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) >= 30),
h AS (SELECT *, CASE WHEN b LIKE '[%' AND contains(b, ']') THEN substring(b, 2, position(']' IN b) - 2)
    WHEN regexp_matches(b, '(?i)^(authority|source|effective|agency)\\s*:') AND regexp_matches(b, '{_END}') THEN regexp_extract(b, '(?s)^(.*?){_END}', 1) END AS head,
  CASE WHEN b LIKE '[%' THEN substring(b, position(']' IN b) + 1) ELSE regexp_replace(b, '(?s)^.*?{_END}', '') END AS rest FROM b),
f AS (SELECT *, list_filter(regexp_split_to_array(head, '[|;\\r\\n]'), lambda x: trim(x) <> '') AS parts FROM h),
g AS (SELECT row_id, {_BARE.format("coalesce(act_id, '')")} AS k, b, rest, parts,
  len(parts) > 0 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '(?i)^\\s*(authority|source|effective|agency)\\s*:'))) = 0 AS ok FROM f),
c AS (SELECT row_id, k, CASE WHEN ok THEN list_sort(list_transform(parts, lambda x: {_BARE.format("x")})) ELSE [] END AS fields, {_BARE.format("CASE WHEN ok THEN rest ELSE b END")} AS body FROM g)
"""
_COLLAPSED_SQL = _COPIES_SQL + "SELECT min(row_id) AS row_id, count(*) AS copies FROM c GROUP BY k, fields, body"
_COPIES_SQL += "SELECT kept_row_id, row_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY k, fields, body) AS kept_row_id FROM c) WHERE row_id <> kept_row_id"
_HAN = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]"
_LEAKS_SQL = f"""
WITH t AS (SELECT false AS held, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM eval_items),
w AS (SELECT held, id, regexp_extract_all(regexp_replace(lower(text), '({_HAN})', ' \\1 ', 'g'), '{_HAN}|[\\p{{L}}\\p{{N}}]+') AS w FROM t WHERE text IS NOT NULL),
g AS (SELECT held, id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT held, id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g WHERE NOT d.held AND i.held
"""

# Spans of 39 words of documents against passages of 26 words of items: answer words first, then the
# longest common subsequence, row by row: the states of a passage's prefixes after each word of a span.
_PARAPHRASES_SQL = f"""
WITH t AS (SELECT false AS held, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM eval_items),
w AS (SELECT held, id, row_number() OVER () AS r, regexp_extract_all(regexp_replace(lower(text), '({_HAN})', ' \\1 ', 'g'), '{_HAN}|[\\p{{L}}\\p{{N}}]+') AS w FROM t WHERE text IS NOT NULL),
vocabulary AS (SELECT DISTINCT unnest(w) AS word FROM w WHERE held),
df AS (SELECT v.word, count(DISTINCT d.r) AS df FROM vocabulary v LEFT JOIN (SELECT DISTINCT r, unnest(w) AS word FROM w WHERE NOT held) d USING (word) GROUP BY 1),
q AS (SELECT id AS item_id, row_number() OVER () AS q, w[a + 1:a + 26] AS q_words FROM (SELECT id, w, unnest(range(0, len(w), 13)) AS a FROM w WHERE held) WHERE len(w[a + 1:a + 26]) >= 13),
z AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY df, word) AS rare FROM (SELECT DISTINCT q, unnest(q_words) AS word FROM q) JOIN df USING (word)),
answers AS (SELECT q, word, count(*) OVER (PARTITION BY q) AS n FROM z WHERE rare <= 4 OR regexp_matches(word, '^\\p{{Nd}}+$')),
s AS (SELECT id AS doc_id, row_number() OVER () AS s, w[13 * a + 1:13 * a + 39] AS s_words FROM (SELECT id, w, unnest(range(0, greatest(1, (len(w) + 12) // 13 - 1))) AS a FROM w WHERE NOT held)),
c AS (SELECT s, q FROM (SELECT DISTINCT s, unnest(s_words) AS word FROM s) JOIN answers USING (word) GROUP BY 1, 2 HAVING count(*) >= any_value(n) // 2 + 1),
p AS (SELECT doc_id, item_id, q_words, len(q_words) AS n, list_filter(s_words, lambda x: list_contains(q_words, x)) AS s_words FROM c JOIN s USING (s) JOIN q USING (q) WHERE len(list_filter(q_words, lambda x: list_contains(s_words, x))) >= ceil(0.6 * len(q_words) - 1e-9)),
l AS (SELECT doc_id, item_id, n, list_reduce(list_prepend(list_transform(q_words, lambda x: 0::BIGINT), list_transform(s_words, lambda y: list_transform(q_words, lambda x: (x = y)::BIGINT))),
  lambda state, same: list_transform([list_transform(range(1, len(same) + 1), lambda i: CASE WHEN same[i] = 1 THEN CASE WHEN i > 1 THEN state[i - 1] ELSE 0 END + 1 ELSE state[i] END)],
    lambda e: list_transform(range(1, len(e) + 1), lambda j: list_max(e[1:j])))[1])[n] AS common FROM p),
runs AS ({{runs}})
SELECT doc_id, item_id, max(common)::INTEGER AS common_words FROM l WHERE common >= ceil(0.6 * n - 1e-9) AND (doc_id, item_id) NOT IN (SELECT (doc_id, item_id) FROM runs) GROUP BY 1, 2
""".replace("{runs}", _LEAKS_SQL)
_PACKED_SQL = """
SELECT budget_id, (SELECT count(*) FROM documents) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS split, true AS near_least, true AS neighbours_alike
FROM pack_budgets WHERE capacity_tokens > 0
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_collapsed, p5_found, p5_classes, p6_pack, p6_report, p7_found, p7_paraphrases, p8_found)}
ORACLES = {"p4_found": _COPIES_SQL, "p4_collapsed": _COLLAPSED_SQL, "p5_found": _SIMILAR_SQL, "p5_classes": _CLASSES_SQL, "p6_report": _PACKED_SQL, "p7_found": _LEAKS_SQL, "p7_paraphrases": _PARAPHRASES_SQL}

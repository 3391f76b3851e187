"""Queries of the three general training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.operators.nested import link_by_containment, nested_nodes, node_table
from codexmill.operators.profile import control_limits, load_metrics, profile_loads
from codexmill.operators.snapshots import snapshot_changes
from codexmill.operators.workspace import written
from codexmill.schema import INTEGER_COLUMNS, SNAPSHOT_COLUMNS
from codexmill.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested_nodes(table(spark, d, "source_records"), with_fields=False)
    return nodes.select("row_id", F.col("pre").alias("item_no"), F.col("parent_pre").alias("parent_no"), F.col("kind").alias("item_kind"))


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested_nodes(table(spark, d, "source_records"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return nested_nodes(table(spark, d, "source_records"), with_fields=False)


#: The node tables of the kinds that breadcrumbs have, with the members of each.
NODE_TABLES = {
    "p1_levels": ("breadcrumb", ("type", "num", "label", "name")),
    "p1_provisions": ("parts", ("type", "num", "label", "name")),
    "p1_notes": ("notes", ("kind", "body")),
    "p1_references": ("refs", ("cite", "target")),
    "p1_sources": ("source", ("url", "as_of")),
}


def _node_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    kind, members = NODE_TABLES[name]
    return lambda spark, d: node_table(p1_nodes(spark, d), kind, dict.fromkeys(members, "string"))


def p1_reference_provisions(spark: SparkSession, d: str) -> DataFrame:
    """Each reference with the innermost provision around it, found by the intervals of the two tables."""
    nodes = written(nested_nodes(table(spark, d, "source_records"), with_fields=False, record="record"), "nodes")
    references = nodes.where("kind = 'refs'")
    links = link_by_containment(references, nodes.where("kind = 'parts'"))
    return references.join(links, ["record", "pre"]).select("row_id", "pre", F.col("ancestor_pre").alias("provision_pre"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile_loads(table(spark, d, "law_rows"), table(spark, d, "file_loads"))


def p2_metrics(spark: SparkSession, d: str) -> DataFrame:
    return load_metrics(table(spark, d, "law_rows"))


def p2_control_limits(spark: SparkSession, d: str) -> DataFrame:
    return control_limits(p2_metrics(spark, d), table(spark, d, "file_loads"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "snapshot_rows"))


def _profile_sql() -> str:
    """A statement per measure over the raw rows, united."""
    shares, ranges = [], []
    parts = [
        "SELECT load_id, 'act_id' AS column_name, 'not_unique' AS measure FROM (SELECT load_id, act_id FROM law_rows "
        "WHERE act_id IS NOT NULL AND load_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1"
    ]
    for c in SNAPSHOT_COLUMNS:
        blank = "0" if c in INTEGER_COLUMNS else f"count(*) FILTER (WHERE {c} = '')"
        low, high = (f"min({c})", f"max({c})") if c in INTEGER_COLUMNS else ("NULL::BIGINT", "NULL::BIGINT")
        shares.append(
            f"SELECT load_id, '{c}' AS column_name, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, {blank} AS blanks, "
            f"count(DISTINCT {c}) AS ds, {low} AS low, {high} AS high FROM law_rows WHERE load_id IS NOT NULL GROUP BY 1"
        )
    both = "FROM m c JOIN b ON b.load_id = c.load_id JOIN m p ON p.load_id = b.prev_load_id AND p.column_name = c.column_name"
    for name, cond in (
        ("null_rate", "abs(c.nulls * p.n - p.nulls * c.n) * 100 > 15 * c.n * p.n"),
        ("empty_rate", "abs(c.blanks * p.n - p.blanks * c.n) * 100 > 15 * c.n * p.n"),
        ("distinct_count", "least(c.ds, p.ds) > 0 AND greatest(c.ds, p.ds) >= 20 AND greatest(c.ds, p.ds) > 2 * least(c.ds, p.ds)"),
        ("value_range", "greatest(c.high - p.high, p.low - c.low) > p.high - p.low"),
    ):
        ranges.append(f"SELECT c.load_id, c.column_name, '{name}' {both} WHERE {cond}")
    parts += ranges
    for c in ("act_id", "citation", "section_number", "source_url"):
        shape = f"regexp_replace(regexp_replace(regexp_replace({c}, '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[0-9]+', '9', 'g')"
        parts.append(
            f"SELECT load_id, '{c}', 'pattern' FROM (SELECT c.load_id, c.s, EXISTS (SELECT 1 FROM law_rows q WHERE q.load_id = b.prev_load_id AND q.{c} <> '' "
            f"AND {shape.replace(f'({c}', f'(q.{c}')} = c.s) AS old FROM (SELECT load_id, {shape} AS s FROM law_rows WHERE {c} <> '') c "
            "JOIN b ON b.load_id = c.load_id WHERE EXISTS (SELECT 1 FROM law_rows q WHERE q.load_id = b.prev_load_id)) "
            "GROUP BY 1 HAVING count(*) FILTER (WHERE NOT old) * 100 > 5 * count(*)"
        )
    for c in ("act_status", "document_type"):
        parts.append(
            f"SELECT load_id, '{c}', 'distribution' FROM (SELECT load_id, v, sum(c) AS c, sum(p) AS p FROM ("
            f"SELECT t.load_id, t.{c} AS v, 1.0 / s.n AS c, 0 AS p FROM law_rows t JOIN b USING (load_id) JOIN t s USING (load_id) JOIN t z ON z.load_id = b.prev_load_id UNION ALL "
            f"SELECT b.load_id, t.{c}, 0, 1.0 / s.n FROM law_rows t JOIN b ON b.prev_load_id = t.load_id JOIN t s ON s.load_id = t.load_id JOIN t z ON z.load_id = b.load_id"
            ") GROUP BY 1, 2) GROUP BY 1 HAVING sum(abs(c - p)) > 0.4 + 1e-9"
        )
    return (
        f"WITH m AS ({' UNION ALL '.join(shares)}), t AS (SELECT load_id, count(*)::DOUBLE AS n FROM law_rows GROUP BY 1), "
        "b AS (SELECT DISTINCT load_id, prev_load_id FROM file_loads WHERE prev_load_id IS NOT NULL) " + " UNION ALL ".join(parts)
    )


def _metrics_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT load_id, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        + ("0::BIGINT AS empty_count" if c in INTEGER_COLUMNS else f"count(*) FILTER (WHERE {c} = '') AS empty_count")
        + f", count(DISTINCT {c}) AS distinct_count, "
        + (f"min({c}) AS min_value, max({c}) AS max_value" if c in INTEGER_COLUMNS else "NULL::BIGINT AS min_value, NULL::BIGINT AS max_value")
        + " FROM law_rows WHERE load_id IS NOT NULL GROUP BY load_id"
        for c in SNAPSHOT_COLUMNS
    )


_CHANGES_SQL = """
WITH kept AS (
  SELECT * FROM snapshot_rows WHERE act_id IS NOT NULL AND snapshot_version IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_version, act_id ORDER BY row_ordinal DESC NULLS LAST, row_id DESC) = 1
), steps AS (
  SELECT version, lag(version) OVER (ORDER BY version) AS before
  FROM (SELECT DISTINCT snapshot_version AS version FROM snapshot_rows WHERE snapshot_version IS NOT NULL)
)
SELECT s.version AS snapshot_version, n.act_id,
       CASE WHEN o.act_id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM steps s JOIN kept n ON n.snapshot_version = s.version
LEFT JOIN kept o ON o.snapshot_version = s.before AND o.act_id = n.act_id
WHERE s.before IS NOT NULL AND (o.act_id IS NULL OR o.text IS DISTINCT FROM n.text OR o.act_status IS DISTINCT FROM n.act_status)
UNION ALL
SELECT s.version, o.act_id, 'removed' FROM steps s JOIN kept o ON o.snapshot_version = s.before
WHERE NOT EXISTS (SELECT 1 FROM kept n WHERE n.snapshot_version = s.version AND n.act_id = o.act_id)
"""

_NODES_SQL = """
WITH RECURSIVE v AS (
  SELECT row_id, breadcrumb, display_path, json_valid(breadcrumb) AND json_type(breadcrumb) = 'ARRAY' AND json_array_length(breadcrumb) > 0
    AND len(list_filter(from_json(breadcrumb, '["JSON"]'), lambda x: json_type(x) <> 'OBJECT')) = 0 AS ok
  FROM (SELECT row_id, display_path, CASE WHEN json_valid(breadcrumb) THEN breadcrumb END AS breadcrumb FROM source_records)
), t AS (SELECT v.row_id, j.id, j.parent, j.type, j.key, j.value FROM v, json_tree(v.breadcrumb) j WHERE v.ok),
up AS (
  SELECT row_id, id, parent AS above, CASE WHEN key IS NOT NULL AND NOT regexp_matches(key, '^[0-9]+$') THEN key END AS kind FROM t WHERE type = 'OBJECT'
  UNION ALL
  SELECT u.row_id, u.id, a.parent, coalesce(u.kind, CASE WHEN a.key IS NOT NULL AND NOT regexp_matches(a.key, '^[0-9]+$') THEN a.key END)
  FROM up u JOIN t a ON a.row_id = u.row_id AND a.id = u.above WHERE a.type = 'ARRAY'
), o AS (
  SELECT u.row_id, u.id, u.above, u.kind, row_number() OVER (PARTITION BY u.row_id ORDER BY u.id) - 1 AS n
  FROM up u LEFT JOIN t a ON a.row_id = u.row_id AND a.id = u.above WHERE a.type = 'OBJECT' OR u.above IS NULL
), p AS (
  SELECT o.row_id, o.id, o.n, CASE WHEN o.above IS NULL THEN coalesce(max(CASE WHEN o.above IS NULL THEN o.n END) OVER (PARTITION BY o.row_id ORDER BY o.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) ELSE a.n END AS parent,
    CASE WHEN o.above IS NULL THEN 'breadcrumb' ELSE o.kind END AS kind
  FROM o LEFT JOIN o a ON a.row_id = o.row_id AND a.id = o.above
), d AS (SELECT row_id, len(string_split(display_path, ' / ')) - 1 AS k FROM v WHERE ok IS NOT TRUE AND display_path IS NOT NULL)
, items AS (
  SELECT row_id, n::INTEGER AS item_no, parent::INTEGER AS parent_no, kind AS item_kind, id FROM p
  UNION ALL SELECT row_id, i::INTEGER, i::INTEGER - 1, 'display_path', NULL FROM (SELECT row_id, unnest(range(k)) AS i FROM d)
)
"""
_FOUND_SQL = _NODES_SQL + "SELECT row_id, item_no, parent_no, item_kind FROM items"
# Ancestors by climbing; a node's post-order number follows from its place, depth and descendants.
_CLIMB_SQL = (
    _NODES_SQL
    + """, climb AS (
  SELECT row_id, item_no, parent_no AS above FROM items WHERE parent_no >= 0
  UNION ALL SELECT c.row_id, c.item_no, i.parent_no FROM climb c JOIN items i ON i.row_id = c.row_id AND i.item_no = c.above WHERE i.parent_no >= 0
), deep AS (SELECT row_id, item_no, count(*)::INTEGER AS level FROM climb GROUP BY 1, 2), wide AS (SELECT row_id, above AS item_no, count(*)::INTEGER AS within FROM climb GROUP BY 1, 2),
labels AS (SELECT row_id, item_no AS pre, item_no - coalesce(level, 0) + coalesce(within, 0) AS post, coalesce(level, 0) AS level, parent_no AS parent_pre, item_kind AS kind, id
  FROM items LEFT JOIN deep USING (row_id, item_no) LEFT JOIN wide USING (row_id, item_no))
"""
)
_LABELS_SQL = _CLIMB_SQL + "SELECT row_id, pre, post, level, parent_pre, kind FROM labels"
_REFERENCES_SQL = (
    _CLIMB_SQL
    + """SELECT r.row_id, r.item_no AS pre, max(a.item_no) AS provision_pre FROM items r LEFT JOIN (SELECT c.row_id, c.item_no AS below, i.item_no FROM climb c JOIN items i ON i.row_id = c.row_id AND i.item_no = c.above WHERE i.item_kind = 'parts') a
  ON a.row_id = r.row_id AND a.below = r.item_no WHERE r.item_kind = 'refs' GROUP BY 1, 2"""
)


def _node_table_sql(name: str) -> str:
    kind, members = NODE_TABLES[name]
    values = ", ".join(f"t.value->>'$.{m}' AS {m}" for m in members)
    return _CLIMB_SQL + f"SELECT l.row_id, pre, post, level, parent_pre, {values} FROM labels l JOIN t ON t.row_id = l.row_id AND t.id = l.id WHERE l.kind = '{kind}'"


_LIMITS_SQL = f"""
WITH m AS ({_metrics_sql()}),
r AS (SELECT load_id, source_file, snapshot_version, column_name, metric, c / row_count AS value
  FROM (SELECT m.*, f.source_file, f.snapshot_version, unnest(['null', 'empty', 'distinct']) AS metric, unnest([null_count, empty_count, distinct_count]) AS c FROM m JOIN file_loads f USING (load_id) WHERE row_count > 0)),
s AS (SELECT *, avg(value) OVER w AS center, stddev_samp(value) OVER w AS spread, count(value) OVER w AS seen FROM r
  WINDOW w AS (PARTITION BY source_file, column_name, metric ORDER BY snapshot_version, load_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT load_id, column_name, metric, value, center FROM s WHERE seen >= 2 AND abs(value - center) > greatest(0.02, 3 * coalesce(spread, 0))
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_labels, p1_reference_provisions, p2_found, p2_metrics, p2_control_limits, p3_found)} | {n: _node_table(n) for n in NODE_TABLES}
ORACLES = {"p1_found": _FOUND_SQL, "p1_labels": _LABELS_SQL, "p1_reference_provisions": _REFERENCES_SQL, "p2_found": _profile_sql(), "p2_metrics": _metrics_sql(), "p2_control_limits": _LIMITS_SQL, "p3_found": _CHANGES_SQL} | {n: _node_table_sql(n) for n in NODE_TABLES}

from __future__ import annotations

from collections import Counter

import re

from codexmill.operators.profile import Check, compile_slots, control_limits, load_metrics, merge_states, profile_loads, standard_checks, summarise, value_states
from codexmill.schema import INTEGER_COLUMNS, SNAPSHOT_COLUMNS, SNAPSHOT_SCHEMA
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("load_id", T.LongType()), *SNAPSHOT_SCHEMA, T.StructField("key", T.StringType()), T.StructField("rows", T.LongType())])
LOADS = "load_id long, prev_load_id long, source_file string, snapshot_version string"


def row(load, **values):
    base = {c: (1 if c in INTEGER_COLUMNS else "x") for c in SNAPSHOT_COLUMNS} | values
    return (load, *[base[c] for c in SNAPSHOT_COLUMNS], "k", 5)


def brute(rows, loads):
    """Each measure straight from its sentence."""
    by, out = {}, set()
    for r in rows:
        if r[0] is not None:
            by.setdefault(r[0], []).append(dict(zip(SNAPSHOT_COLUMNS, r[1:])))
    for load, mine in by.items():
        if max([0, *Counter(r["act_id"] for r in mine if r["act_id"] is not None).values()]) > 1:
            out.add((load, "act_id", "not_unique"))
    for load, prev in {(a, b) for a, b, *_ in loads}:
        a, b = by.get(load), by.get(prev)
        if not a or not b:
            continue
        for c in SNAPSHOT_COLUMNS:
            x, y = [r[c] for r in a], [r[c] for r in b]
            share = lambda v, w: abs(x.count(v) * len(y) - y.count(v) * len(x)) * 100 > w * len(x) * len(y)
            if share(None, 15):
                out.add((load, c, "null_rate"))
            if c not in INTEGER_COLUMNS and share("", 15):
                out.add((load, c, "empty_rate"))
            dx, dy = len({*x} - {None}), len({*y} - {None})
            if dx and dy and max(dx, dy) >= 20 and max(dx, dy) > 2 * min(dx, dy):
                out.add((load, c, "distinct_count"))
            vx, vy = [v for v in x if v is not None], [v for v in y if v is not None]
            if c in INTEGER_COLUMNS and vx and vy:
                w = max(vy) - min(vy)
                if max(vx) - max(vy) > w or min(vy) - min(vx) > w:
                    out.add((load, c, "value_range"))
            if c in ("act_id", "citation", "section_number", "source_url"):
                shape = lambda v: re.sub("[0-9]+", "9", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", v)))
                old = {shape(v) for v in y if v}
                new = [shape(v) not in old for v in x if v]
                if new and sum(new) * 100 > 5 * len(new):
                    out.add((load, c, "pattern"))
            if c in ("act_status", "document_type"):
                if sum(abs(x.count(v) * len(y) - y.count(v) * len(x)) for v in {*x, *y}) * 10 > 4 * len(x) * len(y):
                    out.add((load, c, "distribution"))
    return out


def test_measures(spark):
    ids = [f"A_{i}" for i in range(40)]
    rows = [row(1, act_id=i, citation=i, word_count=10 + k, text="t") for k, i in enumerate(ids)]
    rows += [row(2, act_id=i, citation=None if k < 7 else i, word_count=10 + k, text="" if k < 6 else "t", act_status=None if k < 9 else "x", source_url="x" if k else "Z9") for k, i in enumerate(ids)]
    rows += [row(3, act_id=ids[k % 19], citation="9-9", word_count=200, year=None, document_type="") for k in range(40)]
    rows += [row(4, text="t"), row(4, text=None), row(None), row(9, act_id=None), row(9, act_id=None), row(8, act_id=""), row(8, act_id="")]
    loads = [(1, None, "f", "a"), (2, 1, "f", "b"), (3, 2, "f", "c"), (4, 77, "g", "a"), (5, 4, "g", "b"), (2, 1, "f", "b"), (None, 1, "h", "a")]
    got = {tuple(r) for r in profile_loads(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(loads, LOADS)).collect()}
    want = brute(rows, loads)
    assert got == want and {m for _, _, m in want} == {c.measure for c in standard_checks()}


def test_limits_are_exact(spark):
    rows = [row(1, act_id=str(i), title_name=None if i < 40 else "x", act_status="a" if i < 50 else "b") for i in range(100)]
    rows += [row(2, act_id=str(i), title_name=None if i < 25 else "x", act_status="a" if i < 70 else "b") for i in range(100)]
    loads = spark.createDataFrame([(2, 1, "f", "b")], LOADS)
    got = profile_loads(spark.createDataFrame(rows, SCHEMA), loads)
    assert got.count() == 0  # differences of just 0.15 and 0.2
    rows[100 + 25] = row(2, act_id="25", title_name=None, act_status="a")
    rows[24] = row(1, act_id="24", title_name="x")
    assert ("title_name", "null_rate") not in {(r[1], r[2]) for r in profile_loads(spark.createDataFrame(rows[:100] + rows[100:], SCHEMA), loads).collect()}


def test_empty_tables(spark):
    none, loads = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, "f", "a")], LOADS)
    assert profile_loads(none, loads).count() == 0 and load_metrics(none).count() == 0
    assert profile_loads(spark.createDataFrame([row(1), row(1)], SCHEMA), loads.limit(0)).collect()[0]["measure"] == "not_unique"


def test_states_merge(spark):
    checks = standard_checks()
    rows = [row(1, act_id=str(i % 7), text=None if i % 3 else "y" * 100_000) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [value_states(spark.createDataFrame(rows[i::3], SCHEMA), "load_id", checks) for i in range(3)]
    key = lambda d: sorted(map(str, summarise(d, checks).collect()))
    assert key(merge_states(*parts)) == key(value_states(df, "load_id", checks))
    assert len(compile_slots((Check("a", ("x", "y")), Check("b", ("y",))))) == 2


def test_control_limits(spark):
    rows = [row(n, act_id=str(i), title_name=None if n == 5 and i < 30 else "x") for n in range(1, 6) for i in range(50)]
    loads = spark.createDataFrame([(n, n - 1, "f", f"v{n}") for n in range(1, 6)], LOADS)
    got = control_limits(load_metrics(spark.createDataFrame(rows, SCHEMA)), loads).collect()
    assert [(r["load_id"], r["column_name"], r["metric"]) for r in got] == [(5, "title_name", "null")] and got[0]["value"] == 0.6

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.operators.nested import _decode_deep, containing, label_tree, link_by_containment, nested_nodes, node_table, strict_json
from codexmill.operators.workspace import written

SCHEMA = "row_id long, breadcrumb string, display_path string, pre string, kind long"


def brute(text, path):
    """Items by plain recursion over an order-keeping parse, without labels."""
    def refuse(_):
        raise ValueError

    try:
        top = json.loads(text, object_pairs_hook=lambda p: ("o", p), parse_constant=refuse, parse_int=str) if text else None
    except (ValueError, RecursionError):
        top = None
    out = []
    if isinstance(top, list) and top and all(isinstance(x, tuple) for x in top):
        def walk(v, kind, parent):
            if isinstance(v, tuple):
                me = len(out)
                out.append((me, parent, kind))
                for k, x in v[1]:
                    walk(x, k, me)
                return me
            if isinstance(v, list):
                for x in v:
                    walk(x, kind, parent)

        last = -1
        for x in top:
            last = walk(x, "breadcrumb", last)
    elif path is not None:
        out = [(i, i - 1, "display_path") for i in range(len(path.split(" / ")) - 1)]
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = {}
    for r in nested_nodes(df).collect():
        out.setdefault(r["row_id"], []).append((r["pre"], r["parent_pre"], r["kind"]))
    return {k: sorted(v) for k, v in out.items()}


CASES = [
    '[{"a": {"b": [1, {"c": 2}, [{"d": 3}]]}, "p": [{}, {}]}, {"n": []}]',
    '[{"a": {"x": 1}, "a": {"y": 2}}]',
    '[{}]', "[]", "{}", "null", "", "   ", None, "not json", "[1, 2]", '[{"a": 1}, 7]', "[{'a': 1}]", '[{"a": 1}] ;end', '[{"a": NaN}]', '[{"a": 01}]',
    '[{"a": 1,}]', '﻿[{"a": 1}]', ' \n[{"k": "\\ud800", "m": {"\\ud800": {}}}]\t', "[" * 3000, '[{"a": ' + "9" * 6000 + "}]", '[{"a": "\x01"}]',
]


def test_against_recursion(spark):
    paths = ["A / b / c", None, "", "root", "A /  / b", " / "]
    rows = [(i * 10 + j, t, p) for i, t in enumerate(CASES) for j, p in enumerate(paths)]
    got = found(spark, rows)
    for i, t, p in rows:
        want = [(a, b, k.encode("utf-8", "replace").decode()) for a, b, k in brute(t, p)]
        assert got.get(i, []) == want, (t, p)


def test_nesting_beyond_the_stack(spark):
    n = 20_000
    deep = '[{"a": ' * n + "1" + "}]" * n
    assert len(found(spark, [(1, deep, None)])[1]) == n
    assert found(spark, [(1, deep + "x", "r / s")])[1] == [(0, -1, "display_path")]


def test_empty_table_null_and_repeated_ids(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, '[{"a": {}}]', None), (None, None, "r / s")])[None] == [(0, -1, "breadcrumb"), (0, -1, "display_path"), (1, 0, "a")]


def test_intervals_contain(spark):
    kinds, posts, levels, _ = label_tree(strict_json(CASES[0]))
    parents = containing(posts)
    assert len({*posts}) == len(posts)
    for i, p in enumerate(parents):
        assert levels[i] == (levels[p] + 1 if p >= 0 else 0)
        assert p < i and (p < 0 or posts[p] > posts[i])


def test_typed_tables_and_links(spark):
    df = spark.createDataFrame([(1, '[{"num": "1"}, {"num": "2", "notes": [{"k": "x", "refs": [{"c": "r1"}, {"c": "r2"}]}, {"k": "y"}]}]', None)], "row_id long, breadcrumb string, display_path string")
    nodes = nested_nodes(df)
    top, refs = node_table(nodes, "breadcrumb", {"num": "int"}), node_table(nodes, "refs", {"c": "string"})
    assert [r["num"] for r in top.orderBy("pre").collect()] == [1, 2]
    assert [r["c"] for r in refs.orderBy("pre").collect()] == ["r1", "r2"]
    assert {(r["pre"], r["ancestor_pre"]) for r in link_by_containment(refs, top, "row_id").collect()} == {(3, 1), (4, 1)}
    assert {(r["pre"], r["ancestor_pre"]) for r in link_by_containment(top, top, "row_id").collect()} == {(0, None), (1, 0)}


def test_links_of_repeated_and_null_keys(spark):
    """Trees under one key, or none, are linked each by itself."""
    rows = [(1, '[{"a": {}, "b": {}}]', None), (1, "[{}, {}, {}]", None), (None, '[{"a": {}}]', None), (None, "[{}]", None)]
    nodes = written(nested_nodes(spark.createDataFrame(rows, "row_id long, breadcrumb string, display_path string"), record="record"), "nodes")
    linked = nodes.join(link_by_containment(nodes, nodes), ["record", "pre"])
    assert linked.count() == 9 and linked.where("coalesce(ancestor_pre, -1) <> parent_pre").count() == 0
    assert linked.select("record").distinct().count() == 4


def test_values_of_arrays_are_kept(spark):
    long = "7" * 2000
    text = '[{"refs": [{"cite": "50 CFR 258"}, "§ 65.03", [2, {"d": {}}, []]], "n": 1.10, "n": "2", "o": {"x": null}, "p": [{}, {}], "e": []}, {"z": [true, ' + long + "]}]"
    nodes = nested_nodes(spark.createDataFrame([(1, text, None), (2, '[{"a": ' + "[" * 20_000 + '"v"' + "]" * 20_000 + "}]", None)], "row_id long, breadcrumb string, display_path string"))
    got = {(r["row_id"], r["pre"]): r["fields"] for r in nodes.collect()}
    assert got[1, 0] == '{"refs": [{"pre": 1}, "§ 65.03", [2, {"pre": 2}, []]], "n": 1.10, "n": "2", "p": [{"pre": 5}, {"pre": 6}], "e": []}'
    assert got[1, 1] == '{"cite": "50 CFR 258"}' and got[1, 4] == '{"x": null}' and got[1, 7] == f'{{"z": [true, {long}]}}'
    assert got[2, 0] == '{"a": ' + "[" * 20_000 + '"v"' + "]" * 20_000 + "}"
    top = {r["pre"]: r for r in node_table(nodes.where("row_id = 1"), "breadcrumb", {"n": "string", "z": "string"}).collect()}
    assert top[0]["n"] == "2" and top[0]["z"] is None and long in top[7]["z"]


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(values, st.text(alphabet='[]{}",:1\\ ', max_size=3), st.integers(0, 40))
def test_both_parsers_agree(value, junk, at):
    text = json.dumps(value)
    text = text[: at % (len(text) + 1)] + junk + text[at % (len(text) + 1) :]
    want = strict_json(text)
    try:
        got = _decode_deep(text)
    except ValueError:
        got = None
    assert got == want


@pytest.mark.parametrize("text", ["1 2", "", "[", '{"a"}', '{"a": 1 "b": 2}', "[1,]", "[,1]", "{]"])
def test_deep_parser_refuses(text):
    with pytest.raises(ValueError):
        _decode_deep(text)

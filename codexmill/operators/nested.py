"""Deeply nested JSON records to flat, related node tables, by interval labels.

A depth-first traversal gives each object of a record a pre-order and a post-order number. Object A
holds object B exactly if ``pre(A) < pre(B)`` and ``post(A) > post(B)``, so the labels alone carry
the hierarchy: :func:`containing` recovers each node's parent from them in one sweep, and any two
node tables of a record can be related without another traversal.

Everything happens within the record, in one pass over Arrow batches: no shuffle, and a task never
holds more than a batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.operators.batches import by_bytes

#: Kinds of the nodes that no key names.
TOP_KIND, PATH_KIND = "breadcrumb", "display_path"


def _refuse(name: str) -> None:
    raise ValueError(name)


class Number(str):
    """A number as it is written."""


# Objects become tuples of (key, value) pairs, which keeps repeated keys; numbers stay text.
_DECODE = json.JSONDecoder(object_pairs_hook=tuple, parse_constant=_refuse, parse_int=Number, parse_float=Number).decode
_QUOTED = json.encoder.encode_basestring
_BLANK = " \t\n\r"
_TOKEN = re.compile(
    r"[ \t\n\r]*(?:([{}\[\],:])|(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")"
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))"
)


def _decode_deep(text: str):
    """As ``_DECODE`` without recursion, for nesting beyond the interpreter's stack."""
    text = text.rstrip(_BLANK)
    at, open_, value, wants = 0, [], None, "value"
    words = {"true": True, "false": False, "null": None}
    while True:
        if wants == "end":
            if at != len(text):
                raise ValueError("extra data")
            return value
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError("no token")
        at = m.end()
        mark, string, number, word = m.groups()
        if wants in ("key", "key or close") and not (mark == "}" and wants == "key or close"):
            if string is None or (colon := _TOKEN.match(text, at)) is None or colon[1] != ":":
                raise ValueError("no key")
            open_[-1][1] = json.loads(string)
            at, wants = colon.end(), "value"
            continue
        if wants in ("value", "value or close") and mark in ("{", "["):
            open_.append([mark, None, []])
            wants = "key or close" if mark == "{" else "value or close"
            continue
        if mark is None and wants in ("value", "value or close"):
            value = json.loads(string) if string is not None else Number(number) if number is not None else words[word]
        elif mark in ("}", "]") and wants in ("comma or close", "key or close", "value or close"):
            kind, _, parts = open_.pop()
            if (kind == "{") != (mark == "}"):
                raise ValueError("bracket")
            value = tuple(parts) if kind == "{" else parts
        elif mark == "," and wants == "comma or close":
            wants = "key" if open_[-1][0] == "{" else "value"
            continue
        else:
            raise ValueError("unexpected token")
        if not open_:
            wants = "end"
        else:
            kind, key, parts = open_[-1]
            parts.append((key, value) if kind == "{" else value)
            wants = "comma or close"


def strict_json(text: str | None):
    """The value of an RFC 8259 text, or None if it is none (also for the text ``null``)."""
    if not text:
        return None
    try:
        return _DECODE(text)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return _decode_deep(text)
    except ValueError:
        return None


def label_tree(top: list) -> tuple[list[str], list[int], list[int], list[tuple]]:
    """Kind, post-order number, level and object of each node, in pre-order.

    ``top`` is a breadcrumb: each of its objects is the parent of the next one, so the labels of all
    of them close only after the last.
    """
    kinds, posts, levels, objects = [], [], [], []
    clock, spine = 0, []
    for first in top:
        spine.append(len(kinds))
        todo: list = [(first, TOP_KIND, len(spine) - 1)]
        while todo:
            step = todo.pop()
            if type(step) is int:
                posts[step] = clock
                clock += 1
                continue
            value, kind, level = step
            if type(value) is tuple:
                at = len(kinds)
                kinds.append(kind)
                posts.append(-1)
                levels.append(level)
                objects.append(value)
                if at != spine[-1]:
                    todo.append(at)
                todo += [(v, k, level + 1) for k, v in reversed(value) if type(v) is tuple or type(v) is list]
            else:
                todo += [(v, kind, level) for v in reversed(value) if type(v) is tuple or type(v) is list]
    for at in reversed(spine):
        posts[at] = clock
        clock += 1
    return kinds, posts, levels, objects


def containing(posts: list[int]) -> list[int]:
    """For nodes in pre-order: the pre-order number of the innermost interval around each, else -1."""
    parents, around = [], []
    for pre, post in enumerate(posts):
        while around and posts[around[-1]] < post:
            around.pop()
        parents.append(around[-1] if around else -1)
        around.append(pre)
    return parents


def _utf8(text: str) -> str:
    """``text`` without lone surrogates, which escapes in JSON may name but no column can hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _text(value, children: Iterator[int]) -> str:
    """JSON text of a list or scalar, without recursion. An object in a list is named by its number."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if type(v) is list:
            out.append("[")
            todo.append(b"]")
            for k, x in enumerate(reversed(v)):
                todo += [b", ", x] if k else [x]
        elif type(v) is tuple:
            out.append(f'{{"pre": {next(children)}}}')
        elif type(v) is bytes:
            out.append(v.decode())
        elif type(v) is str:
            out.append(_QUOTED(v))
        else:
            out.append(v if type(v) is Number else json.dumps(v))
    return "".join(out)


def _fields(pairs: tuple, children: list[int]) -> str:
    """JSON text of an object's members but those that are objects, in their order, repeated keys too.

    ``children`` are the numbers of the objects within, which come in the order of the members.
    """
    out, numbers = [], iter(children)
    for k, v in pairs:
        if type(v) is tuple:
            next(numbers)
        else:
            out.append(f"{_QUOTED(k)}: {_text(v, numbers)}")
    return _utf8("{" + ", ".join(out) + "}")


def nested_nodes(
    df: DataFrame,
    key: str = "row_id",
    document: str = "breadcrumb",
    path: str = "display_path",
    separator: str = " / ",
    with_fields: bool = True,
    record: str | None = None,
) -> DataFrame:
    """One row per object of each record's ``document``, with interval labels and parent link.

    Columns: the key, ``pre``, ``post``, ``level``, ``parent_pre`` (-1 for a root), ``kind`` (the key
    that holds the object or its array) and, if asked for, ``fields``, the object's scalar and array
    members as JSON text: in their order, repeated keys as often as they are there, numbers as written.
    In an array, an object is written ``{"pre": n}`` by its node's number, so mixed arrays stay whole.
    ``record`` names a further column that numbers the input rows, for joins of a written table of
    nodes with itself where keys may be null or repeated.

    Defined cases: a document is used if it is strict JSON whose top level is a non-empty array of
    objects only; for any other (null, blank, damaged, other top level) the segments of ``path``
    after the first become a chain of nodes of kind ``display_path``, and a null path gives none. A
    null or repeated key is kept as it is: labels are per input row. Other columns are never read,
    so their names can't clash. Empty input gives an empty result.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            *(T.StructField(n, T.IntegerType()) for n in ("pre", "post", "level", "parent_pre")),
            T.StructField("kind", T.StringType()),
            *([T.StructField("fields", T.StringType())] if with_fields else []),
            *([T.StructField(record, T.LongType())] if record else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, 1):
            keys, take = batch.column(0), []
            pre, post, level, parent, kind, fields = [], [], [], [], [], []
            for i, (text, trail) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                top = strict_json(text)
                if type(top) is list and top and all(type(x) is tuple for x in top):
                    kinds, posts, levels, objects = label_tree(top)
                    kinds = [_utf8(k) for k in kinds]
                    if with_fields:
                        children: list[list[int]] = [[] for _ in posts]
                        for n, above in enumerate(containing(posts)):
                            if above >= 0:
                                children[above].append(n)
                        fields += map(_fields, objects, children)
                elif trail is not None:
                    parts = trail.split(separator)[1:]
                    n = len(parts)
                    kinds, posts, levels = [PATH_KIND] * n, list(range(n - 1, -1, -1)), list(range(n))
                    if with_fields:
                        fields += [json.dumps({"segment": p}, ensure_ascii=False) for p in parts]
                else:
                    continue
                take += [i] * len(posts)
                pre += range(len(posts))
                post += posts
                level += levels
                parent += containing(posts)
                kind += kinds
            if take:
                ints = [pa.array(x, pa.int32()) for x in (pre, post, level, parent)]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(take)), *ints, pa.array(kind, pa.string()), *([pa.array(fields, pa.string())] if with_fields else []), *([pa.array([at + i for i in take], pa.int64())] if record else [])],
                    names=schema.names,
                )
            at += len(keys)

    source = df.select(F.col(key), F.col(document).cast("string").alias("__document"), F.col(path).cast("string").alias("__path"))
    return source.mapInArrow(run, schema)


def node_table(nodes: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one kind of node: labels, parent link, and the given scalar members by type
    (of a repeated key the last one; arrays as JSON text)."""
    longest = str(2**31 - 1)
    parsed = F.map_entries(F.from_json("fields", T.MapType(T.StringType(), T.StringType()), {"maxNumLen": longest, "maxNestingDepth": longest}))
    last = lambda name: F.try_element_at(F.filter(parsed, lambda e: e["key"] == name), F.lit(-1))["value"]
    return nodes.where(F.col("kind") == kind).select(
        *[c for c in nodes.columns if c not in ("kind", "fields")],
        *[last(name).cast(as_type).alias(name) for name, as_type in fields.items()],
    )


def link_by_containment(children: DataFrame, parents: DataFrame, key: str = "record") -> DataFrame:
    """Each node of ``children`` with ``ancestor_pre``, the innermost node of ``parents`` around it.

    ``key`` tells records apart: the number of the input row that :func:`nested_nodes` gives as
    ``record``, or another key that is neither null nor repeated. The nodes of both tables of a record
    are swept in pre-order; an interval is open while the nodes that follow lie within it. The shuffle
    is on ``key``, so a record's nodes meet in one task and nothing larger than a record does.
    Children outside every parent get null. A node that is in both tables isn't its own ancestor.
    """
    both = (
        children.select(F.col(key), "pre", "post", F.lit(1).alias("child"))
        .unionByName(parents.select(F.col(key), "pre", "post", F.lit(0).alias("child")))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pre", "child", "post"))).alias("__n"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, pre, ancestor = [], [], []
            for i, nodes in enumerate(batch.column(1).to_pylist()):
                around: list[tuple[int, int]] = []
                for n in nodes:
                    while around and around[-1][1] < n["post"]:
                        around.pop()
                    if n["child"]:
                        last = 2 if around and around[-1][0] == n["pre"] else 1
                        take.append(i)
                        pre.append(n["pre"])
                        ancestor.append(around[-last][0] if len(around) >= last else None)
                    else:
                        around.append((n["pre"], n["post"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(pre, pa.int32()), pa.array(ancestor, pa.int32())],
                names=[key, "pre", "ancestor_pre"],
            )

    schema = T.StructType([children.schema[key], T.StructField("pre", T.IntegerType()), T.StructField("ancestor_pre", T.IntegerType())])
    return both.mapInArrow(run, schema)

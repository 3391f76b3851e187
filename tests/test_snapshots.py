from __future__ import annotations

import random

from codexmill.operators.snapshots import checker, peel, snapshot_changes

SCHEMA = "row_id long, snapshot_version string, row_ordinal long, act_id string, text string, act_status string, key string, version string, kh long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "v", 1) for r in rows], SCHEMA)


def brute(rows):
    snaps = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        snaps.setdefault(r[1], {})
        if r[3] is not None and r[1] is not None:
            snaps[r[1]][r[3]] = r[4:6]
    snaps.pop(None, None)
    out, order = set(), sorted(snaps)
    for a, b in zip(order, order[1:]):
        for k in {*snaps[a]} | {*snaps[b]}:
            x, y = snaps[a].get(k), snaps[b].get(k)
            if x != y:
                out.add((b, k, "added" if x is None else "removed" if y is None else "changed"))
    return out


def rows_of(n, seed, versions=("v1", "v2", "v3")):
    rnd, rows = random.Random(seed), []
    for v in versions:
        for i in range(n):
            if rnd.random() < 0.9:
                rows.append((len(rows), v, rnd.randrange(5), rnd.choice([None, "", f"k{i}", f"k{i}", f"k{rnd.randrange(n)}"]), rnd.choice([None, "", "a", "b"]), rnd.choice([None, "s"])))
    rnd.shuffle(rows)
    return rows


def found(df, **kw):
    rows = [tuple(r) for r in df.collect()] if kw == {} else [tuple(r) for r in snapshot_changes(df, **kw).collect()]
    assert len(rows) == len({*rows})
    return {*rows}


def test_against_sets(spark):
    rows = rows_of(300, 1)
    assert {tuple(r) for r in snapshot_changes(frame(spark, rows)).collect()} == brute(rows)


def test_failed_buckets_are_enlarged_and_compared(spark):
    rows = rows_of(400, 2)
    assert found(frame(spark, rows), bucket_keys=100, cells=30, rounds=3) == brute(rows)
    assert found(frame(spark, rows), bucket_keys=1000, cells=6, rounds=1) == brute(rows)


def test_edges(spark):
    assert snapshot_changes(frame(spark, [])).count() == 0
    assert snapshot_changes(frame(spark, [(1, "v1", 0, "a", "x" * 300_000, None)])).count() == 0
    rows = [(1, "v1", 0, "a", None, "s"), (2, "v2", 0, "a", "", "s"), (3, "v2", 0, None, "t", "s"), (4, "v3", 0, None, None, None), (5, None, 0, "z", "z", "z"), (6, "v3", 0, "a", "", "s"), (6, "v3", 0, "a", "", "s")]
    assert found(frame(spark, rows), cells=6) == {("v2", "a", "changed")}


def test_hot_key(spark):
    rows = [(i, "v1" if i % 2 else "v2", i, "hot" if i % 3 == 0 else f"k{i // 2}", "t", "s") for i in range(600)]
    assert found(frame(spark, rows), bucket_keys=64) == brute(rows)


def test_peeling_refuses_what_the_digest_denies():
    check_of = checker(30)
    check, cells = check_of(5, 7)
    table = [(-1, 1, 5, 7, check), *[(c, 1, 5, 7, check) for c in cells]]
    assert peel(*map(list, zip(*table)), check_of) == ([(5, 7, 1)], True)
    table[0] = (-1, 0, 5, 7, check)
    assert not peel(*map(list, zip(*table)), check_of)[1]

"""What changed between consecutive full snapshots, by invertible Bloom lookup tables.

Each snapshot is reduced to a set of (key hash, content hash) pairs, one per key, divided into hash
buckets of about ``bucket_keys`` keys. Every bucket gets a table of cells; a pair is added to three
cells as a count and XOR sums, which any number of tasks can build and merge. The table of a snapshot
minus the table of the one before holds only the pairs in which they differ, however large the
snapshots are, and is decoded by peeling cells that hold a single pair. A bucket with more
differences than its cells can hold fails to decode; only such buckets are built again with four
times the cells, and at last compared pair by pair. Decoded pairs must also reproduce the digest
(count and XOR) of the bucket's difference, else the bucket counts as failed.

Scale: rows shrink to 64-bit hashes in the first, pre-aggregated shuffle. The tables take as much
space as the expected differences, not the rows, and a bucket is decoded from a bounded number of
cells. Recovered pairs are joined back for the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codexmill.operators.workspace import written

WAYS = 3


def _parts(columns: list[str]) -> list[Column]:
    """The columns for hashing, each beside its null flag, so that null differs from empty."""
    return [x for c in columns for x in (F.col(c).isNull(), F.col(c))]


def digest_snapshots(df: DataFrame, version: str, key: str, order: list[str], content: list[str]) -> DataFrame:
    """One row per snapshot and non-null key: ``kh`` and ``vh``, hashes of the key and its content.

    Of rows with the same snapshot and key the greatest in ``order`` counts.
    """
    return (
        df.where(F.col(version).isNotNull() & F.col(key).isNotNull())
        .select(F.col(version).alias("version"), F.col(key).alias("key"), F.struct(*order).alias("o"), F.xxhash64(*_parts(content)).alias("vh"))
        .groupBy("version", "key")
        .agg(F.max_by("vh", "o").alias("vh"))
        .select("version", "key", F.xxhash64("key").alias("kh"), "vh")
    )


def version_steps(df: DataFrame, version: str) -> DataFrame:
    """(version, before): each snapshot but the first and its predecessor. A row per snapshot."""
    return (
        df.select(F.col(version).alias("version")).where(F.col("version").isNotNull()).distinct()
        .withColumn("before", F.lag("version").over(Window.orderBy("version")))
        .where(F.col("before").isNotNull())
    )


def _signed(digests: DataFrame, steps: DataFrame, buckets: int) -> DataFrame:
    """Each snapshot's pairs with +1 for the step that leads to it and -1 for the one that leaves it."""
    roles = steps.select("version", F.col("version").alias("step"), F.lit(1).alias("sign")).unionByName(
        steps.select(F.col("before").alias("version"), F.col("version").alias("step"), F.lit(-1).alias("sign"))
    )
    return digests.select("version", "kh", "vh").join(roles, "version").select(
        "step", F.pmod(F.xxhash64(F.lit("bucket"), "kh"), F.lit(buckets)).alias("bucket"), "kh", "vh", "sign", F.xxhash64("kh", "vh").alias("check")
    )


def build_tables(pairs: DataFrame, cells: int) -> DataFrame:
    """Cells of the tables: (step, bucket, cell, count, kx, vx, cx). ``cells`` is per bucket.

    Cell -1 is the digest of the bucket: count and XOR sums of all of its pairs.
    """
    part = cells // WAYS
    at = [F.pmod(F.xxhash64(F.lit(i), "check"), F.lit(part)) + i * part for i in range(WAYS)]
    return (
        pairs.withColumn("cell", F.explode(F.array(F.lit(-1).cast("long"), *at)))
        .groupBy("step", "bucket", "cell")
        .agg(F.sum("sign").alias("count"), F.bit_xor("kh").alias("kx"), F.bit_xor("vh").alias("vx"), F.bit_xor("check").alias("cx"))
        .where("count != 0 or kx != 0 or vx != 0 or cx != 0")
    )


def peel(cell: list[int], count: list[int], kx: list[int], vx: list[int], cx: list[int], check_of) -> tuple[list[tuple[int, int, int]], bool]:
    """The (kh, vh, sign) pairs of one bucket's difference, and whether all of it was decoded.

    ``check_of`` gives a pair's check and cells. A cell is pure if its count is 1 or -1 and its XOR
    sums belong to one pair.
    """
    table = {c: [n, k, v, x] for c, n, k, v, x in zip(cell, count, kx, vx, cx)}
    digest = table.pop(-1, [0, 0, 0, 0])
    todo, found = list(table), []
    most = 2 * len(table)
    while todo and len(found) < most:  # more pairs than cells can only be false ones
        c = todo.pop()
        n, k, v, x = table.get(c, (0, 0, 0, 0))
        if n not in (1, -1):
            continue
        check, cells = check_of(k, v)
        if check != x or c not in cells:
            continue
        found.append((k, v, n))
        for other in cells:
            t = table.setdefault(other, [0, 0, 0, 0])
            t[0] -= n
            t[1] ^= k
            t[2] ^= v
            t[3] ^= check
            todo.append(other)
    done = all(t == [0, 0, 0, 0] for t in table.values())
    total = [0, 0, 0, 0]
    for k, v, n in found:
        total[0] += n
        total[1] ^= k
        total[2] ^= v
        total[3] ^= check_of(k, v)[0]
    return found, done and total == digest


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_MASK = (1 << 64) - 1


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _MASK


def _mix(h: int) -> int:
    h = ((h ^ (h >> 33)) * _P2) & _MASK
    h = ((h ^ (h >> 29)) * _P3) & _MASK
    return h ^ (h >> 32)


def _hash_long(value: int, seed: int) -> int:
    """The published xxHash64 of eight bytes, as Spark's ``xxhash64`` computes it for a bigint."""
    h = (seed + _P5 + 8) & _MASK
    h ^= (_rotl(((value & _MASK) * _P2) & _MASK, 31) * _P1) & _MASK
    return _mix((_rotl(h, 27) * _P1 + _P4) & _MASK)


def _hash_int(value: int, seed: int) -> int:
    """As :func:`_hash_long`, of the four bytes of an int."""
    h = (seed + _P5 + 4) & _MASK
    h ^= ((value & 0xFFFFFFFF) * _P1) & _MASK
    return _mix((_rotl(h, 23) * _P2 + _P3) & _MASK)


def _signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def checker(cells: int):
    """The check and the cells of a pair, equal to what :func:`build_tables` uses."""
    part = cells // WAYS
    seeds = [_hash_int(i, 42) for i in range(WAYS)]

    def check_of(kh: int, vh: int) -> tuple[int, list[int]]:
        check = _signed64(_hash_long(vh, _hash_long(kh, 42)))
        return check, [_signed64(_hash_long(check, s)) % part + i * part for i, s in enumerate(seeds)]

    return check_of


_DECODED = T.StructType(
    [T.StructField("step", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("kh", T.LongType()), T.StructField("vh", T.LongType()), T.StructField("sign", T.IntegerType())]
)


def decode(tables: DataFrame, cells: int) -> DataFrame:
    """(step, bucket, kh, vh, sign): recovered pairs; a failed bucket gives one row with sign 0."""
    per_bucket = tables.groupBy("step", "bucket").agg(*[F.collect_list(c).alias(c) for c in ("cell", "count", "kx", "vx", "cx")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check_of = checker(cells)
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                found, done = peel(*(r[c] for c in ("cell", "count", "kx", "vx", "cx")), check_of)
                rows += [(r["step"], r["bucket"], *f) for f in found] if done else [(r["step"], r["bucket"], None, None, 0)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=_DECODED.names)

    return per_bucket.mapInArrow(run, _DECODED)


def snapshot_changes(
    df: DataFrame,
    version: str = "snapshot_version",
    key: str = "act_id",
    order: tuple[str, ...] = ("row_ordinal", "row_id"),
    content: tuple[str, ...] = ("text", "act_status"),
    bucket_keys: int = 4096,
    cells: int = 1536,
    rounds: int = 3,
) -> DataFrame:
    """(snapshot_version, key, change): keys ``added``, ``removed`` or ``changed`` since the snapshot before.

    Snapshots follow each other in the order of their version strings. Defined cases: rows with a
    null key or version don't count; of repeated keys the greatest in ``order`` counts; null and
    empty content differ; a single snapshot, or an empty table, gives no rows. Two contents are taken
    as equal if their 64-bit hashes are.
    """
    digests = written(digest_snapshots(df, version, key, list(order), list(content)), "digests")
    steps = written(version_steps(df, version), "steps")
    most = digests.groupBy("version").count().agg(F.max("count")).first()[0] or 0
    pairs = _signed(digests, steps, max(1, -(-most // bucket_keys)))
    decoded, left = [], pairs
    for _ in range(rounds):
        got = written(decode(build_tables(left, cells), cells), "decoded")
        decoded.append(got.where("sign != 0"))
        failed = got.where("sign = 0").select("step", "bucket")
        if not failed.take(1):
            left = None
            break
        left = pairs.join(failed, ["step", "bucket"], "left_semi")
        cells *= 4
    if left is not None:  # what no table could hold, pair by pair
        decoded.append(left.groupBy("step", "bucket", "kh", "vh").agg(F.sum("sign").cast("int").alias("sign")).where("sign != 0"))
    changes = decoded[0]
    for d in decoded[1:]:
        changes = changes.unionByName(d)
    # Recovered pairs are few; their keys come from the snapshot that holds them.
    where = F.when(F.col("sign") > 0, F.col("step")).otherwise(F.col("before"))
    named = changes.join(steps.withColumnRenamed("version", "step"), "step").withColumn("version", where)
    return (
        named.join(digests, ["version", "kh", "vh"])
        .groupBy("step", "key")
        .agg(F.max("sign").alias("top"), F.min("sign").alias("low"))
        .select(
            F.col("step").alias(version),
            F.col("key").alias(key),
            F.when(F.col("low") > 0, "added").when(F.col("top") < 0, "removed").otherwise("changed").alias("change"),
        )
    )

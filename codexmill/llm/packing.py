"""Texts packed into containers of fixed capacity, neighbours in content together.

Each text becomes its number of tokens and a point: the hashed counts of its tokens, projected to a
few dimensions and made uniform over the corpus. A Hilbert curve through these points gives one
order in which neighbours resemble each other. The texts are range-sorted along the curve, and each
range packs what follows each other: the items of a stretch, largest first, go into the fullest open
container that still has room for them; containers stay open for later stretches. A text longer than
the capacity is cut into pieces that fill whole containers, and only its rest is packed.

Scale: texts are read once and leave the first stage as a few numbers. The sort is by ranges of
bounded size, ties broken by a unique number, so equal texts may fill many ranges. A task holds one
stretch of items and a bounded number of open containers.
"""

from __future__ import annotations

import base64
import functools
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.operators.batches import by_bytes
from codexmill.operators.workspace import discard, written

#: Fixed value: the published pattern that splits text before the merges of byte-level BPE ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DIMENSIONS, BITS, BUCKETS, SEED = 3, 16, 4096, 20240229


def read_ranks(ranks_file: str, most: int = 64 << 20) -> bytes:
    """The file of a tokenizer's ranks, which is broadcast; a file larger than that is none."""
    with open(ranks_file, "rb") as f:
        ranks = f.read(most + 1)
    if len(ranks) > most:
        raise ValueError(f"{ranks_file} has more than {most} bytes")
    return ranks


@functools.lru_cache(2)
def tokenizer(ranks_bytes: bytes) -> tiktoken.Encoding:
    """The byte-level BPE with the given ranks, a token and its rank per line."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_bytes.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(2)
def _directions(tokens: int) -> np.ndarray:
    """Per token id the projection of the bucket that it is hashed to."""
    rng = np.random.default_rng(SEED)
    table = rng.standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
    bucket = (np.arange(tokens, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
    return table[bucket.astype(np.int64)]


def measure_texts(df: DataFrame, doc_id: str, text: str, ranks_file: str) -> DataFrame:
    """(doc_id, n_tokens, point): tokens of each text and the mean projection of their buckets."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_file))
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(f"x{i}", T.FloatType()) for i in range(DIMENSIONS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(ranks.value)
        encode, towards = encoding.encode_ordinary, _directions(encoding.n_vocab)
        for batch in by_bytes(batches, 1):
            tokens = [np.array(encode(t), np.int64) if t else np.zeros(0, np.int64) for t in batch.column(1).to_pylist()]
            n = np.array([len(t) for t in tokens], np.int64)
            points = np.array([towards[t].mean(axis=0) if len(t) else (0,) * DIMENSIONS for t in tokens], np.float32).reshape(len(n), DIMENSIONS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *[pa.array(points[:, i]) for i in range(DIMENSIONS)]], names=schema.names)

    return df.select(F.col(doc_id), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with integer coordinates below 2 ** bits, one per row.

    After the published transposition of Skilling (2004): inverse undo, Gray code, then the bits of
    all axes interleaved.
    """
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def place_on_curve(measured: DataFrame) -> DataFrame:
    """Adds ``place``: coordinates made uniform by the corpus's mean and spread, then the curve."""
    axes = [f"x{i}" for i in range(DIMENSIONS)]
    full = F.col("n_tokens") > 0
    stats = measured.agg(*[F.avg(F.when(full, F.col(a))).alias(f"m{a}") for a in axes], *[F.stddev_pop(F.when(full, F.col(a))).alias(f"s{a}") for a in axes]).first()
    mean = np.array([stats[f"m{a}"] or 0.0 for a in axes])
    spread = np.array([stats[f"s{a}"] or 1.0 for a in axes])
    spread[spread == 0] = 1.0
    names = [*measured.columns, "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([batch.column(batch.schema.get_field_index(a)).to_numpy(zero_copy_only=False) for a in axes], axis=1)
            share = 1 / (1 + np.exp(-1.702 * (at - mean) / spread))  # logistic form of the normal distribution
            cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, BITS))], names=names)

    return measured.mapInArrow(run, T.StructType([*measured.schema.fields, T.StructField("place", T.LongType())]))


class Packer:
    """Open containers of one capacity, and the stretch of items that is packed next."""

    def __init__(self, capacity: int, first_id: int, stretch: int, most_open: int):
        self.capacity, self.next_id, self.stretch, self.most_open = capacity, first_id, stretch, most_open
        self.waiting: list[tuple[int, int]] = []  # (size, item)
        self.open: list[tuple[int, int]] = []  # (room, container), by room

    def add(self, size: int, item: int) -> list[tuple[int, int]]:
        self.waiting.append((size, item))
        return self.pack() if len(self.waiting) >= self.stretch else []

    def pack(self) -> list[tuple[int, int]]:
        """(item, container) of everything that waits."""
        out = []
        self.waiting.sort(key=lambda w: -w[0])
        for size, item in self.waiting:
            at = bisect_left(self.open, (size, -1))
            if at < len(self.open):
                room, container = self.open.pop(at)
            else:
                room, container = self.capacity, self.next_id
                self.next_id += 1
            out.append((item, container))
            insort(self.open, (room - size, container))
        self.waiting = []
        if len(self.open) > self.most_open:  # the fullest close
            self.open = self.open[-self.most_open :]
        return out


def pack_texts(
    df: DataFrame,
    budgets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    ranks_file: str = DEFAULT_RANKS,
    range_items: int = 100_000,
    stretch: int = 512,
    most_open: int = 128,
    most_budgets: int = 1000,
) -> DataFrame:
    """A container for every text, or piece of one, under each budget.

    Columns: budget_id, container_id (unique within the result), doc_id, piece_no, start_token,
    n_tokens. The tokens of a container never exceed the budget's ``capacity_tokens``. A text is
    cut only if it is longer than that, at multiples of the capacity. A longer ``stretch`` and more open
    containers leave less unused space, and bring texts together that are farther apart on the curve.

    Defined cases: null and empty texts have no tokens and get a container like any other. Null or
    repeated ids are kept. Budgets with a null or non-positive capacity give no rows; more than
    ``most_budgets`` are refused. Empty input gives an empty table. Other columns are never read.
    """
    limits = [(r["budget_id"], r["capacity_tokens"]) for r in budgets.select("budget_id", "capacity_tokens").limit(most_budgets + 1).collect()]
    if len(limits) > most_budgets:
        raise ValueError(f"more than {most_budgets} budgets")
    limits = [(b, c) for b, c in limits if c is not None and c > 0]
    id_type, budget_type = df.schema[doc_id].dataType, budgets.schema["budget_id"].dataType
    schema = T.StructType([T.StructField("budget_id", budget_type), T.StructField("container_id", T.LongType()), T.StructField(doc_id, id_type), T.StructField("piece_no", T.IntegerType()), T.StructField("start_token", T.LongType()), T.StructField("n_tokens", T.LongType())])
    if not limits:
        return df.sparkSession.createDataFrame([], schema)
    measured = written(measure_texts(df, doc_id, text, ranks_file), "packing-sizes")
    placed = written(place_on_curve(measured).withColumn("number", F.monotonically_increasing_id()), "packing-places")
    discard(measured)
    each = F.explode(F.array(*[F.struct(F.lit(b).cast(budget_type).alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in limits]))
    items = placed.select("doc_id", "n_tokens", "place", "number", each.alias("b")).select("doc_id", "n_tokens", "place", "number", "b.*")
    ranges = max(1, math.ceil(placed.count() * len(limits) / range_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer, budget = TaskContext.get().partitionId() << 40, None, None
        pending: dict[int, tuple] = {}
        made = 0

        def flushed(assigned: list[tuple[int, int]]) -> list[tuple]:
            return [(*pending.pop(item), container) for item, container in assigned]

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            ids = pa.array([r[1] for r in rows], arrow_id)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow_budget), pa.array([r[5] for r in rows], pa.int64()), ids, pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], names=schema.names)

        arrow_id = arrow_budget = None
        for batch in batches:
            arrow_id, arrow_budget = batch.column(0).type, batch.column(2).type
            out: list[tuple] = []
            for doc, n, which, capacity in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if packer is None or which != budget:
                    if packer is not None:
                        out += flushed(packer.pack())
                        base = packer.next_id
                    packer, budget = Packer(capacity, base, stretch, most_open), which
                whole = n // capacity if n > capacity else 0
                for piece in range(whole):
                    out.append((which, doc, piece, piece * capacity, capacity, packer.next_id))
                    packer.next_id += 1
                rest = n - whole * capacity
                if rest or not whole:
                    pending[made] = (which, doc, whole, whole * capacity, rest)
                    out += flushed(packer.add(rest, made))
                    made += 1
            yield as_batch(out)
        if packer is not None:
            yield as_batch(flushed(packer.pack()))

    return (
        items.repartitionByRange(ranges, "budget_id", "place", "number")
        .sortWithinPartitions("budget_id", "place", "number")
        .select("doc_id", "n_tokens", "budget_id", "capacity")
        .mapInArrow(run, schema)
    )


def packing_report(packed: DataFrame, docs: DataFrame, budgets: DataFrame, kind: str, doc_id: str = "doc_id") -> DataFrame:
    """Per budget what a packing must keep, and how good it is, from a written table of its containers.

    Columns: budget_id, pieces, texts (first pieces), tokens, containers, least_containers (no packing
    needs fewer), overfull containers, gaps (pieces that don't begin where the one before ends), split
    (texts in pieces that would fit whole), and the share of pairs of texts in a container that are
    alike in ``kind``, a column of ``docs``, beside that share among all pairs of texts.
    """
    capacity = budgets.select("budget_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    rows = packed.join(F.broadcast(capacity), "budget_id")
    loads = rows.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("load"), F.max("capacity").alias("capacity")).groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("containers"), F.count(F.when(F.col("load") > F.col("capacity"), 1)).alias("overfull"), F.ceil(F.sum("load") / F.max("capacity")).alias("least_containers")
    )
    first, full = F.col("piece_no") == 0, F.col("n_tokens") == F.col("capacity")
    pieces = rows.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("pieces"),
        F.count(F.when(first, 1)).alias("texts"),
        F.sum("n_tokens").alias("tokens"),
        F.count(F.when(F.col("start_token") != F.col("piece_no") * F.col("capacity"), 1)).alias("gaps"),
        F.count(F.when(~first & (F.col("n_tokens") == 0), 1)).alias("split"),
        F.count(F.when(~first, 1)).alias("__later"),
        F.count(F.when(full, 1)).alias("__full"),
    )
    # A text has a later piece only after one that fills a container.
    pieces = pieces.withColumn("split", F.col("split") + F.greatest(F.col("__later") - F.col("__full"), F.lit(0))).drop("__later", "__full")
    kinds = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(kind).alias("__kind"))
    firsts = rows.where(first & F.col(doc_id).isNotNull()).select("budget_id", "container_id", doc_id).join(kinds, doc_id)
    # The squares of counts less the counts are the ordered pairs of equal texts.
    pairs = lambda by, name: firsts.groupBy(*by, "__kind").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.sum("n").alias("n")).groupBy("budget_id").agg((F.sum("same") / F.sum(F.col("n") * (F.col("n") - 1))).alias(name))
    inside, among = pairs(["budget_id", "container_id"], "alike_inside"), pairs(["budget_id"], "alike_among_all")
    return loads.join(pieces, "budget_id").join(inside, "budget_id", "left").join(among, "budget_id", "left")

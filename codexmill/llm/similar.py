"""Groups of records that share most of their word shingles: an exact set-similarity self-join.

A record is the set of its distinct shingles; sets of equal members form a class, of which one
record stands for all. The join of the classes uses relations between sets at two levels:

Index. Shingles are ordered from rare to frequent, and only the rarest of each set, which a similar
set can't all lack, are posted in inverted lists. An entry of a list knows its set's size and its
own position in it. Lists are sorted by size; from a set's size and the entry's position follows the
one block of the list in which a partner can be, found by binary search, and everything outside it is
skipped. What is left in the block must pass the partner's own position, and a parity bitmap whose
differing bits bound the difference of the two sets from below. None of these drops a similar pair.

Answers. Candidates are verified in families: a leader and the sets that are candidates with it. The
leader's overlap with each set of the family is counted once, and those of a set that resembles
the leader follow from the leader's by counting only the members in which the two differ.

Scale: texts are read where they lie, three times, and never shuffled. Which shingles are frequent is
counted per task, each class once, in a table of cells; only cells that stand out in a task are
reported and added, so neither what is shuffled nor the table's noise grows with the corpus, and
errors affect the order and the work only. Lists are spread over parts by the number of postings that
there are. A list that is known to be long is split into blocks when it is posted, and pairs of blocks
go to different parts; one that turns out to be long where it was put together is split there and
handed on. A family with too many members is split as well. The filter that tells the last pass which
records matter has a size that follows from their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.words import ShingleSets, WordHashes, mixed
from codexmill.operators.batches import by_bytes
from codexmill.operators.skew import join_by_weight
from codexmill.operators.workspace import discard, written

#: Cells of a task's table of frequencies, and the most of all cells that order shingles.
CELLS, MOST_FREQUENT = 1 << 22, 1 << 20
#: Bits of the filter of record ids, for each id, and at most.
BITS_PER_ID, MOST_BITS = 16, 1 << 28
#: 64-bit parts of a parity bitmap.
PARITY = 4
#: Tasks whose bitmaps are added in one place at the first level.
SHARD = 256
#: Sets that a task remembers to have seen; a class may be posted again beyond that, which the lists bear.
REMEMBERED = 1_000_000


def _column(array: np.ndarray) -> pa.Array:
    return pa.array(array)


def _texts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))


# --------------------------------------------------------------------------- pass 1: sets and counts


class _Fresh:
    """Which sets a task sees for the first time; the same in each pass over the same texts."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        fresh = np.zeros(len(ids), bool)
        for i, c in enumerate(ids.tolist()):
            if c not in self.seen:
                self.seen.add(c)
                fresh[i] = True
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        return fresh


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(CELLS)).astype(np.int64)


def _describe(texts: DataFrame, width: int, min_words: int) -> DataFrame:
    """Per record its set's size and digest, and whether its task saw the set first; per task, with a
    null ``row_id``, how many sets have the shingles of the cells that stand out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, first, counts, total = WordHashes(), _Fresh(), np.zeros(CELLS, np.int32), 0
        for batch in by_bytes(batches, 1):
            s = ShingleSets(batch.column(1).to_pylist(), width, min_words, cache)
            high, low = s.digests()
            n, fresh = len(s.text), first(low)
            cells = _cell(s.hashes[fresh[s.owners()]])
            np.add.at(counts, cells, 1)
            total += len(cells)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(_column(s.text)), _column(high), _column(low), _column(s.sizes.astype(np.int32)), _column(fresh), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names=names)
        cells = np.flatnonzero(counts >= 5 + 2 * (total // CELLS))
        n = len(cells)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())], _column(cells.astype(np.int32)), _column(counts[cells])], names=names)

    names = ["row_id", "high", "low", "size", "fresh", "cell", "n"]
    return texts.mapInArrow(run, "row_id long, high long, low long, size int, fresh boolean, cell int, n int")


def _frequencies(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the most frequent shingles and their counts."""
    counted = described.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "cell").limit(MOST_FREQUENT).toArrow()
    return top.column("cell").to_numpy().astype(np.int64), top.column("n").to_numpy().astype(np.int64)


# --------------------------------------------------------------------------- pass 2: postings


def _least_partner(size: np.ndarray, t: Fraction) -> np.ndarray:
    return -(-size * t.numerator // t.denominator)


def _needed(total: np.ndarray, t: Fraction) -> np.ndarray:
    """The overlap that two sets of ``total`` members together must have."""
    return -(-total * t.numerator // (t.numerator + t.denominator))


def _parity(s: ShingleSets) -> np.ndarray:
    bit = (s.hashes >> np.uint64(24)) % np.uint64(64 * PARITY)
    one = np.uint64(1) << (bit % np.uint64(64))
    word = bit // np.uint64(64)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == np.uint64(w), one, np.uint64(0)), s.start[:-1]) for w in range(PARITY)], axis=1)


#: What is posted: per part the sets of a batch (id, parity, size) and the entries of their shingles.
#: Shingles are told apart within a part by 32 bits; positions beyond 16 bits are written lower than
#: they are, which keeps candidates only; sides are left out where all are 0.
_POSTED = {"ids": np.int64, "parity": np.uint64, "sizes": np.int32, "tokens": np.uint32, "positions": np.uint16, "locals": np.uint16, "sides": np.uint8}
_LAST_POSITION = (1 << 16) - 1
_POSTED_SCHEMA = "part int, " + ", ".join(f"{c} binary" for c in _POSTED)


@dataclass
class _Sets:
    ids: np.ndarray
    parity: np.ndarray
    sizes: np.ndarray


@dataclass
class _Entries:
    """Entries of lists: the shingle, the set's place among the sets, the shingle's position in it, and
    which side of a pair of blocks it is on (0 and 1 meet all, 2 and 3 each other)."""

    token: np.ndarray
    owner: np.ndarray
    position: np.ndarray
    side: np.ndarray

    def take(self, at: np.ndarray) -> _Entries:
        return _Entries(self.token[at], self.owner[at], self.position[at], self.side[at])

    def split(self, ids: np.ndarray, blocks: np.ndarray) -> _Entries:
        """The entries of lists in so many blocks, once for each pair of blocks that theirs is in."""
        if not (blocks > 1).any():
            return self
        mine = (mixed(ids.view(np.uint64))[self.owner] % blocks.astype(np.uint64)).astype(np.int64)
        copies = np.repeat(np.arange(len(blocks)), blocks)
        other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low, high = np.minimum(mine[copies], other), np.maximum(mine[copies], other)
        out = self.take(copies)
        out.side = ((mine[copies] != low).astype(np.uint8) + 2 * (low != high)).astype(np.uint8)
        many = blocks[copies] > 1
        out.token[many] = mixed(out.token[many] + low[many].astype(np.uint64) * np.uint64(2654435761) + high[many].astype(np.uint64) * np.uint64(40503))
        return out

    def packed(self, sets: _Sets, parts: int) -> pa.RecordBatch:
        part = (mixed(self.token) >> np.uint64(33)) % np.uint64(parts)
        by = np.argsort(part, kind="stable")
        rows: list[tuple] = []
        for chunk in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
            if len(chunk):
                used, local = np.unique(self.owner[chunk], return_inverse=True)
                side = self.side[chunk] if self.side[chunk].any() else np.zeros(0)
                columns = (sets.ids[used], sets.parity[used], sets.sizes[used], self.token[chunk], np.minimum(self.position[chunk], _LAST_POSITION), local, side)
                kinds = _POSTED | {"locals": _local_type(len(used))}
                rows.append((int(part[chunk[0]]), *(c.astype(k).tobytes() for c, k in zip(columns, kinds.values()))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, len(_POSTED) + 1)]], names=["part", *_POSTED])


def _local_type(sets: int) -> type:
    return np.uint16 if sets <= 1 << 16 else np.uint32


def _post(texts: DataFrame, width: int, min_words: int, t: Fraction, frequent, parts: int, crowd: int) -> DataFrame:
    """Postings of each class, packed by part. A shingle that n sets are known to have, n over four
    times ``crowd``, has n / ``crowd`` blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, first, counts = WordHashes(), _Fresh(), np.zeros(CELLS, np.int64)
        counts[frequent.value[0]] = frequent.value[1]
        for batch in by_bytes(batches, 1):
            s = ShingleSets(batch.column(1).to_pylist(), width, min_words, cache)
            if not len(s.text):
                continue
            _, ids = s.digests()
            fresh, owner = first(ids), s.owners()
            often = counts[_cell(s.hashes)]
            order = np.lexsort((s.hashes, often, owner))
            position = np.arange(len(order)) - s.start[owner]
            prefix = s.sizes - _least_partner(s.sizes, t) + 1
            keep = (position < prefix[owner]) & fresh[owner]
            order, often = order[keep], often[order[keep]]
            entries = _Entries(s.hashes[order], owner[keep], position[keep], np.zeros(len(order), np.uint8))
            blocks = np.where(often > 4 * crowd, -(-often // crowd), 1)
            yield entries.split(ids, blocks).packed(_Sets(ids, _parity(s), s.sizes), parts)

    return texts.mapInArrow(run, _POSTED_SCHEMA)


def _unpacked(table: pa.Table) -> tuple[_Sets, _Entries]:
    blobs = {c: table.column(c).to_pylist() for c in _POSTED}
    join = lambda c: np.concatenate([np.frombuffer(b, _POSTED[c]) for b in blobs[c]])
    n = [len(b) // 8 for b in blobs["ids"]]
    owner = np.concatenate([np.frombuffer(b, _local_type(k)).astype(np.int64) + at for b, k, at in zip(blobs["locals"], n, np.cumsum([0] + n))])
    sides = np.concatenate([np.frombuffer(b, np.uint8) if b else np.zeros(len(t) // 4, np.uint8) for b, t in zip(blobs["sides"], blobs["tokens"])])
    return _Sets(join("ids"), join("parity").reshape(-1, PARITY), join("sizes").astype(np.int64)), _Entries(join("tokens").astype(np.uint64), owner, join("positions").astype(np.int64), sides)


def _lists(sets: _Sets, e: _Entries) -> tuple[_Entries, np.ndarray, np.ndarray]:
    """The entries by list and size of set, without lists of one; the list of each, and its length."""
    e = e.take(np.lexsort((sets.sizes[e.owner], e.token)))
    new = np.ones(len(e.token), bool)
    new[1:] = e.token[1:] != e.token[:-1]
    group = np.cumsum(new) - 1
    length = np.bincount(group)[group] if len(group) else group
    many = np.flatnonzero(length > 1)
    return e.take(many), group[many], length[many]


def _candidates(sets: _Sets, e: _Entries, group: np.ndarray, t: Fraction, at_once: int) -> Iterator[np.ndarray]:
    """Pairs of class ids of one part's lists that pass all filters, in chunks of two columns."""
    ids, parity, size, owner, side = sets.ids, sets.parity, sets.sizes[e.owner], e.owner, e.side
    rest = size - e.position
    # The block of the list, of sets no larger than one's own, that can hold a partner.
    largest = np.minimum(size, rest * (t.numerator + t.denominator) // t.numerator - size)
    stride = int(size.max(initial=0)) + 2
    key = group * stride + size
    low = np.searchsorted(key, group * stride + _least_partner(size, t), "left")
    high = np.minimum(np.searchsorted(key, group * stride + np.maximum(largest, 0), "right"), np.arange(len(key)))
    length = np.maximum(high - low, 0)
    ends = np.cumsum(length)
    done = 0
    while done < len(length):
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + at_once, "right")))
        n = length[done:upto]
        b = np.repeat(np.arange(done, upto), n)
        a = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n) + low[b]
        done = upto
        total = size[a] + size[b]
        ok = np.minimum(rest[a], rest[b]) >= _needed(total, t)
        ok &= (side[a] < 2) | (side[a] != side[b])
        a, b, total = owner[a[ok]], owner[b[ok]], total[ok]
        differ = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
        ok = (differ <= total - 2 * _needed(total, t)) & (ids[a] != ids[b])
        a, b = ids[a[ok]], ids[b[ok]]
        yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)


def _met(postings: DataFrame, t: Fraction, parts: int, crowd: int, hand_on: bool, at_once: int = 1 << 20) -> DataFrame:
    """Pairs (a, b) of class ids, a part being a task; and, to be handed on, the postings of lists of
    more than eight times ``crowd`` that the counts didn't show, split into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = list(batches)
        if not mine:
            return
        sets, entries = _unpacked(pa.Table.from_batches(mine))
        entries, group, length = _lists(sets, entries)
        long = (length > 8 * crowd) & hand_on
        short = np.flatnonzero(~long)
        for found in _candidates(sets, entries.take(short), group[short], t, at_once):
            none = pa.nulls(len(found), pa.binary())
            yield pa.RecordBatch.from_arrays([_column(found[:, 0]), _column(found[:, 1]), pa.nulls(len(found), pa.int32()), *[none] * len(_POSTED)], names=names)
        rest = np.flatnonzero(long)
        for at in range(0, len(rest), crowd):
            some = rest[at : at + crowd]
            part = entries.take(some).split(sets.ids, -(-length[some] // crowd)).packed(sets, parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64())] * 2 + part.columns, names=names)

    names = ["a", "b", "part", *_POSTED]
    return postings.repartitionById(parts, F.col("part")).mapInArrow(run, f"a long, b long, {_POSTED_SCHEMA}")


def _candidate_pairs(postings: DataFrame, t: Fraction, parts: int, crowd: int) -> DataFrame:
    """Distinct pairs (a, b) of class ids, a written table."""
    met = written(_met(postings, t, parts, crowd, True), "similar-met")
    pairs = met.where("a IS NOT NULL").select("a", "b")
    rest = met.where("part IS NOT NULL").select("part", *_POSTED)
    if rest.take(1):
        pairs = pairs.unionByName(_met(rest, t, parts, crowd, False).select("a", "b"))
    found = written(pairs.distinct(), "similar-candidates")
    discard(met)
    return found


# --------------------------------------------------------------------------- pass 3: members and families


def _filter_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _id_filter(ids: DataFrame, column: str, most: int) -> np.ndarray:
    """A bitmap that has the bit of each of at most ``most`` ids; the join that follows is exact."""
    size = min(MOST_BITS, 1 << max(16, (BITS_PER_ID * most - 1).bit_length()))
    step = size // 8 // 64

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(size, bool)
        for batch in batches:
            bitmap[_filter_bits(np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64), size)] = True
        packed = np.packbits(bitmap)
        used = [i for i in range(64) if packed[i * step : (i + 1) * step].any()]
        shard = TaskContext.get().partitionId() // SHARD
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([shard] * len(used), pa.int32()), pa.array([packed[i * step : (i + 1) * step].tobytes() for i in used], pa.binary())], names=["block", "shard", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        blobs = table.column("bits").to_pylist()
        total = np.frombuffer(blobs[0], np.uint8).copy()
        for b in blobs[1:]:
            total |= np.frombuffer(b, np.uint8)
        return pa.table({"block": pa.array(table.column("block").to_pylist()[:1], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    parts = ids.select(column).mapInArrow(bits, "block int, shard int, bits binary")
    merged = parts.groupBy("block", "shard").applyInArrow(merge, "block int, bits binary").groupBy("block").applyInArrow(merge, "block int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in merged.collect():
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def _members(texts: DataFrame, width: int, min_words: int, wanted) -> DataFrame:
    """(row_id, members) of the records whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in by_bytes(batches, 1):
            at = _filter_bits(np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64), 8 * len(wanted.value))
            chosen = np.flatnonzero((wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            some = batch.take(pa.array(chosen))
            s = ShingleSets(some.column(1).to_pylist(), width, min_words, cache)
            lists = pa.ListArray.from_arrays(pa.array(s.start.astype(np.int32)), pa.array(s.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(s.text)), lists], names=["row_id", "members"])

    return texts.mapInArrow(run, "row_id long, members array<long>")


def _verify_family(pairs: list[tuple[int, int]], sets: dict[int, set], leader: int, t: Fraction) -> list[tuple[int, int, int]]:
    """(a, b, overlap) of the similar pairs. The leader's overlaps are counted whole, those of sets
    close to it by the members in which they differ from it."""
    of_leader: dict[int, int] = {}
    lead = sets.get(leader)
    gone: dict[int, tuple[set, set] | None] = {}
    out = []
    for a, b in pairs:
        x, y = sets[a], sets[b]
        change = gone.get(a, 0)
        if change == 0:
            change = None
            if lead is not None:
                less, more = lead - x, x - lead
                if len(less) + len(more) < len(x) // 2:
                    change = (less, more)
            gone[a] = change
        if change is None:
            overlap = len(x & y)
        else:
            if b not in of_leader:
                of_leader[b] = len(lead & y)
            overlap = of_leader[b] - len(change[0] & y) + len(change[1] & y)
        if overlap * t.denominator >= (len(x) + len(y) - overlap) * t.numerator:
            out.append((a, b, overlap))
    return out


def _shipped(ships: DataFrame, members: DataFrame, led: DataFrame, most_families: int) -> DataFrame:
    """``ships`` with the members of their records. A record of more than ``most_families`` families, or
    1/4096 of all pairs if that is more, has its members in several copies, which share its families."""
    of = led.select(F.explode(F.array("a", "b", "leader")).alias("row_id")).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    bound = max(most_families, 3 * led.count() // 4096)
    hot = of.where(F.col("n") > bound).select("row_id", F.ceil(F.col("n") / bound).alias("copies"))
    if not hot.take(1):
        return ships.join(members, "row_id")
    hot = F.broadcast(hot)  # at most 4,096 rows
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    spread = members.join(hot, "row_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies")
    return ships.join(hot, "row_id", "left").withColumn("copy", F.pmod(F.xxhash64("leader", "cut"), copies)).drop("copies").join(spread, ["row_id", "copy"])


def _verified(pairs: DataFrame, members: DataFrame, t: Fraction, family_members: int, most_families: int) -> DataFrame:
    """(a, b) of row ids that are similar, from the candidates (a, b, members): both sets' sizes."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    leaders = both.groupBy("x").agg(F.least("x", F.min("y")).alias("leader"))
    led = written(pairs.join(leaders.withColumnRenamed("x", "a"), "a"), "similar-families")
    crowded = led.groupBy("leader").agg(F.ceil(F.sum("members") / family_members).alias("cuts"))
    families = led.join(crowded, "leader").withColumn("cut", F.pmod(F.xxhash64("a", "b"), "cuts"))
    ships = families.select("leader", "cut", F.explode(F.array("a", "b", "leader")).alias("row_id")).distinct()
    inside = families.groupBy("leader", "cut").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    there = _shipped(ships, members, led, most_families).groupBy("leader", "cut").agg(F.collect_list(F.struct("row_id", "members")).alias("sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for leader, listed, shipped in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                flat = shipped.values
                sets = {i: set(m.values.to_numpy().tolist()) for i, m in zip(flat.field("row_id").to_pylist(), flat.field("members"))}
                ends = listed.values
                todo = [(a, b) for a, b in zip(ends.field("a").to_pylist(), ends.field("b").to_pylist()) if a in sets and b in sets]
                out += _verify_family(todo, sets, leader, t)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["a", "b"])

    return inside.join(there, ["leader", "cut"]).select("leader", "pairs", "sets").mapInArrow(run, "a long, b long")


def similar_classes(
    df: DataFrame,
    row_id: str = "row_id",
    text: str = "text",
    width: int = 5,
    threshold: Fraction = Fraction(4, 5),
    min_words: int = 1,
    part_postings: int = 1_500_000,
    crowd: int = 20_000,
    family_members: int = 2_000_000,
    most_families: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and links between classes, both written tables.

    The first has (row_id, kept, copies): each record with enough words, the smallest id of its class
    and the class's size. The second has (a, b): ``kept`` of two classes whose similarity, shared
    over all shingles, is at least the threshold, a below b. Every such pair is found.

    Defined cases: null ids, null and empty texts, and texts with fewer than ``min_words`` or
    ``width`` words have no set and don't appear. Records under one id count as one class if they
    are equal. Other columns are never read. Empty input gives empty tables.
    """
    spark, texts = df.sparkSession, _texts(df, row_id, text)
    described = written(_describe(texts, width, min_words), "similar-sets")
    frequent = spark.sparkContext.broadcast(_frequencies(described))
    sets = described.where("row_id IS NOT NULL").select("row_id", "high", "low", "size")
    classes = written(sets.groupBy("high", "low").agg(F.min("row_id").alias("kept"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")), "similar-classes")
    prefix = F.col("size") - F.ceil(F.col("size") * threshold.numerator / threshold.denominator) + 1
    # What will be posted but for blocks, of which the counted part is known.
    postings = described.where("fresh").agg(F.sum(prefix)).first()[0] or 0
    copied = int(sum(n * (n // crowd) for n in frequent.value[1].tolist() if n > 4 * crowd))
    parts = max(1, math.ceil((postings + copied) / part_postings))
    found = _candidate_pairs(_post(texts, width, min_words, threshold, frequent, parts, crowd), threshold, parts, crowd)
    ids = classes.select("low", "kept", "size")
    named = (
        found.join(ids.select(F.col("low").alias("a"), F.col("kept").alias("ka"), F.col("size").alias("na")), "a")
        .join(ids.select(F.col("low").alias("b"), F.col("kept").alias("kb"), F.col("size").alias("nb")), "b")
        .select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), (F.col("na") + F.col("nb")).alias("members"))
        .where("a != b")
        .distinct()
    )
    named = written(named, "similar-named")
    named_ids = named.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = spark.sparkContext.broadcast(_id_filter(named_ids, "id", min(2 * named.count(), classes.count())))
    links = written(_verified(named, _members(texts, width, min_words, wanted), threshold, family_members, most_families), "similar-links")
    membership = written(join_classes(sets, classes), "similar-membership")
    discard(described, classes, found, named)
    return membership, links


def join_classes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(row_id, kept, copies): the class of each record, also where a class has a third of all."""
    return join_by_weight(sets.select("row_id", "high", "low"), classes.drop("size"), ["high", "low"], "copies").select("row_id", "kept", "copies")


def class_links(membership: DataFrame, links: DataFrame) -> DataFrame:
    """(row_id, class_id, copies, links): the class of each record, its size, and to how many other
    classes it is similar. This holds the whole relation, with the links between classes, in as many
    rows as there are records; :func:`similar_pairs` spells it out."""
    ends = links.select(F.explode(F.array("a", "b")).alias("kept")).groupBy("kept").agg(F.count(F.lit(1)).alias("links"))
    classes = membership.groupBy("kept").agg(F.count(F.lit(1)).alias("copies")).join(ends, "kept", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    joined = join_by_weight(membership.select("row_id", "kept"), written(classes, "similar-links-of"), ["kept"], "copies")
    return joined.select("row_id", F.col("kept").alias("class_id"), "copies", "links")


def similar_pairs(membership: DataFrame, links: DataFrame, expand: int = 256) -> DataFrame:
    """(row_id_a, row_id_b), the first smaller: the linked pairs of records.

    A class of up to ``expand`` copies appears with all of its pairs, and in a link with all of its
    members. A larger one appears by its ``kept`` record: linked to each of its copies, and for the
    class in links to others. That is the same relation, without the square of the class's size.
    """
    small = F.col("copies") <= expand
    own = membership.where((F.col("copies") > 1) & small).select("kept", "row_id")
    within = own.alias("p").join(own.alias("q"), (F.col("p.kept") == F.col("q.kept")) & (F.col("p.row_id") < F.col("q.row_id"))).select(F.col("p.row_id").alias("x"), F.col("q.row_id").alias("y"))
    star = membership.where(~small & (F.col("row_id") != F.col("kept"))).select(F.col("kept").alias("x"), F.col("row_id").alias("y"))
    ends = membership.where(small | (F.col("row_id") == F.col("kept"))).select("kept", "row_id")
    across = (
        links.join(ends.select(F.col("kept").alias("a"), F.col("row_id").alias("x")), "a")
        .join(ends.select(F.col("kept").alias("b"), F.col("row_id").alias("y")), "b")
        .select("x", "y")
    )
    return within.unionByName(star).unionByName(across).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).where("row_id_a < row_id_b")

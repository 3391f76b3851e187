"""Evaluation passages in training texts, by latent semantic retrieval.

Texts and items are cut into passages of words. A passage is its words weighted by TF-IDF over the
words of the items, and its place in the latent space of a randomised singular value decomposition of
such passages. A latent space has no room for words that few passages have; what of a passage lies
outside of it is kept as a few more coordinates, the lengths of its residual over classes of words
(:class:`LatentSpace`). With them the cosine of two places is never below that of the passages
themselves, and the words that a hit must share say how large that one is at least. So the cosine
search finds the candidates and loses no hit. What is asked of a candidate is then checked on its
words: a run in the same order, or for paraphrases the longest common subsequence and the words that
carry the item's answer, its numbers and rarest words.

Scale: the items are the query set; one vocabulary, one set of document frequencies and one
decomposition serve ``most_items`` of them, and the search takes their passages in blocks. Document
frequencies count every document. The decomposition is fitted on all passages of the items and on a
bounded sample of documents (``fit_documents``), by distributed products with a thin matrix; what is
found doesn't depend on it. Every passage of every document is searched. Texts are read where they
lie, once for the fit and once per block of item passages, and never shuffled. A passage with fewer
words of the items than a hit must share can't be one and isn't projected.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codexmill.operators.batches import by_bytes
from codexmill.operators.workspace import written

#: Every Han or Kana character is a word of its own.
_find = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+").findall
RANK, OVERSAMPLING, POWER, SEED = 64, 16, 2, 20240229
#: Classes of words for the residual outside the latent space, and the answer words of a passage besides its numbers.
CLASSES, RAREST = 32, 4
NO_WORDS = np.zeros(0, np.int32)


def passage_words(text: str) -> list[str]:
    return _find(text.lower())


@dataclass(frozen=True)
class Items:
    """Items as passages: rows of word numbers, padded with the vocabulary's size, and their items' places."""

    ids: list
    vocabulary: dict[str, int]
    passages: np.ndarray
    owner: np.ndarray


def windows(words: np.ndarray, pad: int, run: int, blocks: int = 2) -> np.ndarray:
    """Windows of ``blocks`` times ``run`` words that begin every ``run`` words, padded; every stretch
    of one block less lies within one."""
    n = max(1, -(-len(words) // run) - blocks + 2)
    out = np.full((n + blocks - 1) * run, pad, np.int32)
    out[: len(words)] = words
    parts = out.reshape(-1, run)
    return np.concatenate([parts[i : i + n] for i in range(blocks)], axis=1)


def read_items(rows: list[tuple], run: int) -> Items:
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in passage_words(t)], np.int32) for _, t in rows]
    pad = len(vocabulary)
    cut = [windows(w, pad, run) for w in words]
    passages, owner = np.concatenate(cut), np.repeat(np.arange(len(rows)), [len(c) for c in cut])
    full = (passages < pad).sum(axis=1) >= run
    return Items([i for i, _ in rows], vocabulary, passages[full], owner[full])


def item_blocks(items: Items, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passages, owner) of all items in blocks of at most ``most`` passages."""
    for i in range(0, len(items.passages), most):
        yield items.passages[i : i + most], items.owner[i : i + most]


class Numbered(dict):
    """Numbers of the items' words, and the vocabulary's size for any other."""

    def __missing__(self, word: str) -> int:
        return self.pad

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, passage_words(text)), np.int32)


def _numbered(vocabulary: dict[str, int]) -> Numbered:
    n = Numbered(vocabulary)
    n.pad = len(vocabulary)
    return n


def _scan(docs: DataFrame, vocabulary, share: float) -> DataFrame:
    """Per task the number of documents and of documents with each word (``counts``); the words of
    about ``share`` of the documents, chosen by hash (``words``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = _numbered(vocabulary.value)
        counts, total = np.zeros(numbered.pad + 1, np.int64), 0
        for batch in by_bytes(batches, 1):
            kept = []
            for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if t:
                    words = numbered.of(t)
                    counts[np.unique(words)] += 1
                    total += 1
                    if (h & 0xFFFFFF) < share * 0x1000000:
                        kept.append(words.tobytes())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.binary()), pa.array(kept, pa.binary())], names=["total", "counts", "words"])
        counts[-1] = 0
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([counts.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names=["total", "counts", "words"])

    return docs.mapInArrow(run, "total long, counts binary, words binary")


def _frequencies(scanned: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Document frequencies and the number of documents; sums are made in the tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts += np.frombuffer(c, np.int64)
                total += n
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["total", "counts"])

    parts = scanned.where("total IS NOT NULL").select("total", "counts").coalesce(64).mapInArrow(add, "total long, counts binary")
    row = parts.repartition(1).mapInArrow(add, "total long, counts binary").collect()[0]
    return np.frombuffer(row["counts"], np.int64)[:size], row["total"]


def _weighted(passages: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """TF-IDF passages times a matrix with a row per word (and a zero row for other words)."""
    scaled = basis * idf[:, None]
    out = np.zeros((len(passages), basis.shape[1]), np.float32)
    for i in range(0, len(passages), 4096):
        out[i : i + 4096] = scaled[passages[i : i + 4096]].sum(axis=1)
    return out


def _transposed(passages: np.ndarray, idf: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The transpose of the TF-IDF passages times ``y``."""
    out = np.zeros((len(idf), y.shape[1]))
    flat, row = passages.ravel(), np.repeat(np.arange(len(passages)), passages.shape[1])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    for a, b in zip(starts, [*starts[1:], len(flat)]):
        out[flat[a]] = y[row[a:b]].sum(axis=0) * idf[flat[a]]
    return out


def _gram_product(texts: list[np.ndarray], idf: np.ndarray, matrix: np.ndarray, run: int) -> np.ndarray:
    """The Gram matrix of all texts' TF-IDF passages times ``matrix``.

    A passage is two neighbouring blocks of ``run`` words, so sums over blocks serve both passages
    that share a block, and each word is touched once in either direction.
    """
    out, size = np.zeros(matrix.shape), len(idf) - 1
    blocks = np.array([max(1, -(-len(t) // run)) + 1 for t in texts], np.int64)  # the last one is empty
    if not len(blocks):
        return out
    ends = np.cumsum(blocks)
    words = np.concatenate(texts)
    block = np.concatenate([np.arange(len(t)) // run + e - b for t, e, b in zip(texts, ends, blocks)])
    known = words < size
    words, block = words[known], block[known]
    if not len(words):
        return out
    firsts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    sums = np.zeros((ends[-1] + 1, matrix.shape[1]), np.float32)
    sums[block[firsts]] = np.add.reduceat((matrix * idf[:, None])[words], firsts, axis=0)
    passages = sums[:-1] + sums[1:]
    passages[ends - 1] = 0
    back = passages.copy()
    back[1:] += passages[:-1]
    order = np.argsort(words, kind="stable")
    words, block = words[order], block[order]
    firsts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    out[words[firsts]] = np.add.reduceat(back[block], firsts, axis=0) * idf[words[firsts], None]
    return out


def _sum_of(rows: int, columns: int):
    """Adds the matrices of a partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rows * columns)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return add


def latent_basis(sample: DataFrame, items: Items, idf: np.ndarray, run: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages of sample and items, a row per word.

    Randomised range finder with power iterations: each takes one distributed product of the
    passages' Gram matrix with a thin matrix. ``sample`` has the ``words`` of documents.
    """
    size, wide = len(idf) - 1, min(rank + OVERSAMPLING, len(idf) - 1)
    thin = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, wide)))[0]
    spark = sample.sparkSession
    for step in range(POWER + 1):
        padded = np.concatenate([thin, np.zeros((1, wide))]).astype(np.float32)
        shared = spark.sparkContext.broadcast((padded, idf))

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matrix, weight = shared.value
            total = np.zeros((size + 1, wide))
            for batch in batches:
                total += _gram_product([np.frombuffer(w, np.int32) for w in batch.column(0).to_pylist()], weight, matrix, run)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        gram = _transposed(items.passages, idf, _weighted(items.passages, idf, padded))
        for r in sample.mapInArrow(product, "part binary").repartition(1).mapInArrow(_sum_of(size + 1, wide), "part binary").collect():
            gram += np.frombuffer(r["part"]).reshape(size + 1, wide)
        shared.unpersist()
        gram = gram[:size]
        if step == POWER:
            break
        thin = np.linalg.qr(gram)[0]
    # The Gram matrix within the range found gives the leading directions.
    values, vectors = np.linalg.eigh((thin.T @ gram + gram.T @ thin) / 2)
    basis = thin @ vectors[:, np.argsort(-values)[: min(rank, wide)]]
    return np.concatenate([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)


class LatentSpace:
    """Places of passages: ``rank`` latent coordinates, and the length of what lies outside of them in
    each class of words. Both are of unit length together.

    The product of two passages is that of their projections plus that of their residuals, which class
    by class is at most the product of the residuals' lengths. So the cosine of two places is an upper
    bound of the cosine of the passages.
    """

    def __init__(self, idf: np.ndarray, basis: np.ndarray, classes: int = CLASSES):
        self.idf, self.basis, self.square, self.classes = idf, basis, idf.astype(np.float64) ** 2, classes
        self.scaled = basis * idf[:, None]
        self.kind = ((np.arange(len(idf), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % classes
        # Per class the Gram matrix of the basis, side by side: lengths of projections within the class.
        self.within = np.concatenate([basis[self.kind == c].T @ basis[self.kind == c] for c in range(classes)], axis=1)

    def places(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit places of passages (rows of word numbers), and the passages' lengths."""
        n, rank = len(passages), self.basis.shape[1]
        out, length = np.zeros((n, rank + self.classes), np.float32), np.zeros(n)
        for i in range(0, n, 2048):
            p = passages[i : i + 2048]
            y = self.scaled[p].sum(axis=1)
            times = (p[:, :, None] == p[:, None, :]).sum(axis=2)
            own = self.square[p] * times
            back = self.idf[p] * np.einsum("nwk,nk->nw", self.basis[p], y)
            cell = np.arange(len(p))[:, None] * self.classes + self.kind[p]
            outside = np.bincount(cell.ravel(), (own - 2 * back).ravel(), minlength=len(p) * self.classes).reshape(len(p), self.classes)
            outside += np.einsum("nck,nk->nc", (y @ self.within).reshape(len(p), self.classes, rank), y)
            whole = own.sum(axis=1, keepdims=True)
            # Rounded up, so that the bound holds in single precision.
            place = np.concatenate([y, np.sqrt(np.maximum(outside, 0) + 1e-5 * whole)], axis=1)
            out[i : i + 2048] = place / np.sqrt(np.where(whole > 0, whole, 1))
            length[i : i + 2048] = np.sqrt(whole[:, 0])
        return out, length

    def least_run(self, passages: np.ndarray, run: int) -> np.ndarray:
        """What any passage that has ``run`` words in a row in common with these has for a product with
        them at least; infinite where no run is all of known words."""
        known = passages < len(self.idf) - 1
        sums = lambda x: np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
        mass, full = sums(self.square[passages] * known), sums(known.astype(np.int64))
        mass, full = mass[:, run:] - mass[:, :-run], full[:, run:] - full[:, :-run]
        return np.where(full == run, mass, np.inf).min(axis=1)


def run_keys(words: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit key of each ``run`` words in a row, along the last axis."""
    n = words.shape[-1] - run + 1
    w, key = words.astype(np.uint64) + np.uint64(1), np.zeros((*words.shape[:-1], n), np.uint64)
    for i in range(run):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[..., i : i + n]
    return key


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one row (Hyyrö 2004)."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for w in b:
        u = row & where.get(w, 0)
        row = ((row + u) | (row - u)) & mask
    return len(a) - row.bit_count()


class Search:
    """What a task needs to search documents for a block of items' passages.

    ``rarity`` ranks the words from rare to frequent; ``numbers`` are those that are numbers.
    """

    def __init__(self, space: LatentSpace, numbered: Numbered, passages: np.ndarray, owner: np.ndarray, run: int):
        self.space, self.numbered, self.run, self.pad = space, numbered, run, numbered.pad
        self.passages, self.owner = passages, owner
        place, self.length = space.places(passages)
        self.place = np.ascontiguousarray(place.T)
        self.at_once = max(1, (1 << 22) // len(passages))

    def candidates(self, part: np.ndarray, least: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (passage of ``part``, passage of the items) whose cosine may be what it must be: their
        product is at least what either side asks for. Also the cosines of their places."""
        place, length = self.space.places(part)
        a, b, c = [], [], []
        for i in range(0, len(part), self.at_once):
            cosine = place[i : i + self.at_once] @ self.place
            needed = np.maximum(least[i : i + self.at_once, None], asked) / (length[i : i + self.at_once, None] * self.length)
            x, y = np.nonzero(cosine >= needed - 1e-4)
            a.append(x + i)
            b.append(y)
            c.append(cosine[x, y])
        return np.concatenate(a), np.concatenate(b), np.concatenate(c)

    def _gathered(self, cut: list[np.ndarray], owner: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
        if not cut:
            return np.zeros((0, width), np.int32), np.zeros(0, np.int64)
        return np.concatenate(cut), np.repeat(owner, [len(w) for w in cut])


class RunSearch(Search):
    """Passages that have ``run`` words in a row in common with an item."""

    def __init__(self, *args):
        super().__init__(*args)
        self.asked = self.space.least_run(self.passages, self.run)
        self.keys = run_keys(self.passages, self.run)

    def hits(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, int]]:
        """(text, item, cosine, run) of each pair that has a run, with the greatest cosine of its candidates."""
        cut, owner, known = [], [], b"\1" * self.run
        for i, words in enumerate(texts):
            if known in (words < self.pad).tobytes():
                cut.append(windows(words, self.pad, self.run))
                owner.append(i)
        passages, owner = self._gathered(cut, owner, 2 * self.run)
        full = np.isfinite(self.space.least_run(passages, self.run))
        passages, owner = passages[full], owner[full]
        best: dict[tuple[int, int], float] = {}
        for i in range(0, len(passages), 2048):
            part = passages[i : i + 2048]
            a, b, cosine = self.candidates(part, self.space.least_run(part, self.run), self.asked)
            keys = run_keys(part, self.run)
            for j in range(0, len(a), 1 << 16):
                x, y = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                same = np.flatnonzero((keys[x][:, :, None] == self.keys[y][:, None, :]).any(axis=(1, 2)))
                for p, q, c in zip(x[same].tolist(), y[same].tolist(), cosine[j + same].tolist()):
                    pair = (int(owner[i + p]), int(self.owner[q]))
                    if pair in best:
                        best[pair] = max(best[pair], c)
                    elif self._confirmed(part[p], q, keys[p]):
                        best[pair] = c
        return [(t, i, c, self.run) for (t, i), c in best.items()]

    def _confirmed(self, passage: np.ndarray, q: int, keys: np.ndarray) -> bool:
        """Whether equal keys are equal runs of known words."""
        for i, j in np.argwhere(keys[:, None] == self.keys[q][None, :]).tolist():
            words = passage[i : i + self.run]
            if (words < self.pad).all() and np.array_equal(words, self.passages[q, j : j + self.run]):
                return True
        return False


class ParaphraseSearch(Search):
    """Spans of three times ``run`` words that have a common subsequence with an item's passage, of
    ``share`` of its words at least, and more than half of its answer words: its numbers and the
    rarest others. Every stretch of twice ``run`` words lies within a span, wherever it begins."""

    def __init__(self, space: LatentSpace, numbered: Numbered, passages: np.ndarray, owner: np.ndarray, run: int, rarity: np.ndarray, numbers: np.ndarray, share: float):
        super().__init__(space, numbered, passages, owner, run)
        self.lists = [[w for w in p if w < self.pad] for p in passages.tolist()]
        self.needed = np.array([math.ceil(share * len(q) - 1e-9) for q in self.lists])
        self.answers = [answer_words(q, rarity, numbers) for q in self.lists]
        self.needs = np.array([len(x) // 2 + 1 for x in self.answers])
        # The least mass of a subsequence that is long enough, and of enough answer words.
        lightest = lambda words, n: float(np.sort(space.square[list(words)])[:n].sum())
        self.asked = np.array([max(lightest(q, n), lightest(x, m)) for q, n, x, m in zip(self.lists, self.needed, self.answers, self.needs)])
        self.is_answer = np.zeros(self.pad + 1, np.int64)
        self.is_answer[sorted(set().union(*self.answers))] = 1
        # Which passages of the items ask for each word.
        word, self.askers = np.array(sorted((w, q) for q, x in enumerate(self.answers) for w in x)).T
        self.asker_at = np.searchsorted(word, np.arange(self.pad + 2))

    def hits(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, int]]:
        """(text, item, cosine, words in common) of each pair's longest subsequence."""
        cut, owner = [], []
        least = int(self.needed.min())
        for i, words in enumerate(texts):
            if np.count_nonzero(words < self.pad) < least:
                continue
            w = windows(words, self.pad, self.run, 3)
            w = w[((w < self.pad).sum(axis=1) >= least) & (self.is_answer[w].sum(axis=1) >= self.needs.min())]
            if len(w):
                cut.append(w)
                owner.append(i)
        spans, owner = self._gathered(cut, owner, 3 * self.run)
        best: dict[tuple[int, int], tuple[int, float]] = {}
        for i in range(0, len(spans), 2048):
            part = spans[i : i + 2048]
            rows, asked_by = self._answered(part)
            if not len(rows):
                continue
            some, rows = np.unique(rows, return_inverse=True)
            part = part[some]
            a, b, cosine = self.candidates(part, np.zeros(len(part)), self.asked)
            # The candidates that have the answer words, too.
            known = rows * len(self.passages) + asked_by
            at = np.searchsorted(known, pair := a * len(self.passages) + b)
            ok = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == pair)
            for j in range(0, len(ok), 1 << 15):
                x, y = a[ok[j : j + (1 << 15)]], b[ok[j : j + (1 << 15)]]
                has = (part[x][:, :, None] == self.passages[y][:, None, :]).any(axis=1) & (self.passages[y] < self.pad)
                fits = np.flatnonzero(has.sum(axis=1) >= self.needed[y])
                for p, q, c in zip(x[fits].tolist(), y[fits].tolist(), cosine[ok[j + fits]].tolist()):
                    n = common_subsequence(self.lists[q], [w for w in part[p].tolist() if w < self.pad])
                    if n >= self.needed[q]:
                        key = (int(owner[i + some[p]]), int(self.owner[q]))
                        best[key] = max(best.get(key, (0, 0.0)), (n, c))
        return [(t, i, c, n) for (t, i), (n, c) in best.items()]

    def _answered(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (span, item passage), ascending, in which most answer words are there."""
        words = np.sort(part, axis=1)
        asked = self.is_answer[words] > 0
        asked[:, 1:] &= words[:, 1:] != words[:, :-1]
        row, at = np.nonzero(asked)
        first = self.asker_at[words[row, at]]
        n = self.asker_at[words[row, at] + 1] - first
        asker = self.askers[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pair, times = np.unique(np.repeat(row, n) * len(self.needs) + asker, return_counts=True)
        pair = pair[times >= self.needs[pair % len(self.needs)]]
        return pair // len(self.needs), pair % len(self.needs)


def answer_words(words: list[int], rarity: np.ndarray, numbers: np.ndarray) -> set[int]:
    """The words of an item's passage that carry its answer: its numbers, and its rarest words."""
    return set(sorted(set(words), key=lambda w: rarity[w])[:RAREST]) | {w for w in words if numbers[w]}


def rarity_of(vocabulary: dict[str, int], seen: np.ndarray) -> np.ndarray:
    """The rank of each word from rare to frequent, ties in alphabetical order."""
    order = sorted(vocabulary, key=lambda w: (int(seen[vocabulary[w]]), w))
    rank = np.zeros(len(order), np.int64)
    rank[[vocabulary[w] for w in order]] = np.arange(len(order))
    return rank


@dataclass(frozen=True)
class Fit:
    """What all blocks of a set of items share."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    basis: np.ndarray
    rarity: np.ndarray


def fitted(source: DataFrame, items: Items, run: int, fit_documents: int, total: int) -> Fit:
    """Document frequencies over all documents, and the decomposition."""
    vocabulary = source.sparkSession.sparkContext.broadcast(items.vocabulary)
    scanned = written(_scan(source, vocabulary, min(1.0, fit_documents / total)), "leak-scan")
    seen, n = _frequencies(scanned, len(items.vocabulary))
    # Between 1 for a word of every document and 2 for one of none: a run of common words counts, too.
    idf = np.append(1 + np.log((n + 1) / (seen + 1)) / np.log(n + 2), 0).astype(np.float32)
    sample = written(scanned.where("words IS NOT NULL").select("words").repartition(32), "leak-sample")
    return Fit(items.vocabulary, idf, latent_basis(sample, items, idf, run), rarity_of(items.vocabulary, seen))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    run: int = 13,
    paraphrases: bool = False,
    subsequence: float = 0.6,
    fit_documents: int = 5000,
    most_items: int = 100_000,
    block_passages: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, cosine, run_words, common_words) of each document that shows an item.

    A pair is confirmed by ``run`` words in a row; with ``paraphrases`` also by a common subsequence
    of the given share of an item's passage, within three times ``run`` words, that come with most of
    its answer words. ``run_words`` is ``run`` or 0, ``common_words`` the subsequence's length or 0,
    ``cosine`` that of the places in the latent space. Which pairs of passages are compared word by
    word is decided there, by a bound that no such pair misses: every pair that has a run is found,
    whatever ``fit_documents``, ``most_items`` and ``block_passages`` are. (The answer words of
    paraphrases are the rarest of all documents; they don't depend on these, either.)

    Defined cases: null and empty texts show nothing, and items of fewer than ``run`` words can't be
    shown. Null ids are kept, repeated rows of a document or item give one row per pair. Other
    columns are never read. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("run_words", T.IntegerType()), T.StructField("common_words", T.IntegerType())])
    item_type = to_arrow_type(schema[item_id].dataType)
    queries = written(items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL").withColumn("n", F.monotonically_increasing_id()), "leak-items").orderBy("n")
    source = docs.select(F.col(doc_id), F.col(text).cast("string").alias("__text"), F.xxhash64(F.col(text).cast("string")).alias("__hash"))
    total = docs.count()
    found, rows = [spark.createDataFrame([], schema)], []

    def searched(known: Items) -> Iterator[DataFrame]:
        fit = spark.sparkContext.broadcast(fitted(source, known, run, fit_documents, total))
        for block in item_blocks(known, block_passages):
            yield in_documents(fit, spark.sparkContext.broadcast(block), [known.ids[i] for i in np.unique(block[1])])

    def in_documents(fit, block, ids: list) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, (passages, owner) = fit.value, block.value
            owner = np.unique(owner, return_inverse=True)[1]
            numbered = _numbered(f.vocabulary)
            base = (LatentSpace(f.idf, f.basis), numbered, passages, owner, run)
            tasks = [(RunSearch(*base), True)]
            if paraphrases:
                numbers = np.array([w.isdecimal() for w in f.vocabulary])
                tasks.append((ParaphraseSearch(*base, f.rarity, numbers, subsequence), False))
            for part in by_bytes(batches, 1, 4 << 20):
                texts = [numbered.of(t) if t else NO_WORDS for t in part.column(1).to_pylist()]
                for task, is_run in tasks:
                    hits = task.hits(texts)
                    zeros = pa.array([0] * len(hits), pa.int32())
                    size = pa.array([h[3] for h in hits], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([ids[h[1]] for h in hits], item_type), pa.array([float(h[2]) for h in hits], pa.float64()), *((size, zeros) if is_run else (zeros, size))],
                        names=schema.names,
                    )

        return source.select(doc_id, "__text").mapInArrow(go, schema)

    def flush() -> None:
        known = read_items(rows, run) if rows and total else None
        if known is not None and len(known.passages):
            found.extend(searched(known))
        rows.clear()

    for r in queries.toLocalIterator():
        rows.append((r["i"], r["t"]))
        if len(rows) == most_items:
            flush()
    flush()
    result = functools.reduce(DataFrame.unionByName, found)
    return result.groupBy(doc_id, item_id).agg(F.max_by(F.struct("cosine", "run_words", "common_words"), F.struct("run_words", "common_words", "cosine")).alias("h")).select(doc_id, item_id, "h.*")

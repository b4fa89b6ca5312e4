"""Benchmark decontamination (8): SimHash of item-sized windows.

A benchmark item and a window of as many words are sets of weighted five-word shingles; a shingle
weighs its number of occurrences. Fingerprints have BITS bits in BLOCKS blocks. Items are indexed by size, block and the block's bits;
of two fingerprints that differ in at most RADIUS bits some block differs in RADIUS // BLOCKS at most, so looking up
all values that close to each of a window's blocks finds every item within the radius. Of other items of the same size about
one in six is met in passing (measured in the tests) and dropped by its whole fingerprint. The exact weighted similarity (sum of
lesser weights over sum of greater weights) then decides. At a similarity of 0.8 the bits that differ are about
27 of 180 degrees, 38 of 256 with a deviation of 6; the radius lies four deviations above, and the recall there is tested.

A window without enough of the benchmark's shingles can't be similar, so only windows that hold them are
fingerprinted; no window that could match is passed over. The benchmark reaches the executors in
parts of about AT_ONCE bytes (one part for usual benchmarks; the index takes about ten times that), documents are read once a
part, and nothing is shuffled but the found pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS, BLOCKS, RADIUS = 256, 16, 63
AT_ONCE = 4_000_000  # bytes of the benchmark that are indexed and broadcast at a time
FOUND = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def plain_words(raw: bytes) -> np.ndarray:
    """Hashes of words without case (ASCII) and without marks at their ends."""
    return common.word_hashes(raw.lower(), stripped=True)[0]


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    lanes = common.mix(shingles[:, None] + np.arange(BITS // 64, dtype=np.uint64) * common._STEP)
    return (np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(shingles), BITS // 8), axis=1).astype(np.int8) << 1) - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Packed bits of the signs of summed vectors, one row each."""
    return np.packbits(sums > 0, axis=-1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact weighted similarity of two bags of shingles."""
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / (len(a) + len(b) - both)


class Index:
    """Items by size and fingerprint block, all in arrays."""

    def __init__(self, items: list[tuple[int, bytes]], radius: int = RADIUS):
        self.radius, self.ids, self.bags, self.size = radius, [], [], []
        prints = []
        for item, raw in items:
            words = plain_words(raw)
            if not len(words):
                continue
            bag = common.shingle_hashes(words)
            self.ids.append(item)
            self.bags.append(bag)
            self.size.append(len(words))
            prints.append(fingerprint(bits_of(bag).sum(axis=0, dtype=np.int32)))
        self.prints = np.array(prints, np.uint8).reshape(len(prints), BITS // 8)
        # shingles, and the sizes of the items that have each
        size = np.array(self.size, np.int64)
        owned = np.repeat(size, [len(b) for b in self.bags])
        flat = np.concatenate([*self.bags, np.zeros(0, np.uint64)])
        order = np.lexsort((owned, flat))
        flat, owned = flat[order], owned[order]
        new = np.append(True, (flat[1:] != flat[:-1]) | (owned[1:] != owned[:-1]))[: len(flat)]
        self.shingles, self.first = np.unique(flat[new], return_index=True)
        self.first, self.sizes = np.append(self.first, new.sum()), owned[new]
        self.short = sorted({n for n in self.size if n < common.SHINGLE})
        # a first look at 2^22 bits, right for all that are not there
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.shingles >> np.uint64(42)] = True
        # every item under its size, block and the block's bits
        keys = self._keys(size, self.prints.view(np.uint16)).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.item = keys[order], order // BLOCKS
        self.filled = np.zeros(1 << 22, bool)
        self.filled[self._slot(self.keys)] = True
        self.around = np.array([m for m in range(1 << 16) if m.bit_count() <= radius // BLOCKS], np.uint16)  # all that a block may differ by

    @staticmethod
    def _keys(size, values) -> np.ndarray:
        return np.asarray(size)[..., None] << 20 | np.arange(BLOCKS) << 16 | values.astype(np.int64)

    @staticmethod
    def _slot(keys) -> np.ndarray:
        return (keys.astype(np.uint64) * common._STEP >> np.uint64(42)).astype(np.int64)

    def candidates(self, size: int, p: np.ndarray) -> np.ndarray:
        """All items of a size that differ in few enough bits in some block."""
        keys = (self._keys(size, p.view(np.uint16)).reshape(-1, 1) ^ self.around.astype(np.int64)).ravel()
        keys = keys[self.filled.take(self._slot(keys))]
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(self.item[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if a < b)]))

    def near(self, size: int, p: np.ndarray) -> list[int]:
        """All items of a size whose fingerprint is within the radius."""
        some = self.candidates(size, p)
        return some[np.unpackbits(self.prints[some] ^ p, axis=1).sum(axis=1) <= self.radius].tolist()

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the benchmark's shingles, with each size of an item that has it."""
        at = np.flatnonzero(self.seen.take((shingles >> np.uint64(42)).astype(np.int64)))
        if not len(at) or not len(self.shingles):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.shingles, shingles[at]), len(self.shingles) - 1)
        here = self.shingles[which] == shingles[at]
        at, which = at[here], which[here]
        many = self.first[which + 1] - self.first[which]
        each = np.arange(many.sum()) + np.repeat(self.first[which] - np.cumsum(many) + many, many)
        return np.repeat(at, many), self.sizes[each]


def windows(index: Index, words: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
    """item number: best similarity and its first window, of those at least `least`."""
    best: dict[int, tuple[float, int]] = {}
    n = len(words)
    for size in index.short:  # items of fewer words than a shingle are one shingle of their size
        if size <= n:
            shingles = common.shingle_hashes(words, size)
            at, sizes = index.hits(shingles)
            _score(index, shingles, size, 1, at[sizes == size], least, best)
    if n < common.SHINGLE:
        return best
    shingles = common.shingle_hashes(words)
    at, sizes = index.hits(shingles)
    fits = (sizes >= common.SHINGLE) & (sizes <= n)
    at, sizes = at[fits], sizes[fits]
    for size in np.unique(sizes).tolist():
        places = at[sizes == size]
        many = size - common.SHINGLE + 1  # shingles in a window
        here = np.zeros(n - size + 2, np.int64)
        np.add.at(here, np.maximum(0, places - many + 1), 1)
        np.add.at(here, np.minimum(places, n - size) + 1, -1)
        # a window this similar shares so many shingles; others can't reach `least`
        starts = np.flatnonzero(np.cumsum(here[:-1]) >= 2 * many * least / (1 + least) - 1e-9)
        _score(index, shingles, size, many, starts, least, best)
    return best


def _score(index, shingles, size, many, starts, least, best) -> None:
    for part in np.split(starts, np.flatnonzero(np.diff(starts) > many) + 1):
        if not len(part):
            continue
        lo, hi = part[0], part[-1] + many
        sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(bits_of(shingles[lo:hi]), axis=0, dtype=np.int32)))
        prints = fingerprint(sums[part - lo + many] - sums[part - lo])
        for start, p in zip(part.tolist(), prints):
            for i in index.near(size, p):
                value = similarity(index.bags[i], shingles[start : start + many])
                if value >= least - 1e-12 and value > best.get(i, (0,))[0]:
                    best[i] = value, start


def contamination(documents: DataFrame, benchmark: DataFrame, least: float = common.SIMILAR, radius: int = RADIUS, at_once: int = AT_ONCE) -> DataFrame:
    """documents: doc_id, text; benchmark: item_id, text.

    Returns a row for each document and item with a window of the item's size at least `least`
    similar: doc_id, item_id, similarity, start_word (from 0) and n_words of the first best window.
    Words are compared without ASCII case and without marks at their ends. Null and empty texts,
    of documents or items, match nothing; a null doc_id or item_id stays null; repeated rows give repeated
    rows; empty tables give none.
    """
    spark = documents.sparkSession
    documents, benchmark = common.pick(documents, "doc_id", "text"), common.pick(benchmark, "item_id", "text")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / at_once))
    common.ship(spark)
    out = None
    for b in range(blocks):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = sorted(((r[0], (r[1] or "").encode()) for r in mine.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))
        index = spark.sparkContext.broadcast(Index(items, radius))

        def run(batches, index=index):
            at = index.value
            for part, texts in common.slices(batches, 1):
                found = [[], [], [], [], []]
                for doc, raw in zip(part.column(0).to_pylist(), texts):
                    for i, (value, start) in windows(at, plain_words(raw), least).items():
                        for column, x in zip(found, (doc, at.ids[i], value, start, at.size[i])):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = documents.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out

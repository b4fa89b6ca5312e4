"""LM scoring (7) by online logistic context mixing.

A text, A-Z lower-cased, is a sequence of symbols: what single blanks separate, every other white character being a symbol of
its own (`symbols`; the text can be rebuilt from them), and an end. A symbol is coded bit by bit along a Huffman code of the
commonest symbols that the training texts hold twice or more (the vocabulary); all others share one code, the escape, and are spelled. Every bit is
predicted from contexts that cross the borders of words: the code's node alone, with the symbol before, with the two before, and
with the last very common symbol, which tells languages apart. A context's slot counts zeros and
ones. Those of every node, however rare, as log odds, are mixed by a logistic unit whose weights are chosen by a gate (how deep the node is,
how well the contexts are known) and learnt online; an adaptive probability map then refines the mixed probability.

An escaped word's probability is a mixture of its share among the escaped words of the training texts and of its spelling: the same
mixing over the bits of its bytes, from the bytes before and the whole word so far. No prediction looks at what it codes,
so the probabilities of all symbols, and of all bytes, that can follow add up to 1.

Scale. The table of words holds every word of the corpus, grows with it, and is only ever joined. The vocabulary has a fixed
size; slots grow with the training texts up to a stated bound, since they are broadcast, and contexts that collide there are
added up. Training texts are dealt by a hash to groups of GROUP bytes, whatever the number of cores, and sorted by it, so equal tables give
equal models: each group learns online, its counts before each step predicting that step; then counts are added up in blocks of slots and
weights averaged by their events. Texts are cut to pieces at blanks, contexts carried over, so long ones need no more memory.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = 1 << 18  # symbols with a code of their own, broadcast
SLOTS = 1 << 19  # of each hashed context, at most
GROUP = 64_000_000  # bytes of training text that are learnt from in one go
COMMON = 64  # words that tell languages apart
SMOOTH, RATE, MAP = 0.4, 0.15, 33
PIECE, STEP, BLOCK = 12_000, 2_000, 1 << 13  # bytes of a piece, symbols of a step of learning (of scoring: four times as many, which changes no score), slots of a block
SALT = 64  # places where weights are added up
KNOWN = 200_000  # words counted in a task before they are sent on
END = b" "  # no symbol holds a blank
_OTHER = [bytes([c]) for c in range(9, 14)]
SPECIAL = frozenset([b"", END, *_OTHER])  # symbols that are no words
_PACKED = "zstd"
_U = np.uint32
# how well a context is known, by how often it was seen: three classes for each of the first two hashed contexts
_SURE = [np.array([0] * 3 + [3] * 37 + [6], np.int32), np.array([0] * 2 + [1] * 10 + [2], np.int32)]
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], _U)


def symbols(text: bytes) -> list[bytes]:
    for c in _OTHER:
        if c in text:
            text = text.replace(c, b" " + c + b" ")
    return text.split(b" ")


def cut(text: bytes, most: int = PIECE) -> list[bytes]:
    """Pieces of a text, cut at blanks, whose symbols in turn are the text's."""
    out, at = [], 0
    while len(text) - at > most:
        to = text.find(b" ", at + most)
        if to < 0:
            break
        out.append(text[at:to])
        at = to + 1
    out.append(text[at:] if at else text)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(15))) * _U(0x2C1B3C6D)
    x = (x ^ (x >> _U(12))) * _U(0x297A2D39)
    return x ^ (x >> _U(15))


class Tree:
    """A Huffman code: the inner nodes (0 the heaviest, the root) and bits from the root to each leaf. Below nodes of less than
    `least` of all counts a leaf has its share of the node's (`rest`, log10), and no bits."""

    def __init__(self, counts: np.ndarray, least: float = 0.0):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        weight = array("q", (np.asarray(counts, np.int64)[order] + 1).tobytes() + bytes(8 * (n - 1)))
        parent, side = array("i", bytes(4 * (2 * n - 1))), bytearray(2 * n - 1)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):  # two queues: leaves and inner nodes, both by weight
            for bit in (0, 1):
                if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                    child, leaf = leaf, leaf + 1
                else:
                    child, inner = inner, inner + 1
                weight[new] += weight[child]
                parent[child], side[child] = new, bit
        weight, parent, side = np.frombuffer(weight, np.int64), np.frombuffer(parent, np.int32), np.frombuffer(side, np.int8)
        root, place = 2 * n - 2, np.empty(n, np.int64)
        place[order] = np.arange(n)

        def climb():
            """(leaves below the root, where they are, the nodes above), step by step: no table of all leaves by their depths."""
            own, at = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
            while (open_ := at != root).any():
                own, at = own[open_], at[open_]
                yield own, at, parent[at]
                at = parent[at]

        light = weight < least * weight[root]  # weights rise on the way, so nodes of a path are light up to some step
        size, top = np.zeros(n, np.int64), weight[:n].copy()
        for own, _, up in climb():
            size[own] += ~light[up]
            top[own[light[up]]] = weight[up[light[up]]]
        self.rest, self.size = np.log10(weight[:n] / top)[place], size[place]
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.packed = np.zeros(int(size.sum()), np.int32)
        left, start = size, self.start[order]
        for own, at, up in climb():
            own, at, up = (x[~light[up]] for x in (own, at, up))
            left[own] -= 1
            depth = left[own]
            # the bits' nodes, bits and gates by depth in one number, since looking up is what costs
            self.packed[start[own] + depth] = (root - up) | side[at].astype(np.int32) << 24 | ((depth >= 3) * np.int32(9) + (depth >= 8) * np.int32(9)) << 25
        self.nodes = int((self.packed & 0xFFFFFF).max(initial=0)) + 1


class Learner:
    """Counts, weights by gate and the probability map over a tree; learns in order.

    A step is (ids, contexts): the leaves coded and a 32-bit hash a leaf for each hashed context; `sizes` are the bits of
    the slots' numbers. Slot 0.. of the first table are the nodes themselves."""

    def __init__(self, tree: Tree, sizes: list[int]):
        self.tree, self.sizes = tree, sizes
        self.offset = np.concatenate(([0, tree.nodes], tree.nodes + np.cumsum(1 << np.array(sizes, np.int64)))).tolist()
        self.kinds = len(sizes) + 1
        self.gates = 27
        self.fresh()

    def fresh(self) -> None:
        """Nothing is learnt: a worker that has had one group gets the next."""
        self.w = np.full((self.gates, self.kinds + 1), 0.3, np.float32)
        self.w[:, -1] = 0
        self.hits, self.mass = np.zeros((self.gates, MAP, 2)), np.zeros(self.gates)
        self.counts = None

    def events(self, ids: np.ndarray, contexts: list[np.ndarray]):
        """(leaf of each bit, bit, gate by depth, slots of each context)."""
        tree = self.tree
        n = tree.size[ids]
        own = np.repeat(np.arange(len(ids)), n)
        at = np.arange(len(own)) + (tree.start[ids] - np.cumsum(n) + n).take(own)
        packed = tree.packed.take(at)
        node = packed & np.int32(0xFFFFFF)
        here, slots = node.view(_U) * _SALT[0], [node.astype(np.int64)]
        for k, (c, bits) in enumerate(zip(contexts, self.sizes)):
            h = c.take(own)
            h ^= here
            h *= _SALT[1] + _U(2 * k)
            h ^= h >> _U(15)
            h *= _SALT[2]
            h >>= _U(32 - bits)
            slots.append(h + np.int64(self.offset[k + 1]))
        return own, (packed >> np.int32(24)) & np.int32(1), packed >> np.int32(25), slots

    def _mix(self, gate, odds) -> np.ndarray:
        w = np.ascontiguousarray(self.w.T)
        x = w[-1].take(gate)
        for k, side in enumerate(odds):
            x += w[k].take(gate) * side
        return np.clip(x, -14, 14, out=x)

    def learn(self, ids, contexts) -> None:
        if self.counts is None:
            self.counts = np.zeros((self.offset[-1], 2), np.int32)
        flat, pairs = self.counts.reshape(-1), self.counts.reshape(-1).view(np.int64)
        _, bit, gate, slots = self.events(ids, contexts)
        odds, known = [], []
        for k, s in enumerate(slots):
            both = pairs.take(s)  # zeros below, ones above
            ones, zeros = (both >> 32).astype(np.float32), both.astype(np.int32).astype(np.float32)
            if k in (1, 2):
                known.append(_SURE[k - 1].take((ones + zeros).astype(np.int64), mode="clip"))
            ones += np.float32(SMOOTH)
            zeros += np.float32(SMOOTH)
            ones /= zeros
            odds.append(np.log(ones, out=ones))
        gate = (gate + known[0] + known[1]).astype(np.int64)
        x = self._mix(gate, odds)
        missed = (bit - 1 / (1 + np.exp(-x))).astype(np.float32)
        cell = gate * (2 * MAP) + np.rint((x + np.float32(14)) * np.float32((MAP - 1) / 28)).astype(np.int64) * 2 + bit
        self.hits += np.bincount(cell, minlength=self.hits.size).reshape(self.hits.shape)
        mass = np.bincount(gate, minlength=self.gates)
        rate = RATE / (1 + 0.01 * np.sqrt(self.mass / STEP)) / np.maximum(mass, 1000)
        for k in range(self.kinds):
            self.w[:, k] += rate * np.bincount(gate, missed * odds[k], self.gates)
        self.w[:, -1] += rate * np.bincount(gate, missed, self.gates)
        self.mass += mass
        for s in slots:
            s += s
            s += bit
            np.add.at(flat, s, np.int32(1))  # of the array's own kind: a hundred times as fast as a Python number

    # what a group has learnt, in rows that can be added up: blocks of counts, and (k below 0) weights times events, hits, events

    def rows(self, salt: int = 0):
        if self.counts is not None:
            for b in range(0, len(self.counts), BLOCK):
                if (some := self.counts[b : b + BLOCK]).any():
                    yield b // BLOCK, pa.compress(some.tobytes(), _PACKED, asbytes=True)
        yield -1 - salt, b"".join(x.astype(np.float64).tobytes() for x in (self.w * self.mass[:, None], self.hits, self.mass))

    def settle(self, rows) -> "Learner":
        """Takes rows added up, and turns counts to log odds."""
        counts, learnt = np.zeros((self.offset[-1], 2), np.int64), []
        for block, data in rows:
            if block < 0:
                learnt.append(np.frombuffer(data))
            else:
                some = np.frombuffer(data, np.int64).reshape(-1, 2)
                counts[block * BLOCK : block * BLOCK + len(some)] = some
        if learnt:
            w, hits, mass = np.split(sum(learnt), np.cumsum([self.w.size, self.hits.size]))
            w = w.reshape(self.w.shape) / np.maximum(mass, 1)[:, None]
            self.w, self.hits = np.where(mass[:, None] > 0, w, self.w).astype(np.float32), hits.reshape(self.hits.shape)
        middle = 1 / (1 + np.exp(-(np.arange(MAP) * 28 / (MAP - 1) - 14)))
        hits = self.hits + 20 * np.stack([1 - middle, middle], axis=1)
        table = (hits[..., 1] / hits.sum(-1)).astype(np.float32)
        self.low, self.rise = table.ravel(), np.diff(table, axis=1, append=table[:, -1:]).ravel()
        self.odds = np.log((counts[:, 1] + SMOOTH) / (counts[:, 0] + SMOOTH)).astype(np.float32)
        self.sure = np.zeros(len(counts), np.int8)
        for k in (1, 2):
            part = slice(self.offset[k], self.offset[k + 1])
            self.sure[part] = _SURE[k - 1].take(counts[part].sum(1), mode="clip")
        self.counts = None
        return self

    def score(self, ids, contexts) -> np.ndarray:
        """log10 probability of each leaf."""
        own, bit, gate, slots = self.events(ids, contexts)
        gate = (gate + self.sure.take(slots[1]) + self.sure.take(slots[2])).astype(np.int64)
        x = self._mix(gate, (self.odds.take(s) for s in slots))
        at = (x + np.float32(14)) * np.float32((MAP - 1) / 28)
        lo = np.minimum(at.astype(np.int64), MAP - 2)
        at -= lo
        lo += gate * MAP
        one = (self.low.take(lo) + self.rise.take(lo) * at + 1 / (1 + np.exp(-x))) * np.float32(0.5)
        return np.bincount(own, np.log(np.abs(one - (1 - bit).astype(np.float32))), len(ids)) / math.log(10) + self.tree.rest[ids]


# ------------------------------------------------------------------ symbols and their contexts


class Words:
    """The vocabulary: symbols (bytes), commonest first, their counts, and the escape."""

    def __init__(self, top: list[tuple[bytes, int]], escaped: int):
        self.counts = [n for _, n in top] + [escaped]
        self.escape, self.nothing = len(top), len(top) + 1
        self.marks = {w: i for i, (w, _) in enumerate(top) if w in SPECIAL}
        self.end = self.marks[END]
        self._fill([(i, w) for i, (w, _) in enumerate(top) if w not in SPECIAL])
        usual = [i for i, (w, _) in enumerate(top) if w not in SPECIAL][:COMMON]
        self.tells = np.zeros(len(top) + 2, bool)
        self.tells[usual] = True

    def contexts(self, ids: np.ndarray, first: np.ndarray, before: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashes of each context for pieces that begin at `first`; before: for each piece the last symbol, the one before
        it, and the last that tells the language. Also the same three after each piece."""
        n, index = len(ids), np.arange(len(ids))
        one, two = np.empty(n, np.int64), np.empty(n, np.int64)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        ends = np.append(first[1:], n)
        long = first[ends - first > 1]
        one[first], two[first] = before[:, 0], before[:, 1]
        two[long + 1] = before[ends - first > 1, 0]
        own = np.repeat(np.arange(len(first)), ends - first)
        last = np.maximum.accumulate(np.where(self.tells[ids], index, -1))
        said = np.concatenate(([-1], last[:-1]))
        tells = np.where(said >= first[own], ids[said], before[own, 2])
        after = np.stack([ids[ends - 1], one[ends - 1], np.where(last[ends - 1] >= first, ids[last[ends - 1]], before[:, 2])], axis=1)
        a, b, c = one.astype(_U), two.astype(_U), tells.astype(_U)
        return [_mixed(a * _SALT[1] + _U(11)), _mixed(a * _SALT[1] + b * _SALT[2] + _U(12)), _mixed(c * _SALT[4] + _U(13))], after

    def _fill(self, words: list[tuple[int, bytes]]) -> None:
        """An open-addressed table of words' hashes, at most a quarter full; 0 is free."""
        number = np.array([i for i, _ in words], np.int32)
        hashes = common.word_hashes(b" ".join(w for _, w in words))[0]
        self.shift = np.uint64(64 - max(4, (4 * len(words)).bit_length()))
        self.keys = np.zeros(1 << (64 - int(self.shift)), np.uint64)
        self.number = np.full(len(self.keys), self.escape, np.int32)
        left, slot = np.arange(len(words)), (hashes >> self.shift).astype(np.int64)
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.number[slot[put]] = hashes[put], number[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers; the escape for others."""
        slot = (hashes >> self.shift).astype(np.int64)
        key, out = self.keys.take(slot), self.number.take(slot)
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            key, out[open_] = self.keys.take(slot[open_]), self.number.take(slot[open_])
            open_ = open_[(key != hashes[open_]) & (key != 0)]
        return out

    def ids(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """A text's `symbols` and its end as numbers, and the escaped ones in turn."""
        hashes, start, end = common.word_hashes(text)
        if not len(hashes):
            return np.array([*map(self.marks.__getitem__, symbols(text)), self.end], np.int32), []
        ids = self.find(hashes)
        rare = [text[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist())] if len(odd := np.flatnonzero(ids == self.escape)) else []
        # white space other than single blanks between words
        gaps = np.flatnonzero((start[1:] - end[:-1] > 1) | (np.frombuffer(text, np.uint8)[end[:-1]] != 32)) + 1
        place, more = [], []
        for k in ([0] if start[0] else []) + gaps.tolist() + ([len(ids)] if end[-1] < len(text) else []):
            left, right = (b"a" if k else b""), (b"a" if k < len(ids) else b"")
            said = symbols(left + text[end[k - 1] if k else 0 : start[k] if k < len(ids) else len(text)] + right)
            marks = [self.marks[x] for x in said[len(left) : len(said) - len(right)]]
            place += [k] * len(marks)
            more += marks
        return np.insert(ids, [*place, len(ids)], [*more, self.end]).astype(np.int32), rare

    def steps(self, texts: list[np.ndarray], most: int = 0):
        """Steps over texts (their ids) in turn: (text of each piece, ids, first, contexts)."""
        most = most or STEP
        fresh, todo, size, carried = [self.nothing] * 3, [], 0, None

        def step():
            ids = np.concatenate([x for _, x in todo])
            long = np.fromiter((len(x) for _, x in todo), np.int64, len(todo))
            first = np.cumsum(long) - long
            before = np.array([fresh] * len(todo), np.int64)
            if carried is not None:
                before[0] = carried
            contexts, after = self.contexts(ids, first, before)
            return ([t for t, _ in todo], ids, first, contexts), after[-1]

        for t, ids in enumerate(texts):
            for at in range(0, len(ids), most):
                todo.append((t, ids[at : at + most]))
                size += len(todo[-1][1])
                cut_here = at + most < len(ids)
                if size >= most or cut_here:  # a text's next piece needs what this one ends with
                    out, after = step()
                    yield out
                    todo, size, carried = [], 0, after if cut_here else None
        if todo:
            yield step()[0]


def spelling(words: list[bytes], most: int = 4 * STEP):
    """Steps over words: (number of each word's piece, ids, contexts); bytes are their own leaves, 255 ends a word.
    Pieces of a long word look back four bytes; the word so far is its first 24 bytes."""
    todo, size = [], 0

    def step():
        raw = np.frombuffer(b"".join(x for _, _, x in todo), np.uint8)
        long = np.fromiter((len(x) for _, _, x in todo), np.int64, len(todo))
        skip = np.fromiter((s for _, s, _ in todo), np.int64, len(todo))
        first = np.cumsum(long) - long
        own = np.repeat(np.arange(len(todo)), long)
        place = np.arange(len(raw)) - first[own]
        b = raw.astype(_U) + _U(1)

        def before(k: int) -> np.ndarray:
            x = np.zeros(len(b), _U)
            x[k:] = b[:-k] if k < len(b) else 0
            return np.where(place >= k, x, _U(0))

        one, two, three = map(before, (1, 2, 3))
        near = one + (two << _U(9)) + (three << _U(18))
        power = _mixed(np.arange(1, 25, dtype=_U))
        sums = np.cumsum(np.where(place < 24, b * power[np.minimum(place, 23)], 0).astype(_U), dtype=_U)
        so_far = np.concatenate((np.zeros(1, _U), sums))
        so_far = so_far[:-1] - so_far[first][own]
        contexts = [_mixed(near), _mixed(so_far + _U(17)), _mixed(one + (two << _U(9)) + _U(0x60000000))]
        used = place >= skip[own]
        return [t for t, *_ in todo], own[used], raw[used].astype(np.int64), [c[used] for c in contexts]

    for t, word in enumerate(words):
        for at in range(0, len(word) + 1, PIECE):
            low = max(0, at - 4)
            piece = word[low : at + PIECE] + (b"\xff" if at + PIECE > len(word) else b"")
            todo.append((t, at - low, piece))
            size += len(piece)
            if size >= most:
                yield step()
                todo.clear()
                size = 0
    if todo:
        yield step()


def spelled(learner: Learner, words: list[bytes]) -> np.ndarray:
    """log10 probability of each word's bytes and its end."""
    out = np.zeros(len(words))
    for number, own, ids, contexts in spelling(words, 16 * STEP):
        np.add.at(out, number, np.bincount(own, learner.score(ids, contexts), len(number)))
    return out


# ------------------------------------------------------------------ training


def _added(parts: DataFrame, slots: int) -> DataFrame:
    """k, data: all rows of one k added up, counts as long; one k in one place at a time."""
    sizes = [8 * min(BLOCK, slots - b) for b in range(0, slots, BLOCK)]

    def add(batches):
        block, total = None, None
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                some = np.frombuffer(pa.decompress(data.as_buffer(), sizes[k], _PACKED), np.int32) if k >= 0 else np.frombuffer(data.as_buffer())
                if k != block and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.tobytes()], pa.binary())], ["k", "data"])
                if k != block:
                    block, total = k, np.zeros(len(some), np.int64 if k >= 0 else np.float64)
                total += some
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([total.tobytes()], pa.binary())], ["k", "data"])

    return parts.repartition("k").sortWithinPartitions("k").mapInArrow(add, "k long, data binary")


def train(rows: DataFrame, learner: Learner, steps, total: int, group: int = GROUP) -> Learner:
    """rows: data (binary), h (long, the order). steps(list of data) yields (ids, contexts). total: bytes of all texts."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((learner, steps))

    def run(batches):
        learner, steps = sent.value
        learner.fresh()
        some = False
        for _, texts in common.slices(batches, 0):
            for ids, contexts in steps(texts):
                learner.learn(ids, contexts)
                some = True
        for k, data in learner.rows(TaskContext.get().partitionId() % SALT) if some else ():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([data], pa.binary())], ["k", "data"])

    dealt = rows.repartition(max(1, math.ceil(total / group)), "h").sortWithinPartitions("h").select("data")
    got = _added(dealt.mapInArrow(run, "k long, data binary"), learner.offset[-1]).toArrow()  # at most all slots, and SALT small rows
    learner.settle(zip(got.column("k").to_pylist(), got.column("data").to_pylist()))
    sent.unpersist()
    return learner


class _WordSteps:
    def __init__(self, words: Words):
        self.words = words

    def __call__(self, texts):
        for _, ids, _, contexts in self.words.steps([np.frombuffer(t, np.int32) for t in texts]):
            yield ids, contexts


def _byte_steps(words):
    for _, _, ids, contexts in spelling(words):
        yield ids, contexts


def _sizes(events: float, most: int, kinds: int) -> list[int]:
    return [max(10, min(most.bit_length() - 1, math.ceil(math.log2(max(2, events)))))] * kinds


# ------------------------------------------------------------------ the operator


def _word_counts(plain: DataFrame) -> DataFrame:
    """w, n (in training texts), m (in all): every symbol and the end."""

    def run(batches):
        def rows(counters):
            names = list(dict.fromkeys(chain(*counters)))
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                taught, held = ([c[w] for w in some] for c in counters)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(taught, pa.int64()), pa.array([a + b for a, b in zip(taught, held)], pa.int64())], ["w", "n", "m"])

        counters = Counter(), Counter()
        for part, texts in common.slices(batches, 2):
            held = part.column(1).to_pylist()
            for i, text in enumerate(texts):
                mine = counters[held[i]]
                for piece in cut(text.lower()):
                    mine.update(symbols(piece))
                mine[END] += 1
                if len(mine) > KNOWN:
                    yield from rows(counters)
                    for c in counters:
                        c.clear()
        yield from rows(counters)

    return plain.mapInArrow(run, "w binary, n long, m long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def lm_scores(documents: DataFrame, vocabulary: int = VOCABULARY, slots: int = SLOTS, group: int = GROUP) -> DataFrame:
    """documents: doc_id, text (null: empty). Texts whose crc32(doc_id) mod 10 is 0 are held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text under the
    mixed model) and bits_per_byte (of the text and its end), one row per row. An empty text is its end alone.
    A null doc_id is not held out. Without training texts no word is known and all bits are even. An empty table gives none.
    Texts and words may be of any length; repeated rows get equal rows.
    """
    spark = documents.sparkSession
    common.ship(spark)
    df = common.pick(documents, "doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    plain = df.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    words = common.keep(_word_counts(plain), "words")
    special = F.col("w").isin(*[bytearray(w) for w in SPECIAL])
    n_words, distinct, everything, size = words.agg(
        *[F.coalesce(x, F.lit(0)) for x in (F.sum(F.when(~special, F.col("n"))), F.count(F.when(~special & (F.col("n") > 0), 1)), F.sum("n"), F.sum(F.expr("n * (length(w) + 1)")))]
    ).first()
    usual = words.where(~special & (F.col("n") > 1)).orderBy(F.desc("n"), "w").limit(vocabulary).select("w", "n").toArrow()  # `vocabulary` rows
    usual = list(zip(usual.column("w").to_pylist(), usual.column("n").to_pylist()))
    marks = {w: 0 for w in SPECIAL} | {bytes(r[0]): r[1] for r in words.where(special).select("w", "n").collect()}
    n_docs, top = marks[END], sorted([*usual, *marks.items()], key=lambda x: (-x[1], x[0]))
    total, kinds = n_words + n_docs, distinct + (n_docs > 0)
    denominator = total + 0.1 * (kinds + 1)

    # every text as numbers, once: what learns and what scores reads these
    chosen = Words(top, everything - sum(n for _, n in top))
    names = spark.sparkContext.broadcast(chosen)

    def encode(batches):
        chosen, row = names.value, TaskContext.get().partitionId() << 40
        for part, texts in common.slices(batches, 2):
            both = [chosen.ids(t.lower()) for t in texts]
            columns = [pa.array(row + np.arange(len(texts))), part.column(0), part.column(1), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array([i.tobytes() for i, _ in both], pa.binary()), pa.array([r for _, r in both], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "size", "ids", "rare"])
            row += len(texts)

    encoded = common.keep(plain.mapInArrow(encode, "row long, doc_id long, held_out boolean, size long, ids binary, rare array<binary>"), "encoded")
    learner = Learner(Tree(np.array(chosen.counts)), _sizes(everything, slots, 3))
    train(encoded.where("NOT held_out").select(F.col("ids").alias("data"), F.xxhash64("doc_id", "ids").alias("h")), learner, _WordSteps(chosen), size, group)

    # words beyond the vocabulary, with the log10 probability of each
    rare = words.where(~special & (F.col("n") < 2))
    if len(usual) == vocabulary:
        w, n = usual[-1]
        rare = words.where(~special & ((F.col("n") < n) | ((F.col("n") == n) & (F.col("w") > F.lit(bytearray(w))))))
    mass, single, letters, spoken = rare.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.count(F.when(F.col("n") == 1, 1)), F.sum(F.expr("CASE WHEN n > 0 THEN length(w) + 1 END")), F.count(F.when(F.col("n") > 0, 1)))]).first()
    seen = min(0.99, max(0.01, 1 - single / mass)) if mass else 0.0
    letter_counts = np.bincount(np.frombuffer(b"\xff".join(w for w, _ in usual) + b"\xff", np.uint8), minlength=256)  # as the vocabulary has them
    speller = Learner(Tree(letter_counts), _sizes(4 * letters, slots, 3))
    train(rare.where("n > 0").select(F.col("w").alias("data"), F.xxhash64("w").alias("h")), speller, _byte_steps, letters, group // 8)
    sent = spark.sparkContext.broadcast(speller)

    def spell(batches):
        speller = sent.value
        for part, letters in common.slices(batches, 0):
            n = part.column(1).to_numpy().astype(np.float64)
            shared = np.log10(np.maximum(seen * n / max(mass, 1), 1e-300))
            own = spelled(speller, letters) + math.log10(1 - seen)
            high, low = np.maximum(shared, own), np.minimum(shared, own)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(high + np.log10(1 + 10 ** np.maximum(low - high, -300)))], ["w", "n", "lp"])

    rare = rare.select("w", "n").mapInArrow(spell, "w binary, n long, lp double")

    base = np.log10((np.array([*chosen.counts[:-1], 0]) + 0.1) / denominator)
    is_word = np.array([w not in SPECIAL for w, _ in top] + [False], np.float64)
    base *= is_word
    chosen.keys = chosen.number = None  # the texts are numbers by now
    model = spark.sparkContext.broadcast((chosen, learner, base, is_word))
    end = float(np.log10((n_docs + 0.1) / denominator))

    def run(batches):
        chosen, learner, base, is_word = model.value
        for part, texts in common.slices(batches, 4):
            score, hot, known = (np.zeros(len(texts)) for _ in range(3))
            for number, ids, first, contexts in chosen.steps([np.frombuffer(t, np.int32) for t in texts], 4 * STEP):
                for total, each in ((score, learner.score(ids, contexts)), (hot, base.take(ids)), (known, is_word.take(ids))):
                    np.add.at(total, number, np.add.reduceat(each, first))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1, 2, 3, 5)), pa.array(known.astype(np.int64)), pa.array(hot + end), pa.array(score)], ["row", "doc_id", "held_out", "size", "n_rare", "n_hot", "hot_base", "lp"])

    schema = "row long, doc_id long, held_out boolean, size long, n_rare int, n_hot long, hot_base double, lp double"
    scored = encoded.select("row", "doc_id", "held_out", "size", "ids", F.size("rare").alias("n_rare")).mapInArrow(run, schema)
    rest = encoded.where("size(rare) > 0").select("row", F.explode("rare").alias("w")).join(rare, "w").groupBy("row").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("more"), F.sum("lp").alias("more_lp"), F.sum(F.log10((F.col("n") + 0.1) / F.lit(float(denominator)))).alias("more_base")
    )
    out = scored.join(rest, "row", "left")
    extra = lambda c: F.coalesce(c, F.lit(0))
    score = F.col("lp") + extra("more_lp")
    return out.select(
        "doc_id", "held_out", (F.col("n_hot") + F.col("n_rare") + 1).alias("n_tokens"), (F.col("n_hot") + extra("more") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("hot_base") + extra("more_base")).alias("base_score"),
        score.alias("score"), (-score / math.log10(2) / F.col("size")).alias("bits_per_byte"),
    )

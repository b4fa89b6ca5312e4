"""Ids of a byte-level BPE vocabulary with word ends, for many words at once.

The library merges one word at a time, about 20 microseconds each. Here words are looked up together, by hashes in arrays, and the
words of plain Latin text that a task has not met yet are merged together, one round of merges for all of them in
arrays; words with any other character go to the library. Both give the same ids (tested).
"""

from __future__ import annotations

import json

import numpy as np
import regex

from . import common

# The vocabulary's own splitting pattern, and the characters that the array path takes
# (in them lower-casing is character by character and composition changes nothing).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\x21-\x3b\x3d-\x7eÀ-ÿ]*+")


def _byte_characters() -> list[str]:
    """Byte-level vocabularies write a printable byte as itself, others as U+0100 and on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class WordIds:
    """Ids of stretches between white space, remembered in arrays: a table of their hashes, and where their ids lie."""

    LIMIT = 500_000  # stretches; beyond it only those that were met since the last time stay

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in _byte_characters()], np.int64)
        self.last = np.array([vocab[c + end] for c in _byte_characters()], np.int64)
        pairs = np.array([(vocab[a] << 20 | vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.merged = pairs[:, 1]
        self._index(pairs[:, 0])
        self.clear()

    def _index(self, pairs: np.ndarray) -> None:
        """An open-addressed table of pair -> rank, at most an eighth full."""
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        self.never = len(pairs)
        left, self.probes = np.arange(len(pairs)), 0
        slot = self._slot(pairs)
        while len(left):
            free = self.keys[slot[left]] < 0
            _, one = np.unique(slot[left[free]], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.ranks[slot[put]] = pairs[put], put
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, pairs: np.ndarray) -> np.ndarray:
        slot, out = self._slot(pairs), np.full(len(pairs), self.never, np.int64)
        open_ = np.arange(len(pairs))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == pairs[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found >= 0)
            if not go.any():
                break
            open_, slot = open_[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def clear(self) -> None:
        self._keep(np.zeros(0, np.int64))

    def _keep(self, some: np.ndarray) -> None:
        """Forgets all but some of the stretches."""
        n = len(some)
        if n:
            ids, size, hashes = self._gather(some), self.size[some], self.hashes[some]
        self.slots = np.zeros(1 << (4 * self.LIMIT).bit_length(), np.int32)  # number of a stretch + 1; 0 is free
        self.hashes, self.first, self.size, self.met = (np.zeros(1024, k) for k in (np.uint64, np.int64, np.int64, bool))
        self.ids, self.used, self.known = np.zeros(4096, np.uint32), 0, 0
        if n:
            self._add(hashes, ids, size)

    def _gather(self, some: np.ndarray) -> np.ndarray:
        size = self.size.take(some)
        return self.ids.take(np.arange(size.sum()) + np.repeat(self.first.take(some) - np.cumsum(size) + size, size))

    def _add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new stretches."""
        n, number = len(hashes), np.arange(self.known, self.known + len(hashes))
        for name, more in (("hashes", self.known + n), ("first", self.known + n), ("size", self.known + n), ("met", self.known + n), ("ids", self.used + len(ids))):
            if more > len(x := getattr(self, name)):
                setattr(self, name, np.concatenate([x, np.zeros(max(more - len(x), len(x)), x.dtype)]))
        self.hashes[number], self.size[number] = hashes, size
        self.first[number] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.known = self.used + len(ids), self.known + n
        if 2 * self.known > len(self.slots):
            self.slots = np.zeros(4 * len(self.slots), np.int32)
            number = np.arange(self.known)
        left, slot = number, self._place(self.hashes[number])
        while len(left):
            free = self.slots[slot] == 0
            at = np.flatnonzero(free)
            at = at[np.unique(slot[at], return_index=True)[1]]
            self.slots[slot[at]] = left[at] + 1
            stay = np.ones(len(left), bool)
            stay[at] = False
            left, slot = left[stay], (slot[stay] + 1) & (len(self.slots) - 1)
        return np.arange(self.known - n, self.known)

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of stretches, -1 of unknown ones."""
        slot = self._place(hashes)
        out = self.slots.take(slot).astype(np.int64) - 1
        open_ = np.flatnonzero((out >= 0) & (self.hashes.take(out) != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            out[open_] = self.slots.take(slot[open_]).astype(np.int64) - 1
            open_ = open_[(out[open_] >= 0) & (self.hashes.take(out[open_]) != hashes[open_])]
        return out

    def of(self, texts: list[bytes]):
        """The ids of each text, little-endian unsigned 32-bit."""
        if self.known > self.LIMIT:
            self._keep(np.flatnonzero(self.met[: self.known]))
        split = [common.word_hashes(t) for t in texts]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _, _ in split)])
        ends = np.cumsum([len(h) for h, _, _ in split])
        number = self._find(hashes)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, one, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            places = unknown[one]
            start, end = (np.concatenate([x[k] for x in split]).take(places).tolist() for k in (1, 2))
            ids = self.learn([texts[t][a:b] for t, a, b in zip(np.searchsorted(ends, places, side="right").tolist(), start, end)])
            number[unknown] = self._add(new, np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) >> 2)[back]
        self.met[number] = True
        ids = self._gather(number)
        cut = np.concatenate(([0], np.cumsum(self.size.take(number))))[np.concatenate(([0], ends)).astype(np.int64)].tolist()
        for a, b in zip(cut[:-1], cut[1:]):
            yield ids[a:b].tobytes()

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of the words."""
        said = b"\n".join(words).decode("utf-8", "replace").split("\n")
        plain, find = PLAIN.fullmatch, SPLIT.findall
        odd, parts, text = [], {}, []
        for t, alpha in zip(said, map(str.isalpha, said)):
            if alpha and (t.isascii() or plain(t)):
                text.append(t.lower())
            elif t[-1] in ".," and t[:-1].isalpha() and (t.isascii() or plain(t)):
                text.append((t[:-1].lower(), t[-1]))
            elif plain(t):
                text.append(find(t.lower()))
            else:
                text.append(None)
                odd.append(t)
        self._merge({q for p in text if p is not None for q in ((p,) if type(p) is str else p)}, parts)
        library = iter(self.library.encode_batch(odd, add_special_tokens=False))
        get = parts.__getitem__
        return [get(p) if type(p) is str else np.array(next(library).ids, "<u4").tobytes() if p is None else b"".join(map(get, p)) for p in text]

    def _merge(self, todo: set[str], parts: dict[str, bytes]) -> None:
        todo = list(todo)
        for at in range(0, len(todo), 40_000):
            some = todo[at : at + 40_000]
            parts.update(zip(some, self._merged([p.encode() for p in some])))

    def _merged(self, words: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym, own = self.inner[raw], np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        done_sym, done_own, never = [], [], self.never
        while len(sym):
            rank = np.append(np.where(own[:-1] == own[1:], self._rank((sym[:-1] << 20) | sym[1:]), never), never)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(rank, first)
            least = np.repeat(least, np.diff(np.append(first, len(sym))))
            over = least == never
            done_sym.append(sym[over])
            done_own.append(own[over])
            hit = np.flatnonzero((rank == least) & ~over)
            if not len(hit):
                break
            # of overlapping places (a pair of equal symbols) every other one, from the left
            run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[offset % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            stay = ~over
            stay[hit + 1] = False
            sym, own = sym[stay], own[stay]
        sym, own = np.concatenate(done_sym), np.concatenate(done_own)
        sym = sym[np.argsort(own, kind="stable")].astype("<u4").tobytes()
        cut = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(words))))) * 4
        return [sym[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

"""Best-fit packing (10): best-fit decreasing with a segment tree over remaining capacities.

The tree's leaves are the capacities 0..size and hold how many open bins have just that much
room; the tightest bin for a document is the first leaf at or above its length, found in
logarithmic time. Documents of one length are interchangeable, so the driver plans over the
histogram of lengths (at most `size` rows, whatever the corpus) and plans exactly what
document-by-document best-fit decreasing would do: items of one length fill the tightest bin
while it still takes them, then the next. The plan is a table of runs: ranks [lo, ...) of a length
go to consecutive bins, q to a bin, from a given offset. The cluster only numbers the pieces of
each length, in salted groups, and looks its rank up in the plan.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import WordIds

SIZE = 2048
SALTS = 512  # groups that a length is split into for numbering
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------ planning


class CapacityTree:
    """A segment tree over capacities 0..size with the number of open bins at each."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.sums = [0] * (2 * self.width)

    def add(self, capacity: int, count: int) -> None:
        at = capacity + self.width
        while at:
            self.sums[at] += count
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity >= length at which a bin is open."""
        at = length + self.width
        if self.sums[at]:
            return length
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, items in a bin, first offset) of best-fit decreasing."""
    tree, open_bins = CapacityTree(size), [deque() for _ in range(size + 1)]  # capacity: ranges (first bin, count)
    runs, bins = [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            open_bins[capacity].append((first, count))
            tree.add(capacity, count)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                q = size // length
                full, rest = divmod(left, q)
                runs.append((length, rank, bins, q, 0))
                put(size - q * length, bins, full)
                put(size - rest * length, bins + full, 1 if rest else 0)
                bins += full + (rest > 0)
                break
            first, count = open_bins[room].popleft()
            tree.add(room, -count)
            q = room // length
            used = min(count, left // q)
            runs.append((length, rank, first, q, size - room))
            put(room - q * length, first, used)
            rank, left = rank + used * q, left - used * q
            if used < count:
                rest = left  # fewer than q items for one more bin
                put(room - rest * length, first + used, 1 if rest else 0)
                kept = used + (rest > 0)
                if kept < count:
                    open_bins[room].appendleft((first + kept, count - kept))
                    tree.add(room, count - kept)
                left = 0
    return runs


def sequences(histogram: dict[int, int], size: int = SIZE) -> int:
    """How many bins the plan opens."""
    last = 0
    for length, lo, first, q, offset in (runs := plan(histogram, size)):
        if not offset:
            items = histogram[length] - lo
            last = max(last, first + -(-items // q))
    return last if runs else 0


# ------------------------------------------------------------------ tokens


_IDS: dict[str, WordIds] = {}
_BYTES_AT_ONCE = 4_000_000


def token_bytes(texts: list[bytes], path: str):
    """Little-endian ids of each text, closed by id 0. The vocabulary never joins across white
    space, so a text's ids are those of its stretches in turn."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    for raw in _IDS[path].of(texts):
        yield raw + b"\0\0\0\0"


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """documents: doc_id, text (null: empty). Ids of each text and a closing 0, cut into pieces of
    `size` where longer. Returns PIECES."""
    path = path or vocabulary_path()

    def cut(batches):
        for batch, texts in common.slices(batches, 1, _BYTES_AT_ONCE):
            out = [[], [], [], [], []]
            for doc, raw in zip(batch.column(0).to_pylist(), token_bytes(texts, path)):
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    common.ship(documents.sparkSession)
    return common.pick(documents, "doc_id", "text").mapInArrow(cut, PIECES)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id, offset to a table of pieces that has `length` (1..size) and, to order
    equal lengths, doc_id, piece and ids_crc32.

    Ties of a length are numbered by salt and then doc_id, piece and ids_crc32; rows that agree in
    all of these are alike, so whichever comes first gives the same table. Null doc_ids come
    first. An empty table gives an empty table.
    """
    spark = cut.sparkSession
    cut = common.keep(cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))), "pieces")
    counts = cut.groupBy("length", "_salt").count()
    start = counts.select("length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `size` rows
    runs = plan(histogram, size)
    table = np.array(runs, np.int64).reshape(-1, 5)
    shift = np.int64(1) << np.int64(48)
    keys = table[:, 0] * shift + table[:, 1]
    order = np.argsort(keys)
    keys, table = keys[order], table[order]
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(start, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    names = [f for f in cut.schema if f.name != "_salt"]
    where = ranked.columns.index("length"), ranked.columns.index("_rank")
    kept, titles = [ranked.columns.index(f.name) for f in names], [f.name for f in names] + ["sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in where)
            run = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            item = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(run[:, 2] + item // run[:, 3]), pa.array(run[:, 4] + item % run[:, 3] * length)],
                titles,
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def best_fit_packing(documents: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens. Null and empty texts are the
    closing id alone. Returns PIECES and sequence_id, offset; one row per piece."""
    return pack(pieces(documents, size, path), size)

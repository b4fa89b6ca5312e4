"""Quality classifier (3): a factorisation machine over hashed words, structure and metadata.

score = sigmoid(bias + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), the pairwise
interactions by the sum-of-squares identity, so linear in a text's features. Features: words hashed to
WORDS_DIM places (log counts, unit length), structure statistics of the text in buckets (each place 1),
and any named metadata columns hashed as name=value.

Learnt on the driver from a bounded sample of labelled rows (SAMPLE rows, ENTRIES features, the least by a hash of the id);
the scored features never hold labels, ids, language or source unless a caller names such a column as
metadata. The model has a fixed size, so it is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import common

WORDS_DIM, META_DIM, FACTORS = 1 << 17, 1 << 12, 8
SAMPLE, ENTRIES = 12_000, 12_000_000  # labelled rows learnt from, and features in them (about 20 bytes each), at most
EPOCHS, BATCH, RATE, SHRINK = 15, 256, 0.1, 1e-6
BUCKETS = 12
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOLS, _STOPS = b"#*$%&|<>~^=+_@\\/{}[]", b".,;:!?"


STATISTICS = ("size", "upper", "lower", "digits", "symbols", "stops", "bangs", "word_length", "distinct", "doubled", "lines", "repeated_lines")
DIM = WORDS_DIM + len(STATISTICS) * BUCKETS + META_DIM


def statistics(raw: bytes, words: list[bytes]) -> list[int]:
    """A bucket 0..BUCKETS-1 for each of STATISTICS."""
    size, n = len(raw), len(words)

    def share(part: float, whole: float) -> int:  # finer near 0
        return min(BUCKETS - 1, int((part / whole) ** 0.5 * BUCKETS)) if whole else 0

    def without(drop: bytes) -> int:
        return size - len(raw.translate(None, drop))

    lines = [x for x in raw.split(b"\n") if x.strip()]
    doubled = sum(x == y for x, y in zip(words, words[1:]))
    return [
        min(BUCKETS - 1, n.bit_length()), share(without(_UPPER), size), share(without(_LOWER), size), share(without(_DIGIT), size),
        share(without(_SYMBOLS), size), share(without(_STOPS), size), share(raw.count(b"!"), size), min(BUCKETS - 1, int((size - n) / n)) if n else 0,
        share(len(set(words)), n), share(doubled, n), min(BUCKETS - 1, len(lines).bit_length()), share(len(lines) - len(set(lines)), len(lines)),
    ]


def features(texts: list[bytes], metadata: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (starts, places, values)."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate([*(common.word_hashes(t)[0] for t in texts), np.zeros(0, np.uint64)]) % np.uint64(WORDS_DIM)
    flat = flat.astype(np.int64)
    keys, times = np.unique(np.repeat(np.arange(len(words)), counts) * WORDS_DIM + flat, return_counts=True)
    row, place, value = keys // WORDS_DIM, keys % WORDS_DIM, np.log1p(times)
    value /= np.sqrt(np.maximum(np.bincount(row, value * value, len(words)), 1e-9))[row]
    extra = np.array([statistics(t, w) for t, w in zip(texts, words)], np.int64).reshape(len(texts), len(STATISTICS))
    extra += WORDS_DIM + np.arange(len(STATISTICS)) * BUCKETS
    if metadata:
        base = WORDS_DIM + len(STATISTICS) * BUCKETS
        meta = np.array([[base + xxhash.xxh64_intdigest(m) % META_DIM for m in ms] for ms in zip(*metadata)], np.int64)
        extra = np.concatenate([extra, meta.reshape(len(texts), len(metadata))], axis=1)
    row = np.concatenate([row, np.repeat(np.arange(len(texts)), extra.shape[1])])
    order = np.argsort(row, kind="stable")
    place = np.concatenate([place, extra.ravel()])[order]
    value = np.concatenate([value, np.full(extra.size, 0.5)])[order]
    return np.searchsorted(row[order], np.arange(len(texts))), place, value


class Machine:
    """bias, w (DIM), v (DIM x FACTORS)."""

    def __init__(self, seed: int = 5):
        self.bias, self.w = 0.0, np.zeros(DIM, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (DIM, FACTORS)).astype(np.float32)

    def _parts(self, starts, place, value):
        vx = self.v[place] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        out = self.bias + np.add.reduceat(self.w[place] * value, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
        return out, vx, sums

    def score(self, starts, place, value) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._parts(starts, place, value)[0], -40, 40)))

    def fit(self, starts, place, value, y, epochs=EPOCHS, batch=BATCH, rate=RATE, shrink=SHRINK, seed=5) -> "Machine":
        """Adagrad on the logistic loss; y in 0, 1. No rows: the machine stays as it is."""
        n = len(starts)
        if not n:
            return self
        ends, rng = np.append(starts[1:], len(place)), np.random.default_rng(seed)
        share = min(max(y.mean(), 0.01), 0.99)
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(DIM, 1e-6, np.float32), np.full((DIM, FACTORS), 1e-6, np.float32), 1e-6
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(n), max(1, n // batch)):
                long = ends[some] - starts[some]
                at = np.concatenate(([0], np.cumsum(long)[:-1]))
                here = np.arange(long.sum()) + np.repeat(starts[some] - at, long)
                p, x = place[here], value[here]
                out, vx, sums = self._parts(at, p, x)
                error = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[some]) / len(some)
                each = np.repeat(error, long) * x
                used, back = np.unique(p, return_inverse=True)
                d = np.bincount(back, each, len(used)) + shrink * self.w[used]
                gw[used] += d * d
                self.w[used] -= rate * d / np.sqrt(gw[used])
                part = each[:, None] * (np.repeat(sums, long, axis=0) - vx)
                d = np.stack([np.bincount(back, part[:, f], len(used)) for f in range(FACTORS)], axis=1) + shrink * self.v[used]
                gv[used] += d * d
                self.v[used] -= 0.2 * rate * d / np.sqrt(gv[used])
                gb += float(error.sum()) ** 2
                self.bias -= rate * float(error.sum()) / gb**0.5
        return self


def _inputs(documents: DataFrame, metadata: list[str]) -> DataFrame:
    """Numbers count by their size: half steps of the logarithm to base 2, with their sign."""
    plain = common.pick(documents, "doc_id", "text", *metadata)
    plain = plain.toDF("doc_id", "text", *[f"m{i}" for i in range(len(metadata))])

    def value(name: str):
        if isinstance(plain.schema[name].dataType, NumericType):
            return F.expr(f"coalesce(concat(cast(signum({name}) AS int), '~', cast(floor(2 * log2(1 + abs(cast({name} AS double)))) AS bigint)), '')")
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return plain.select("doc_id", "text", *[value(f"m{i}").alias(f"m{i}") for i in range(len(metadata))])


def _named(batch, first: int, metadata: list[str]) -> list[list[str]]:
    return [[f"{m}={x}" for x in batch.column(first + i).to_pylist()] for i, m in enumerate(metadata)]


def fit(documents: DataFrame, labels: DataFrame, metadata: list[str] = (), sample: int = SAMPLE, entries: int = ENTRIES) -> Machine:
    """labels: doc_id, label (0 or 1; rows with anything else are left out; a repeated doc_id counts once,
    with its greatest label). Rows are taken in the order of a hash of the id, up to `sample` rows with `entries` features."""
    labels = common.pick(labels, "doc_id", "label").where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most
    rows = _inputs(documents, metadata).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    metadata, names = list(metadata), rows.columns

    def run(batches):
        for batch, texts in common.slices(batches, names.index("text")):
            starts, place, value = features(texts, _named(batch, names.index("m0") if metadata else 0, metadata))
            at = pa.array(np.append(starts, len(place)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("doc_id")), batch.column(names.index("label")).cast(pa.int32()), pa.ListArray.from_arrays(at, pa.array(place, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))],
                ["doc_id", "label", "place", "value"],
            )

    table = common.keep(rows.mapInArrow(run, "doc_id long, label int, place array<int>, value array<float>"), "features")
    size = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over `sample` rows
    some = table.select("doc_id", F.xxhash64("doc_id").alias("h"), F.size("place").alias("n")).withColumn("so_far", F.sum("n").over(size)).where(F.col("so_far") <= entries)
    got = table.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").toArrow().sort_by("doc_id").combine_chunks()
    common.drop(table)
    if not got.num_rows:
        return Machine()
    place = got.column("place").combine_chunks() if hasattr(got.column("place"), "combine_chunks") else got.column("place")
    value = got.column("value").combine_chunks() if hasattr(got.column("value"), "combine_chunks") else got.column("value")
    place, value = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (place, value))
    starts = place.offsets.to_numpy()[:-1].astype(np.int64)
    return Machine().fit(starts - starts[0], place.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), got.column("label").to_numpy().astype(np.float64))


def score(documents: DataFrame, machine: Machine, metadata: list[str] = ()) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5), one row per row;
    null and empty texts are scored by their structure and the bias."""
    metadata = list(metadata)
    common.ship(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch, texts in common.slices(batches, 1):
            p, meta = [], _named(batch, 2, metadata)
            for at in range(0, len(texts), 256):
                p.append(model.value.score(*features(texts[at : at + 256], [m[at : at + 256] for m in meta])))
            p = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _inputs(documents, metadata).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out():
    """True for the third of documents that is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def quality(documents: DataFrame, labels: DataFrame, metadata: list[str] = (), sample: int = SAMPLE) -> DataFrame:
    """labels: doc_id, quality. Learns from labelled rows that aren't held out and scores all documents.
    Returns doc_id, held_out, score, predicted. Without labels every score is near 0.5."""
    known = common.pick(labels, "doc_id", "quality").withColumnRenamed("quality", "label").where(~held_out())
    common.ship(documents.sparkSession)
    machine = fit(documents, known, metadata, sample)
    return score(documents, machine, metadata).select("doc_id", held_out().alias("held_out"), "score", "predicted")

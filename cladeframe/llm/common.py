"""Shared parts: column choice, joins that bear hot keys, word hashing, links within buckets."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.graph import components
from cladeframe.session import drop, keep, ship  # noqa: F401

SHINGLE = 5  # words in a shingle
SIMILAR = 0.8  # least similarity of near duplicates


# ------------------------------------------------------------------ frames


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only. An exact name wins over one that differs in case; the first of
    several equal names is taken. Columns of other names can't clash with later ones."""
    return plain(df).select(*[F.col(f"_in{place(df, n)}").alias(n) for n in names])


def plain(df: DataFrame) -> DataFrame:
    """All columns by place, _in0, _in1, ..: names that can't clash."""
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> int:
    """Where the column that `pick` takes is."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return found[0]


def decided(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of df whose doc_id is among ids (left_semi) or isn't (left_anti); a null doc_id is among none."""
    rows, ids = plain(df), pick(ids, "doc_id").distinct().toDF("_id")
    return rows.join(ids, F.col(f"_in{place(df, 'doc_id')}") == F.col("_id"), how).toDF(*df.columns)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


HOT_KEYS = 20_000
MEETINGS, PART = 4, 16  # drawn ids that each id of a token meets at first, and how many share one


def join_hot(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """rows (a kept table) joined to counted (one too): a row for each key of `on`, with n, how many rows have the key.

    Keys that more than one in HOT_KEYS of all matches have, so HOT_KEYS at most, are broadcast; the rows of others are
    shuffled. A key that a third of all rows have never meets in one task.
    """
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > max(1000, total // HOT_KEYS)
    hot = counted.where(is_hot)
    if not hot.limit(1).count():
        return rows.join(counted.drop("n"), on)
    few = F.broadcast(hot.drop("n"))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counted.where(~is_hot).drop("n"), on)
    return rows.join(few, on).unionByName(cold)


# ------------------------------------------------------------------ words

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """What a worker remembers of words (bytes). It is emptied when it holds about LIMIT bytes, and when another operator's
    task begins in the same worker: one memo at most takes room there."""

    LIMIT, ENTRY = 40_000_000, 160  # bytes; of an entry besides its word and value
    _in_use: Memo | None = None

    def __init__(self):
        super().__init__()
        self.held = 0

    def begin(self):
        """To be called where a task begins."""
        if Memo._in_use is not None and Memo._in_use is not self:
            Memo._in_use.clear()
        Memo._in_use = self
        return self

    def full(self) -> bool:
        return self.held > self.LIMIT

    def clear(self) -> None:
        super().clear()
        self.held = 0


_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
_SEGMENT = 1 << 18  # bytes hashed in one go; a word of as many is hashed by the library, wherever it stands
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"'()[]{}<>*#$%&|-_")] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(_SEGMENT + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(raw: bytes, stripped: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, first bytes and ends (exclusive) of a text's words (what ASCII white space separates), without any loop over words: sums of
    bytes times powers, of which a word's own are a difference. stripped: without marks at a word's ends, unless all are."""
    hashes, places, ends, at = [], [], [], 0
    while at < len(raw):
        to = len(raw)
        if to - at >= _SEGMENT:
            window = np.flatnonzero(_WHITE[np.frombuffer(raw, np.uint8, _SEGMENT, at)])
            if not len(window):  # one long word
                to = at + _SEGMENT
                while to < len(raw) and not _WHITE[raw[to]]:
                    to += 1
                hashes.append(np.array([xxhash.xxh64_intdigest((raw[at:to].strip(bytes(np.flatnonzero(_MARKS).tolist())) if stripped else b"") or raw[at:to])], np.uint64))
                places.append(np.array([at]))
                ends.append(np.array([to]))
                at = to
                continue
            to = at + int(window[-1]) + 1
        b = np.frombuffer(raw, np.uint8, to - at, at)
        white = np.ones(len(b) + 2, bool)
        white[1:-1] = _WHITE[b]
        edges = np.flatnonzero(white[1:] != white[:-1])
        start, end = edges[::2], edges[1::2]
        places.append(start + at)
        ends.append(end + at)
        if stripped:
            index, mark = np.arange(len(b)), _MARKS[b]
            first = np.minimum.accumulate(np.where(mark, len(b), index)[::-1])[::-1][start]
            last = np.maximum.accumulate(np.where(mark, -1, index))[end - 1] + 1
            some = first < last
            start, end = np.where(some & (first < end), first, start), np.where(some & (last > start), last, end)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(b)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * _INVERSES[start]))
        at = to
    none = np.zeros(0, np.int64)
    return np.concatenate([*hashes, none.view(np.uint64)]), np.concatenate([*places, none]), np.concatenate([*ends, none])


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """One hash per run of k words; a shorter text that has words is one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out *= _STEP
        out += words[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Makes equal hashes of one text distinct by their occurrence number."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return hashes
    start = np.concatenate(([0], np.flatnonzero(~same) + 1))
    number = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    out = hashes.copy()
    again = number > 0
    out[order[again]] = mix(s[again] + number[again].astype(np.uint64) * _STEP)
    return out


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches, column: int, most: int = 2_000_000):
    """(slice of a batch, its texts as UTF-8): rows whose texts take about `most` bytes; a longer text is alone."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            part = batch.slice(at, to - at)
            yield part, as_bytes(part.column(column))
            at = to
    release()


def release() -> None:
    """Where a task ends: gives unused memory back, since workers stay for other tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ------------------------------------------------------------------ buckets


def buckets(keyed: DataFrame) -> DataFrame:
    """key, id, pivot (the bucket's least id) of all buckets of several ids. keyed: key, id long, repeats allowed."""
    shared = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot <> other").drop("other")
    return keep(keyed.join(shared, "key").select("key", "id", "pivot").distinct(), "buckets")


def links_in_buckets(buckets: DataFrame, verify, tokens, least: float = SIMILAR) -> DataFrame:
    """All verified links between ids that share a bucket, up to connection.

    buckets: key, id, pivot, as `buckets` makes it. verify(pairs a, b) returns the pairs that hold, a and b first; a pair that
    holds has a Jaccard similarity of its token sets of at least `least`. tokens(ids) returns id, v: distinct tokens (array
    of long).

    Members of a bucket are paired with its least id, as many pairs as members. Where the components
    found so hold together all of a bucket, its other pairs can't change them. Members of other buckets are joined
    more, across components, by the tokens of their prefixes: in the order of rarity a pair this similar shares one
    among the first (1 - least) n + 1 tokens of each, at places that leave enough to share. In a large group of
    copies of one text the rare tokens are each copy's own edits, so copies too far from each other don't meet. First
    the ids of a token meet its most central id and a few drawn ones only, again as many pairs as ids; what then still is apart meets
    pair by pair. No link between components is lost and no bucket is expanded into all its pairs.
    """
    first = keep(buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = keep(verify(first).select("a", "b"), "links")
    label = components(links)
    member = keep(buckets.join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "labelled")
    drop(label)
    mixed = member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_ = keep(member.join(mixed, "key", "left_semi").select("id", "label").distinct(), "open")
    drop(member)
    if not open_.limit(1).count():
        drop(first, open_)
        return links
    sets = keep(tokens(open_.select("id")).join(open_, "id").select("id", "label", "v"), "tokens")
    flat = sets.select("id", "label", F.size("v").alias("n"), F.explode("v").alias("t"))
    count = flat.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")  # a token of one id can't be shared; it still takes a place
    ranked = flat.join(count, "t", "left").groupBy("id", "label", "n").agg(F.array_sort(F.collect_list(F.expr("CASE WHEN c IS NOT NULL THEN struct(c, t) END"))).alias("s"))
    lone = F.expr("n - size(s)")
    prefix = F.expr(f"greatest(0, n - cast(ceil({least}D * n - 1e-9) AS int) + 1 - (n - size(s)))")
    ranked = ranked.withColumn("lone", lone).select("id", "label", "n", "lone", F.posexplode(F.slice("s", F.lit(1), prefix)).alias("i", "x"))
    ranked = keep(ranked.select("id", "label", "n", "lone", F.col("x.t").alias("t"), F.expr("lone + i + 1").alias("p")), "prefixes")
    enough = lambda xn, xp, yn, yp: f"1 + least({xn} - {xp}, {yn} - {yp}) >= {least}D / (1 + {least}D) * ({xn} + {yn}) - 1e-9"
    # the ids of a token meet its most central one, the one with the fewest tokens of its own, and some drawn from small parts of them: as many
    # pairs as ids each time, and what they link need not meet pair by pair
    met, drawn = first, [first]
    for tries in (MEETINGS, 2 * MEETINGS):
        size = ranked.groupBy("t").agg(F.count("*").alias("many"))
        rows = ranked.join(size, "t").select("*", F.explode(F.sequence(F.lit(0), F.lit(tries))).alias("j"))
        rows = rows.withColumn("part", F.expr(f"CASE WHEN j = 0 THEN 0 ELSE pmod(xxhash64(id, j, {tries}), greatest(1, many div {PART})) END"))
        centre = rows.groupBy("t", "j", "part").agg(F.expr(f"min_by(struct(id, label, n, p), CASE WHEN j = 0 THEN struct(CAST(lone AS BIGINT) AS x, id AS y) ELSE struct(0L AS x, xxhash64(id, j, {tries + 1}) AS y) END)").alias("c"))
        pair = rows.join(centre, ["t", "j", "part"]).where(f"label <> c.label AND {enough('n', 'p', 'c.n', 'c.p')}").select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()
        pair = keep(pair.join(met, ["a", "b"], "left_anti"), "centres")
        drawn.append(pair)
        met = met.unionByName(pair)
        found = keep(verify(pair).select("a", "b"), "links")
        if not found.limit(1).count():
            break
        links = links.unionByName(found)
        label = components(links)
        again = keep(ranked.join(label.toDF("id", "now"), "id", "left").withColumn("label", F.coalesce("now", "label")).drop("now"), "prefixes")
        drop(ranked, label)
        ranked = again
    main = ranked.groupBy("t", "label").agg(F.count("*").alias("c")).groupBy("t").agg(F.expr("max_by(label, struct(c, label))").alias("main"), F.count("*").alias("k")).where("k > 1")
    here = keep(ranked.join(main.select("t", "main"), "t"), "meeting")
    x = here.where("label <> main").select("t", F.col("id").alias("xi"), F.col("label").alias("xl"), F.col("n").alias("xn"), F.col("p").alias("xp"))
    y = here.select("t", F.col("id").alias("yi"), F.col("label").alias("yl"), F.col("n").alias("yn"), F.col("p").alias("yp"), "main")
    rest = x.join(y, "t").where(f"xl <> yl AND (yl = main OR xi < yi) AND {enough('xn', 'xp', 'yn', 'yp')}").select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b")).distinct()
    rest = keep(rest.join(met, ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(keep(verify(rest).select("a", "b"), "links"))
    drop(open_, sets, ranked, here, rest, *drawn)
    return links

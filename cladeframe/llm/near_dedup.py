"""MinHash near-dedup (4) by order MinHash.

A text is the sequence of its five-word shingles, each labelled with its occurrence number (so all
are distinct). For each of BANDS hash functions the TUPLE shingles of least hash are taken and
kept in text order; the tuple is the band's key. Two texts agree in a band only if they share those
shingles in the same order, which follows edit similarity.

Similarity, verified for every candidate: M / (n1 + n2 - M), M being the most shingles that an
alignment can match in order, within the band of diagonals that a similarity of 0.8 allows. For
texts in the same order this is their Jaccard similarity. Labelled shingles are distinct, so the
alignment is a longest increasing subsequence of matched places: n log n, no table.

Scale. Identical word sequences become one class first (partial aggregation on a 128-bit digest), so
copies cost one row each. Members of a bucket are compared with the bucket's least id: as many
pairs as members. Where that leaves several components in one bucket, an exact prefix join between
components follows (`common.links_in_buckets`), so that no link is lost. Python sees pairs in a stream sorted
by pivot and holds one pivot at a time.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BANDS, TUPLE = 20, 3  # a pair at 0.8 is missed by all bands with probability (1 - 0.8^3)^20 < 1e-6
_AT_ONCE = 2_000_000  # hash values held at once
SALT = 64  # groups that the pairs of one pivot are dealt to


def order_minhash(shingles: np.ndarray, bands: int = BANDS, take: int = TUPLE, seed: int = 7) -> np.ndarray:
    """One 64-bit key a band of a text's labelled shingles (at least one)."""
    seeds = common.mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(seed * 2 + 1))
    odd = common.mix(seeds) | np.uint64(1)
    take = min(take, len(shingles))
    keys = seeds.copy()
    step = max(1, _AT_ONCE // len(shingles))
    for at in range(0, bands, step):
        rows = slice(at, at + step)
        if take == len(shingles):
            chosen = np.broadcast_to(shingles, (len(keys[rows]), take))
        else:
            ranks = (shingles[None, :] ^ seeds[rows, None]) * odd[rows, None]
            place = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)
            chosen = shingles[place]
        for c in range(take):
            keys[rows] = common.mix(keys[rows] * common._STEP + chosen[:, c])
    return keys


def similarity(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Aligned similarity of two sequences of distinct shingles; 0 where it is below `least`."""
    if not len(a) or not len(b):
        return 0.0
    total = len(a) + len(b)
    need = least / (1 + least) * total
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(ia - ib) <= total - 2 * need + 1e-9  # the diagonals of an alignment good enough
    ia, ib = ia[near], ib[near]
    if len(ib) < need - 1e-9:
        return 0.0
    ib = ib[np.argsort(ia)]
    if (np.diff(ib) > 0).all():
        matched = len(ib)
    else:
        tails: list[int] = []
        for x in ib.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        matched = len(tails)
    value = matched / (total - matched)
    return value if value >= least - 1e-12 else 0.0


def _shingles(raw: bytes) -> np.ndarray:
    return common.labelled(common.shingle_hashes(common.word_hashes(raw)[0]))


def sketch(documents: DataFrame, bands: int = BANDS, take: int = TUPLE) -> DataFrame:
    """doc_id, digest (binary, null without words), keys (array of long) of each document."""

    def run(batches):
        for batch, texts in common.slices(batches, 1):
            digests, keys = [], []
            for raw in texts:
                words = common.word_hashes(raw)[0]
                if not len(words):
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(words.tobytes()))
                keys.append(order_minhash(common.labelled(common.shingle_hashes(words)), bands, take).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "keys"])

    common.ship(documents.sparkSession)
    return common.pick(documents, "doc_id", "text").mapInArrow(run, "doc_id long, digest binary, keys array<long>")


def shingle_arrays(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """id, v: the labelled shingles, in text order, of the named documents (doc_id, text)."""

    def cut(batches):
        for batch, texts in common.slices(batches, 1):
            arrays = [_shingles(raw).view(np.int64) for raw in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.list_(pa.int64()))], ["id", "v"])

    # never broadcast: the ids grow with the documents
    named = documents.select(F.col("doc_id").alias("id"), "text").join(ids.select("id").hint("merge"), "id", "left_semi")
    return named.dropDuplicates(["id"]).mapInArrow(cut, "id long, v array<long>")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs: a, b long (ids; a the pivot); texts: `shingle_arrays` of all of them. Returns a, b, similarity >= least."""
    pairs = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALT)))
    pivots = pairs.select("a", "s").distinct().join(texts, F.col("a") == F.col("id")).select("a", "s", F.lit(0).alias("t"), F.col("a").alias("b"), "v")
    others = pairs.join(texts, F.col("b") == F.col("id")).select("a", "s", F.lit(1).alias("t"), "b", "v")

    def compare(batches):
        pivot, own = None, None
        for batch in batches:
            a, t, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            v, at = batch.column(4).flatten().to_numpy(zero_copy_only=False), batch.column(4).offsets.to_numpy()
            at = at - at[0]
            found = [[], [], []]
            for i in range(len(a)):
                x = v[at[i] : at[i + 1]]
                if t[i] == 0:
                    pivot, own = a[i], x.copy()
                else:
                    assert pivot == a[i]
                    if value := similarity(own, x, least):
                        for column, y in zip(found, (a[i], b[i], value)):
                            column.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])
        common.release()

    return pivots.unionByName(others).repartition("a", "s").sortWithinPartitions("a", "s", "t").mapInArrow(compare, "a long, b long, similarity double")


def near_duplicates(documents: DataFrame, least: float = common.SIMILAR, bands: int = BANDS, take: int = TUPLE) -> DataFrame:
    """documents: doc_id long, text.

    Returns one row per row of documents: doc_id, class_id (the least doc_id of its class of near
    duplicates), n_links (links of its text to other texts, as found), copies (documents with the same
    words), kept (it is the one that stays). Same words are the same text, whatever the white space.
    A text without words (null, empty) is a class of its own. Rows of one doc_id and one text get
    equal rows. A row without doc_id can't be named: class_id null, kept. An empty table gives none.
    """
    documents = common.pick(documents, "doc_id", "text")
    table = common.keep(sketch(documents, bands, take), "sketch")
    classes = common.keep(
        table.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")),
        "classes",
    )
    one = classes.select("digest", F.col("rep").alias("doc_id"))  # with the id in the key, a text's copies don't meet
    keyed = table.join(one, ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    keyed = common.keep(keyed, "bands")
    buckets = common.buckets(keyed)
    texts = common.keep(shingle_arrays(documents, buckets.select("id").distinct()), "shingles")  # read once, of all that any step compares
    links = common.links_in_buckets(buckets, lambda pairs: verify(pairs, texts, least), lambda some: texts.join(some, "id", "left_semi"), least)
    label = common.components(links)
    common.drop(keyed, buckets, texts)
    count = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    known = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").join(count, "rep", "left")
    known = known.select("digest", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies", F.col("copies").alias("n"))
    known = common.keep(known, "known")
    named = "digest IS NOT NULL AND doc_id IS NOT NULL"
    rows = table.select("doc_id", "digest")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("class_id", "n_links", "copies")]
    out = common.join_hot(rows.where(named), known, ["digest"]).unionByName(rows.where(f"NOT ({named})").select("digest", "doc_id", *nothing))
    class_id = F.coalesce("class_id", "doc_id")
    return out.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), class_id).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == class_id)).alias("kept"),
    )

"""Substring dedup (5) by paragraph MinHash banding.

A passage is a stretch of at least `least_words` words. Two kinds stand in several documents:

* near copies: paragraphs (lines) of at least `least_words` words. Each has bands of minima of hashed five-word shingles; `tune` picks
  them so that a pair at the wanted similarity collides with probability `recall` or more. Colliding paragraphs are verified by the
  exact Jaccard similarity of their shingle sets, and paragraphs cluster by connected components.
* exact copies of any stretch, also within lines or across them. Runs of SEED words that have the least hash among those that start in
  a reach of words are its seeds; the reach is such that any passage holds a seed, chosen by the passage alone. Seeds
  that other documents have too are chained along the diagonal (place here less place in the first document that has it) while all words between
  them are the same, and each chain is extended word by word to both sides while the two documents agree. Windows of `least_words` words that
  hold a seed but go beyond what the first document shares there, or hold one that it has in several places, meet those of all documents by
  a hash of all their words (`_whole`): so no window that two documents have is left out. Stretches of a first document that
  overlap are one passage: intervals on a line, so components need no rounds.

Scale. A seed is 20 bytes and one word in ten has one; equal seeds meet in one aggregation that keeps numbers only. Frequent
seeds, paragraphs and places are joined by broadcast, the others by shuffle (`common.join_hot`), so no key gathers in a task, and no
pairs of documents are made: every copy meets the first document alone, or all others in one aggregation. Texts are read again only around the ends of chains and for
paragraphs that collide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST, SEED, RECALL = 26, 8, 1 - 1e-6
_SEEDS = common.mix(np.arange(1, 65, dtype=np.uint64))


def tune(similar: float = common.SIMILAR, recall: float = RECALL, most: int = 32) -> tuple[int, int]:
    """(bands, rows): of those with the recall, with few bands, the most rows."""
    fits = [(r, b) for r in range(1, 9) for b in range(1, most + 1) if 1 - (1 - similar**r) ** b >= recall]
    rows = max(r for r, b in fits if b <= most // 2) if any(b <= most // 2 for _, b in fits) else 1
    return min(b for r, b in fits if r == rows), rows


def line_signatures(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of stretches [start, end) of texts' shingles, one row each."""
    out = np.zeros((bands, len(starts)), np.uint64)
    if not len(starts):
        return out.T
    size = ends - starts
    cut = np.cumsum(size) - size
    inside = shingles[np.arange(size.sum()) + np.repeat(starts - cut, size)]
    hashed = np.empty_like(inside)
    for k in range(bands * rows):
        np.bitwise_xor(inside, _SEEDS[k], out=hashed)
        np.multiply(hashed, _SEEDS[k] | np.uint64(1), out=hashed)
        out[k // rows] = common.mix(out[k // rows] * common._STEP + np.minimum.reduceat(hashed, cut) + np.uint64(k))
    return out.T


def _sliding(which, x: np.ndarray, reach: int) -> np.ndarray:
    """The least or greatest of every `reach` values in a row, by doubling."""
    width = 1
    while 2 * width <= reach:
        x = which(x[:-width], x[width:])
        width *= 2
    return which(x[: len(x) - (reach - width)], x[reach - width :])


def least_of(keys: np.ndarray, reach: int, inside: np.ndarray) -> np.ndarray:
    """Places of the least of every `reach` keys in a row, all of equal ones; inside: whether the `reach` keys from each place are of one text."""
    if not inside.any():
        return np.zeros(0, np.int64)
    least = np.where(inside, _sliding(np.minimum, keys, reach), np.uint64(0))
    edge = np.zeros(reach - 1, np.uint64)
    found = _sliding(np.maximum, np.concatenate([edge, least, edge]), reach) == keys
    held = np.concatenate([[0], np.cumsum(np.concatenate([inside, edge.astype(bool)]))])
    return np.flatnonzero(found & (held[1:] > held[np.maximum(np.arange(len(keys)) - reach + 1, 0)]))


def thinned(same: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """Which places to keep: of equal keys in a row (same: as the place before has in its text) closer than `reach`, as in a text that says one word over
    and over, only as many as every reach needs."""
    kept = np.ones(len(places), bool)
    last = 0
    for j in np.flatnonzero(same).tolist():
        if not same[j - 1]:
            last = places[j - 1]
        if places[j] - last >= reach:
            last = places[j]
        else:
            kept[j] = False
    return kept


def seeds(hashes: np.ndarray, least_words: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(keys, starts, steps, links, many, again) of the seeds of a text, or of texts one after the other (bounds: where each begins, and the end); any
    `least_words` words in a row of a text hold one. A step is the way to the next seed's start, a link the hash of all words up to the next seed's last one
    (0, 0: no next in the text); many: the text has the key in several places; again: in an earlier one."""
    size = min(SEED, least_words)
    none = np.zeros(0, np.int64)
    bounds = np.array([0, len(hashes)]) if bounds is None else bounds
    if np.diff(bounds).max(initial=0) < least_words:
        return none.view(np.uint64), none, none, none.view(np.uint64), none.astype(bool), none.astype(bool)
    keys = common.shingle_hashes(hashes, size)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    reach = least_words - size + 1
    places = least_of(keys, reach, of[: len(of) - least_words + 1] == of[least_words - 1 :])
    key, of = keys[places], of[places]
    order = np.lexsort((key, of))
    new = np.append(True, (key[order[1:]] != key[order[:-1]]) | (of[order[1:]] != of[order[:-1]]))
    many, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order] = ~new | ~np.append(new[1:], True)
    again[order] = ~new
    same = np.append(False, (key[1:] == key[:-1]) & (of[1:] == of[:-1]))
    if same.any():
        kept = thinned(same, places, reach)
        places, key, of, many, again = places[kept], key[kept], of[kept], many[kept], again[kept]
    step = np.append(np.where(of[1:] == of[:-1], np.diff(places), 0), 0)
    link = np.append(key[1:], np.uint64(0)) + step.astype(np.uint64)
    for k in range(size, int(step.max())):
        between = np.flatnonzero(k < step)
        link[between] = link[between] * common._STEP + hashes[places[between] + k]
    link = np.where(step > 0, common.mix(link + key), np.uint64(0))
    return key, places, step, link, many, again


def joined(texts: list[bytes], most: int = 1 << 17):
    """(first, after, raw, starts): texts in a row that take `most` bytes at most, as one with a line end after each but the last, and where each begins in
    it; a longer text is alone. Many short texts take few steps so, and their words are as they are alone."""
    first, held = 0, 0
    for i, x in enumerate([*texts, None]):
        if i > first and (x is None or held + len(x) > most):
            yield first, i, b"\n".join(texts[first:i]), np.cumsum([0, *(len(y) + 1 for y in texts[first : i - 1])])
            first, held = i, 0
        held += 0 if x is None else len(x) + 1


def units(raw: bytes, least_words: int, bands: int, rows: int, starts=(0,)):
    """(seeds: keys, starts, steps, links, many, again, text), (paragraphs: bodies, starts, sizes, band keys, text) of a text, or of those that `joined`
    gives; text: its number; places in words of the text."""
    hashes, places, _ = common.word_hashes(raw)
    bounds = np.append(np.searchsorted(places, starts), len(hashes))
    size = np.diff(np.searchsorted(places, np.concatenate(([0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), [len(raw)]))))
    shingles = common.shingle_hashes(hashes) if len(hashes) >= common.SHINGLE else np.zeros(0, np.uint64)
    long = np.flatnonzero(size >= max(least_words, common.SHINGLE))
    start = (np.cumsum(size) - size)[long]
    size = size[long]
    words = memoryview(hashes.tobytes())
    bodies = [xxhash.xxh64_intdigest(words[8 * i : 8 * j], 3) for i, j in zip(start.tolist(), (start + size).tolist())]
    signatures = line_signatures(shingles, start, start + size - common.SHINGLE + 1, bands, rows)
    keys, at, *rest = seeds(hashes, least_words, bounds)
    of, line_of = (np.searchsorted(bounds, x, side="right") - 1 for x in (at, start))
    return (keys, at - bounds[of], *rest, of), (np.array(bodies, np.uint64), start - bounds[line_of], size, signatures, line_of)


def _units(documents: DataFrame, least_words: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch, texts in common.slices(batches, 1, 1_000_000):
            doc, key, start, size, again, many, step, link, sig, held = ([] for _ in range(10))
            ids = np.array(batch.column(0).to_pylist())
            for first, after, raw, starts in joined(texts):
                (k, p, t, c, m, other, of), (b, s, n, g, line_of) = units(raw, least_words, bands, rows, starts)
                doc.append(ids[first:after][np.concatenate([of, line_of])])
                key.append(np.concatenate([k, b]))
                start.append(np.concatenate([p, s]))
                size.append(np.concatenate([np.zeros(len(p), np.int64), n]))
                again.append(np.concatenate([other, np.zeros(len(b), bool)]))
                many.append(np.concatenate([m, np.zeros(len(b), bool)]))
                step.append(np.concatenate([t, np.zeros(len(b), np.int64)]))
                link.append(np.concatenate([c, np.zeros(len(b), np.uint64)]))
                sig.append(g.view(np.int64).ravel())
                held.append(np.concatenate([np.zeros(len(k), np.int32), np.full(len(b), bands, np.int32)]))
            doc, key, start, size, again, many, step, link, sig, held = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, key, start, size, again, many, step, link, sig, held))
            ends = pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc.astype(np.int64)), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again.astype(bool)), pa.array(many.astype(bool)), pa.array(step.astype(np.int32)), pa.array(link.astype(np.uint64).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(sig, pa.int64()))],
                ["doc", "key", "start", "size", "again", "many", "step", "link", "bands"],
            )

    return documents.mapInArrow(run, "doc long, key long, start int, size int, again boolean, many boolean, step int, link long, bands array<long>")


def _kept(df: DataFrame, what: str) -> DataFrame:
    """As `common.keep`; files of the shuffles behind it, which take more room than the table, go at once: Spark deletes them when the driver collects its garbage."""
    table = common.keep(df, what)
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


# ------------------------------------------------------------------ near copies of paragraphs


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs a, b of paragraphs whose sets of shingles (id, v) are similar enough."""
    both = pairs.join(sets.toDF("a", "va"), "a").join(sets.toDF("b", "vb"), "b")
    # that many of all distinct ones: va and vb repeat none
    return both.where(F.expr(f"(1 + {least}D) * size(array_intersect(va, vb)) >= {least}D * (size(va) + size(vb)) - 1e-9")).select("a", "b")


def _shingle_sets(documents: DataFrame, places: DataFrame) -> DataFrame:
    """id, v: the set of shingles of each paragraph (body, doc, start, size), read at one of its places."""
    places = places.groupBy("doc").agg(F.collect_list(F.struct("body", "start", "size")).alias("lines"))

    def cut(batches):
        for batch, texts in common.slices(batches, 0):
            body, found = [], []
            for raw, lines in zip(texts, batch.column(1).to_pylist()):
                words = common.word_hashes(raw)[0]
                for x in lines:
                    body.append(x["body"])
                    found.append(np.unique(common.shingle_hashes(words[x["start"] : x["start"] + x["size"]])).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(body, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "v"])

    return documents.join(places, documents["doc_id"] == places["doc"]).select("text", "lines").mapInArrow(cut, "id long, v array<long>")


def _near(documents: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """doc, start_word, end_word, cluster, first_doc: paragraphs that are near copies of others (lines: key, doc, start, size, bands)."""
    buckets = common.buckets(lines.select(F.posexplode("bands").alias("i", "k"), F.col("key").alias("id")).select(F.xxhash64("i", "k").alias("key"), "id"))
    ids = common.keep(buckets.select(F.col("id").alias("body")).distinct(), "members")
    one = lines.groupBy(F.col("key").alias("body")).agg(F.min("doc").alias("doc"), F.expr("min_by(start, doc)").alias("start"), F.first("size").alias("size"))
    one = one.join(ids.hint("merge"), "body", "left_semi")  # counted first, so a frequent line is one row
    sets = _kept(_shingle_sets(documents, one), "lines")
    links = common.links_in_buckets(buckets, lambda pairs: _verify(pairs, sets, least), lambda some: sets.join(some, "id", "left_semi"), least)
    label = common.components(links)
    common.drop(buckets, ids, sets)
    # of those that have a link: how many rows, and in which documents
    bodies = lines.groupBy(F.col("key").alias("id")).agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).join(label, "id")
    bodies = common.keep(bodies, "linked")
    ends = bodies.groupBy("label").agg(F.min("least").alias("first_doc"), F.max("most").alias("last_doc")).where("first_doc <> last_doc").select("label", "first_doc")
    known = common.keep(bodies.join(ends, "label").select(F.col("id").alias("key"), F.col("label").alias("cluster"), "first_doc", "n"), "clusters")
    found = common.join_hot(lines.select("key", "doc", "start", "size"), known, ["key"])
    return found.select("doc", F.col("start").cast("long").alias("start_word"), F.expr("cast(start + size AS long)").alias("end_word"), "cluster", "first_doc")


# ------------------------------------------------------------------ exact copies


def _flanks(documents: DataFrame, places: DataFrame, most: int, size: int) -> DataFrame:
    """doc, at, side, words: hashes of up to `most` words of the text before (side 0, nearest first) or from (side 1) each place; of places
    wanted so: low, windows: hashes of `most` words from low, low + 1, .., that hold the seed that begins (0) or ends (1) there and reach beyond it to that side. Side 2: the
    windows that hold the seed which begins there, no words."""
    places = places.groupBy("doc", "at", "side").agg(F.max("wanted").alias("wanted")).groupBy("doc").agg(F.collect_list(F.struct("at", "side", "wanted")).alias("places"))
    spare = most - size

    def run(batches):
        for batch, texts in common.slices(batches, 1, 500_000):
            lists = batch.column(2)
            number, flat = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())), lists.flatten()
            ids = np.repeat(batch.column(0).to_numpy(), np.diff(number))
            at, side = (flat.field(c).to_numpy().astype(np.int64) for c in (0, 1))
            wanted = flat.field(2).to_numpy(zero_copy_only=False).astype(bool)
            words, windows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            n_words, n_windows, low = (np.zeros(len(at), np.int32) for _ in range(3))
            for first, after, raw, starts in joined(texts):
                full, places, _ = common.word_hashes(raw)
                bounds = np.append(np.searchsorted(places, starts), len(full))
                here = slice(number[first], number[after])
                of = np.repeat(np.arange(after - first), np.diff(number[first : after + 1]))
                a, s, w, begin, end = at[here] + bounds[of], side[here], wanted[here], bounds[of], bounds[of + 1]
                top = np.minimum(np.where(s == 1, a + most, a), end)
                n = np.where(s == 2, 0, np.maximum(top - np.maximum(np.where(s == 1, a, a - most), begin), 0))
                step = np.where(s == 1, 1, -1)
                words.append(full[np.repeat(np.where(s == 1, a, top - 1), n) + np.repeat(step, n) * _within(n)].astype(np.uint32).view(np.int32))
                n_words[here] = n
                if w.any() and len(full) >= most:
                    lo = np.maximum(np.choose(s, (a - spare, a - most + 1, a - spare)), begin)
                    m = np.where(w, np.maximum(np.minimum(np.choose(s, (a, a - size + 1, a + 1)), end - most + 1) - lo, 0), 0)
                    windows.append(common.shingle_hashes(full, most)[np.repeat(lo, m) + _within(m)].view(np.int64))
                    n_windows[here], low[here] = m, np.where(w, lo - begin, 0)
            lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), np.concatenate(x)) for n, x in ((n_words, words), (n_windows, windows))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(side, pa.int32()), lists[0], pa.array(low), lists[1]],
                ["doc", "at", "side", "words", "low", "windows"],
            )

    both = documents.join(places, documents["doc_id"] == places["doc"]).select("doc", "text", "places")
    return both.mapInArrow(run, "doc long, at int, side int, words array<int>, low int, windows array<long>")


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _whole(windows: DataFrame, least_words: int) -> DataFrame:
    """doc, first_doc, diagonal, lo, hi: stretches of words that several documents have (windows: doc, start, key of `least_words` words)."""
    windows = common.keep(windows.distinct(), "windows")
    shared = windows.groupBy("key").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.min(F.struct("doc", "start")).alias("x"), F.count("*").alias("n"))
    shared = common.keep(shared.where("first_doc <> last_doc").select("key", "first_doc", F.col("x.start").alias("first_start"), "n"), "shared-windows")
    copies = common.join_hot(windows, shared, ["key"]).where("doc <> first_doc OR start <> first_start").select("doc", "first_doc", F.expr("start - first_start").alias("diagonal"), "start").distinct()
    order = Window.partitionBy("doc", "first_doc", "diagonal").orderBy("start")
    copies = copies.withColumn("new", F.when(F.col("start") - F.lag("start").over(order) <= least_words, 0).otherwise(1))
    copies = copies.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = common.keep(copies.groupBy("doc", "first_doc", "diagonal", "run").agg(F.min("start").alias("lo"), F.expr(f"max(start) + {least_words}").alias("hi")).drop("run"), "whole")
    common.drop(windows, shared)
    return found


def _exact(documents: DataFrame, table: DataFrame, least_words: int) -> DataFrame:
    """doc, start_word, end_word, cluster, first_doc: stretches that other documents have word by word (table: doc, key, start, again, many, step, link)."""
    size = min(SEED, least_words)
    first_of = lambda c: F.expr(f"min_by({c}, CASE WHEN NOT again THEN doc END)").alias(f"first_{c}")
    shared = table.groupBy("key").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), *map(first_of, ("start", "link")), F.min(F.when(F.col("many"), F.col("doc"))).alias("many_doc"), F.count("*").alias("n"))
    shared = shared.where("first_doc <> last_doc").select("key", "first_doc", "first_start", "first_link", F.expr("many_doc <=> first_doc").alias("many_first"), (F.col("n") > 2).alias("several"), "n")
    shared = _kept(shared, "shared")
    met = common.join_hot(table.select("key", "doc", "start", "step", "link"), shared, ["key"])
    # a seed that its first document has in several places: one of them is met below, so all windows around it are compared
    whole = met.where("many_first").select("doc", F.col("start").alias("at"), F.lit(2).alias("side"), F.lit(True).alias("wanted"))
    copies = met.where("doc <> first_doc").select("doc", "first_doc", F.expr("start - first_start").alias("diagonal"), "start", F.expr("CASE WHEN link = first_link THEN step ELSE 0 END").alias("step"), "several").distinct()
    by_place = Window.partitionBy("doc", "first_doc", "diagonal").orderBy("start")
    # a chain goes on where seeds touch, or all words up to the next one are the same
    copies = copies.withColumn("far", F.col("start") - F.lag("start").over(by_place)).withColumn("new", F.when((F.col("far") <= size) | (F.col("far") == F.lag("step").over(by_place)), 0).otherwise(1))
    copies = copies.withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    chains = copies.groupBy("doc", "first_doc", "diagonal", "run").agg(F.min("start").alias("lo"), F.expr(f"max(start) + {size}").alias("hi"), F.max("several").alias("several")).drop("run")
    chains = _kept(chains, "chains")
    # two ends of each chain, here and in the first document
    ends = chains.select("doc", "first_doc", "diagonal", "lo", "hi", "several", F.explode(F.expr("array(0, 1)")).alias("side"))
    ends = ends.withColumn("at", F.expr("CASE WHEN side = 0 THEN lo ELSE hi END")).withColumn("first_at", F.expr("at - diagonal"))
    places = ends.select("doc", "at", "side", F.col("several").alias("wanted")).unionByName(ends.select(F.col("first_doc").alias("doc"), F.col("first_at").alias("at"), "side", F.lit(False).alias("wanted")))
    flanks = _kept(_flanks(documents, places.unionByName(whole), least_words, size), "flanks")
    common.drop(shared)
    ends = common.keep(ends.join(flanks.where("side < 2"), ["doc", "at", "side"]), "ends")
    first = ends.groupBy("first_doc", "first_at", "side").agg(F.count("*").alias("n"))
    first = common.keep(first.join(flanks.select(F.col("doc").alias("first_doc"), F.col("at").alias("first_at"), "side", F.col("words").alias("others")), ["first_doc", "first_at", "side"]), "first-ends")
    same = "array_position(zip_with(words, others, (x, y) -> x <=> y), false)"
    further = common.join_hot(ends, first, ["first_doc", "first_at", "side"]).withColumn("p", F.expr(same))
    further = further.withColumn("more", F.expr("cast(CASE WHEN p = 0 THEN size(words) ELSE p - 1 END AS int)"))
    further = _kept(further.select("doc", "first_doc", "diagonal", "lo", "hi", "side", "more", "several", "low", "windows"), "further")
    found = further.groupBy("doc", "first_doc", "diagonal", "lo", "hi").agg(F.expr("max(CASE WHEN side = 0 THEN more END)").alias("before"), F.expr("max(CASE WHEN side = 1 THEN more END)").alias("after"))
    found = found.select("doc", "first_doc", "diagonal", F.expr("lo - before").alias("lo"), F.expr("hi + after").alias("hi")).where(f"hi - lo >= {least_words}")
    # what goes beyond the words that a first document shares may be in other documents too: those windows meet by all their words
    beyond = further.where("several").select("doc", "side", "lo", "hi", "more", F.posexplode("windows").alias("i", "key"), "low").withColumn("start", F.expr("low + i"))
    beyond = beyond.where(f"CASE WHEN side = 0 THEN start < lo - more ELSE start + {least_words} > hi + more END").select("doc", "start", "key")
    around = flanks.where("side = 2").select("doc", F.posexplode("windows").alias("i", "key"), "low").select("doc", F.expr("low + i").alias("start"), "key")
    found = found.unionByName(_whole(beyond.unionByName(around), least_words))
    found = _kept(found.distinct().withColumn("first_lo", F.expr("lo - diagonal")), "copies")
    common.drop(chains, flanks, ends, first, further)
    # stretches of a first document that share as many words as a seed are one passage
    origin = found.groupBy("first_doc", "first_lo").agg(F.expr("max(hi - diagonal)").alias("first_hi"), F.count("*").alias("n"))
    in_order = Window.partitionBy("first_doc").orderBy("first_lo")
    origin = origin.withColumn("reach", F.max("first_hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    origin = origin.withColumn("new", F.expr(f"CASE WHEN first_lo <= reach - {size} THEN 0 ELSE 1 END"))
    origin = origin.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    origin = origin.withColumn("cluster", F.xxhash64("first_doc", F.min("first_lo").over(Window.partitionBy("first_doc", "run"))))
    origin = common.keep(origin.select("first_doc", "first_lo", "first_hi", "cluster", "n"), "origins")
    copies = common.join_hot(found, origin.drop("first_hi"), ["first_doc", "first_lo"]).select("doc", "lo", "hi", "cluster", "first_doc")
    rows = copies.unionByName(origin.select(F.col("first_doc").alias("doc"), F.col("first_lo").alias("lo"), F.col("first_hi").alias("hi"), "cluster", "first_doc"))
    # stretches of one document and passage that touch are one row
    order = Window.partitionBy("doc", "cluster").orderBy("lo", "hi")
    rows = rows.withColumn("reach", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.expr("CASE WHEN lo <= reach THEN 0 ELSE 1 END")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("doc", "cluster", "first_doc", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # seeds at the edge of a passage may be chosen in some copies only: what lies within a copy of an earlier document says nothing more
    order = Window.partitionBy("doc").orderBy("lo", F.desc("hi"), "first_doc", "cluster")
    rows = rows.withColumn("around", F.max(F.expr("struct(hi, -first_doc AS earlier)")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where("around IS NULL OR around.hi < hi OR -around.earlier > first_doc")
    return rows.select("doc", F.col("lo").cast("long").alias("start_word"), F.col("hi").cast("long").alias("end_word"), "cluster", "first_doc")


def repeated_passages(documents: DataFrame, least: float = common.SIMILAR, recall: float = RECALL, least_words: int = LEAST) -> DataFrame:
    """documents: doc_id, text. Passages of at least `least_words` words that stand in several documents.

    Returns doc_id, start_word, end_word (exclusive), n_words, kind (`exact`: a stretch that another document has word by word, from its
    first word to its last; `near`: a line that is at least `least` similar to others, or linked to such), cluster (an id that copies of a
    passage share), first_doc (the least doc_id that has it) and removed (true but for the first). Rows of other clusters stay apart, also
    where they touch or overlap, so each keeps its first copy. Exact rows together hold every window of `least_words` words that several documents have,
    and no other word; a stretch is compared with the first document that has its seeds, so a longer match with a later document may show as several rows. Texts of null doc_id can't be told apart and are left out, as are
    null, empty and shorter texts. Rows that repeat a doc_id and its text are one document. Text that repeats within one document
    only is no passage. Texts may be of any length. An empty table gives none.
    """
    common.ship(documents.sparkSession)
    bands, rows = tune(least, recall)
    documents = common.pick(documents, "doc_id", "text").where("doc_id is not null")
    table = common.keep(_units(documents, least_words, bands, rows), "units")
    if documents.groupBy("doc_id").count().where("count > 1").limit(1).count():  # texts are read again once for each place
        documents = documents.groupBy("doc_id").agg(F.min("text").alias("text"))
    exact = _kept(_exact(documents, table.where("size = 0"), least_words).withColumn("kind", F.lit("exact")), "exact")
    near = common.keep(_near(documents, table.where("size > 0"), least).withColumn("kind", F.lit("near")).distinct(), "near")
    common.drop(table)
    out = exact.unionByName(near)
    return out.select(F.col("doc").alias("doc_id"), "start_word", "end_word", F.expr("end_word - start_word").alias("n_words"), "kind", "cluster", "first_doc", F.expr("first_doc <> doc").alias("removed"))

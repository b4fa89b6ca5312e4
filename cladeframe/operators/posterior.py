"""Posterior of a site without a tree and along branches: how many cells carry the mutation, by dynamic programming in log space."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.session import ship

PLAIN = 2048  # items up to which the recursion, whose time is their square, gives the likeliest number
BLOCK = 64  # items that are added one by one before distributions are joined in pairs


# ------------------------------------------------------------------ numeric core


def log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def normalised(mut: np.ndarray, unmut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two log likelihoods of each cell, made to add up to 1."""
    z = np.logaddexp(mut, unmut)
    return mut - z, unmut - z


def count_distribution(mut: np.ndarray, unmut: np.ndarray) -> np.ndarray:
    """log P(exactly l cells carry it), l = 0..n: the Poisson-binomial recursion."""
    dp = np.zeros(1)
    for a, b in zip(mut, unmut):
        grown = np.full(len(dp) + 1, -np.inf)
        grown[:-1] = dp + b
        grown[1:] = np.logaddexp(grown[1:], dp + a)
        dp = grown
    return dp


def likeliest(mut: np.ndarray, unmut: np.ndarray, counts: range) -> tuple[int, float, list[int]]:
    """Of the numbers of carriers in counts the likeliest (the least of equal ones), its log probability, and the carriers, traced back: an item is one
    where the probability of all ways with it is no less than of all ways without. Choices are made again from every sqrt(n)-th step, so that
    n items take n sqrt(n) memory."""
    n = len(mut)
    width = max(1, int(np.sqrt(n)))

    def step(dp, i):
        return np.append(dp + unmut[i], -np.inf), np.append(-np.inf, dp + mut[i])

    dp, at = np.zeros(1), []
    for i in range(n):
        if i % width == 0:
            at.append(dp)
        dp = np.logaddexp(*step(dp, i))
    some = [k for k in counts if k <= n]
    if not some:
        return 0, -np.inf, []
    best = some[int(np.argmax(dp[some]))]
    carriers, k = [], best
    for first in range((len(at) - 1) * width, -1, -width):
        here, without = at[first // width], []
        for i in range(first, min(n, first + width)):
            no, yes = step(here, i)
            without.append(no > yes)
            here = np.logaddexp(no, yes)
        for i in range(first + len(without) - 1, first - 1, -1):
            if k and not without[i - first][k]:
                carriers.append(i)
                k -= 1
    return best, float(dp[best]), carriers[::-1]


def best_count(mut: np.ndarray, unmut: np.ndarray) -> tuple[int, float, list[int]]:
    """The likeliest number of carriers, its log probability, and the carriers."""
    return likeliest(mut, unmut, range(len(mut) + 1))


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P(exactly l carry it), l = 0..n, of items that carry it with probability p (q: or don't): distributions of blocks, joined in pairs by Fourier
    transforms. Time and memory are nearly in proportion to n; the error is some 1e-15 in all, so it is for numbers near the mode."""
    blocks = 1 << max(0, int(np.ceil(np.log2(max(1, len(p)) / BLOCK))))
    yes, no = np.zeros(blocks * BLOCK), np.ones(blocks * BLOCK)
    yes[: len(p)], no[: len(p)] = p, q
    yes, no = yes.reshape(blocks, BLOCK), no.reshape(blocks, BLOCK)
    dp = np.zeros((blocks, BLOCK + 1))
    dp[:, 0] = 1
    for i in range(BLOCK):
        dp[:, 1:] = dp[:, 1:] * no[:, i : i + 1] + dp[:, :-1] * yes[:, i : i + 1]
        dp[:, 0] *= no[:, i]
    while len(dp) > 1:
        size = 2 * dp.shape[1] - 1
        both = np.fft.rfft(dp, 1 << (size - 1).bit_length(), axis=1)
        dp = np.maximum(np.fft.irfft(both[::2] * both[1::2], axis=1)[:, :size], 0)
    return dp[0, : len(p) + 1]


def mode(mut: np.ndarray, unmut: np.ndarray) -> tuple[int, float]:
    """The likeliest number of carriers (the least of equal ones) and its log probability, without the carriers."""
    z = np.logaddexp(mut, unmut)
    if len(mut) <= PLAIN or not np.isfinite(z).all():
        dp = count_distribution(mut, unmut)
        return int(np.argmax(dp)), float(dp.max())
    dp = spread(np.exp(mut - z), np.exp(unmut - z))
    best = int(np.argmax(dp >= dp.max() * (1 - 1e-12)))
    return best, float(z.sum() + np.log(dp[best]))


def first_terms(mut: np.ndarray, unmut: np.ndarray) -> tuple[float, float, float, float]:
    """log P that no cell carries it, that one does, one or more, two or more; sums of what can happen, so none is a small difference."""
    sure = np.isneginf(unmut)
    a, b = mut[~sure], unmut[~sure]
    z, odds = np.logaddexp(a, b), np.logaddexp.accumulate(a - b) if len(a) else np.zeros(0)
    none = float(b.sum())
    one = none + float(odds[-1]) if len(a) else -np.inf
    with np.errstate(divide="ignore"):
        some = float(z.sum() + np.log(-np.expm1((b - z).sum())))
    before = np.cumsum(b) - b + np.concatenate(([-np.inf], odds))[: len(a)]  # one among those before each
    two = total(before + a + z.sum() - np.cumsum(z))
    all_, given = float(z.sum()), float(mut[sure].sum())
    if not sure.any():
        return none, one, some, two
    return (-np.inf, given + none, given + all_, given + some) if sure.sum() == 1 else (-np.inf, -np.inf, given + all_, given + all_)


def total(x: np.ndarray) -> float:
    return float(np.logaddexp.reduce(x)) if len(x) else -np.inf


def at_least(mut: np.ndarray, unmut: np.ndarray, n: int) -> float:
    """log P(n or more cells carry it)."""
    return total(count_distribution(mut, unmut)[n:])


def late(mut: np.ndarray, unmut: np.ndarray, leaf: np.ndarray) -> dict:
    """A leaf's cells (indices): log P that some of them carry the mutation and no others; of the likeliest number of them, that number (`traced` finds
    its cells, in the square of the leaf's time); that one does."""
    rest = float(unmut.sum() - unmut[leaf].sum())
    _, one, some, _ = first_terms(mut[leaf], unmut[leaf])
    number, best = mode(mut[leaf], unmut[leaf])
    return {"p": rest + some, "best": rest + best, "n_cells": number, "leaf": leaf, "one": rest + one}


def traced(mut: np.ndarray, unmut: np.ndarray, place: dict) -> np.ndarray:
    """The cells of a place that `late`, `internal` or `early` gives."""
    return place["leaf"][best_count(mut[place["leaf"]], unmut[place["leaf"]])[2]] if "leaf" in place else place["cells"]


def _clusters(mut, unmut, clusters, counts: range) -> tuple[np.ndarray, float, np.ndarray]:
    """Whole clusters carry or don't: log P of each number of them; of the likeliest in counts, its cells."""
    a, b = (np.array([x[c].sum() for c in clusters]) for x in (mut, unmut))
    _, best, chosen = likeliest(a, b, counts)
    cells = np.unique(np.concatenate([clusters[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
    return count_distribution(a, b), best, cells


def internal(mut: np.ndarray, unmut: np.ndarray, node: np.ndarray, clusters: list[np.ndarray]) -> dict | None:
    """A node whose cells some of the clusters share in part: log P that two or more of these carry the mutation. Cells of none of them don't, which
    counts once for every cluster, as published. One such cluster: the node's cells carry it and no others. None: no result."""
    inside = [c for c in clusters if 0 < len(np.intersect1d(c, node)) < len(node)]
    if not inside:
        return None
    if len(inside) == 1:
        p = float(mut[node].sum() + unmut.sum() - unmut[node].sum())
        return {"p": p, "best": p, "cells": inside[0]}
    rest = float(unmut[np.setdiff1d(np.arange(len(unmut)), np.concatenate(inside))].sum()) * len(inside)
    dp, best, cells = _clusters(mut, unmut, inside, range(2, len(inside) + 1))
    return {"p": rest + total(dp[2:]), "best": rest + best, "cells": cells}


def early(mut: np.ndarray, unmut: np.ndarray, pivots: list[np.ndarray]) -> dict:
    """Pivot clusters: log P that two or more but not all carry the mutation; nothing for two or fewer."""
    if len(pivots) <= 2:
        return {"p": -np.inf, "best": -np.inf, "cells": np.zeros(0, np.int64)}
    dp, best, cells = _clusters(mut, unmut, pivots, range(2, len(pivots)))
    return {"p": total(dp[2:-1]), "best": best, "cells": cells}


def site_posterior(mut: np.ndarray, unmut: np.ndarray, leaves: list[np.ndarray], internals: list[np.ndarray], pivots: list[np.ndarray], trace: bool = True) -> dict:
    """somatic, artifact (no cell carries it), germline (all do), adding up to 1; one_cell and best, the part of the likeliest place; place (late,
    internal, early or none), n_cells and (trace) cells there. Clusters are arrays of cells. The prior is 1 / nodes, nodes being the leaves' cells and the internal nodes."""
    nodes = sum(map(len, leaves)) + len(internals)
    clusters = [*leaves, *internals, *pivots]
    places = [("late", late(mut, unmut, c)) for c in leaves]
    places += [("internal", x) for c in internals if (x := internal(mut, unmut, c, clusters)) is not None]
    places.append(("early" if len(pivots) > 2 else "none", early(mut, unmut, pivots)))
    prior = -np.log(nodes) if nodes else -np.inf
    somatic = total(np.array([x["p"] for _, x in places])) + prior
    z = total(np.array([somatic, unmut.sum(), mut.sum()]))
    place, top = max(places, key=lambda x: x[1]["best"])
    share = lambda x: float(np.exp(x - z))
    one = total(np.array([x["one"] for k, x in places if k == "late"])) + prior
    return {"somatic": share(somatic), "artifact": share(unmut.sum()), "germline": share(mut.sum()), "one_cell": share(one), "best": share(top["best"] + prior), "place": place, "n_cells": top["n_cells"] if "leaf" in top else len(top["cells"])} | ({"cells": traced(mut, unmut, top)} if trace else {})


# ------------------------------------------------------------------ on Spark


def branch_sets(imputed: DataFrame) -> DataFrame:
    """mut, n, pivot (not strictly inside another's cells), leaf (strictly holds no other's), early (a pivot, or a maximal set strictly inside
    a pivot). Containment of u in v is that their shared cells are all of u's: counts, one join on cell."""
    size = imputed.groupBy("mut").agg(F.count("*").alias("n"))
    both = imputed.toDF("cell", "u").join(imputed.toDF("cell", "v"), "cell").where("u <> v").groupBy("u", "v").agg(F.count("*").alias("k"))
    inside = both.join(size.toDF("u", "nu"), "u").join(size.toDF("v", "nv"), "v").where("k = nu AND nv > nu").select("u", "v")
    pivots = size.join(inside.select(F.col("u").alias("mut")).distinct(), "mut", "left_anti").select("mut")
    leaves = size.join(inside.select(F.col("v").alias("mut")).distinct(), "mut", "left_anti").select("mut")
    direct = inside.join(pivots.withColumnRenamed("mut", "v"), "v", "left_semi").select("u").distinct()
    deeper = inside.join(pivots.withColumnRenamed("mut", "v"), "v", "left_anti").select("u").distinct()
    early = pivots.union(direct.join(deeper, "u", "left_anti"))
    flag = lambda f, name: f.select("mut", F.lit(True).alias(name))
    out = size.join(flag(pivots, "pivot"), "mut", "left").join(flag(leaves, "leaf"), "mut", "left").join(flag(early.toDF("mut"), "early"), "mut", "left")
    return out.select("mut", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("pivot", "leaf", "early")])


def carrier_counts(likelihoods: DataFrame) -> DataFrame:
    """mut, cells, carriers, log_p, p_none, p_one, p_two: the count distribution of each site; cell, mut, ll_mut, ll_unmut. Equal likelihoods are counted
    first; a site's group is one row for each pair of them, and takes memory in proportion to its cells."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["ll_mut", "ll_unmut"]).sort_values(["ll_mut", "ll_unmut"])
        a, b = (np.repeat(x, pdf.n) for x in normalised(pdf.ll_mut.to_numpy(float), pdf.ll_unmut.to_numpy(float)))
        none, _, some, more = np.exp(np.minimum(first_terms(a, b), 0))
        return pd.DataFrame([(key[0], len(a), *mode(a, b), none, some, more)], columns=["mut", "cells", "carriers", "log_p", "p_none", "p_one", "p_two"])

    ship(likelihoods.sparkSession)
    rows = likelihoods.groupBy("mut", "ll_mut", "ll_unmut").agg(F.count("*").alias("n"))
    return rows.groupBy("mut").applyInPandas(one, "mut long, cells long, carriers long, log_p double, p_none double, p_one double, p_two double")


def site_posteriors(likelihoods: DataFrame, clusters: DataFrame) -> DataFrame:
    """mut, somatic, artifact, germline, one_cell, best, place, n_cells, label of each site; clusters: cell, cluster, kind (leaf, internal or pivot), a cell
    in any number of them. Cells without a likelihood are left out. Cells of the same clusters and likelihoods are counted first; a site's group
    is one row for each such kind of cell."""

    def one(key, table):  # Spark takes no hints that are text
        table = table.sort_by("cell")
        a, b = (table.column(c).to_numpy().astype(float) for c in ("ll_mut", "ll_unmut"))
        n = np.where(np.isnan(a) | np.isnan(b), 0, table.column("n").to_numpy())
        start = np.cumsum(n) - n
        member = table.column("member").combine_chunks()
        row, flat = pc.list_parent_indices(member).to_numpy(), member.flatten()
        kinds, names = (flat.field(c).dictionary_encode() for c in ("kind", "cluster"))
        code = kinds.indices.to_numpy().astype(np.int64) * len(names.dictionary) + names.indices.to_numpy()
        of = {"leaf": {}, "internal": {}, "pivot": {}}
        for c in np.unique(code[n[row] > 0]).tolist():
            rows = row[code == c]
            many = n[rows]
            at = np.arange(many.sum()) + np.repeat(start[rows] - np.cumsum(many) + many, many)
            of[kinds.dictionary[c // len(names.dictionary)].as_py()][names.dictionary[c % len(names.dictionary)].as_py()] = at
        a, b = np.repeat(a, n), np.repeat(b, n)
        p = site_posterior(a, b, *([x for _, x in sorted(of[k].items())] for k in ("leaf", "internal", "pivot")), trace=False)
        carriers = int((a > b).sum())
        label = "cell_specific" if carriers == 1 else "absent" if carriers == 0 else "successful_pass" if p["somatic"] >= 0.9 else "failed_pass"
        row = {"mut": key[0].as_py()} | {k: p[k] for k in ("somatic", "artifact", "germline", "one_cell", "best", "place", "n_cells")} | {"label": label}
        return pa.Table.from_pylist([row], pa.schema([("mut", pa.int64()), *((k, pa.float64()) for k in ("somatic", "artifact", "germline", "one_cell", "best")), ("place", pa.string()), ("n_cells", pa.int64()), ("label", pa.string())]))

    ship(likelihoods.sparkSession)
    member = clusters.where("kind IS NOT NULL AND cluster IS NOT NULL").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("kind", "cluster"))).alias("member"))
    rows = likelihoods.join(member, "cell", "left").groupBy("mut", "ll_mut", "ll_unmut", "member").agg(F.count("*").alias("n"), F.min("cell").alias("cell"))
    return rows.groupBy("mut").applyInArrow(one, "mut long, somatic double, artifact double, germline double, one_cell double, best double, place string, n_cells long, label string")

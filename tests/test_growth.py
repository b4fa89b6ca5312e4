import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import tests_of as T
from cladeframe.operators import flips, growth, models, pairs, posterior, trees
from cladeframe.sources import sinks


def matrix_of(columns):
    cells = tuple(f"c{i}" for i in range(len(next(iter(columns.values())))))
    bits = lambda v, ok: sum(1 << i for i, x in enumerate(v) if ok(x))
    return growth.Matrix(cells, {m: bits(v, lambda x: x == "1") for m, v in columns.items()}, {m: bits(v, lambda x: x != "-") for m, v in columns.items()})


def frame(spark, columns):
    rows = [(f"c{i}", m, None if x == "-" else int(x)) for m, v in columns.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "cell string, mut string, state int")


def planted(rng, cells=60, muts=14):
    """A tree of nested cell sets."""
    sets = {}
    for i in range(muts):
        base = rng.choice([None, *sets]) if sets else None
        pool = list(sets[base]) if base else [c for c in range(cells) if not any(c in s for s in sets.values())]
        free = [c for c in pool if not any(c in s for k, s in sets.items() if k != base and (base is None or s < sets[base]))]
        if len(free) >= 4:
            sets[f"m{i}"] = set(rng.sample(free, max(3, len(free) * 2 // 3)))
    return {m: "".join("1" if c in s else "0" for c in range(cells)) for m, s in sets.items()}


def test_scaffold_of_a_perfect_tree(spark):
    for seed in (1, 2):
        columns = planted(random.Random(seed))
        result, matrix = growth.scaffold(frame(spark, columns), runs=20)
        result = growth.full_tree(result, matrix)
        assert result.tree.conflict_free() and not result.external
        assert set(result.tree.mutations()) == set(columns)
        assert sum(growth.flips(result.tree, matrix).values()) <= 0.05 * 60 * len(columns)


def test_scaffold_of_noise_is_conflict_free(spark):
    rng = random.Random(4)
    columns = {f"m{i}": "".join(rng.choice("0001-") for _ in range(40)) for i in range(12)}
    result, matrix = growth.scaffold(frame(spark, columns), runs=10)
    assert result.tree.conflict_free()
    imputed, tree = growth.as_frames(spark, growth.full_tree(result, matrix), matrix)
    dense = frame(spark, columns).select("cell", "mut").join(imputed.select("cell", "mut", F.lit(1).alias("state")), ["cell", "mut"], "left").na.fill(0)
    assert pairs.conflicts(dense).count() == 0
    total = flips.flip_counts(flips.compare(frame(spark, columns), imputed)).first()
    assert sum(total) == 40 * 12


def test_placement():
    m = matrix_of({"a": "111100", "b": "110000", "c": "000011", "d": "100000"})
    tree = growth.Tree({"a": "ROOT", "c": "ROOT"}, {"a": m.ones["a"], "c": m.ones["c"]})
    tree = growth.place(tree, m, "b", growth.Weights())
    assert tree.parent["b"] == "a" and tree.cells["b"] == m.ones["b"]
    tree = growth.place(tree, m, "d", growth.Weights())
    assert tree.parent["d"] == "b"
    less = tree.without({"b"})
    assert less.parent["d"] == "a" and "b" not in less.cells
    assert tree.text().splitlines()[1] == "  └─ a" and json.loads(json.dumps(tree.as_dict()))["name"] == "ROOT"
    assert tree.newick() == "(((d)b)a,c)ROOT;"
    assert [x[:2] for x in sinks.hierarchy(tree)] == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "a")]
    assert growth.penalty(m, "b", m.ones["a"], growth.Weights(0.1)) == 0.2


def test_communities():
    two = {(a, b): 1.0 for k in (0, 5) for a, b in itertools.combinations(range(k, k + 5), 2)} | {(0, 5): 0.1}
    got = growth.communities(range(11), two)
    assert len({got[i] for i in range(5)}) == 1 and got[0] != got[5] and len({got[i] for i in range(5, 10)}) == 1 and got[10] not in (got[0], got[5])


def test_consensus(spark):
    g = frame(spark, {"1": "110000", "2": "110000", "3": "000110", "4": "000011"}).select("cell", F.col("mut").cast("long").alias("mut"), "state")
    clones = {tuple(r.members): r.weight for r in growth.consensus_clones(g, 10).collect()}
    assert abs(sum(len(k) * w for k, w in clones.items()) - 16) < 1e-9 and clones[(1, 2)] == 4.0
    again = {tuple(r.members): r.weight for r in growth.consensus_clones(g.repartition(7), 10).collect()}
    assert clones == again


def test_posterior_is_enumeration():
    rng = np.random.default_rng(1)
    mut, unmut = posterior.normalised(rng.normal(0, 2, 7), rng.normal(0, 2, 7))
    dp = posterior.count_distribution(mut, unmut)
    for k in range(8):
        want = sum(math.exp(sum(mut[i] if i in s else unmut[i] for i in range(7))) for s in itertools.combinations(range(7), k))
        assert abs(math.exp(dp[k]) - want) < 1e-12
    clusters = [np.array([0, 1]), np.array([2, 3, 4]), np.array([5, 6])]
    way = lambda carriers: math.exp(sum(mut[i] if i in carriers else unmut[i] for i in range(7)))
    # late: some cells of a leaf, no others
    some = [s for k in range(1, 4) for s in itertools.combinations((2, 3, 4), k)]
    got = posterior.late(mut, unmut, clusters[1])
    assert math.isclose(math.exp(got["p"]), sum(map(way, some))) and math.isclose(math.exp(got["one"]), sum(way(s) for s in some if len(s) == 1))
    # internal: two or more whole clusters; cells of none count once for each cluster
    node, parts = np.arange(6), [np.array([0, 1]), np.array([2, 3])]
    none = math.exp(sum(unmut[4:]))
    sets = [set(parts[0]) | set(parts[1])]
    assert math.isclose(math.exp(posterior.internal(mut, unmut, node, [*parts, np.array([6]), node])["p"]), sum(map(way, sets)) * none)
    assert posterior.internal(mut, unmut, node, [np.array([6]), node]) is None
    assert math.isclose(math.exp(posterior.internal(mut, unmut, node, [parts[0], node])["p"]), way(set(range(6))))
    # early: two of three pivots
    assert math.isclose(math.exp(posterior.early(mut, unmut, clusters)["p"]), sum(way(set(a) | set(b)) for a, b in itertools.combinations(clusters, 2)))
    assert posterior.early(mut, unmut, clusters[:2])["p"] == -np.inf
    # all together: prior 1 / (cells of leaves + internal nodes)
    p = posterior.site_posterior(mut, unmut, clusters, [node], clusters)
    places = [posterior.late(mut, unmut, c)["p"] for c in clusters] + [posterior.internal(mut, unmut, node, [*clusters, node, *clusters])["p"], posterior.early(mut, unmut, clusters)["p"]]
    weights = [sum(map(math.exp, places)) / (7 + 1), way(()), way(range(7))]
    assert np.allclose([p["somatic"], p["artifact"], p["germline"]], np.array(weights) / sum(weights))


def test_traced_carriers():
    """The way back takes an item where all ways with it are no less likely than all ways without."""
    mut, unmut = np.log([0.9, 0.2, 0.8, 0.5]), np.log([0.1, 0.8, 0.2, 0.5])
    k, p, cells = posterior.best_count(mut, unmut)
    assert (k, cells) == (2, [0, 2]) or (k, cells) == (2, [0, 3])
    # two carriers of four: the last (0.5 each way): without 0.5 P(2 of 3) > with 0.5 P(1 of 3)?
    two, one = 0.9 * 0.2 * 0.2 + 0.9 * 0.8 * 0.8 + 0.1 * 0.2 * 0.8, 0.9 * 0.8 * 0.2 + 0.1 * 0.2 * 0.2 + 0.1 * 0.8 * 0.8
    assert math.isclose(math.exp(p), 0.5 * two + 0.5 * one) and cells == ([0, 2] if two > one else [0, 3])


def test_likeliest_number_of_many_cells():
    """A site of 400000 cells: their square would be bits of 160 GB. The number lies within 1 of the mean, and its probability is a normal curve's top."""
    p = np.random.default_rng(3).choice([0.05, 0.35, 0.5, 0.95], 400_000)
    k, top = posterior.mode(np.log(p), np.log1p(-p))
    assert abs(k - p.sum()) <= 1 and abs(top + 0.5 * math.log(2 * math.pi * (p * (1 - p)).sum())) < 1e-4
    none, one, some, more = posterior.first_terms(np.log(p), np.log1p(-p))
    assert math.isclose(none, np.log1p(-p).sum()) and math.isclose(one - none, math.log((p / (1 - p)).sum())) and abs(some) < 1e-6 and abs(more) < 1e-6


@pytest.mark.parametrize("n", [0, 1, 2, 65, 700])
def test_many_cells_as_few(monkeypatch, n):
    rng = np.random.default_rng(n)
    mut, unmut = rng.normal(-1, 2, n), rng.normal(0, 2, n)
    dp = posterior.count_distribution(mut, unmut)
    got, want = posterior.first_terms(mut, unmut), (dp[0], dp[1] if n else -np.inf, posterior.total(dp[1:]), posterior.total(dp[2:]))
    assert all(g == w or abs(g - w) < 1e-8 for g, w in zip(got, want))
    monkeypatch.setattr(posterior, "PLAIN", 0)
    k, p = posterior.mode(mut, unmut)
    assert k == np.argmax(dp) == len(posterior.best_count(mut, unmut)[2]) and abs(p - dp.max()) < 1e-8


def test_first_terms_of_sure_cells():
    for sure in ([0], [0, 2]):
        mut, unmut = np.log([0.3, 0.2, 0.6]), np.log([0.7, 0.8, 0.4])
        mut[sure], unmut[sure] = 0, -np.inf
        dp = posterior.count_distribution(mut, unmut)
        assert np.allclose(np.exp(posterior.first_terms(mut, unmut)), np.exp([dp[0], dp[1], posterior.total(dp[1:]), posterior.total(dp[2:])]))


def test_sites_of_many_cells(spark):
    """100000 cells a site, half of them in each of two leaves."""
    cells = spark.range(100_000).selectExpr("id AS cell", "explode(array(1L, 2L)) AS mut").selectExpr("cell", "mut", "CASE WHEN cell % 10 < mut THEN 0.95D ELSE 0.05D END AS p").selectExpr("cell", "mut", "ln(p) AS ll_mut", "ln(1 - p) AS ll_unmut")
    got = {r.mut: r for r in posterior.carrier_counts(cells).collect()}
    for m in (1, 2):
        mean = 100_000 * (0.05 + 0.09 * m)
        assert got[m].cells == 100_000 and abs(got[m].carriers - mean) <= 1 and abs(got[m].log_p + 0.5 * math.log(2 * math.pi * 100_000 * 0.0475)) < 1e-4
    kinds = spark.range(100_000).selectExpr("id AS cell", "cast(id % 2 AS int) AS cluster", "'leaf' AS kind")
    for r in posterior.site_posteriors(cells, kinds).collect():
        # the likeliest place is the leaf whose cells are mutant more often; of mutation 2 both leaves are alike and the first one is taken
        assert r.place == "late" and abs(r.n_cells - (50_000 * 0.05 + 0.9 * (10_000))) <= 1 and abs(r.somatic - 1) < 1e-9


def test_ends_of_many_cells(spark):
    """What t14_none_and_some shows, of a site whose cells squared take 40 GB as bits; each end has a closed form."""
    cells = spark.range(200_000).selectExpr("id AS cell", "7L AS mut", "1e-6 * (1 + id % 5) AS p").selectExpr("cell", "mut", "ln(p) AS ll_mut", "ln(1 - p) AS ll_unmut")
    r = posterior.carrier_counts(cells).first()
    p = 1e-6 * (1 + np.arange(200_000) % 5)
    none = np.log1p(-p).sum()
    assert r.cells == 200_000 and math.isclose(r.p_none, math.exp(none), rel_tol=1e-9) and math.isclose(r.p_one, -math.expm1(none), rel_tol=1e-9)
    assert math.isclose(r.p_two, 1 - math.exp(none) * (1 + (p / (1 - p)).sum()), rel_tol=1e-9) and r.carriers == 0 and math.isclose(r.log_p, none, rel_tol=1e-9)


def test_distributions():
    assert abs(T.fisher_two_sided(3, 1, 1, 3) - 34 / 70) < 1e-9
    assert abs(T.binomial_two_sided(2, 10) - 0.109375) < 1e-12
    assert abs(T.binomial_cdf(3, 10, 0.5) - 176 / 1024) < 1e-12
    assert abs(T.normal_sf(1.959964) - 0.025) < 1e-6


def test_closure_depth(spark):
    t = spark.createDataFrame([(i, i - 1) for i in range(1, 41)], "node long, parent long")
    assert trees.closure(t).count() == sum(i + 1 for i in range(1, 41))
    assert trees.depths(t).agg(F.max("depth")).first()[0] == 40


def test_classifiers(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", *(str(rng.gauss(3 if i % 2 else 0, 1)) if rng.random() > 0.05 else "no" for _ in range(3)), "mosaic" if i % 2 else "artifact", f"p{i % 3}") for i in range(120)]
    data = spark.createDataFrame(rows, "mut string, a string, b string, c string, label string, sampleid string")
    out = models.scrna(data, data.where("sampleid = 'p1'"), ["a", "b", "c"], tested="p1", trees=20).join(data.select("mut", F.col("label").alias("y")), "mut").collect()
    assert sum(r.label == r.y for r in out) >= 0.85 * len(out)
    scores = spark.createDataFrame([(i, 0.9 if i % 10 == 0 else 0.01 * (i % 7), 0.1, 0.2) for i in range(60)], "mut long, fp_mean double, fp_std double, fp_cv double")
    train = spark.createDataFrame([(0.9, 0.1, 0.2, "germline", "x"), (0.8, 0.1, 0.2, "germline", "y"), (0.05, 0.1, 0.2, "mosaic", "x"), (0.02, 0.1, 0.1, "mosaic", "y")] * 5, "fp_mean double, fp_std double, fp_cv double, label string, sampleid string")
    got = {r.mut for r in models.germline(scores, train).where("germline").collect()}
    assert got and got <= set(range(0, 60, 10))
    assert models.germline(scores, train.limit(0)).where("germline").count() == 0


# A published example of 29 cells and 37 mutations, the mutations at 1 of each cell, both in the order of their names
EXAMPLE = (
    [29],
    [30],
    [20],
    [0, 1, 2, 3, 6, 10, 11, 12, 18, 20],
    [0, 1, 2, 3, 6, 10, 11, 12, 14, 15, 17, 18, 20],
    [0, 1, 2, 3, 6, 10, 11, 12, 14, 15, 17, 18, 20],
    [31],
    [32],
    [19],
    [19],
    [4, 7, 9],
    [4, 7, 9],
    [21],
    [5, 8, 13, 16],
    [5, 8, 13, 16],
    [16],
    [34],
    [0, 1, 3, 6, 10, 11, 12, 17, 18, 20],
    [2, 10, 18, 20],
    [28],
    [33],
    [25],
    [24],
    [36],
    [27],
    [22],
    [26],
    [35],
    [23],
)


def test_published_example(spark):
    """One false negative, no other flip, 20 children of the root, a longest chain of 13 mutations, no conflict."""
    rows = [(f"c{i:02}", f"m{j:02}", int(j in ones)) for i, ones in enumerate(EXAMPLE) for j in range(37)]
    result, matrix = growth.scaffold(spark.createDataFrame(rows, "cell string, mut string, state int"))
    for r in (result, growth.full_tree(result, matrix)):
        tree = r.tree
        assert growth.flips(tree, matrix) == {"fn": 1, "fp": 0, "na0": 0, "na1": 0} and tree.conflict_free()
        assert len(tree.children("ROOT")) == 20 and len(tree.mutations()) == 37 and not r.external
        assert max(sum(len(n.split("|")) for n in tree.lineage(x)) for x in tree.parent) == 13


def test_matrix_of_many_cells(spark):
    """Bit sets over more cells than one bitmap holds."""
    g = spark.range(40_000).selectExpr("concat('c', lpad(cast(id AS string), 6, '0')) AS cell", "'m' AS mut", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE 0 END AS state")
    m = growth.Matrix.collect(g)
    want = [i for i in range(40_000) if i % 7]
    assert len(m.cells) == len(want) and m.known["m"].bit_count() == len(want)
    assert [i for i, c in enumerate(m.cells) if m.ones["m"] >> i & 1] == [i for i, x in enumerate(want) if x % 3 == 0]


def test_penalties_agree_with_their_frames(spark):
    """The growth's weights are the table operators' weights."""
    rows = [(i, k, a, 20 - a, o, m, n) for i, (k, a, o, m, n) in enumerate(itertools.product(("new_leaf", "on_edge", "on_node"), (0, 2, 3, 5, 9, 13, 17), (3, 15), (60, 75), (5, 30)))]
    got = trees.dynamic_weights(spark.createDataFrame([(*r, 100) for r in rows], "id int, kind string, na1 int, na0 int, ones int, missing int, nodes int, cells int"), 0.001, 0.1, 1.0).collect()
    w = growth.Weights(0.1, 0.001, 1.0)
    for r in got:
        assert math.isclose(r.omega, growth.omega_of(r.na1 / 20, w)) and math.isclose(r.phi, growth.phi_of(r.na1 / 20, r.kind, r.missing / 100, r.ones / 100, r.nodes, w))
    shape = spark.createDataFrame([("new_leaf", True, 0, 7, 0.5), ("on_node", False, 0, 7, 0.5), ("new_parent_merge", False, 3, 7, 0.5)], "kind string, anchor_is_root boolean, children int, nodes int, phi double")
    for r in trees.structural_penalty(shape).collect():
        assert math.isclose(r.structure, growth.structure(r.kind, "ROOT" if r.anchor_is_root else "x", tuple("abc"[: r.children]), r.nodes, r.phi))

"""Cases worked out by hand from the published definitions, one for each operator whose meaning they fix."""

import math

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import tests_of as T
from cladeframe.operators import graph, pairs, readstats, trees


def reads(spark, rows):
    """rows: cell, umi, bases and qualities."""
    flat = [(c, u, 1, b, q, i) for c, u, seen in rows for i, (b, q) in enumerate(seen)]
    return spark.createDataFrame(flat, "cell long, umi long, mut long, base string, qual int, place int")


def test_dynamic_weights(spark):
    """Omega and phi by missing, mutant and turned shares, kind and size of the tree."""
    cases = [
        ("new_leaf", 50, 50, 5, 80, 30, 0.5 * 0.1, 0.3 * 0.8 * 0.9), ("on_node", 50, 50, 5, 80, 30, 0.05, 0.3 * 1.2), ("on_edge", 30, 70, 15, 60, 10, 0.004, 0.6 * 0.9), ("on_node", 30, 70, 15, 60, 60, 0.004, 0.6 * 1.1),
        ("on_edge", 0, 0, 50, 0, 21, 0.001, 0.9), ("new_leaf", 81, 19, 20, 60, 20, 0.09, 0.8), ("on_node", 61, 39, 5, 40, 1, 0.07, 1.2), ("on_node", 15, 85, 5, 40, 1, 0.002, 1.0), ("on_node", 6, 94, 5, 40, 1, 0.0015, 1.0),
    ]
    frame = spark.createDataFrame([(i, *c[:6], 100) for i, c in enumerate(cases)], "id int, kind string, na1 int, na0 int, ones int, missing int, nodes int, cells int")
    for r in trees.dynamic_weights(frame, 0.001, 0.1, 1.0).collect():
        assert (r.omega, r.phi) == pytest.approx(cases[r.id][6:])
    assert trees.dynamic_weights(frame.limit(1), 0.001, 0.1, 0.2).first().phi == 0.1


def test_umi_likelihood(spark):
    """Two reads of A and one of T."""
    got = {r.base: r for r in readstats.umi_likelihood(reads(spark, [(1, 1, [("A", 20), ("A", 30), ("T", 10)])])).collect()}
    a, t = 0.99 * 0.999, 0.9
    pcr = {b: 10 ** (-6 * (n + 0.5) / 5) for b, n in (("A", 2), ("T", 1), ("C", 0), ("G", 0))}
    none, right = (1 - 1e-6) ** 100, a * t
    want = {"A": 0.5 * none * a * 0.1 + 0.5 * right * min(pcr["T"], pcr["C"]), "T": 0.5 * none * t * 0.01 * 0.001 + 0.5 * right * pcr["A"]}
    want |= {"C": right * pcr["A"] * pcr["T"] * pcr["G"], "G": right * pcr["A"] * pcr["T"] * pcr["C"]}
    total = sum(want.values())
    for b, x in want.items():
        assert got[b].likelihood == pytest.approx(x / total) and got[b].quality == math.ceil(-10 * math.log10(1 - x / total))


def test_umi_consensus(spark):
    """The best quality; ref among equal ones, else the first of A, T, C, G."""
    rows = reads(spark, [(1, 1, [("T", 30)]), (1, 2, [("T", 20), ("A", 20)]), (2, 3, [("G", 20), ("C", 20)])])
    assert {r.umi: r.base for r in readstats.umi_consensus(rows, "A").collect()} == {1: "T", 2: "A", 3: "C"}
    bulk = {r.base: r for r in readstats.bulk_consensus(rows, "A").collect()}
    assert [(bulk[b].consensus, bulk[b].raw, bulk[b].spots) for b in "ATCG"] == [(1, 1, 2), (1, 2, 2), (1, 1, 2), (0, 1, 2)] and bulk["G"].qualities == "NA"


def test_error_counts(spark):
    """Three reads or more of another base beside a second one; more than three of a lone other base."""
    q = 20
    rows = [(1, 1, [("T", q)] * 3 + [("A", q)]), (1, 2, [("T", q)] * 3), (1, 3, [("G", q)] * 4), (1, 4, [("A", q)] * 5), (2, 1, [("C", q)] * 3 + [("G", q)]), (2, 2, [("C", q)] * 2 + [("A", q)])]
    r = readstats.error_counts(reads(spark, rows), "A").first()
    assert (r.reads, r.umis, r.pcr, r.pcr_alts, r.lysis, r.lysis_alt) == (23, 6, 2, "C,T", 1, "G")
    r = readstats.error_counts(reads(spark, [*rows, (3, 1, [("T", q)] * 4)]), "A").first()
    assert (r.lysis, r.lysis_alt) == (2, ".")


def test_distance_and_segregation(spark):
    """Distance bias by depth, and segregation bias, by hand."""

    def one(places, length=120):
        frame = spark.createDataFrame([(1, "T", p) for p in places], "mut long, base string, place int")
        return T.variant_distance(frame, "T", length).first().bias

    assert one([5]) == math.inf
    assert one([10, 20]) == pytest.approx((240 - 2 * 6 - 1) * 6 / 119 / 60)
    assert one([10, 20, 60]) == pytest.approx(0.5 * math.erfc(-(20 - 18) * 0.079))
    twelve = list(range(0, 120, 10))
    assert one(twelve) == pytest.approx(0.5 * math.erfc(-(30 - (22.3 + 22.8) / 2) * (0.153 + 0.19) / 2))
    assert one(twelve * 20) == pytest.approx(0.5 * math.erfc(-(30 - 23.7) * 0.7))
    frame = spark.createDataFrame([(1, "T")] * 3 + [(1, "A")] * 9 + [(2, "A")], "mut long, base string")
    got = {r.mut: r.bias for r in T.segregation_bias(frame).collect()}
    assert got == {1: pytest.approx(math.log(0.5) + math.log(1 + math.exp(math.log(0.5) + 3 * math.log(2) - 3))), 2: None}


def test_rank_bias(spark):
    """Places 1, 2 of ref, 2, 3 of alt: three pairs in order and one tie."""
    frame = spark.createDataFrame([(1, "A", 1), (1, "A", 2), (1, "T", 2), (1, "T", 3), (2, "A", 1)], "mut long, base string, place int")
    got = {r.mut: r.z for r in T.rank_bias(frame).collect()}
    assert got[2] == math.inf and got[1] == pytest.approx((3.5 - 2) / math.sqrt(4 / 12 * (5 - 6 / 12)))


def test_chains_settle(spark):
    """A chain of 700 nodes: closure and components reach their ends; a circle raises."""
    chain = spark.range(1, 701).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    up = trees.closure(chain)
    assert up.count() == sum(range(2, 702)) and up.agg(F.max("depth")).first()[0] == 700
    linked = pairs.components_of(chain.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    assert linked.count() == 701 and linked.agg(F.max("label")).first()[0] == 0
    with pytest.raises(ValueError):
        trees.closure(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))
    assert trees.closure(chain.limit(0)).count() == 0 and graph.components(spark.createDataFrame([], "a long, b long")).count() == 0

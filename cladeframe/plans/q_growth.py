"""Queries of the randomised and the sequential parts: rows only, tested by invariants and by hand-made trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import growth, pairs

from . import fixtures as fx
from .registry import query


@query("g01_consensus_clones")
def g01c(s, d):
    return growth.consensus_clones(fx.geno(s, d), runs=100).select(F.expr("array_join(transform(members, x -> cast(x AS string)), '|')").alias("members"), "weight")


@query("g03_communities")
def g03(s, d):
    e = {(r.u, r.v): r.jaccard for r in pairs.correlated(fx.geno(s, d)).collect()}
    return s.createDataFrame(sorted(growth.communities(range(fx.MUTS), e).items()), "mut long, grp long")


@query("tree_growth")
def tree_growth(s, d):
    """The imputed matrix of a grown tree over all cells."""
    result, matrix = growth.scaffold(fx.geno(s, d), runs=100)
    result = growth.full_tree(result, matrix)
    return growth.as_frames(s, result, matrix)[0]

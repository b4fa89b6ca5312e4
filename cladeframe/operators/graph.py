"""Graphs as tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.session import drop, keep


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of an undirected graph.

    edges: a, b long; loops, repeats and either direction are fine. Returns (id, label), label
    being the component's least id, for every id that has an edge. Each round takes the least
    label of all neighbours and then follows labels once more, so the number of rounds grows with
    the logarithm of a component's width; every round is a table in the shared folder. Labels only fall, so the rounds end.
    """
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both = keep(both.distinct(), f"{what}-edges")
    label = keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")), what)
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = label.join(near, "id").select("id", F.least("label", "near").alias("next"), "label")
        jump = label.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = keep(step.join(jump, "next").select("id", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), what)
        moved = new.where("moved").limit(1).count()
        drop(label)
        label = new.drop("moved")
        if not moved:
            drop(both)
            return label

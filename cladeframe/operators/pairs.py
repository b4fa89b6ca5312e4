"""Pairs of mutations over cells: counts, similarity, correlation, reference sets, groups.

The pair count is one shuffle: the self-join on cell and the aggregation by pair. A cell has at most as many
rows as there are mutations, so its pairs are bounded by the square of the mutations and not of the cells; counts
of single states come from an aggregation, not from the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.session import keep

from .graph import components

LOW, FRACTION, CELLS = 0.08, 0.5, 1  # least Jaccard; else least fraction of either; least shared cells


def pair_counts(geno: DataFrame) -> DataFrame:
    """u < v, n11, n10, n01, n00 over cells in which both states are known."""
    g = geno.where("state IS NOT NULL").select("cell", "mut", "state")
    other = g.toDF("cell", "v", "t")
    pairs = g.toDF("cell", "u", "s").join(other, "cell").where("u < v")
    count = lambda a, b: F.count_if((F.col("s") == a) & (F.col("t") == b))
    return pairs.groupBy("u", "v").agg(count(1, 1).alias("n11"), count(1, 0).alias("n10"), count(0, 1).alias("n01"), count(0, 0).alias("n00"))


def mutant_counts(geno: DataFrame) -> DataFrame:
    """mut, ones: cells with state 1."""
    return geno.groupBy("mut").agg(F.count_if(F.col("state") == 1).alias("ones"))


def jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("jaccard", F.expr("coalesce(try_divide(n11, n11 + n10 + n01), 0D)"))


def fractions(pairs: DataFrame, ones: DataFrame) -> DataFrame:
    """fu, fv: shared cells by all cells with a 1 of u (of v), whether the other is known there or not."""
    a, b = ones.toDF("u", "ou"), ones.toDF("v", "ov")
    return pairs.join(a, "u").join(b, "v").withColumn("fu", F.expr("coalesce(try_divide(n11, ou), 0D)")).withColumn("fv", F.expr("coalesce(try_divide(n11, ov), 0D)")).drop("ou", "ov")


def correlated(geno: DataFrame, low: float = LOW, fraction: float = FRACTION, cells: int = CELLS) -> DataFrame:
    """u, v, jaccard, fu, fv of correlated pairs."""
    out = fractions(jaccard(pair_counts(geno)), mutant_counts(geno))
    test = f"n11 >= {cells} AND (jaccard >= {low} OR (jaccard > 0 AND greatest(fu, fv) >= {fraction}))"
    return out.where(test).select("u", "v", "jaccard", "fu", "fv")


def neighbours(edges: DataFrame) -> DataFrame:
    """r, mut: the edges in both directions."""
    return edges.select(F.col("u").alias("r"), F.col("v").alias("mut")).union(edges.select("v", "u"))


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """r, members: sorted."""
    return neighbours(edges).groupBy("r").agg(F.array_sort(F.collect_list("mut")).alias("members"))


def reference_cells(geno: DataFrame, edges: DataFrame) -> DataFrame:
    """r, cell: the cell set that a mutation stands for.

    Fewer than three neighbours: cells with r = 1. Otherwise each cell's number of neighbours at 1 is taken; if the greatest is at
    most 2, or more than half of the cells with any have 1 or 2, again cells with r = 1. Else cells whose number reaches q are
    added, q being the number just above those that make up the top tenth of cells (of all cells with any; the top number plus one if
    it alone exceeds a tenth)."""
    near = neighbours(edges)
    own = geno.where("state = 1").select(F.col("mut").alias("r"), "cell")
    sums = geno.where("state = 1").join(near, "mut").groupBy("r", "cell").agg(F.count("*").alias("s"))
    table = sums.groupBy("r", "s").agg(F.count("*").alias("n"))
    by_r = Window.partitionBy("r")
    table = table.withColumn("share", F.expr("n") / F.sum("n").over(by_r)).withColumn("top", F.max("s").over(by_r))
    table = table.withColumn("running", F.round(F.sum("share").over(by_r.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)), 9))
    cut = table.groupBy("r").agg(
        F.max("top").alias("top"), F.sum(F.expr("CASE WHEN s IN (1, 2) THEN share ELSE 0 END")).alias("low"),
        F.min(F.expr("CASE WHEN running <= 0.1 THEN s END")).alias("inside"),
    )
    degree = near.groupBy("r").agg(F.count("*").alias("degree"))
    cut = cut.join(degree, "r").where("degree >= 3 AND top > 2 AND low <= 0.5").select("r", F.expr("coalesce(inside, top + 1)").alias("q"))
    return own.select("r", "cell").union(sums.join(cut, "r").where("s >= q").select("r", "cell")).distinct()


def false_positive_scores(geno: DataFrame, edges: DataFrame) -> DataFrame:
    """r, fp_mean, fp_std, fp_cv over mutations with any mutant cell: the share of their mutant cells outside r's cell set if they
    are r's neighbours, inside it otherwise."""
    edges = keep(edges, "edges")  # mutation pairs, read four times
    u = keep(reference_cells(geno, edges).withColumn("inside", F.lit(1)), "reference-cells")
    ones = geno.where("state = 1").select("mut", "cell")
    total = ones.groupBy("mut").agg(F.count("*").alias("n"))
    hits = ones.join(u, "cell").groupBy("r", "mut").agg(F.count("*").alias("k"))
    refs = u.select("r").distinct()
    grid = refs.crossJoin(F.broadcast(total)).where("r <> mut")
    near = neighbours(edges).withColumn("near", F.lit(True))
    rows = grid.join(hits, ["r", "mut"], "left").join(near, ["r", "mut"], "left")
    rows = rows.select("r", F.expr("CASE WHEN near THEN (n - coalesce(k, 0)) / n ELSE coalesce(k, 0) / n END").alias("fp"))
    out = rows.groupBy("r").agg(F.avg("fp").alias("fp_mean"), F.stddev_pop("fp").alias("fp_std"))
    return out.withColumn("fp_cv", F.expr("coalesce(try_divide(fp_std, fp_mean), 0D)"))


def conflicts(geno: DataFrame) -> DataFrame:
    """Pairs that show 11, 10 and 01 together: no perfect phylogeny holds both."""
    return pair_counts(geno).where("n11 > 0 AND n10 > 0 AND n01 > 0").select("u", "v")


def intersecting(geno: DataFrame, mut: int, least: int = 1) -> DataFrame:
    """mut, shared: mutations that share at least so many mutant cells with one; missing counts as 0."""
    own = geno.where((F.col("mut") == mut) & (F.col("state") == 1)).select("cell")
    return geno.where((F.col("mut") != mut) & (F.col("state") == 1)).join(own, "cell", "left_semi").groupBy("mut").agg(F.count("*").alias("shared")).where(f"shared >= {least}")


def shared_cells(geno: DataFrame) -> DataFrame:
    """u, v, shared for all pairs with a shared mutant cell."""
    one = geno.where("state = 1").select("cell", "mut")
    return one.toDF("cell", "u").join(one.toDF("cell", "v"), "cell").where("u < v").groupBy("u", "v").agg(F.count("*").alias("shared"))


def first_clones(geno: DataFrame) -> DataFrame:
    """The part of the consensus that no shuffle changes: the clone that a reference starts, itself and its neighbours; members and weight."""
    sets = neighbour_sets(correlated(geno))
    full = geno.select(F.col("mut").alias("r")).distinct().join(sets, "r", "left")
    members = full.select(F.array_sort(F.array_union(F.array("r"), F.coalesce("members", F.expr("cast(array() AS array<bigint>)")))).alias("members"))
    return members.groupBy("members").agg(F.count("*").alias("weight"))


def clone_edges(clones: DataFrame) -> DataFrame:
    """u, v, w: for each pair the weights of the clones that hold both."""
    a = clones.select(F.explode("members").alias("u"), "members", "weight")
    return a.select("u", F.explode("members").alias("v"), "weight").where("u < v").groupBy("u", "v").agg(F.sum("weight").alias("w"))


def drop_lone(clones: DataFrame, stats: DataFrame, runs: float, mcf: float = 0.05, mcn: int = 5) -> DataFrame:
    """clones without the singletons that stayed alone in every run and are rare: fraction or cells at most the cut."""
    lone = clones.where(F.size("members") == 1).select(F.col("members")[0].alias("mut"), "weight").where(F.col("weight") >= runs)
    rare = lone.join(stats, "mut").where(f"mutant_fraction <= {mcf} OR mutant_cells <= {mcn}").select(F.array("mut").alias("members"))
    return clones.join(rare, "members", "left_anti")


def group_weights(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """a < b, w: summed weights between groups."""
    g = groups
    both = edges.join(g.toDF("u", "gu"), "u").join(g.toDF("v", "gv"), "v").where("gu <> gv")
    return both.groupBy(F.least("gu", "gv").alias("a"), F.greatest("gu", "gv").alias("b")).agg(F.sum("w").alias("w"))


def hubs(weights: DataFrame, groups: DataFrame, quantile: float = 0.75) -> DataFrame:
    """grp, degree of groups whose weighted degree exceeds the quantile over all groups; groups without links count as 0."""
    degree = weights.select(F.col("a").alias("grp"), "w").union(weights.select("b", "w")).groupBy("grp").agg(F.sum("w").alias("degree"))
    full = groups.select("grp").distinct().join(degree, "grp", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    cut = full.agg(F.expr(f"percentile(degree, {quantile}D)").alias("cut"))
    return full.crossJoin(F.broadcast(cut)).where("degree > cut").select("grp", "degree")


def components_of(pairs: DataFrame) -> DataFrame:
    """mut, label: connected components of pairs u, v among mutations, the label being the least of each."""
    return components(pairs.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("mut"), "label")


def backbone_support(geno: DataFrame, groups: DataFrame, backbone: DataFrame) -> DataFrame:
    """mut, grp, cells, share: for each mutation and backbone group, the mutation's mutant cells that carry the backbone."""
    ones = geno.where("state = 1").select("cell", "mut")
    carriers = ones.join(backbone.select(F.col("founder").alias("mut"), "grp"), "mut").select("cell", "grp").distinct()
    total = ones.groupBy("mut").agg(F.count("*").alias("n"))
    return ones.join(carriers, "cell").groupBy("mut", "grp").agg(F.count("*").alias("cells")).join(total, "mut").select("mut", "grp", "cells", F.expr("cells / n").alias("share"))


def best_backbone(support: DataFrame) -> DataFrame:
    """mut, grp of most cells, then share, then least group."""
    w = Window.partitionBy("mut").orderBy(F.desc("cells"), F.desc("share"), "grp")
    return support.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("mut", "grp", "cells")


def misgrouped(best: DataFrame, groups: DataFrame, backbone: DataFrame) -> DataFrame:
    """Mutations, no founders, whose best backbone isn't their group's."""
    rows = best.select("mut", F.col("grp").alias("best")).join(groups, "mut").where("best <> grp")
    return rows.join(backbone.select(F.col("founder").alias("mut")), "mut", "left_anti").select("mut", "grp", "best")


def clone_affinity(edges: DataFrame, groups: DataFrame, founders: DataFrame) -> DataFrame:
    """mut, grp, ratio, rep, score: the share of a group's mutations that a mutation is correlated to, whether its founder is one, and
    the share times a size factor 0.7 + 0.3 min(1, size / 10)."""
    size = groups.groupBy("grp").agg(F.count("*").alias("size"))
    near = neighbours(edges).toDF("mut", "other").join(groups.toDF("other", "grp"), "other")
    near = near.join(founders.select("grp", "founder"), "grp")
    out = near.groupBy("mut", "grp").agg(F.count("*").alias("k"), F.max((F.col("other") == F.col("founder")).cast("int")).alias("rep")).join(size, "grp")
    return out.select("mut", "grp", F.expr("k / size").alias("ratio"), "rep", F.expr("k / size * (0.7D + 0.3D * least(1D, size / 10D))").alias("score"), "size")


def best_clone(affinity: DataFrame) -> DataFrame:
    """mut, grp by founder, ratio, size, then least group."""
    w = Window.partitionBy("mut").orderBy(F.desc("rep"), F.desc(F.round("ratio", 9)), F.desc("size"), "grp")
    return affinity.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("mut", "grp", "rep", "ratio")


def group_presence(geno: DataFrame, groups: DataFrame, clone: DataFrame) -> DataFrame:
    """grp, fraction: the share of a clone's cells that have any mutation of the group."""
    n = clone.agg(F.countDistinct("cell").alias("n"))
    seen = geno.where("state = 1").join(clone.select("cell"), "cell", "left_semi").join(groups, "mut").select("grp", "cell").distinct()
    out = groups.select("grp").distinct().join(seen.groupBy("grp").agg(F.count("*").alias("k")), "grp", "left").crossJoin(F.broadcast(n))
    return out.select("grp", F.expr("coalesce(try_divide(coalesce(k, 0), n), 0D)").alias("fraction"))

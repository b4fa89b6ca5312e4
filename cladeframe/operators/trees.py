"""Trees as tables node, parent: closure, placement of cells, nodes that hold mutations, candidate positions and penalties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.session import keep

ROOT = 0


def closure(tree: DataFrame) -> DataFrame:
    """node, ancestor, depth: every node with itself (0) and all its ancestors, the root among them. Path lengths double each round, and
    each round is a table, so a tree of depth d takes log2(d) joins of plans that don't grow. A circle raises."""
    step = tree.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found, length = [keep(step, "closure")], 1
    nodes = found[0].count()
    while length <= 2 * nodes:
        paths = reduce(DataFrame.unionByName, found)
        hop = found[-1].where(f"depth = {length}")
        rest = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        longer = keep(hop.join(rest, "ancestor").select("node", F.col("top").alias("ancestor"), F.expr(f"{length} + more").cast("int").alias("depth")), "closure")
        if not longer.limit(1).count():
            own = tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
            return reduce(DataFrame.unionByName, found, own)
        found.append(longer)
        length *= 2
    if not nodes:
        return step
    raise ValueError("closure: nodes in a circle")


def depths(tree: DataFrame) -> DataFrame:
    return closure(tree).groupBy("node").agg(F.max("depth").alias("depth"))


def paths_to_root(tree: DataFrame) -> DataFrame:
    """node, path: from the node up to the root, joined by >."""
    rows = closure(tree).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))).alias("p"))
    return rows.select("node", F.expr("array_join(transform(p, x -> cast(x.ancestor AS string)), '>')").alias("path"))


def path_between(tree: DataFrame, a: int, b: int) -> DataFrame:
    """node, side: nodes between two, over their deepest common ancestor, which counts once."""
    up = closure(tree)
    x, y = up.where(F.col("node") == a).select(F.col("ancestor").alias("n"), F.col("depth").alias("da")), up.where(F.col("node") == b).select(F.col("ancestor").alias("n"), F.col("depth").alias("db"))
    meet = x.join(y, "n").agg(F.min("da").alias("ma"), F.min("db").alias("mb"))
    one = x.crossJoin(F.broadcast(meet)).where("da <= ma").select(F.col("n").alias("node"))
    two = y.crossJoin(F.broadcast(meet)).where("db < mb").select(F.col("n").alias("node"))
    return one.union(two)


def leaves_paths(tree: DataFrame) -> DataFrame:
    leaves = tree.select("node").join(tree.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    return paths_to_root(tree).join(leaves, "node", "left_semi")


def star(founders: DataFrame, root: int = -1) -> DataFrame:
    return founders.select(F.col("founder").alias("node"), F.lit(root).cast("long").alias("parent"))


def first_level(tree: DataFrame, root: int = ROOT) -> DataFrame:
    """clone, node: nodes below each child of the root, itself included."""
    tops = tree.where(F.col("parent") == root).select(F.col("node").alias("clone"))
    return closure(tree).join(tops, F.col("ancestor") == F.col("clone")).select("clone", "node")


def clone_backbones(tree: DataFrame, stats: DataFrame, root: int = ROOT) -> DataFrame:
    """clone, size, backbone: the clone's mutation of most cells, least of equal ones."""
    rows = first_level(tree, root).join(stats.select(F.col("mut").alias("node"), "mutant_cells"), "node", "left")
    return rows.groupBy("clone").agg(F.count("*").alias("size"), F.expr("max_by(node, struct(coalesce(mutant_cells, 0), -node))").alias("backbone"))


def cell_clones(geno: DataFrame, groups: DataFrame, founders: DataFrame) -> DataFrame:
    """cell, grp: the group with most mutations at 1; then whether its founder is 1; then the least group."""
    ones = geno.where("state = 1").join(groups, "mut").join(founders.select("grp", "founder"), "grp")
    rows = ones.groupBy("cell", "grp").agg(F.count("*").alias("n"), F.max((F.col("mut") == F.col("founder")).cast("int")).alias("f"))
    w = Window.partitionBy("cell").orderBy(F.desc("n"), F.desc("f"), "grp")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("cell", "grp", F.col("n").alias("score"))


def weighted_cell_clones(geno: DataFrame, groups: DataFrame, founders: DataFrame, weight: float = 2.0) -> DataFrame:
    """cell, grp, score: a founder counts `weight`, other mutations 1."""
    ones = geno.where("state = 1").join(groups, "mut").join(founders.select("grp", "founder"), "grp")
    rows = ones.groupBy("cell", "grp").agg(F.sum(F.expr(f"CASE WHEN mut = founder THEN {weight}D ELSE 1D END")).alias("score"))
    w = Window.partitionBy("cell").orderBy(F.desc("score"), "grp")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("cell", "grp", "score")


def prevalent_cell_clones(geno: DataFrame, groups: DataFrame) -> DataFrame:
    """cell, grp, score: by count, then by how many mutant cells the group has, then by its size, then the least group."""
    ones = geno.where("state = 1").join(groups, "mut")
    size = groups.groupBy("grp").agg(F.count("*").alias("size")).join(ones.groupBy("grp").agg(F.countDistinct("cell").alias("prevalence")), "grp", "left")
    rows = ones.groupBy("cell", "grp").agg(F.count("*").alias("score")).join(size, "grp")
    w = Window.partitionBy("cell").orderBy(F.desc("score"), F.desc("prevalence"), F.desc("size"), "grp")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("cell", "grp", "score")


def latest_nodes(tree: DataFrame, node_mut: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, depth: the deepest of the nodes that hold any of the wanted mutations."""
    held = node_mut.join(wanted, "mut", "left_semi").select("node").distinct().join(depths(tree), "node")
    top = held.agg(F.max("depth").alias("deepest"))
    return held.crossJoin(F.broadcast(top)).where("depth = deepest").select("node", "depth")


def intersecting_nodes(geno: DataFrame, node_mut: DataFrame, mut: int) -> DataFrame:
    """node, shared: nodes with a mutation that shares a mutant cell with a new one; shared is the greatest count."""
    from .pairs import intersecting

    return intersecting(geno, mut).join(node_mut, "mut").groupBy("node").agg(F.max("shared").alias("shared"))


def path_nodes(tree: DataFrame, nodes: DataFrame, root: int = ROOT) -> DataFrame:
    """node: the given nodes and all their ancestors, and the root. Paths between two of them run over ancestors, so they are in."""
    up = closure(tree).join(nodes.select("node"), "node", "left_semi").select(F.col("ancestor").alias("node"))
    return up.union(nodes.select("node")).union(tree.sparkSession.createDataFrame([(root,)], "node long")).distinct()


def candidates(tree: DataFrame, path: DataFrame, root: int = ROOT, most: int = 3) -> DataFrame:
    """kind, anchor, children (sorted): on_node, new_leaf at every path node (the root takes on_node only), on_edge where a child is on a path too,
    new_parent_merge of 2 to `most` such children."""
    p = path.select(F.col("node").alias("anchor"))
    none = F.expr("cast(array() AS array<bigint>)")
    kids = tree.join(path.select("node"), "node", "left_semi").join(p, F.col("parent") == F.col("anchor")).where(F.col("anchor") != root).select("anchor", F.col("node").alias("child"))
    out = p.select(F.lit("on_node").alias("kind"), "anchor", none.alias("children"))
    out = out.unionByName(p.where(F.col("anchor") != root).select(F.lit("new_leaf").alias("kind"), "anchor", none.alias("children")))
    out = out.unionByName(kids.select(F.lit("on_edge").alias("kind"), "anchor", F.array("child").alias("children")))
    two = kids.toDF("anchor", "a").join(kids.toDF("anchor", "b"), "anchor").where("a < b")
    out = out.unionByName(two.select(F.lit("new_parent_merge").alias("kind"), "anchor", F.array("a", "b").alias("children")))
    if most >= 3:
        three = two.join(kids.toDF("anchor", "c"), "anchor").where("b < c")
        out = out.unionByName(three.select(F.lit("new_parent_merge").alias("kind"), "anchor", F.array("a", "b", "c").alias("children")))
    return out


def base_penalty(observed: DataFrame, imputed: DataFrame, fnfp: float = 1.0, omega: float = 0.001) -> DataFrame:
    """fp, fn, na1, na0, penalty of each candidate: fp + fnfp fn + omega (na1 P(0) + na0 P(1)), P from the observed states of the mutation
    (one half without any). observed: cell, state of one mutation for all cells; imputed: candidate, cell with v = 1."""
    prior = observed.agg(F.expr("coalesce(avg(CASE WHEN state IS NOT NULL THEN state END), 0.5D)").alias("p1"))
    grid = imputed.select("candidate").distinct().crossJoin(observed)
    rows = grid.join(imputed.withColumn("v", F.lit(1)), ["candidate", "cell"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    out = rows.groupBy("candidate").agg(
        F.count_if(F.expr("state = 1 AND v = 0")).alias("fp"), F.count_if(F.expr("state = 0 AND v = 1")).alias("fn"),
        F.count_if(F.expr("state IS NULL AND v = 1")).alias("na1"), F.count_if(F.expr("state IS NULL AND v = 0")).alias("na0"),
    ).crossJoin(F.broadcast(prior))
    return out.select("candidate", "fp", "fn", "na1", "na0", F.expr(f"fp + {fnfp}D * fn + {omega}D * (na1 * (1 - p1) + na0 * p1)").alias("penalty"))


OMEGA = "CASE WHEN r > 0.8 THEN 0.9D * {w} WHEN r > 0.6 THEN 0.7D * {w} WHEN r > 0.4 THEN 0.5D * {w} ELSE least(0.95D * {w}, {o} * CASE WHEN r > 0.2 THEN 4D WHEN r > 0.1 THEN 2D WHEN r > 0.05 THEN 1.5D ELSE 1D END) END"


def dynamic_weights(rows: DataFrame, omega: float = 0.001, fnfp: float = 1.0, phi: float = 1.0) -> DataFrame:
    """omega and phi of candidates (na1, na0, kind, ones, missing, cells, nodes).

    Both follow the share r of missing states turned to 1. phi shrinks where many states are missing and few mutant; where r is large it
    shrinks for new nodes and grows for others; new nodes in trees of over 20 nodes get 0.9 of it; never below 0.1."""
    r = rows.withColumn("r", F.expr("coalesce(try_divide(na1, na1 + na0), 0D)"))
    r = r.withColumn("omega", F.expr(OMEGA.format(w=f"{fnfp}D", o=f"{omega}D")))
    new = "kind IN ('new_leaf', 'on_edge')"
    a = "CASE WHEN missing / cells > 0.7 AND ones / cells < 0.1 THEN 0.3D WHEN missing / cells > 0.5 AND ones / cells < 0.2 THEN 0.6D ELSE 1D END"
    b = f"CASE WHEN r > 0.4 THEN CASE WHEN {new} THEN 0.8D ELSE 1.2D END WHEN r > 0.2 THEN CASE WHEN {new} THEN 0.9D ELSE 1.1D END ELSE 1D END"
    c = f"CASE WHEN nodes > 20 AND {new} THEN 0.9D ELSE 1D END"
    return r.withColumn("phi", F.expr(f"greatest(0.1D, {phi}D * ({a}) * ({b}) * ({c}))")).drop("r")


def structural_penalty(rows: DataFrame) -> DataFrame:
    """structure of candidates (kind, anchor_is_root, children, nodes, phi): log N + phi log N, N the nodes after the placement; 0.5 ln k for
    a merge of k, 0.5 ln N at the root."""
    n = "(nodes + CASE WHEN kind = 'on_node' THEN 1 ELSE 2 END)"
    merge = "CASE WHEN kind = 'new_parent_merge' THEN 0.5D * ln(children) ELSE 0D END"
    root = f"CASE WHEN anchor_is_root THEN 0.5D * ln({n}) ELSE 0D END"
    return rows.withColumn("structure", F.expr(f"ln({n}) + phi * ln({n}) + {merge} + {root}"))


def choose(scored: DataFrame) -> DataFrame:
    """The first candidate of least penalty that isn't empty."""
    w = Window.orderBy(F.round("penalty", 9), "candidate")
    return scored.where("size > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def imputed_leaf(geno: DataFrame, imputed: DataFrame, tree: DataFrame, mut: int, anchor: int) -> DataFrame:
    """cell: a new leaf's cells, those of the mutation without cells of nodes outside the anchor's lineage (neither above nor the anchor itself)."""
    new = geno.where((F.col("mut") == mut) & (F.col("state") == 1)).select("cell")
    lineage = closure(tree).where(F.col("node") == anchor).select(F.col("ancestor").alias("mut")).union(tree.sparkSession.createDataFrame([(ROOT,), (anchor,)], "mut long")).distinct()
    others = imputed.where(F.col("mut") != mut).join(lineage, "mut", "left_anti").select("cell").distinct()
    return new.join(others, "cell", "left_anti")


def chain_penalty(geno: DataFrame, imputed: DataFrame, new_cells: DataFrame, chain: DataFrame, fnfp: float = 1.0) -> DataFrame:
    """mut, turned, cost: for each mutation of an ancestor chain the new cells that it has to take: those observed 0 cost fnfp."""
    need = new_cells.crossJoin(F.broadcast(chain)).join(imputed.select("cell", "mut"), ["cell", "mut"], "left_anti")
    rows = need.join(geno, ["cell", "mut"], "left")
    return rows.groupBy("mut").agg(F.count("*").alias("turned"), F.expr(f"sum(CASE WHEN state = 0 THEN {fnfp}D ELSE 0D END)").alias("cost"))


def remove_nodes(tree: DataFrame, gone: DataFrame) -> DataFrame:
    """tree without some nodes; children go to their nearest ancestor that stays."""
    up = closure(tree).where("depth > 0")
    alive = up.join(gone.select(F.col("node").alias("ancestor")), "ancestor", "left_anti")
    return alive.join(gone.select("node"), "node", "left_anti").groupBy("node").agg(F.min_by("ancestor", "depth").alias("parent"))


def branch_groups(tree: DataFrame, listed: DataFrame) -> DataFrame:
    """key, members: listed nodes along each path from the root, maximal sets only, keyed by the earliest."""
    on = closure(tree).join(listed.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    sets = on.join(listed, "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list("ancestor")).alias("members"), F.max_by("ancestor", "depth").alias("key")).select("key", "members").distinct()
    big = sets.select(F.col("key").alias("key"), F.col("members").alias("b"))
    inside = sets.join(big, "key").where("size(b) > size(members) AND size(array_except(members, b)) = 0").select("key", "members").distinct()
    out = sets.join(inside, ["key", "members"], "left_anti")
    return out.select("key", F.expr("array_join(transform(members, x -> cast(x AS string)), '|')").alias("members"))


def rename_on_node(tree: DataFrame, node: str, new: str) -> DataFrame:
    """A placement on a node: its name becomes `node|new`, also as a parent (text names)."""
    name = f"{node}|{new}"
    swap = lambda c: F.when(F.col(c) == node, F.lit(name)).otherwise(F.col(c)).alias(c)
    return tree.select(swap("node"), swap("parent"))

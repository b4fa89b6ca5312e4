"""Statistics and orders of the cell x mutation table in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRUCT = "struct<grp:bigint,mut:bigint>"


def mutant_fraction(geno: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """mut, mutant_cells, mutant_fraction: cells with state 1, by covered cells (or by `rows`: mut, n)."""
    out = geno.groupBy("mut").agg(F.count_if(F.col("state") == 1).alias("mutant_cells"), F.count("state").alias("n"))
    if rows is not None:
        out = out.drop("n").join(rows, "mut")
    return out.select("mut", "mutant_cells", F.expr("coalesce(try_divide(mutant_cells, n), 0D)").alias("mutant_fraction"))


def proportions(dense: DataFrame, muts: DataFrame) -> DataFrame:
    """mut, p0, p1, pna: shares of states; a mutation without rows has 0, 0, 1."""
    share = dense.groupBy("mut").agg(*[F.avg(F.expr(f"CASE WHEN {c} THEN 1D ELSE 0D END")).alias(n) for n, c in (("p0", "state = 0"), ("p1", "state = 1"), ("pna", "state IS NULL"))])
    return muts.join(share, "mut", "left").select("mut", F.coalesce("p0", F.lit(0.0)).alias("p0"), F.coalesce("p1", F.lit(0.0)).alias("p1"), F.coalesce("pna", F.lit(1.0)).alias("pna"))


def missing_by_type(geno: DataFrame, cells: DataFrame, muts: DataFrame) -> DataFrame:
    """mut, cell_type, na: 1 - covered / cells of the type."""
    types = cells.groupBy("cell_type").agg(F.count("*").alias("n"))
    seen = geno.where("state IS NOT NULL").join(cells, "cell").groupBy("mut", "cell_type").agg(F.count("*").alias("k"))
    return muts.crossJoin(F.broadcast(types)).join(seen, ["mut", "cell_type"], "left").select("mut", "cell_type", F.expr("1 - coalesce(k, 0) / n").alias("na"), "n")


def informative(na: DataFrame, threshold: float | None = 0.95) -> DataFrame:
    """Mutations covered well enough. A type is informative where na is below the threshold (none: the third quartile over mutations).
    One type: it has to be; a type with over 90 % of the cells: that one; else two types."""
    na = na.withColumn("cut", F.lit(threshold) if threshold is not None else F.expr("percentile(na, 0.75D) OVER (PARTITION BY cell_type)"))
    types = na.select("cell_type", "n").distinct()
    shape = types.agg(F.count("*").alias("types"), F.expr("try_divide(max(n), sum(n))").alias("share"), F.max_by("cell_type", "n").alias("main"))
    rows = na.crossJoin(F.broadcast(shape)).withColumn("ok", F.expr("na < cut"))
    out = rows.groupBy("mut").agg(F.count_if("ok").alias("k"), F.max(F.expr("ok AND cell_type = main")).alias("in_main"), F.max("types").alias("types"), F.max("share").alias("share"))
    return out.where("CASE WHEN types = 1 THEN k >= 1 WHEN share > 0.9 THEN in_main ELSE k >= 2 END").select("mut")


def uniformity(obs: DataFrame, cells: DataFrame, cv: float = 6.0) -> DataFrame:
    """mut, median, mean, std, cv, pass: the covered indicator over all cells, and the median of covered totals."""
    n = cells.agg(F.countDistinct("cell").alias("n"))
    k = obs.where("total >= 1").join(cells.select("cell"), "cell", "left_semi").groupBy("mut").agg(F.count("*").alias("k"), F.expr("median(total)").alias("median"))
    out = k.crossJoin(F.broadcast(n)).withColumn("mean", F.expr("k / n")).withColumn("std", F.expr("sqrt(greatest(mean * (1 - mean), 0))")).withColumn("cv", F.expr("std / mean"))
    return out.select("mut", "median", "mean", "std", "cv", F.expr(f"cv <= {cv}D").alias("pass"))


def quality_mutations(obs: DataFrame, geno: DataFrame, cells: DataFrame, muts: DataFrame, threshold: float = 0.95, cv: float = 6.0, both: bool = False) -> DataFrame:
    """Kept mutations: informative ones and uniformly covered ones, together (both: uniform ones only)."""
    uniform = uniformity(obs, cells, cv).where("pass").select("mut")
    return uniform if both else informative(missing_by_type(geno, cells, muts), threshold).union(uniform).distinct()


def site_summary(obs: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """One row a mutation; the coverage of the cell of greatest fraction takes the least cell of equal ones."""
    return obs.groupBy("mut").agg(
        F.sum("total").alias("cov_in_pseudobulk"), F.avg(F.expr("nullif(total, 0)")).alias("avg_cov_percell"), F.avg(F.expr("nullif(vaf, 0)")).alias("avg_mutAF_percell"),
        F.max("vaf").alias("max_mutAF_percell"), F.expr("max_by(total, struct(vaf, -cell))").alias("cov_in_maxmutAFcell"), F.max("alt").alias("max_mutAllele_num"),
        F.sum("alt").alias("total_mutAllele_num"), F.count_if(F.expr("alt > 0")).alias("mutAllele_cellnum"), F.count_if(F.expr(f"p >= {cutoff}")).alias("moreCutoff_cellnum"),
        F.count_if(F.expr(f"alt > 0 AND p >= {cutoff}")).alias("mutant_cellnum"), F.expr(f"try_divide(count_if(alt > 0 AND p >= {cutoff}), count(*))").alias("mutant_cell_fraction"),
    )


def pseudo_bulk(obs: DataFrame) -> DataFrame:
    return obs.groupBy("mut").agg(F.sum("alt").alias("alt"), F.sum("total").alias("total"))


def bulk_table(obs: DataFrame) -> DataFrame:
    """mut, source, mutant, reference of the pseudo-bulk and of one cell, the one of least hash-like rule (largest total, then least cell)."""
    bulk = pseudo_bulk(obs).select("mut", F.lit("pseudo_bulk").alias("source"), F.col("alt").alias("mutant"), F.expr("total - alt").alias("reference"))
    one = obs.groupBy("mut").agg(F.expr("max_by(struct(alt, total), struct(total, -cell))").alias("c")).select("mut", F.lit("cell").alias("source"), F.col("c.alt").alias("mutant"), F.expr("c.total - c.alt").alias("reference"))
    return bulk.union(one)


def cluster_summary(spots: DataFrame) -> DataFrame:
    """By cluster: spots, mutant spots, sums, mean vaf, ratio; and whether its ratio is an upper outlier (above Q3 + 1.5 IQR)."""
    out = spots.groupBy("cluster").agg(F.count("*").alias("spots"), F.count_if(F.expr("alt > 0")).alias("mutant_spots"), F.sum("alt").alias("alt"), F.sum("depth").alias("depth"), F.avg("vaf").alias("mean_vaf"))
    out = out.withColumn("ratio", F.expr("try_divide(mutant_spots, spots)"))
    cut = out.agg(F.expr("percentile(ratio, 0.75D) + 1.5D * (percentile(ratio, 0.75D) - percentile(ratio, 0.25D))").alias("cut"))
    return out.crossJoin(F.broadcast(cut)).withColumn("outlier", F.expr("ratio > cut")).drop("cut")


def outlier_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("outlier").agg(F.count("*").alias("clusters"), F.sum("spots").alias("spots"), F.sum("alt").alias("alt"), F.sum("depth").alias("depth"))


def state_counts(dense: DataFrame) -> DataFrame:
    return dense.groupBy(F.coalesce(F.col("state").cast("string"), F.lit("NA")).alias("value")).agg(F.count("*").alias("n"))


def final_order(stats: DataFrame) -> DataFrame:
    """mut, place: mutations of 30 cells or more first, then in steps of five cells downwards; by fraction inside, then name. One row
    a mutation, so one ordered task is enough."""
    bucket = F.expr("CASE WHEN mutant_cells >= 30 THEN 6 ELSE mutant_cells div 5 END")
    w = Window.orderBy(F.desc(bucket), F.desc(F.round("mutant_fraction", 9)), "mut")
    return stats.select("mut", "mutant_cells", "mutant_fraction", F.row_number().over(w).alias("place"))


def freeze_ones(geno: DataFrame, groups: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mut, place), (cell, first): mutations by group and fraction downwards; a cell's key is the first of them at which it is 1."""
    w = Window.orderBy("grp", F.desc(F.round("mutant_fraction", 9)), "mut")
    muts = groups.join(stats, "mut").select("mut", F.row_number().over(w).alias("place"))
    keyed = geno.where("state = 1").join(muts, "mut").groupBy("cell").agg(F.min("place").alias("first"))
    everyone = geno.select("cell").distinct().join(keyed, "cell", "left")
    return muts, everyone.select("cell", F.coalesce("first", F.lit(1 << 30)).alias("first"))


def founders(groups: DataFrame, stats: DataFrame) -> DataFrame:
    """grp, founder: the mutation of most mutant cells, the least name of equal ones."""
    w = Window.partitionBy("grp").orderBy(F.desc("mutant_cells"), "mut")
    return groups.join(stats, "mut").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("grp", F.col("mut").alias("founder"), "mutant_cells")


def cumulative_share(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Share of each value and the running share from the greatest value down. counts has one row a value."""
    w = Window.orderBy(F.desc(value))
    out = counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy()))
    return out.withColumn("running", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def trimmed_cut(scores: DataFrame, value: str = "prob", trim: float = 0.05, k: float = 1.5, floor: float = 0.1) -> DataFrame:
    """cut: mean + k standard deviations of the values without the share `trim` at each end, at least the floor."""
    w = Window.orderBy(value, "mut")
    ranked = scores.select(value, F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    inner = ranked.where(f"r > floor(n * {trim}D) AND r <= n - floor(n * {trim}D)")
    return inner.agg(F.expr(f"greatest({floor}D, avg({value}) + {k}D * stddev_pop({value}))").alias("cut"))


def ladder_cut(scores: DataFrame, value: str = "prob", ladder: tuple[float, ...] = (2.6, 2.0, 1.5, 1.0)) -> DataFrame:
    """cut: mean + k deviations with the first k that keeps it at most 0.9, else the last; held to [0.1, 0.9]."""
    s = scores.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    k = "CASE " + " ".join(f"WHEN m + {k}D * s <= 0.9D THEN {k}D" for k in ladder) + f" ELSE {ladder[-1]}D END"
    return s.select(F.expr(f"least(0.9D, greatest(0.1D, m + ({k}) * s))").alias("cut"))


def overlap_candidates(ranges: DataFrame) -> DataFrame:
    """Candidates lo, hi that may still be best: lo at most the greatest hi among those of least lo."""
    least = ranges.agg(F.min("lo").alias("least"))
    top = ranges.crossJoin(F.broadcast(least)).where("lo = least").agg(F.max("hi").alias("bar"))
    return ranges.crossJoin(F.broadcast(top)).where("lo <= bar").drop("bar")


def equal_columns(geno: DataFrame) -> DataFrame:
    """node, members: mutations with the same mutant cells become one node, named by its members joined by |."""
    sig = geno.where("state = 1").groupBy("mut").agg(F.sort_array(F.collect_list("cell")).alias("sig"))
    out = sig.groupBy("sig").agg(F.array_sort(F.collect_list("mut")).alias("members"))
    return out.select(F.expr("array_join(transform(members, x -> cast(x AS string)), '|')").alias("node"), F.size("members").alias("n"))


def phylip(geno: DataFrame, muts: DataFrame) -> DataFrame:
    """cell, sequence: R for 0, A for 1, - for missing, in the order of mutations."""
    full = geno.select("cell").distinct().crossJoin(F.broadcast(muts)).join(geno, ["cell", "mut"], "left")
    letter = F.expr("CASE state WHEN 1 THEN 'A' WHEN 0 THEN 'R' ELSE '-' END")
    return full.groupBy("cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mut", letter.alias("c")))), lambda x: x["c"]), "").alias("sequence"))


def clone_signatures(geno: DataFrame) -> DataFrame:
    """signature, cells: cells with equal lists of mutations are one subclone."""
    per = geno.where("state = 1").groupBy("cell").agg(F.array_sort(F.collect_list("mut")).alias("s"))
    return per.groupBy(F.expr("array_join(transform(s, x -> cast(x AS string)), '|')").alias("signature")).agg(F.count("*").alias("cells"))


def absorb_subsets(signatures: DataFrame) -> DataFrame:
    """signature, cells, into: a subclone whose mutations are a proper part of another's goes into the least such of most mutations.
    Subclones are few next to cells; the test joins on a shared first mutation."""
    s = signatures.select("signature", "cells", F.expr("transform(split(signature, '[|]'), x -> cast(x AS bigint))").alias("m"))
    big = s.select(F.col("signature").alias("into"), F.col("m").alias("b"), F.explode("m").alias("k"))
    small = s.withColumn("k", F.col("m")[0])
    fits = small.join(big, "k").where("size(b) > size(m) AND size(array_except(m, b)) = 0")
    into = fits.groupBy("signature").agg(F.expr("max_by(into, struct(size(b), into))").alias("into"))
    return signatures.join(into, "signature", "left")


def plot_order(geno: DataFrame, cells: DataFrame, stats: DataFrame) -> DataFrame:
    """cell, cell_type, n, place: cells ordered by their first mutation in `final_order` and then by how many they have."""
    order = final_order(stats).select("mut", "place")
    per = geno.where("state = 1").join(order, "mut").groupBy("cell").agg(F.min("place").alias("clone_order"), F.count("*").alias("n"))
    return per.join(cells, "cell").select("cell", "cell_type", "clone_order", "n", F.row_number().over(Window.partitionBy("clone_order").orderBy(F.desc("n"), "cell")).alias("place"))


def clone_labels(geno: DataFrame, founders_: DataFrame) -> DataFrame:
    """cell, label (C1..): a label for each backbone mutation that the cell has, numbered in the order of groups."""
    w = Window.orderBy("grp")
    names = founders_.select(F.col("founder").alias("mut"), F.concat(F.lit("C"), F.dense_rank().over(w).cast("string")).alias("label"))
    return geno.where("state = 1").join(names, "mut").select("cell", "label", F.col("mut").alias("backbone"))


def cell_quality(counts: DataFrame, mitochondrial: str = "gene LIKE 'MT-%'", share: float = 0.25, genes: int = 500) -> DataFrame:
    """Cells of (cell, gene, n) with a mitochondrial share below the cut and more genes than the cut."""
    return counts.groupBy("cell").agg(F.expr(f"try_divide(sum(CASE WHEN {mitochondrial} THEN n ELSE 0 END), sum(n))").alias("mt"), F.count_if(F.col("n") > 0).alias("genes")).where(f"mt < {share} AND genes > {genes}")

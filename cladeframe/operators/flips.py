"""Observed against imputed genotypes: flips, false positives and negatives, retention, conflicts with an outgroup.

`observed` is dense (cell, mut, state; null: not covered); `imputed` lists the 1s (cell, mut)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import closure

KINDS = {"fn": "state = 0 AND v = 1", "fp": "state = 1 AND v = 0", "na0": "state IS NULL AND v = 0", "na1": "state IS NULL AND v = 1"}


def compare(observed: DataFrame, imputed: DataFrame) -> DataFrame:
    """cell, mut, state, v for every observed row."""
    return observed.join(imputed.select("cell", "mut", F.lit(1).alias("v")), ["cell", "mut"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def flip_counts(rows: DataFrame, *by: str) -> DataFrame:
    """fn (0 to 1), fp (1 to 0), na0, na1, same; in all or by mut or cell."""
    same = F.count_if(F.expr("state IS NOT NULL AND state = v")).alias("same")
    return rows.groupBy(*by).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in KINDS.items()], same)


def flip_lists(rows: DataFrame) -> DataFrame:
    """mut and for each kind its cells, sorted, joined by commas."""
    parts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.expr(f"CASE WHEN {c} THEN cell END"))), lambda x: x.cast("string")), ",").alias(n) for n, c in KINDS.items()]
    return rows.groupBy("mut").agg(*parts)


def flip_codes(rows: DataFrame) -> DataFrame:
    """cell, mut, code: observed>imputed, 3 for missing."""
    return rows.select("cell", "mut", F.concat_ws(">", F.coalesce("state", F.lit(3)).cast("string"), F.col("v").cast("string")).alias("code"))


def across_tree_ratios(rows: DataFrame) -> DataFrame:
    """mut, fp_ratio, fn_ratio. fp_ratio: mean over other mutations of their false positives inside this one's imputed cells by all
    of theirs (0 without any). fn_ratio: observed 0s among the imputed cells, by those and the observed 1s in cells that have more than one 1."""
    fp = rows.where(KINDS["fp"]).select("cell", F.col("mut").alias("o"))
    total = fp.groupBy("o").agg(F.count("*").alias("n"))
    cells = rows.where("v = 1").select("cell", "mut")
    inside = cells.join(fp, "cell").where("mut <> o").groupBy("mut", "o").agg(F.count("*").alias("k")).join(total, "o")
    sums = inside.groupBy("mut").agg(F.sum(F.expr("k / n")).alias("s"))
    muts = rows.select("mut").distinct()
    others = muts.agg((F.count("*") - 1).alias("others"))
    rich = rows.where("state = 1").groupBy("cell").agg(F.count("*").alias("c")).where("c > 1").select("cell")
    ones = rows.where("state = 1").join(rich, "cell", "left_semi").groupBy("mut").agg(F.count("*").alias("ones"))
    zeros = rows.where("v = 1 AND state = 0").groupBy("mut").agg(F.count("*").alias("zeros"))
    out = muts.join(sums, "mut", "left").join(zeros, "mut", "left").join(ones, "mut", "left").crossJoin(F.broadcast(others))
    return out.select("mut", F.expr("coalesce(try_divide(s, others), 0D)").alias("fp_ratio"), F.expr("coalesce(try_divide(coalesce(zeros, 0), coalesce(zeros, 0) + coalesce(ones, 0)), 0D)").alias("fn_ratio"))


def subclone_ratios(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """mut, out_ratio, in_ratio: the share of a mutation's imputed cells that are false positives of a mutation of other groups, and of
    its own (a group of one: 0)."""
    cells = rows.where("v = 1").select("cell", "mut")
    size = cells.groupBy("mut").agg(F.count("*").alias("n"))
    g = groups
    fp = rows.where(KINDS["fp"]).select("cell", F.col("mut").alias("o")).join(g.toDF("o", "go"), "o")
    pairs = cells.join(g.toDF("mut", "gm"), "mut").join(fp, "cell").where("mut <> o")
    side = lambda c: pairs.where(c).select("mut", "cell").distinct().groupBy("mut").agg(F.count("*").alias("k"))
    out = side("gm <> go").withColumnRenamed("k", "ko").join(side("gm = go").withColumnRenamed("k", "ki"), "mut", "full")
    return size.join(out, "mut", "left").select("mut", F.expr("coalesce(ko, 0) / n").alias("out_ratio"), F.expr("coalesce(ki, 0) / n").alias("in_ratio"))


def site_ratio(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """mut, fp, ones, ratio: false positives among a mutation's observed 1s in the cells of its own group."""
    g = groups
    inside = rows.where("v = 1").join(g, "mut").select("grp", "cell").distinct()
    own = rows.where("state = 1").join(g, "mut").join(inside, ["grp", "cell"], "left_semi")
    return own.groupBy("mut").agg(F.count_if(F.col("v") == 0).alias("fp"), F.count("*").alias("ones")).withColumn("ratio", F.expr("fp / ones"))


def false_positive_cells(rows: DataFrame) -> DataFrame:
    """mut, fp, ratio, others: false positives, their share of observed 1s, and the other mutations that are imputed in those cells."""
    fp = rows.where(KINDS["fp"]).select("cell", "mut")
    ones = rows.where("state = 1").groupBy("mut").agg(F.count("*").alias("ones"))
    other = fp.join(rows.where("v = 1").select("cell", F.col("mut").alias("o")), "cell").where("mut <> o").groupBy("mut").agg(F.array_sort(F.collect_set("o")).alias("o"))
    out = ones.join(fp.groupBy("mut").agg(F.count("*").alias("fp")), "mut", "left").join(other, "mut", "left")
    return out.select("mut", F.expr("coalesce(fp, 0)").alias("fp"), F.expr("coalesce(fp, 0) / ones").alias("ratio"), F.expr("coalesce(array_join(transform(o, x -> cast(x AS string)), ','), '')").alias("others"))


def false_positives_by_cell(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.count_if(F.expr(KINDS["fp"])).alias("fp"), F.count_if(F.col("state") == 1).alias("ones")).withColumn("ratio", F.expr("coalesce(try_divide(fp, ones), 0D)"))


def false_positive_summary(rows: DataFrame) -> DataFrame:
    per = false_positive_cells(rows)
    return per.agg(F.avg("ratio").alias("mean"), F.expr("median(ratio)").alias("median"), F.sum("fp").alias("fp"))


def retention(observed: DataFrame, imputed: DataFrame, tree: DataFrame) -> DataFrame:
    """mut, kept, flips, ratio, cells: over a mutation's cells that are 1 in both, and all its ancestors: pairs in which the ancestor is
    observed 1, pairs in which it was turned to 1 from 0, kept by both, and distinct cells of the former. Without ancestors or cells: 1."""
    rows = compare(observed, imputed)
    retained = rows.where("state = 1 AND v = 1").select("cell", "mut")
    up = closure(tree).where("depth > 0").select(F.col("node").alias("mut"), F.col("ancestor").alias("a"))
    pairs = retained.join(up, "mut").join(rows.select("cell", F.col("mut").alias("a"), "state", "v"), ["cell", "a"])
    out = pairs.groupBy("mut").agg(F.count_if(F.expr("state = 1")).alias("kept"), F.count_if(F.expr(KINDS["fn"])).alias("flips"), F.count_distinct(F.expr("CASE WHEN state = 1 THEN cell END")).alias("cells"))
    full = rows.select("mut").distinct().join(out, "mut", "left")
    return full.select("mut", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("flips", F.lit(0)).alias("flips"), F.expr("coalesce(try_divide(kept, kept + flips), 1D)").alias("ratio"), F.coalesce("cells", F.lit(0)).alias("cells"))


def cell_support(rows: DataFrame) -> DataFrame:
    """cell, both (1 in both), fn, to_one (0 or missing turned to 1)."""
    return rows.groupBy("cell").agg(F.count_if(F.expr("state = 1 AND v = 1")).alias("both"), F.count_if(F.expr(KINDS["fn"])).alias("fn"), F.count_if(F.expr("v = 1 AND (state IS NULL OR state = 0)")).alias("to_one"))


def removable_cells(support: DataFrame, both: int = 1, fn: int = 1, to_one: int = 2) -> DataFrame:
    return support.where(f"both = {both} AND fn >= {fn} AND to_one >= {to_one}").select("cell")


def outgroup_conflicts(rows: DataFrame, outgroup: DataFrame) -> DataFrame:
    """cell, main, out, decision: cells imputed in both the tree and an outgroup mutation; the side with more observed 1s wins, a tie goes to
    the outgroup."""
    marked = rows.join(outgroup.select("mut", F.lit(1).alias("o")), "mut", "left").withColumn("o", F.coalesce("o", F.lit(0)))
    per = marked.groupBy("cell").agg(
        F.count_if(F.expr("o = 0 AND v = 1")).alias("vm"), F.count_if(F.expr("o = 1 AND v = 1")).alias("vo"),
        F.count_if(F.expr("o = 0 AND v = 1 AND state = 1")).alias("main"), F.count_if(F.expr("o = 1 AND v = 1 AND state = 1")).alias("out"),
    )
    return per.where("vm > 0 AND vo > 0").select("cell", "main", "out", F.expr("CASE WHEN main > out THEN 'main' ELSE 'outgroup' END").alias("decision"))


def conflicting_cells(rows: DataFrame, outgroup: DataFrame) -> DataFrame:
    return outgroup_conflicts(rows, outgroup).select("cell")


def resolve_outgroup(imputed: DataFrame, decisions: DataFrame, outgroup: DataFrame) -> DataFrame:
    """imputed without, in each conflicting cell, the losing side's 1s."""
    marked = imputed.join(outgroup.select("mut", F.lit(True).alias("o")), "mut", "left").join(decisions.select("cell", "decision"), "cell", "left")
    return marked.where("decision IS NULL OR (decision = 'outgroup') = coalesce(o, false)").select("cell", "mut")


def metric_versions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two versions of a metric table, their columns suffixed _1 and _2, by key."""
    one = a.select(key, *[F.col(c).alias(f"{c}_1") for c in a.columns if c != key])
    return one.join(b.select(key, *[F.col(c).alias(f"{c}_2") for c in b.columns if c != key]), key, "left")

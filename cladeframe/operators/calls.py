"""Genotype calls, parsing and row-level filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ":,/| ;"  # fixed: the first one present splits an allele entry
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _number(text: str) -> str:
    return f"CASE WHEN trim({text}) rlike '{_NUMBER}' THEN try_cast(trim({text}) AS double) END"


def parse_allele_entry(df: DataFrame, entry: str = "entry") -> DataFrame:
    """Adds ref, alt, total (long) and maf (double). Two numbers are alt and total; total < alt, blanks and
    words are missing; a whole number is coverage, a fraction in [0, 1] an allele fraction, another number rounds
    to coverage."""
    text = f"trim(coalesce({entry}, ''))"
    sep = "CASE " + " ".join(f"WHEN instr({text}, '{c}') > 0 THEN '{c}'" for c in SEPARATORS) + " END"
    df = df.withColumn("_sep", F.expr(sep))
    df = df.withColumn("_parts", F.expr(f"CASE WHEN _sep IS NOT NULL THEN split({text}, concat('[', _sep, ']')) END"))
    df = df.withColumn("_a", F.expr(_number("_parts[0]"))).withColumn("_t", F.expr(f"CASE WHEN size(_parts) = 2 THEN {_number('_parts[1]')} END"))
    df = df.withColumn("_one", F.expr(f"CASE WHEN _sep IS NULL THEN {_number(text)} END"))
    pair = "_a IS NOT NULL AND _t IS NOT NULL AND _t >= _a"
    whole = f"_one IS NOT NULL AND NOT contains({text}, '.')"
    fraction = f"_one IS NOT NULL AND contains({text}, '.') AND _one BETWEEN 0 AND 1"
    df = df.withColumn("alt", F.expr(f"CASE WHEN {pair} THEN cast(_a AS long) END"))
    df = df.withColumn("total", F.expr(f"CASE WHEN {pair} THEN cast(_t AS long) WHEN _one IS NOT NULL AND NOT ({fraction}) THEN cast(rint(_one) AS long) END"))
    df = df.withColumn("ref", F.expr("total - alt"))
    df = df.withColumn("maf", F.expr(f"CASE WHEN {pair} THEN CASE WHEN _t = 0 THEN 0D ELSE _a / _t END WHEN {fraction} AND NOT ({whole}) THEN _one END"))
    return df.drop("_sep", "_parts", "_a", "_t", "_one")


def derive_from_reads(df: DataFrame) -> DataFrame:
    """Of parsed entries: vaf, coverage, alleles. Both counts: (alt / total, total, alt), a total of 0 is uncovered; a
    fraction only: (maf, 1, rounded maf); coverage only: (missing, coverage, 0); nothing: (missing, 0, 0)."""
    return df.select(
        "*",
        F.expr("CASE WHEN alt IS NOT NULL THEN CASE WHEN total > 0 THEN alt / total END WHEN maf IS NOT NULL THEN maf END").alias("vaf"),
        F.expr("CASE WHEN total IS NOT NULL THEN total WHEN maf IS NOT NULL THEN 1 ELSE 0 END").alias("coverage"),
        F.expr("CASE WHEN alt IS NOT NULL THEN alt WHEN maf IS NOT NULL THEN cast(rint(maf) AS long) ELSE 0 END").alias("alleles"),
    )


def genotype(df: DataFrame, p_thresh: float = 0.5) -> DataFrame:
    """state: null uncovered; 1 with mutant reads and a posterior above the threshold; else 0."""
    return df.withColumn("state", F.expr(f"CASE WHEN total >= 1 THEN CASE WHEN coalesce(vaf, 0) > 0 AND coalesce(p, 0) > {p_thresh} THEN 1 ELSE 0 END END"))


def ternary(df: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """state with 3 for missing: 1 when the posterior is in (cutoff, 1] and mutant reads exist."""
    return df.withColumn("state", F.expr(f"CASE WHEN p IS NULL THEN 3 WHEN p > {cutoff} AND p <= 1 AND alt > 0 THEN 1 ELSE 0 END"))


def initial_filter(obs: DataFrame, p_thresh: float = 0.5, maf_max: float = 0.3, maf_mean: float = 0.1) -> DataFrame:
    """Cells with a positive fraction and a posterior above the threshold, then mutations by the greatest and the mean positive
    fraction in those cells."""
    good = obs.groupBy("cell").agg(F.max("vaf").alias("v"), F.max("p").alias("q")).where(f"v > 0 AND q > {p_thresh}").select("cell")
    kept = obs.join(good, "cell", "left_semi")
    muts = kept.groupBy("mut").agg(F.max("vaf").alias("v"), F.avg(F.expr("CASE WHEN vaf > 0 THEN vaf END")).alias("a"))
    return kept.join(muts.where(f"v >= {maf_max} AND a >= {maf_mean}").select("mut"), "mut", "left_semi")


def drop_empty(geno: DataFrame) -> DataFrame:
    """Without mutations that are never 1, then without cells that have no 1."""
    ones = geno.where("state = 1")
    return geno.join(ones.select("mut").distinct(), "mut", "left_semi").join(ones.select("cell").distinct(), "cell", "left_semi")


def mutant_cells(obs: DataFrame, cutoff: float) -> DataFrame:
    """Observations of cells with a site whose posterior exceeds the cutoff and that has mutant reads."""
    return obs.join(obs.where(f"p > {cutoff} AND alt >= 1").select("cell").distinct(), "cell", "left_semi")


def phylogeny_label(df: DataFrame, high: float = 0.9, low: float = 0.1) -> DataFrame:
    """label from mutant_cells, posterior, one_cell."""
    return df.withColumn("label", F.expr(f"CASE WHEN mutant_cells = 1 THEN 'cell_specific' WHEN mutant_cells = 0 THEN 'absent' WHEN posterior >= {high} AND one_cell < {low} THEN 'successful_pass' ELSE 'failed_pass' END"))


def annotation_filter(df: DataFrame, least: float = 0.85) -> DataFrame:
    """pass_umi, pass_ase, pass_editing of consistency, ase, editing (null: not annotated)."""
    return df.select("*", F.expr(f"coalesce(consistency >= {least}, false)").alias("pass_umi"), F.expr("coalesce(ase, 'Unknown') IN ('Unknown', 'False')").alias("pass_ase"), F.expr("coalesce(editing, 'False') = 'False'").alias("pass_editing"))


def germline_rescue(df: DataFrame, fraction: float = 0.5, cells: int = 5) -> DataFrame:
    """Of rows mut, germline, mutant_fraction, mutant_cells: still germline, i.e. predicted, of a fraction not below the limit and in more
    cells than the limit; the others are somatic again."""
    return df.withColumn("germline", F.expr(f"germline AND mutant_fraction >= {fraction} AND mutant_cells > {cells}"))


def informative_inside(geno: DataFrame, clone: DataFrame) -> DataFrame:
    """Mutations with both a 1 and a 0 in the cells of a clone."""
    inside = geno.join(clone.select("cell"), "cell", "left_semi").groupBy("mut").agg(F.max("state").alias("hi"), F.min("state").alias("lo"))
    return inside.where("hi = 1 AND lo = 0").select("mut")


def merge_nodes(geno: DataFrame, node_mut: DataFrame) -> DataFrame:
    """cell, node, state: a node's state is the greatest of its mutations', null when all are."""
    return geno.join(node_mut, "mut").groupBy("cell", "node").agg(F.max("state").alias("state"))


def split_nodes(merged: DataFrame, node_mut: DataFrame) -> DataFrame:
    """cell, mut, state from node states."""
    return merged.join(node_mut, "node").select("cell", "mut", "state")


def node_key(names: Column) -> Column:
    """The normal form of a merged name: members sorted, joined by |."""
    return F.array_join(F.array_sort(F.split(names, "[|]")), "|")


def immune_split(geno: DataFrame, immune: DataFrame) -> DataFrame:
    """cell (text), mut, state. A cell that has 1s of both immune and other mutations becomes two, `-immune` and `-non`, each with
    the other side's states missing; other cells stay."""
    marked = geno.join(immune.select("mut", F.lit(True).alias("immune")), "mut", "left").withColumn("immune", F.coalesce("immune", F.lit(False)))
    both = marked.where("state = 1").groupBy("cell").agg(F.max("immune").alias("a"), F.min("immune").alias("b")).where("a AND NOT b").select("cell", F.lit(True).alias("two"))
    rows = marked.join(both, "cell", "left").withColumn("side", F.explode(F.expr("CASE WHEN two THEN array('immune', 'non') ELSE array('') END")))
    state = "CASE WHEN side = '' OR (side = 'immune') = immune THEN state END"
    return rows.select(F.expr("CASE WHEN side = '' THEN cast(cell AS string) ELSE concat(cell, '-', side) END").alias("cell"), "mut", F.expr(state).alias("state"))


def class_decode(df: DataFrame, ladder: list[tuple[str, float]]) -> DataFrame:
    """label: the first class of the ladder whose probability (column p_<class>) exceeds its cut; else the likeliest class, first of
    equal ones."""
    names = list(dict.fromkeys(c for c, _ in ladder))
    best = "CASE " + " ".join(f"WHEN p_{c} = greatest({', '.join('p_' + x for x in names)}) THEN '{c}'" for c in names) + " END" if len(names) > 1 else f"'{names[0]}'"
    cases = " ".join(f"WHEN p_{c} > {cut} THEN '{c}'" for c, cut in ladder)
    return df.withColumn("label", F.expr(f"CASE {cases} ELSE {best} END"))


SCRNA_LADDER = [("mosaic", 0.4), ("artifact", 0.6), ("mosaic", 0.2)]
SCDNA_LADDER = [("mosaic", 0.5), ("germline", 0.6), ("repeat", 0.6), ("mosaic", 0.2)]


def spatial_flags(spots: DataFrame, prob: float = 0.5, likelihood: float = 0.5) -> DataFrame:
    """Of depth, vaf, p, likelihood: has_mutant_allele, high_prob, high_likelihood, mutated, mutant_allele_num."""
    return spots.select(
        "*", F.expr("vaf > 0").alias("has_mutant_allele"), F.expr(f"p > {prob}").alias("high_prob"), F.expr(f"likelihood > {likelihood}").alias("high_likelihood"),
        F.expr(f"vaf > 0 AND p > {prob} AND likelihood > {likelihood}").alias("mutated"), F.expr("cast(ceil(depth * vaf) AS long)").alias("mutant_allele_num"),
    )

"""From files to a tree: the four modes, their parameters and their outputs."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators import calls, flips, growth, matrix, pairs
from cladeframe.sources import sinks, tables


@dataclass(frozen=True)
class Mode:
    """Parameters of a run. Matrices are read as posteriors, likelihoods and allele counts, or (binary) as one table of states."""

    binary: bool = False
    p_thresh: float = 0.5  # posterior of a mutant state
    quality: bool = False  # whether mutations are filtered by fraction and coverage before the scaffold
    posterior: float = 0.5
    maf_max: float = 0.3
    maf_mean: float = 0.1
    missing: float = 0.95
    cv: float = 6.0
    runs: int = 100
    resolution: float = 1.0
    omega: float = 0.001
    fnfp: float = 0.1
    phi: float = 1.0
    fp_across: float = 0.2
    fn_across: float = 0.9
    fp_cells: float = 0.2  # share of a mutation's cells that may be false positives
    seed: int = 42

    @property
    def weights(self) -> growth.Weights:
        return growth.Weights(self.fnfp, self.omega, self.phi)


# The parameters that differ between modes
MODES = {
    "binary": Mode(binary=True, p_thresh=0.9, resolution=0.1, fnfp=1.0, fp_cells=0.4),
    "scdna": Mode(p_thresh=0.9, quality=True, resolution=0.1, fnfp=1.0, fp_cells=0.4),
    "scrna": Mode(quality=True),
    "spatial": Mode(quality=True),
}


@dataclass(frozen=True)
class Outcome:
    """geno: states that went in; result: tree and what found no place; imputed: cell, mut at 1; tree: node, parent; rows: cell, mut, state, v;
    totals: flips of each kind."""

    geno: DataFrame
    result: growth.Result
    imputed: DataFrame
    tree: DataFrame
    rows: DataFrame
    totals: dict[str, int]


def states(spark: SparkSession, source: str, mode: Mode) -> tuple[DataFrame, DataFrame]:
    """(obs, geno) of a file (binary) or a folder of matrices."""
    if mode.binary:
        obs = tables.read_binary_matrix(spark, source)
        return obs, obs.select("cell", "mut", "state")
    obs, _, _ = tables.load_all(spark, source)
    return obs, calls.genotype(obs, mode.p_thresh).select("cell", "mut", "state")


def kept_mutations(obs: DataFrame, geno: DataFrame, mode: Mode, cell_types: DataFrame | None = None) -> DataFrame:
    """mut: mutations for the scaffold: fractions first, then informative or uniformly covered ones. cell_types: cell, cell_type; one type without."""
    cells = obs.select("cell").distinct()
    types = cells.withColumn("cell_type", F.lit("default")) if cell_types is None else cells.join(cell_types, "cell", "left").select("cell", F.coalesce("cell_type", F.lit("default")).alias("cell_type"))
    some = calls.initial_filter(obs, mode.posterior, mode.maf_max, mode.maf_mean).select("mut").distinct()
    good = matrix.quality_mutations(obs.join(some, "mut", "left_semi"), geno.join(some, "mut", "left_semi"), types, some, mode.missing, mode.cv)
    return good.join(some, "mut", "left_semi")


def run(spark: SparkSession, source: str, mode: Mode | str, immune: list[str] | None = None, cell_types: DataFrame | None = None) -> Outcome:
    """Reads, filters, groups, grows and repairs. Mutations that no group takes are attached to the full tree; what stays without a place is
    result.external. A run without a mutant state gives an empty tree."""
    mode = MODES[mode] if isinstance(mode, str) else mode
    obs, geno = states(spark, source, mode)
    if immune:
        geno = calls.immune_split(geno, spark.createDataFrame([(m,) for m in immune], "mut string"))
    geno = calls.drop_empty(geno)
    first = geno.join(kept_mutations(obs, geno, mode, cell_types), "mut", "left_semi") if mode.quality else geno
    result, bits = growth.scaffold(first, mode.runs, mode.resolution, mode.weights, mode.seed)
    if mode.quality:  # the others join the full tree
        whole = growth.Matrix.collect(geno)
        result = replace(result, tree=moved(result.tree, bits, whole), external=(*result.external, *sorted(set(whole.ones) - set(bits.ones))))
        bits = whole
    result = growth.full_tree(result, bits, mode.weights, mode.fp_across, mode.fn_across)
    imputed, tree = growth.as_frames(spark, result, bits)
    text = geno.select(F.col("cell").cast("string").alias("cell"), F.col("mut").cast("string").alias("mut"), "state").join(imputed.select("mut").distinct(), "mut", "left_semi")
    rows = flips.compare(text, imputed.withColumn("v", F.lit(1)))
    return Outcome(geno, result, imputed, tree, rows, growth.flips(result.tree, bits, mode.weights))


def moved(tree: growth.Tree, old: growth.Matrix, new: growth.Matrix) -> growth.Tree:
    """The tree's cell sets over another matrix's cells."""
    at = {c: i for i, c in enumerate(new.cells)}
    place = [at[c] for c in old.cells]
    return growth.Tree(tree.parent, {n: sum(1 << place[i] for i in range(len(place)) if bits >> i & 1) for n, bits in tree.cells.items()})


def write(outcome: Outcome, folder: str | Path) -> None:
    """The conflict-free matrix, states with 3 for missing, flips of each mutation and in total, the tree in three forms, the hierarchy and a report."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    muts = sorted(outcome.result.tree.mutations())
    sinks.write_tree(outcome.result.tree, folder)
    (folder / "report.txt").write_text(sinks.report(outcome.result.tree, outcome.result.external) + "\n")
    (folder / "hierarchy.csv").write_text("\n".join(["mutation,main_group,sub_group,is_backbone", *(",".join(map(str, r)) for r in sinks.hierarchy(outcome.result.tree))]) + "\n")
    names = {"fn": "False_Negative", "fp": "False_Positive", "na0": "NA_to_0", "na1": "NA_to_1"}
    (folder / "total_flips.txt").write_text("\t".join(f"total_flipping_{n}" for n in names.values()) + "\n" + "\t".join(str(outcome.totals[k]) for k in names) + "\n")
    if muts:
        sinks.write_cf_matrix(outcome.imputed, muts, str(folder / "matrix.CFMatrix"))
        sinks.write_states(outcome.geno.join(outcome.imputed.select("mut").distinct(), "mut", "left_semi"), muts, str(folder / "states"))
        flips.flip_lists(outcome.rows).orderBy("mut").write.mode("overwrite").option("sep", "\t").option("header", True).csv(str(folder / "flips"))


def conflicts(outcome: Outcome) -> int:
    """Pairs of mutations of the imputed matrix that contradict a tree: 0."""
    dense = outcome.imputed.select("cell").distinct().crossJoin(outcome.imputed.select("mut").distinct()).join(outcome.imputed.withColumn("state", F.lit(1)), ["cell", "mut"], "left")
    return pairs.conflicts(dense.select("cell", "mut", F.coalesce("state", F.lit(0)).alias("state"))).count()

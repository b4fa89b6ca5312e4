"""Sinks: wide matrices, flips, trees, tree input."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators import pairs


def wide(df: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """One column a name; give the names where they are known, else they are looked up."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value)).orderBy(row)


def write_cf_matrix(imputed: DataFrame, muts: list, path: str, judge: bool = True) -> None:
    """cellIDxmutID and a 0/1 column a mutation, tab-separated. With judge a matrix that has conflicts is refused."""
    dense = imputed.select("cell").distinct().crossJoin(F.broadcast(imputed.select("mut").distinct())).join(imputed.select("cell", "mut", F.lit(1).alias("state")), ["cell", "mut"], "left").withColumn("state", F.coalesce("state", F.lit(0)))
    if judge and pairs.conflicts(dense).limit(1).count():
        raise ValueError("the matrix has conflicts")
    out = wide(dense, "cell", "mut", "state", muts).na.fill(0)
    out.withColumnRenamed("cell", "cellIDxmutID").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_states(geno: DataFrame, muts: list, path: str, missing: int = 3, transpose: bool = False) -> None:
    """States with a number for missing, cells as rows or, transposed, as columns."""
    filled = geno.withColumn("state", F.coalesce("state", F.lit(missing)))
    out = wide(filled, "mut", "cell", "state") if transpose else wide(filled, "cell", "mut", "state", muts)
    out.na.fill(missing).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_tree(tree, folder: str | Path) -> None:
    """T.json, T.txt, T.newick of a grown tree."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "T.json").write_text(json.dumps(tree.as_dict(), indent=2))
    (folder / "T.txt").write_text(tree.text() + "\n")
    (folder / "T.newick").write_text(tree.newick() + "\n")


def hierarchy(tree) -> list[tuple[str, str, str, bool]]:
    """mutation, main_group (the backbone's first mutation), node, is_backbone."""
    out = []
    for n in sorted(tree.parent):
        top = tree.lineage(n)[-1]
        out += [(m, top.split("|")[0], n, n == top) for m in n.split("|")]
    return out


def report(tree, external: tuple[str, ...] = ()) -> str:
    """Main groups with their sizes and mutations, then what found no place."""
    lines = [f"main groups: {len(tree.children('ROOT'))}"]
    for c in tree.children("ROOT"):
        ms = [m for n in (c, *sorted(tree.below(c) - {c})) for m in n.split("|")]
        lines.append(f"{c}: {len(ms)} mutations: {', '.join(ms)}")
    return "\n".join([*lines, f"external: {', '.join(external) or 'none'}"])


def tree_input_lines(obs: DataFrame, bulk: DataFrame, sample: str, barcodes: list[str]) -> DataFrame:
    """value: the raw tree-input line of each mutation; obs: cell, mut, p, ll_mut, ll_unmut, alt, total; bulk: mut, posterior, entry."""
    order = F.array(*[F.lit(b) for b in barcodes])
    per = obs.groupBy("mut").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("p", "ll_mut", "ll_unmut", F.concat_ws("/", F.col("alt").cast("string"), F.col("total").cast("string")).alias("e"))))).alias("m"))
    text = lambda k: F.array_join(F.transform(order, lambda b: F.coalesce(F.col("m")[b][k].cast("string"), F.lit("NA"))), ",")
    parts = F.split("mut", "_")
    return per.join(bulk, "mut").select(F.concat_ws(",", F.lit(sample), *[parts[i] for i in range(4)], F.col("posterior").cast("string"), text("p"), text("ll_mut"), text("ll_unmut"), "entry", text("e")).alias("value"))

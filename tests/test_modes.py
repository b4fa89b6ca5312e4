"""Runs from files to outputs, and the sources that feed them."""

import itertools
import json
import math
import random

import pytest

from cladeframe.functions import tests_of as T
from cladeframe.plans import modes
from cladeframe.sources import tables


def nested(n_cells, seed):
    """States of a small tree: a above b and c, d apart; a few unknown."""
    rng = random.Random(seed)
    rows = {}
    for i in range(n_cells):
        a = i < n_cells // 2
        rows[f"cell{i:02}"] = {"1_10_A_T": a, "1_20_A_T": a and i % 2 == 0, "1_30_A_T": a and i % 2 == 1, "2_10_C_G": not a and i % 5 < 3}
    return rows, {(c, m) for c in rows for m in rows[c] if rng.random() < 0.04}


def test_binary_mode(spark, tmp_path):
    rows, unknown = nested(24, 1)
    muts = list(next(iter(rows.values())))
    lines = ["ID\t" + "\t".join(m.replace("_", ":", 1) for m in muts)] + ["\t".join([c, *("NA" if (c, m) in unknown else str(int(v[m])) for m in muts)]) for c, v in rows.items()]
    (tmp_path / "in.tsv").write_text("\n".join(lines) + "\n")
    out = modes.run(spark, str(tmp_path / "in.tsv"), "binary")
    modes.write(out, tmp_path / "out")
    assert out.totals["fp"] == out.totals["fn"] == 0 and not out.result.external and modes.conflicts(out) == 0
    parent = {m: n for m, n in ((m, p) for n, p in out.result.tree.parent.items() for m in n.split("|"))}
    assert parent["1_20_A_T"] == parent["1_30_A_T"] == "1_10_A_T" and parent["2_10_C_G"] == parent["1_10_A_T"] == "ROOT"
    got = {(r.cell, r.mut) for r in out.imputed.collect()}
    assert all(((c, m) in got) == v[m] for c, v in rows.items() for m in muts if (c, m) not in unknown and any(v[x] and (c, x) not in unknown for x in muts))
    assert json.loads((tmp_path / "out" / "T.json").read_text())["name"] == "ROOT" and (tmp_path / "out" / "total_flips.txt").read_text().splitlines()[1].startswith("0\t0")
    cf = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "matrix.CFMatrix"))
    assert cf.columns == ["cellIDxmutID", *sorted(muts)] and cf.count() == len({c for c, _ in got})
    assert {r.mutation for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "hierarchy.csv")).collect()} == set(muts)


@pytest.mark.parametrize("mode", ["scrna", "scdna", "spatial"])
def test_matrix_modes(spark, tmp_path, mode):
    rows, unknown = nested(40, 2)
    muts, cells = [*next(iter(rows.values())), "3_1_A_G"], list(rows)
    state = lambda c, m: None if (c, m) in unknown or m == "3_1_A_G" and c != cells[3] else bool(rows[c].get(m, c == cells[3]))

    def table(name, value):
        (tmp_path / name).write_text("\n".join(["\t".join(["mut", *cells])] + ["\t".join([m, *(value(state(c, m)) for c in cells)]) for m in muts]) + "\n")

    table(tables.FILES["p"], lambda s: "NA" if s is None else "0.99" if s else "0.01")
    table(tables.FILES["ll_mut"], lambda s: "NA" if s is None else "-1")
    table(tables.FILES["ll_unmut"], lambda s: "NA" if s is None else "-1")
    entry = lambda s: "NA" if s is None else "6/9" if s else "0/9"
    (tmp_path / tables.FILES["entry"]).write_text("\n".join(["\t".join(["mut", "bulk", *cells])] + ["\t".join([m, "50/200", *(entry(state(c, m)) for c in cells)]) for m in muts]) + "\n")
    (tmp_path / tables.FEATURES).write_text("mut\tn\n" + "".join(f"{m}\t1\n" for m in muts))
    out = modes.run(spark, str(tmp_path), mode, immune=["9_9_A_T"])
    tree = out.result.tree
    assert set(tree.mutations()) | set(out.result.external) == set(muts) and modes.conflicts(out) == 0 and out.totals["fp"] == 0
    node = tree.mutations()
    for below in ("1_20_A_T", "1_30_A_T"):
        assert below in out.result.external or any("1_10_A_T" in n.split("|") for n in tree.lineage(node[below]))
    assert {"1_10_A_T", "2_10_C_G"} <= set(node) and not set(tree.lineage(node["1_10_A_T"])) & set(tree.lineage(node["2_10_C_G"]))
    modes.write(out, tmp_path / "out")
    assert (tmp_path / "out" / "report.txt").exists()


def test_mutation_lists(spark, tmp_path):
    (tmp_path / "spots").write_text("#chrom\tpos\nchr1\t5\t.\tA\tT\t1\tAA-1\nchr1\t5\t.\tA\tT\t1\tCC-1\nchr2\t7\t.\tG\tC\t1\tAA-1\n")
    assert {r.mut for r in tables.read_spot_mutations(spark, str(tmp_path / "spots")).collect()} == {"chr1_5_A_T", "chr2_7_G_C"}
    (tmp_path / "pos").write_text("chr1\t14623\tC\tA,<*>\n")
    assert tuple(tables.read_positions(spark, str(tmp_path / "pos")).first()) == ("chr1", 14623, "C", "A,<*>")
    (tmp_path / "prior").write_text("chr1\t14622\t14623\tA\n")
    assert tables.read_prior_positions(spark, str(tmp_path / "prior")).first().mut == "chr1_14623_A_N"


def test_chromosome_files():
    files = [f"/x/g.sites.v3.{c}.vcf.bgz" for c in ("chr1", "chr2", "chrX")]
    assert tables.chromosome_files(files) == dict(zip(("chr1", "chr2", "chrX"), files))
    assert tables.chromosome_files(["/x/split_a_chr7.bed"]) == {"chr7": "/x/split_a_chr7.bed"}
    with pytest.raises(ValueError):
        tables.chromosome_files(["/x/a.chr1.vcf", "/y/a.chr1.vcf"])


def test_counts_and_expression(spark, tmp_path):
    (tmp_path / "barcodes.tsv").write_text("AA-1\nCC-1\n")
    (tmp_path / "features.tsv").write_text("E1\tTp53\tGene\nE2\tMyc\tGene\nE3\tActb\tGene\n")
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% by hand\n3 2 3\n1 1 4\n3 2 2\n2 2 1\n")
    want = {("AA-1", "Tp53", 4.0), ("CC-1", "Actb", 2.0), ("CC-1", "Myc", 1.0)}
    assert {tuple(r) for r in tables.read_counts(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in tables.read_expression(spark, str(tmp_path)).collect()} == {(c, g.upper(), n) for c, g, n in want}
    tables.read_counts(spark, str(tmp_path)).write.parquet(str(tmp_path / "e.parquet"))
    assert tables.read_expression(spark, str(tmp_path / "e.parquet")).count() == 3


def test_signed_rank_tail_by_enumeration():
    for n in (1, 4, 7):
        for least in range(n * (n + 1) // 4 + 1):
            ways = sum(sum(r for r, up in zip(range(1, n + 1), signs) if up) <= least for signs in itertools.product((0, 1), repeat=n))
            assert math.isclose(T.signed_rank_tail(n, least), min(1.0, 2 * ways / 2**n))


def test_dropout(spark):
    rng = random.Random(3)
    pairs = {1: [(i, i) for i in range(8)], 2: [(i * i, rng.randint(0, 9)) for i in range(9)], 3: [(5, 2)] * 4, 4: [(i % 3, i // 3 % 3) for i in range(80)]}
    got = {r.mut: r for r in T.dropout(spark.createDataFrame([(m, x, y) for m, v in pairs.items() for x, y in v], "mut long, total long, alt long"), "total", "alt", "mut").collect()}
    assert got[1].r2 == pytest.approx(1) and got[1].p == 1 and not got[1].no_dropout and (got[3].r2, got[3].p) == (1, 1)
    x, y = ([a[k] for a in pairs[2]] for k in (0, 1))
    z = [[(v - sum(u) / 9) / math.sqrt(sum((w - sum(u) / 9) ** 2 for w in u) / 9) for v in u] for u in (x, y)]
    d = sorted((a - b for a, b in zip(*z)), key=abs)
    assert len({round(abs(v), 9) for v in d}) == 9
    up = sum(i + 1 for i, v in enumerate(d) if v > 0)
    assert got[2].p == pytest.approx(T.signed_rank_tail(9, min(up, 45 - up)))
    assert got[4].p > 0.05 and got[4].r2 < 0.1 and got[4].no_dropout

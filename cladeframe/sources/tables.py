"""Text sources: matrices, lists, intervals, typed tables, raw tree input. Every reader declares its schema and gives the long form, so the
dynamic axis (one column a cell or mutation) is data and never schema inference."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = ("", "NA", "nan", "NaN", "no", "unknown", "undefined", ".")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", row: str = "row", column: str = "column") -> DataFrame:
    """row, column, value (text, null if missing) of a table whose first line names the columns and first field the row. Only the one header line
    comes to the driver; rows are split and unpivoted in parallel."""
    text = _lines(spark, path)
    header = text.limit(1).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = header[0].split(sep)[1:]
    cells = text.where(F.col("value") != header[0]).select(F.split("value", F.lit("\\" + sep if sep in "|.$" else sep), -1).alias("f"))
    titles = F.array(*[F.lit(n) for n in names])
    long = cells.select(F.col("f")[0].alias(row), F.explode(F.arrays_zip(titles.alias("c"), F.slice("f", 2, max(1, len(names))).alias("v"))).alias("x"))
    value = F.trim("x.v")
    return long.select(row, F.col("x.c").alias(column), F.when(~value.isin(*MISSING), value).alias("value"))


def read_numbers(spark: SparkSession, path: str, strict: bool = False, **names) -> DataFrame:
    """`read_matrix` with doubles; words become null, or raise when strict."""
    df = read_matrix(spark, path, **names)
    return df.withColumn("value", F.col("value").cast("double") if strict else F.expr("try_cast(value AS double)"))


def read_binary_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a 1/0/NA table of cells x mutations: posterior, vaf and state are the value, alt 10 at 1, total 10 where covered; `:` in
    headers becomes `_`."""
    df = read_matrix(spark, path, row="cell", column="mut").withColumn("mut", F.replace("mut", F.lit(":"), F.lit("_")))
    v = F.expr("try_cast(try_cast(value AS double) AS int)")
    return df.select("cell", "mut", v.alias("state"), v.cast("double").alias("p"), v.cast("double").alias("vaf"), (F.coalesce(v, F.lit(0)) * 10).cast("long").alias("alt"), F.when(v.isNotNull(), 10).otherwise(0).cast("long").alias("total"))


def bulk_of(obs: DataFrame) -> DataFrame:
    """mut, entry (alt/total) of the pseudo-cell `bulk`."""
    return obs.groupBy("mut").agg(F.concat_ws("/", F.sum("alt").cast("string"), F.sum("total").cast("string")).alias("entry"))


FILES = {"p": "data.posterior_matrix.txt", "ll_mut": "data.likelihood_mut_matrix.txt", "ll_unmut": "data.likelihood_unmut_matrix.txt", "entry": "data.allele_count.txt"}
FEATURES = "features.preprocess_items.txt"


def load_all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs, bulk, features) of a folder with the five files, mutations as rows. The posterior's cells and mutations decide; the others are joined to
    them, with 0 counts and missing values where they have none."""
    from cladeframe.operators.calls import derive_from_reads, parse_allele_entry

    read = lambda k: read_matrix(spark, f"{folder}/{FILES[k]}", row="mut", column="cell")
    out = read("p").select("cell", "mut", F.expr("try_cast(value AS double)").alias("p"))
    for k in ("ll_mut", "ll_unmut"):
        out = out.join(read(k).select("cell", "mut", F.expr("try_cast(value AS double)").alias(k)), ["cell", "mut"], "left")
    entries = parse_allele_entry(read("entry").withColumnRenamed("value", "entry"))
    counts = derive_from_reads(entries).select("cell", "mut", F.col("alleles").alias("alt"), F.col("coverage").alias("total"), "vaf")
    obs = out.join(counts.where("cell <> 'bulk'"), ["cell", "mut"], "left").select("cell", "mut", "p", "ll_mut", "ll_unmut", F.coalesce("alt", F.lit(0)).alias("alt"), F.coalesce("total", F.lit(0)).alias("total"), "vaf")
    features = read_matrix(spark, f"{folder}/{FEATURES}", row="mut", column="feature")
    return obs, counts.where("cell = 'bulk'").drop("cell"), features


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """mut, place: identifiers chrom_pos_ref_alt in the file's order, once each. One column, or four and more (chrom, pos, ref, alt with commas, or six
    with the alt in the fifth); lines that start with # or chrom are headers."""
    rows = _lines(spark, path).where("NOT value rlike '^(#|[cC]hrom)'").withColumn("n", F.monotonically_increasing_id())
    fields = rows.select("n", F.split(F.trim("value"), "\\t").alias("f"))
    one = F.when(F.size("f") >= 6, F.concat_ws("_", F.col("f")[0], F.col("f")[2], F.col("f")[3], F.col("f")[4])).when(F.size("f") >= 4, F.concat_ws("_", F.col("f")[0], F.col("f")[1], F.col("f")[2], F.col("f")[3])).otherwise(F.col("f")[0])
    parts = fields.select("n", F.split(one, "_").alias("p"))
    alts = parts.select("n", "p", F.posexplode(F.split(F.col("p")[3], ",")).alias("k", "alt"))
    named = alts.select(F.concat_ws("_", F.col("p")[0], F.col("p")[1], F.col("p")[2], "alt").alias("mut"), F.struct("n", "k").alias("place"))
    return named.groupBy("mut").agg(F.min("place").alias("place"))


def read_spot_mutations(spark: SparkSession, path: str) -> DataFrame:
    """mut: identifiers chrom_pos_germline_mutant of a table of spot genotypes, once each."""
    f = _lines(spark, path).where("NOT value rlike '^(#|chrom)'").select(F.split(F.trim("value"), "\\s+").alias("f"))
    return f.select(F.concat_ws("_", F.col("f")[0], F.col("f")[1], F.col("f")[3], F.col("f")[4]).alias("mut")).distinct()


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt (as it stands, several with commas) of lines chrom, position, ref, alt."""
    f = _lines(spark, path).select(F.split(F.trim("value"), "\\s+").alias("f"))
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("int").alias("pos"), F.col("f")[2].alias("ref"), F.col("f")[3].alias("alt"))


def read_prior_positions(spark: SparkSession, path: str) -> DataFrame:
    """mut: chrom_end_ref_N of lines chrom, start, end, ref; N stands for any alt."""
    f = _lines(spark, path).select(F.split(F.trim("value"), "\\s+").alias("f"))
    return f.select(F.concat_ws("_", F.col("f")[0], F.col("f")[2], F.col("f")[3], F.lit("N")).alias("mut"))


def chromosome_files(paths: list[str]) -> dict[str, str]:
    """chromosome: its file. Names are split at dots and underscores; a part that one name alone has is its chromosome. A single file's is the last
    part but one. Names without a part of their own, or with several, are refused."""
    parts = [re.split("[._]", p.rsplit("/", 1)[-1]) for p in paths]
    if len(paths) == 1:
        return {parts[0][-2] if len(parts[0]) > 1 else parts[0][0]: paths[0]}
    seen = Counter(x for ps in parts for x in ps)
    own = [[x for x in ps if seen[x] == 1] for ps in parts]
    if any(len(x) != 1 for x in own):
        raise ValueError(f"no unique part in each of {paths}")
    return {x[0]: p for x, p in zip(own, paths)}


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """cell, gene, n of a folder with barcodes.tsv, features.tsv (name in the second column, or the only one) and matrix.mtx, gzipped or not: numbers of
    lines in the first two name the rows and columns of the third."""

    def named(what: str) -> DataFrame:
        text = spark.read.text(f"{folder}/{what}.tsv*", wholetext=True).select(F.split(F.regexp_replace("value", "\\r|\\n$", ""), "\n").alias("l"))
        return text.select(F.posexplode("l").alias("i", "l")).select((F.col("i") + 1).alias("i"), F.split("l", "\t").alias("f"))

    genes = named("features").select(F.col("i").alias("g"), F.coalesce(F.get("f", F.lit(1)), F.col("f")[0]).alias("gene"))
    cells = named("barcodes").select(F.col("i").alias("c"), F.col("f")[0].alias("cell"))
    lines = _lines(spark, f"{folder}/matrix.mtx*").where("NOT startswith(value, '%')").select(F.split(F.trim("value"), "\\s+").alias("f"))
    size = spark.read.text(f"{folder}/matrix.mtx*").where("NOT startswith(value, '%')").first()  # rows, columns, entries
    rows = lines.where(F.array_join("f", " ") != " ".join(size[0].split())).select(F.col("f")[0].cast("int").alias("g"), F.col("f")[1].cast("int").alias("c"), F.col("f")[2].cast("double").alias("n"))
    return rows.join(genes, "g").join(cells, "c").select("cell", "gene", "n")


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """cell, gene (upper case), n of an expression matrix: a folder as `read_counts` takes, Parquet with these columns, or HDF5 in the layout matrix/barcodes,
    features/name, indptr, indices, data, where h5py is installed. A file of the last kind is read whole in one task."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("cell", F.upper("gene").alias("gene"), F.col("n").cast("double").alias("n"))
    if not path.endswith((".h5", ".h5ad")):
        return read_counts(spark, path).withColumn("gene", F.upper("gene"))
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 needs h5py; convert the matrix to Parquet with cell, gene, n") from e

    def unpack(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with h5py.File(io.BytesIO(content)) as f:
                    m = f["matrix"]
                    cells, genes = m["barcodes"][:].astype(str), m["features"]["name"][:].astype(str)
                    ends, data, index = m["indptr"][:], m["data"][:], m["indices"][:]
                    yield pd.DataFrame({"cell": np.repeat(cells, np.diff(ends)), "gene": genes[index], "n": data.astype(float)})

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "cell string, gene string, n double")
    return out.withColumn("gene", F.upper("gene"))


def read_barcodes(spark: SparkSession, path: str, pos: int = 1, in_tissue: int | None = 1) -> DataFrame:
    """barcode, x, y: a one-column list (x and y null), or comma-separated barcode, in_tissue and two coordinate pairs of which `pos` (1 or 2) is
    taken; in_tissue None keeps all spots."""
    f = _lines(spark, path).select(F.split("value", ",").alias("f"))
    x, y = F.get("f", F.lit(2 * pos)), F.get("f", F.lit(2 * pos + 1))
    df = f.select(F.col("f")[0].alias("barcode"), F.expr("try_cast(get(f, 1) AS int)").alias("in_tissue"), x.cast("double").alias("x"), y.cast("double").alias("y")).where("barcode <> 'barcode'")
    return (df if in_tissue is None else df.where(f"in_tissue IS NULL OR in_tissue = {in_tissue}")).drop("in_tissue")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, rest (further fields)."""
    f = _lines(spark, path).where("NOT value rlike '^(#|track|browser)'").select(F.split("value", "\\t").alias("f"))
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("int").alias("start"), F.col("f")[2].cast("int").alias("end"), F.slice("f", F.lit(4), F.greatest(F.size("f") - 3, F.lit(0))).alias("rest"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, info (map); one row an alt."""
    from cladeframe.functions.expressions import key_values

    f = _lines(spark, path).where("NOT startswith(value, '#')").select(F.split("value", "\\t").alias("f"))
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("int").alias("pos"), F.col("f")[3].alias("ref"), F.explode(F.split(F.col("f")[4], ",")).alias("alt"), key_values(F.coalesce(F.get("f", F.lit(7)), F.lit(""))).alias("info"))


def by_chromosome(df: DataFrame, folder: str) -> None:
    """One partition folder a chromosome, so that a read of some prunes the others."""
    df.repartition("chrom").sortWithinPartitions(*[c for c in ("start", "pos") if c in df.columns]).write.partitionBy("chrom").mode("overwrite").parquet(folder)


TYPED = {
    "prior": "chr string, pos int, ref string, fA double, fT double, fC double, fG double",
    "count": "barcode string, total_dp int, alt_dp int",
    "individual": "chr string, pos int, ID string, germline string, mutant string, cluster string, spot_number int, consensus_read_count string, genotype string, p_mosaic double, Gi string, vaf double",
    "cluster_vaf": "chr string, pos int, ID string, germline string, mutant string, cluster string, spot_number int, consensus_read_count string, vaf double",
    "spot": "chr string, pos int, ID string, germline string, mutant string, cluster string, spot_barcode string, consensus_read_count string, l_germline double, l_mosaic double, max_spot_geno string, G_spot_max double, depth int, vaf double, p_mosaic double",
    "cell_number": "identifier string, cells int",
    "cluster": "barcode string, cluster string",
    "coverage": "barcode string, average_coverage double",
    "celltype": "barcode string, cell_type string",
    "germline": "identifier string, FP_mean double, FP_std double, FP_cv double, FN_num int, low_counts_ratio string, sampleid string, label string",
}


def read_typed(spark: SparkSession, path: str, kind: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """A table of a known layout; chr, pos, germline and mutant give `identifier`. `unknown` numbers are null."""
    df = spark.read.schema(TYPED[kind]).csv(path, sep=sep, header=header, nullValue="NA", mode="PERMISSIVE")
    return df.withColumn("identifier", F.concat_ws("_", "chr", "pos", "germline", "mutant")) if {"chr", "pos", "germline", "mutant"} <= set(df.columns) else df


def read_tree_input(spark: SparkSession, path: str, barcodes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(obs, sites) of lines sample, chrom, pos, ref, alt, posterior, n posteriors, n + n likelihoods, bulk and n alt/total entries; the n-th value is
    the n-th barcode's. sites has the bulk entry."""
    n = len(barcodes)
    f = _lines(spark, path).select(F.split("value", ",", -1).alias("f"))
    f = f.withColumn("mut", F.concat_ws("_", F.col("f")[1], F.col("f")[2], F.col("f")[3], F.col("f")[4]))
    part = lambda k, name: F.slice("f", 7 + k, n).alias(name)
    sites = f.select(F.col("f")[0].alias("sample"), "mut", F.col("f")[5].cast("double").alias("posterior"), F.col("f")[6 + 3 * n].alias("bulk"))
    names = F.array(*[F.lit(b) for b in barcodes])
    rows = f.select("mut", F.explode(F.arrays_zip(names.alias("b"), part(0, "p"), part(n, "m"), part(2 * n, "u"), part(3 * n + 1, "e"))).alias("x"))
    obs = rows.select(F.col("x.b").alias("cell"), "mut", F.expr("try_cast(x.p AS double)").alias("p"), F.expr("try_cast(x.m AS double)").alias("ll_mut"), F.expr("try_cast(x.u AS double)").alias("ll_unmut"), F.col("x.e").alias("entry"))
    return obs, sites


def read_caller_output(spark: SparkSession, path: str) -> DataFrame:
    """site, ref, alt, cells (array), counts (array of maps base -> n) of tab-separated lines: identifier, genotype tuple text, bracketed list of
    cells, bracketed list of base:count maps."""
    f = _lines(spark, path).select(F.split("value", "\\t").alias("f"))
    inner = lambda i: F.regexp_replace(F.col("f")[i], "^\\[|\\]$", "")
    gt = F.regexp_extract_all(F.col("f")[1], F.lit("([ACGTN]+)"), F.lit(1))
    maps = F.transform(F.regexp_extract_all(inner(3), F.lit("\\{([^}]*)\\}"), F.lit(1)), lambda m: F.map_from_entries(F.transform(F.filter(F.split(F.regexp_replace(m, "['\" ]", ""), ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[0], F.split(x, ":")[1].cast("int")))))
    return f.select(F.col("f")[0].alias("site"), F.element_at(gt, 1).alias("ref"), F.element_at(gt, -1).alias("alt"), F.transform(F.split(inner(2), ","), lambda x: F.regexp_replace(F.trim(x), "['\"]", "")).alias("cells"), maps.alias("counts"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (from 1), base of a FASTA file with one sequence a header; lines keep their order through their offsets."""
    text = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    seq = text.select(F.regexp_extract("value", "^([^\\s]+)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("value", "^[^\\n]*\\n", ""), "\\s", "").alias("s"))
    return seq.select("chrom", F.posexplode(F.split(F.upper("s"), "")).alias("i", "base")).where("base <> ''").select("chrom", (F.col("i") + 1).alias("pos"), "base")


def config(defaults: dict, path: str | Path) -> dict:
    """A YAML file (`key: value` lines, nested by two spaces) laid over defaults; yaml is used where it is installed."""
    text = Path(path).read_text()
    try:
        import yaml

        own = yaml.safe_load(text) or {}
    except ImportError:
        own = {}
        stack = [(-1, own)]
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            indent = len(line) - len(line.lstrip())
            key, _, value = line.strip().partition(":")
            while stack[-1][0] >= indent:
                stack.pop()
            if value.strip():
                v = value.strip().strip("'\"")
                stack[-1][1][key] = int(v) if v.lstrip("-").isdigit() else v
            else:
                stack[-1][1][key] = {}
                stack.append((indent, stack[-1][1][key]))

    def merge(a: dict, b: dict) -> dict:
        return {k: merge(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in {**a, **b}}

    return merge(defaults, own)

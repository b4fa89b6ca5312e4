"""Counts and features from reads: umi, cell, mut, base, qual, reverse, place, mapq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASES = "ATCG"


def base_counts(reads: DataFrame) -> DataFrame:
    """cell, mut, A, T, C, G over reads."""
    return reads.groupBy("cell", "mut").agg(*[F.count_if(F.col("base") == b).alias(b) for b in BASES])


def umi_base_counts(reads: DataFrame) -> DataFrame:
    """cell, umi, mut, A, T, C, G: reads of each base in each UMI."""
    return reads.groupBy("cell", "umi", "mut").agg(*[F.count_if(F.col("base") == b).alias(b) for b in BASES])


def umi_likelihood(reads: DataFrame, pcr: float = 1e-6, cycles: int = 100, weight: float = 0.5) -> DataFrame:
    """cell, umi, mut, reads, base, n, likelihood, quality: the four bases of each UMI.

    A base that is read has `weight` of the chance that no cycle of PCR erred and all sequencing errors are those of the other
    bases' reads, and the rest of the chance that all reads are right and PCR made them differ: 10^(-6 (n + 0.5) / (reads + 2)) of a base
    with n reads, the least of the others'. A base that isn't read: all reads are right and PCR made every other base. The
    likelihood is normalised over the bases; quality is its phred score, rounded up, 40 where it is 1.
    """
    right = "(1 - pow(10D, -qual / 10D))"
    product = lambda x, c: f"CASE WHEN count_if(({c}) AND {x} <= 0) > 0 THEN 0D ELSE exp(coalesce(sum(CASE WHEN ({c}) AND {x} > 0 THEN ln({x}) END), 0D)) END"
    wide = reads.groupBy("cell", "umi", "mut").agg(
        F.count("*").alias("reads"), *[F.count_if(F.col("base") == b).alias(f"n{b}") for b in BASES],
        *[F.expr(f"({product(right, f'base = {b!r}')}) * ({product(f'(1 - {right})', f'base <> {b!r}')})").alias(f"own{b}") for b in BASES], F.expr(product(right, "true")).alias("right"),
    )
    for b in BASES:
        wide = wide.withColumn(f"p{b}", F.expr(f"pow(10D, -6D * (n{b} + 0.5D) / (reads + 2D))"))
    for b in BASES:
        others = [f"p{x}" for x in BASES if x != b]
        seen = f"{weight}D * {(1 - pcr) ** cycles!r}D * own{b} + {1 - weight}D * right * least({', '.join(others)})"
        wide = wide.withColumn(f"l{b}", F.expr(f"CASE WHEN n{b} > 0 THEN {seen} ELSE right * {' * '.join(others)} END"))
    wide = wide.withColumn("z", F.expr(" + ".join(f"l{b}" for b in BASES)))
    long = wide.select("cell", "umi", "mut", "reads", "z", F.explode(F.expr("array(" + ", ".join(f"struct({k} AS k, '{b}' AS base, n{b} AS n, l{b} AS l)" for k, b in enumerate(BASES)) + ")")).alias("x"))
    long = long.select("cell", "umi", "mut", "reads", "x.k", "x.base", "x.n", F.expr("CASE WHEN z > 0 THEN x.l / z END").alias("likelihood"))
    return long.withColumn("quality", F.expr("CASE WHEN likelihood IS NULL THEN 0 WHEN likelihood = 1 THEN 40 ELSE cast(ceil(round(-10 * log10(1 - likelihood), 9)) AS int) END"))


def umi_consensus(reads: DataFrame, ref: str = "A") -> DataFrame:
    """cell, umi, mut, base, quality, reads: the base of the best quality of each UMI: ref among equal ones, else the first of A, T, C, G."""
    best = F.expr(f"max_by(struct(base, quality), struct(quality, base = '{ref}', -k))")
    return umi_likelihood(reads).groupBy("cell", "umi", "mut").agg(best.alias("x"), F.first("reads").alias("reads")).select("cell", "umi", "mut", "x.base", "x.quality", "reads")


def bulk_consensus(reads: DataFrame, ref: str = "A") -> DataFrame:
    """mut, base, spots, consensus, qualities, raw of the four bases: cells, UMIs whose consensus the base is, their qualities (quality:count by
    quality, comma-joined; NA without), and reads."""
    by = umi_consensus(reads, ref).groupBy("mut", "base", "quality").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("quality", "n"))), lambda x: F.concat_ws(":", x["quality"].cast("string"), x["n"].cast("string"))), ",")
    called = by.groupBy("mut", "base").agg(F.sum("n").alias("consensus"), text.alias("qualities"))
    per_cell = reads.groupBy("mut", "cell").agg(*[F.count_if(F.col("base") == b).alias(b) for b in BASES])
    raw = per_cell.groupBy("mut").agg(F.count("*").alias("spots"), *[F.sum(b).alias(b) for b in BASES])
    raw = raw.select("mut", "spots", F.expr(f"stack({len(BASES)}, " + ", ".join(f"'{b}', {b}" for b in BASES) + ") AS (base, raw)"))
    return raw.join(called, ["mut", "base"], "left").select("mut", "base", "spots", F.coalesce("consensus", F.lit(0)).alias("consensus"), F.coalesce("qualities", F.lit("NA")).alias("qualities"), "raw")


def bulk_quality(reads: DataFrame) -> DataFrame:
    """mut, base, n, mean_quality, histogram (quality:count sorted, comma-joined) of the reads themselves."""
    by = reads.groupBy("mut", "base", "qual").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qual", "n"))), lambda x: F.concat_ws(":", x["qual"].cast("string"), x["n"].cast("string"))), ",")
    return by.groupBy("mut", "base").agg(F.sum("n").alias("reads"), F.expr("sum(qual * n) / sum(n)").alias("mean_quality"), text.alias("histogram"))


def error_counts(reads: DataFrame, ref: str = "A", least: int = 3) -> DataFrame:
    """mut, reads, umis, pcr, pcr_alts, lysis, lysis_alt. pcr: UMIs with several bases and `least` reads or more of one that isn't ref; pcr_alts: those
    bases, comma-joined, '.' without. lysis: UMIs of more than `least` reads, all of one base that isn't ref; lysis_alt: that base if
    there is one such UMI, else '.'."""
    other = [b for b in BASES if b != ref]
    per = reads.groupBy("mut", "cell", "umi").agg(F.count("*").alias("n"), *[F.count_if(F.col("base") == b).alias(b) for b in BASES])
    per = per.withColumn("many", F.expr("filter(array(" + ", ".join(f"CASE WHEN {b} >= {least} THEN '{b}' END" for b in other) + "), x -> x IS NOT NULL)"))
    per = per.withColumn("is_pcr", F.expr(f"size(many) > 0 AND {' + '.join(f'cast({b} > 0 AS int)' for b in BASES)} > 1"))
    per = per.withColumn("lone", F.expr(f"CASE WHEN n > {least} THEN CASE {' '.join(f'WHEN {b} = n THEN {b!r}' for b in other)} END END"))
    out = per.groupBy("mut").agg(
        F.sum("n").alias("reads"), F.count("*").alias("umis"), F.count_if("is_pcr").alias("pcr"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.expr("CASE WHEN is_pcr THEN many END"))))), ",").alias("pcr_alts"),
        F.count("lone").alias("lysis"), F.min("lone").alias("lysis_alt"),
    )
    return out.withColumn("pcr_alts", F.expr("CASE WHEN pcr_alts = '' THEN '.' ELSE pcr_alts END")).withColumn("lysis_alt", F.expr("CASE WHEN lysis = 1 THEN lysis_alt ELSE '.' END"))


def umi_consistency(reads: DataFrame, alt: str = "T", soft: float = 0.75) -> DataFrame:
    """mut, umis, mean, hard, soft and the same without single-read UMIs: over UMIs with the alt, its share of their reads."""
    per = reads.groupBy("mut", "cell", "umi").agg(F.count_if(F.col("base") == alt).alias("a"), F.count("*").alias("n")).where("a > 0").withColumn("s", F.expr("a / n"))
    multi = "CASE WHEN n > 1 THEN {} END"
    return per.groupBy("mut").agg(
        F.count("*").alias("umis"), F.avg("s").alias("mean"), F.avg(F.expr("CASE WHEN s = 1 THEN 1D ELSE 0D END")).alias("hard"), F.avg(F.expr(f"CASE WHEN s >= {soft} THEN 1D ELSE 0D END")).alias("soft"),
        F.avg(F.expr(multi.format("s"))).alias("mean_multi"), F.avg(F.expr(multi.format("CASE WHEN s = 1 THEN 1D ELSE 0D END"))).alias("hard_multi"),
    )


def depth_statistics(obs: DataFrame) -> DataFrame:
    """mut, item, average, greatest and least in mutant (alt > 0) and other cells, difference of averages; item: ref, alt, total, vaf."""
    items = "stack(4, 'ref', cast(total - alt AS double), 'alt', cast(alt AS double), 'total', cast(total AS double), 'vaf', vaf) AS (item, x)"
    long = obs.select("mut", F.expr("alt > 0").alias("mutant"), F.expr(items))
    side = lambda c, n: [F.avg(F.expr(f"CASE WHEN {c} THEN x END")).alias(f"avg_{n}"), F.max(F.expr(f"CASE WHEN {c} THEN x END")).alias(f"max_{n}"), F.min(F.expr(f"CASE WHEN {c} THEN x END")).alias(f"min_{n}")]
    return long.groupBy("mut", "item").agg(*side("mutant", "mutant"), *side("NOT mutant", "unmutant")).withColumn("difference", F.expr("avg_mutant - avg_unmutant"))


def depth_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("mut").agg(
        F.count("*").alias("spots"), F.count_if(F.expr("alt > 0")).alias("mutant_spots"), F.expr("count_if(alt > 0) / count(*)").alias("mutant_share"),
        F.sum("alt").alias("alt"), F.sum("total").alias("total"), F.expr("coalesce(try_divide(sum(alt), sum(total)), 0D)").alias("bulk_vaf"),
    )


def mean_read_length(reads: DataFrame, length: str = "qual") -> DataFrame:
    """cell, mean_length: built-in partial sums; a cell without reads isn't in the table and counts as 0 in a left join."""
    return reads.groupBy("cell").agg(F.expr(f"sum({length}) / count(*)").alias("mean_length"))


def allele_features(reads: DataFrame) -> DataFrame:
    """mut, base: reads, cells, umis, mean and median quality and mapping quality, reverse share, distinct places, share of the most
    common place, reads per umi and per cell, share of reads of mapping quality 0."""
    # distinct values in two aggregations each: several in one would multiply every read
    kinds = lambda c, name: reads.groupBy("mut", "base", c).agg(F.count("*").alias("k")).groupBy("mut", "base").agg(F.count(c).alias(name), F.max("k").alias("top"))
    out = reads.groupBy("mut", "base").agg(
        F.count("*").alias("reads"), F.avg("qual").alias("mean_quality"), F.expr("median(qual)").alias("median_quality"), F.avg("mapq").alias("mean_mapq"),
        F.avg(F.expr("CASE WHEN reverse THEN 1D ELSE 0D END")).alias("reverse_share"), F.avg(F.expr("CASE WHEN mapq = 0 THEN 1D ELSE 0D END")).alias("multi_share"),
    )
    for c, name in (("cell", "cells"), ("umi", "umis")):
        out = out.join(kinds(c, name).drop("top"), ["mut", "base"])
    return out.join(kinds("place", "places"), ["mut", "base"]).select("*", F.expr("top / reads").alias("top_place"), F.expr("reads / umis").alias("per_umi"), F.expr("reads / cells").alias("per_cell")).drop("top")


def strand_table(reads: DataFrame, ref: str = "A", alt: str = "T") -> DataFrame:
    """mut, four counts, odds: the strand table of two alleles and its odds ratio (null where a factor of the denominator is 0)."""
    c = lambda b, s: F.count_if((F.col("base") == b) & (F.col("reverse") == s))
    out = reads.groupBy("mut").agg(c(ref, False).alias("ref_fwd"), c(ref, True).alias("ref_rev"), c(alt, False).alias("alt_fwd"), c(alt, True).alias("alt_rev"))
    return out.withColumn("odds", F.expr("try_divide(cast(ref_fwd AS double) * alt_rev, cast(ref_rev AS double) * alt_fwd)"))


def majority_strand(reads: DataFrame) -> DataFrame:
    out = reads.groupBy("mut").agg(F.count_if("reverse").alias("minus"), F.count_if(~F.col("reverse")).alias("plus"))
    return out.withColumn("strand", F.expr("CASE WHEN minus > plus THEN '-' WHEN plus > minus THEN '+' ELSE 'unknown' END"))


def best_candidate(reads: DataFrame, ref: str = "A") -> DataFrame:
    """mut, base: the base of greatest summed quality; of equal ones the reference, then the least."""
    per = reads.groupBy("mut", "base").agg(F.sum("qual").cast("long").alias("q"))
    w = Window.partitionBy("mut").orderBy(F.desc("q"), F.desc(F.col("base") == ref), "base")
    return per.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("mut", "base", "q")


def context_counts(contexts: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n for all labels."""
    return labels.join(contexts.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def near_depths(depth: DataFrame, sites: DataFrame, offsets: tuple[int, ...]) -> DataFrame:
    """site, depths: sorted depths at fixed offsets of each site, joined by commas. depth: chrom, pos, dp."""
    wanted = sites.select("site", "chrom", F.explode(F.array(*map(F.lit, offsets))).alias("o"), "pos").select("site", "chrom", F.expr("pos + o").alias("pos"))
    rows = wanted.join(depth, ["chrom", "pos"])
    return rows.groupBy("site").agg(F.expr("array_join(transform(array_sort(collect_list(dp)), x -> cast(x AS string)), ',')").alias("depths"), F.count("*").alias("n"))


def expression(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """gene, n, fpkm: reads per kilobase of exons and million reads. counts: gene, n; lengths: gene, bases."""
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(lengths, "gene").crossJoin(F.broadcast(total)).select("gene", "n", F.expr("try_divide(n * 1e9D, cast(bases AS double) * all)").alias("fpkm"))


def phase_rows(snps: DataFrame) -> DataFrame:
    """site, nearest, supported: of (site, snp, distance, support) the nearest and the best supported SNP, ties by name."""
    return snps.groupBy("site").agg(F.expr("min_by(snp, struct(distance, snp))").alias("nearest"), F.expr("max_by(snp, struct(support, -snp))").alias("supported"))

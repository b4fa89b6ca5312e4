"""Joins by genomic place. A range join is dealt to stretches of BUCKET bases: intervals go to every stretch they touch, points to their
own, so the join is by (chrom, stretch) and never compares a whole chromosome with itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1024


def points_in(points: DataFrame, intervals: DataFrame, closed: bool = False, bucket: int = BUCKET) -> DataFrame:
    """All pairs of a point (chrom, pos, ..) in an interval (chrom, start, end, ..); half-open unless closed. `end` may not lie before start."""
    last = "end" if closed else "end - 1"
    spread = intervals.withColumn("_b", F.explode(F.expr(f"CASE WHEN {last} >= start THEN sequence(start div {bucket}, ({last}) div {bucket}) ELSE array() END")))
    return points.withColumn("_b", F.expr(f"pos div {bucket}")).join(spread, ["chrom", "_b"]).where(f"pos >= start AND pos <= {last}").drop("_b")


def annotate_points(points: DataFrame, intervals: DataFrame, key: str, value: str) -> DataFrame:
    """points and `hit`: the least value of the intervals that hold each, null without any."""
    hits = points_in(points, intervals).groupBy(key).agg(F.min(value).alias("hit"))
    return points.join(hits, key, "left")


def nearest_boundary(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """key, distance: to the nearest start or end on the chromosome, without any null. Boundaries and points are put in one order; the last
    boundary before and the first after a point are the only ones that can be nearest, so this is a sort and no join."""
    marks = intervals.select("chrom", F.explode(F.array("start", "end")).alias("pos")).distinct().withColumn("b", F.col("pos")).withColumn(key, F.lit(None).cast("long"))
    rows = points.select("chrom", "pos", F.lit(None).cast("int").alias("b"), key).unionByName(marks.select("chrom", "pos", "b", key))
    w = Window.partitionBy("chrom").orderBy("pos")
    before, after = F.max("b").over(w), F.min("b").over(Window.partitionBy("chrom").orderBy(F.desc("pos")))
    rows = rows.withColumn("x", before).withColumn("y", after).where(F.col(key).isNotNull())
    return rows.select(key, F.least(F.col("pos") - F.col("x"), F.col("y") - F.col("pos")).alias("distance"))


def semi_match(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of b whose keys occur in a."""
    return b.join(a.select(*keys).distinct(), keys, "left_semi")


def annotate_variants(variants: DataFrame, functions: DataFrame, exonic: DataFrame) -> DataFrame:
    """site, region, gene: region, with its exonic function in brackets where it has one; nothing known: NONE; a gene ends before `(`."""
    out = variants.join(functions, "site", "left").join(exonic, "site", "left")
    region = F.expr("coalesce(CASE WHEN func IS NOT NULL THEN concat(region, '(', func, ')') ELSE region END, 'NONE')")
    return out.select("site", region.alias("region"), F.expr("coalesce(substring_index(gene, '(', 1), 'NONE')").alias("gene"))


def allele_prior(sites: DataFrame, frequencies: DataFrame) -> DataFrame:
    """site, A, T, C, G from known frequencies (chrom, pos, alt, af): the reference base takes what is left; an unknown site is its reference."""
    known = sites.join(frequencies, ["chrom", "pos"], "left").where("alt IS NULL OR alt <> ref")
    sums = known.groupBy("site", "ref").agg(*[F.sum(F.expr(f"CASE WHEN alt = '{b}' THEN af ELSE 0D END")).alias(b) for b in "ATCG"])
    rest = "greatest(0D, 1 - (A + T + C + G))"
    return sums.select("site", *[F.expr(f"CASE WHEN ref = '{b}' THEN {rest} ELSE {b} END").alias(b) for b in "ATCG"])


def exon_lengths(exons: DataFrame) -> DataFrame:
    return exons.groupBy("gene").agg(F.expr("sum(end - start)").alias("bases"))


def choose_table(sites: DataFrame, own: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """A value from the site's own table, else from another, else `none`."""
    return sites.join(own.select(key, F.col(value).alias("_a")), key, "left").join(other.select(key, F.col(value).alias("_b")), key, "left").select(*sites.columns, F.coalesce(F.col("_a").cast("string"), F.col("_b").cast("string"), F.lit("none")).alias(value))

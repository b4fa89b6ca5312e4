"""Inputs of the registered queries, derived from the driver's tables, and the same as SQL for DuckDB.

obs     one row per covered (cell, mut): total reads, alt reads, vaf (alt / total), p (a posterior: (alt + 1) / (total + 2))
geno    obs with the genotype as state
dense   all cells x muts, state null where not covered
cells   cell, cell_type
groups  mut, grp; tree: node, parent (0 is the root); m: imputed matrix, 1 where a mutation or a descendant is seen
reads   one row per read; spots, sites, intervals: spatial and genomic stand-ins
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MUTS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").where("l_quantity <= 10").select("l_orderkey", F.expr(f"l_partkey % {MUTS}").cast("long").alias("mut"), "l_discount")
    rows = line.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = rows.groupBy(F.col("o_custkey").cast("long").alias("cell"), "mut").agg(F.count("*").alias("total"), F.sum(F.expr("CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END")).alias("alt"))
    return out.withColumn("p", F.expr("(alt + 1D) / (total + 2D)")).withColumn("vaf", F.expr("alt / total"))


def geno(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).select("cell", "mut", F.expr("CASE WHEN alt > 0 THEN 1 ELSE 0 END").alias("state"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).select("cell").distinct().select("cell", F.expr("cell % 5").cast("int").alias("cell_type"))


def muts(spark: SparkSession) -> DataFrame:
    return spark.range(MUTS).select(F.col("id").alias("mut"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    g = geno(spark, d)
    return g.select("cell").distinct().crossJoin(F.broadcast(muts(spark))).join(g, ["cell", "mut"], "left").select("cell", "mut", "state")


def groups(spark: SparkSession) -> DataFrame:
    return muts(spark).select("mut", F.expr("mut % 4").alias("grp"))


def tree(spark: SparkSession) -> DataFrame:
    return spark.range(1, MUTS).select(F.col("id").alias("node"), F.expr("id div 2").alias("parent"))


def imputed(spark: SparkSession, d: str) -> DataFrame:
    """cell, mut, v: 1 where the mutation or one below it in `tree` is seen; only cells with a seen mutation."""
    from cladeframe.operators.trees import closure

    above = closure(tree(spark)).select(F.col("node").alias("mut"), F.col("ancestor").alias("up"))
    on = geno(spark, d).where("state = 1").join(above, "mut").select("cell", F.col("up").alias("mut")).distinct()
    return on.withColumn("v", F.lit(1))


def reads(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select(
        F.col("l_suppkey").cast("long").alias("umi"), F.col("o_custkey").cast("long").alias("cell"), F.expr(f"cast(l_partkey % {MUTS} AS long)").alias("mut"),
        F.expr("CASE l_returnflag WHEN 'N' THEN 'A' WHEN 'R' THEN 'T' ELSE 'C' END").alias("base"), F.expr("cast(l_quantity AS int)").alias("qual"),
        F.expr("l_linestatus = 'F'").alias("reverse"), F.expr("cast(l_linenumber AS int)").alias("place"), F.expr("cast(l_orderkey % 61 AS int)").alias("mapq"),
    )


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("iid"), F.expr("cast(p_size % 5 AS int)").alias("chrom"), F.expr("cast(floor(p_retailprice) AS int)").alias("start"), F.expr("cast(floor(p_retailprice) + p_size AS int)").alias("end"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("site"), F.expr("cast(s_suppkey % 5 AS int)").alias("chrom"), F.expr("cast(900 + (s_suppkey * 37) % 1200 AS int)").alias("pos"))


def spots(spark: SparkSession, d: str) -> DataFrame:
    out = obs(spark, d).where("mut = 3").select("cell", F.expr("cell % 20").alias("x"), F.expr("cell div 20").alias("y"), F.col("total").alias("depth"), "alt", "vaf")
    return out.withColumn("cluster", F.expr("cast(cell % 7 AS int)"))


ENTRIES = ("3/9", "0/0", "9/3", "NA", ".", "", "5", "0.25", "3:9", "3 9", "2.0/4.0", "nan", "7.6", "1|2", "1;2", "4,8", None)

SQL = f"""obs AS (SELECT o_custkey::BIGINT AS cell, (l_partkey % {MUTS})::BIGINT AS mut, count(*)::BIGINT AS total,
   sum(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END)::BIGINT AS alt,
   (sum(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) + 1)::DOUBLE / (count(*) + 2) AS p, sum(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS vaf
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity <= 10 GROUP BY 1, 2),
geno AS (SELECT cell, mut, CASE WHEN alt > 0 THEN 1 ELSE 0 END AS state FROM obs),
cells AS (SELECT DISTINCT cell, (cell % 5)::INT AS cell_type FROM obs),
muts AS (SELECT range AS mut FROM range({MUTS})),
dense AS (SELECT c.cell, k.mut, g.state FROM cells c CROSS JOIN muts k LEFT JOIN geno g ON g.cell = c.cell AND g.mut = k.mut),
groups AS (SELECT mut, mut % 4 AS grp FROM muts),
tree AS (SELECT mut AS node, mut // 2 AS parent FROM muts WHERE mut > 0),
up AS (SELECT node, node AS ancestor, 0 AS depth FROM tree UNION ALL SELECT up.node, t.parent, up.depth + 1 FROM up JOIN tree t ON t.node = up.ancestor),
m AS (SELECT DISTINCT g.cell, up.ancestor AS mut, 1 AS v FROM geno g JOIN up ON up.node = g.mut WHERE g.state = 1),
reads AS (SELECT l_suppkey::BIGINT AS umi, o_custkey::BIGINT AS cell, (l_partkey % {MUTS})::BIGINT AS mut, CASE l_returnflag WHEN 'N' THEN 'A' WHEN 'R' THEN 'T' ELSE 'C' END AS base,
   l_quantity::INT AS qual, l_linestatus = 'F' AS reverse, l_linenumber::INT AS place, (l_orderkey % 61)::INT AS mapq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
intervals AS (SELECT p_partkey::BIGINT AS iid, (p_size % 5)::INT AS chrom, floor(p_retailprice)::INT AS "start", (floor(p_retailprice) + p_size)::INT AS "end" FROM part),
sites AS (SELECT s_suppkey::BIGINT AS site, (s_suppkey % 5)::INT AS chrom, (900 + (s_suppkey * 37) % 1200)::INT AS pos FROM supplier),
spots AS (SELECT cell, cell % 20 AS x, cell // 20 AS y, total AS depth, alt, vaf, (cell % 7)::INT AS cluster FROM obs WHERE mut = 3)"""


def oracle(body: str, more: str = "") -> str:
    """A statement over the fixtures; `more` holds further common tables."""
    return f"WITH RECURSIVE {SQL}{',' + chr(10) + more if more else ''}\n{body}"

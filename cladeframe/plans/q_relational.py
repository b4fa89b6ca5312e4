"""Queries of parsing, filters, pair and matrix statistics, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions import expressions as X
from cladeframe.operators import calls, matrix, pairs

from . import fixtures as fx
from .registry import query


def r9(df: DataFrame) -> DataFrame:
    """Doubles rounded to nine digits, so that both engines agree on the last ones."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _stats(s, d):
    return matrix.mutant_fraction(fx.geno(s, d))


def _founders(s, d):
    return matrix.founders(fx.groups(s), _stats(s, d))


STATS = "stats AS (SELECT mut, count(*) FILTER (state = 1) AS mutant_cells, count(*) FILTER (state = 1) / count(*)::DOUBLE AS mutant_fraction FROM geno GROUP BY mut)"
FOUNDERS = STATS + ", founders AS (SELECT grp, mut AS founder, mutant_cells FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mutant_cells DESC, mut) AS r FROM groups JOIN stats USING (mut)) WHERE r = 1)"
PAIRS = """pc AS (SELECT a.mut AS u, b.mut AS v, count(*) FILTER (a.state = 1 AND b.state = 1) AS n11, count(*) FILTER (a.state = 1 AND b.state = 0) AS n10,
 count(*) FILTER (a.state = 0 AND b.state = 1) AS n01, count(*) FILTER (a.state = 0 AND b.state = 0) AS n00 FROM geno a JOIN geno b USING (cell) WHERE a.mut < b.mut GROUP BY 1, 2)"""
EDGES = (
    PAIRS
    + """, o AS (SELECT mut, count(*) FILTER (state = 1) AS ones FROM geno GROUP BY mut),
pj AS (SELECT u, v, n11, coalesce(n11 / nullif(n11 + n10 + n01, 0)::DOUBLE, 0) AS jaccard, coalesce(n11 / nullif(a.ones, 0)::DOUBLE, 0) AS fu, coalesce(n11 / nullif(b.ones, 0)::DOUBLE, 0) AS fv
 FROM pc JOIN o a ON a.mut = u JOIN o b ON b.mut = v),
edges AS (SELECT u, v, jaccard, fu, fv FROM pj WHERE n11 >= 1 AND (jaccard >= 0.08 OR (jaccard > 0 AND greatest(fu, fv) >= 0.5))),
near AS (SELECT u AS r, v AS mut FROM edges UNION ALL SELECT v, u FROM edges)"""
)


# ---- parsing


def _entries(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, e) for i, e in enumerate(fx.ENTRIES)], "id int, entry string")


_ENTRY_ROWS = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if e is None else chr(39) + e + chr(39)})" for i, e in enumerate(fx.ENTRIES)) + ") AS v(id, entry))"
_PARSED = (
    _ENTRY_ROWS
    + """, e1 AS (SELECT id, entry, trim(coalesce(entry, '')) AS t, regexp_extract(trim(coalesce(entry, '')), '^([0-9.]+) *[:,/|; ] *([0-9.]+)$', 1) AS a,
 regexp_extract(trim(coalesce(entry, '')), '^([0-9.]+) *[:,/|; ] *([0-9.]+)$', 2) AS b FROM e),
e2 AS (SELECT id, entry, t, TRY_CAST(a AS DOUBLE) AS a, TRY_CAST(b AS DOUBLE) AS b, CASE WHEN regexp_matches(t, '^[0-9]*[.]?[0-9]+$') THEN TRY_CAST(t AS DOUBLE) END AS one FROM e1),
ep AS (SELECT id, entry, CASE WHEN b >= a THEN (b - a)::BIGINT END AS ref, CASE WHEN b >= a THEN a::BIGINT END AS alt,
 CASE WHEN b >= a THEN b::BIGINT WHEN one IS NOT NULL AND NOT (contains(t, '.') AND one <= 1) THEN round_even(one, 0)::BIGINT END AS total,
 CASE WHEN b >= a THEN CASE WHEN b = 0 THEN 0 ELSE a / b END WHEN contains(t, '.') AND one <= 1 THEN one END AS maf FROM e2)"""
)


@query("f01_parse_allele_entry", "SELECT id, ref, alt, total, round(maf, 9) AS maf FROM ep", _PARSED)
def f01(s, d):
    return r9(calls.parse_allele_entry(_entries(s)).select("id", "ref", "alt", "total", "maf"))


@query(
    "f02_derive_from_reads",
    """SELECT id, round(CASE WHEN alt IS NOT NULL THEN CASE WHEN total > 0 THEN alt / total::DOUBLE END ELSE maf END, 9) AS vaf,
 CASE WHEN total IS NOT NULL THEN total WHEN maf IS NOT NULL THEN 1 ELSE 0 END AS coverage, CASE WHEN alt IS NOT NULL THEN alt WHEN maf IS NOT NULL THEN round_even(maf, 0)::BIGINT ELSE 0 END AS alleles FROM ep""",
    _PARSED,
)
def f02(s, d):
    return r9(calls.derive_from_reads(calls.parse_allele_entry(_entries(s))).select("id", "vaf", "coverage", "alleles"))


@query("f03_genotype", "SELECT cell, mut, CASE WHEN total >= 1 THEN CASE WHEN vaf > 0 AND p > 0.5 THEN 1 ELSE 0 END END AS state FROM obs")
def f03(s, d):
    return calls.genotype(fx.obs(s, d)).select("cell", "mut", "state")


@query("f04_ternary", "SELECT d.cell, d.mut, CASE WHEN p IS NULL THEN 3 WHEN p > 0.5 AND p <= 1 AND alt > 0 THEN 1 ELSE 0 END AS state FROM dense d LEFT JOIN obs o ON o.cell = d.cell AND o.mut = d.mut")
def f04(s, d):
    full = fx.dense(s, d).select("cell", "mut").join(fx.obs(s, d), ["cell", "mut"], "left")
    return calls.ternary(full).select("cell", "mut", "state")


@query(
    "f05_initial_filter",
    "SELECT cell, mut, total, alt FROM k WHERE mut IN (SELECT mut FROM k GROUP BY mut HAVING max(vaf) >= 0.3 AND avg(vaf) FILTER (vaf > 0) >= 0.1)",
    "k AS (SELECT * FROM obs WHERE cell IN (SELECT cell FROM obs GROUP BY cell HAVING max(vaf) > 0 AND max(p) > 0.5))",
)
def f05(s, d):
    return calls.initial_filter(fx.obs(s, d)).select("cell", "mut", "total", "alt")


@query("f06_drop_empty", "SELECT * FROM geno WHERE mut IN (SELECT mut FROM geno WHERE state = 1) AND cell IN (SELECT cell FROM geno WHERE state = 1)")
def f06(s, d):
    return calls.drop_empty(fx.geno(s, d)).select("cell", "mut", "state")


@query("f07_mutant_cells", "SELECT cell, mut, alt FROM obs WHERE cell IN (SELECT cell FROM obs WHERE p > 0.6 AND alt >= 1)")
def f07(s, d):
    return calls.mutant_cells(fx.obs(s, d), 0.6).select("cell", "mut", "alt")


@query("f08_site_filter", "SELECT mut, max(p) AS p, sum(alt)::BIGINT AS alt FROM obs GROUP BY mut HAVING max(p) >= 0.9 AND sum(alt) <> 0")
def f08(s, d):
    return fx.obs(s, d).groupBy("mut").agg(F.max("p").alias("p"), F.sum("alt").alias("alt")).where("p >= 0.9 AND alt <> 0")


@query("f09_distinct_entries", "SELECT DISTINCT mut, nullif(concat(alt, '/', total), '0/1') AS entry FROM obs")
def f09(s, d):
    return fx.obs(s, d).select("mut", F.expr("nullif(concat(alt, '/', total), '0/1')").alias("entry")).distinct()


@query(
    "f10_phylogeny_label",
    "SELECT mut, CASE WHEN n = 1 THEN 'cell_specific' WHEN n = 0 THEN 'absent' WHEN hi >= 0.9 AND lo < 0.3 THEN 'successful_pass' ELSE 'failed_pass' END AS label FROM (SELECT mut, count(*) FILTER (alt > 0) AS n, max(p) AS hi, avg(p) AS lo FROM obs GROUP BY mut)",
)
def f10(s, d):
    rows = fx.obs(s, d).groupBy("mut").agg(F.count_if(F.expr("alt > 0")).alias("mutant_cells"), F.max("p").alias("posterior"), F.avg("p").alias("one_cell"))
    return calls.phylogeny_label(rows, 0.9, 0.3).select("mut", "label")


@query(
    "f11_annotation_filter",
    "SELECT site, coalesce(c >= 0.85, false) AS pass_umi, coalesce(a, 'Unknown') IN ('Unknown', 'False') AS pass_ase, coalesce(e, 'False') = 'False' AS pass_editing FROM (SELECT site, CASE WHEN pos % 3 > 0 THEN pos / 2100.0::DOUBLE END AS c, CASE pos % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS a, CASE pos % 5 WHEN 0 THEN 'True' END AS e FROM sites)",
)
def f11(s, d):
    rows = fx.sites(s, d).select("site", F.expr("CASE WHEN pos % 3 > 0 THEN pos / 2100D END").alias("consistency"), F.expr("CASE pos % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END").alias("ase"), F.expr("CASE pos % 5 WHEN 0 THEN 'True' END").alias("editing"))
    return calls.annotation_filter(rows).select("site", "pass_umi", "pass_ase", "pass_editing")


@query("f12_germline_rescue", "SELECT mut, mut % 2 = 0 AND mutant_fraction >= 0.16 AND mutant_cells > 5 AS germline FROM stats", STATS)
def f12(s, d):
    return calls.germline_rescue(_stats(s, d).withColumn("germline", F.expr("mut % 2 = 0")), 0.16, 5).select("mut", "germline")


@query("f13_informative_inside", "SELECT mut FROM geno WHERE cell % 50 = 0 GROUP BY mut HAVING max(state) = 1 AND min(state) = 0")
def f13(s, d):
    return calls.informative_inside(fx.geno(s, d), fx.cells(s, d).where("cell % 50 = 0"))


def _nodes(s):
    return fx.muts(s).select(F.expr("concat('n', mut div 3)").alias("node"), "mut")


@query("f14_merge_nodes", "SELECT cell, concat('n', mut // 3) AS node, max(state) AS state FROM dense GROUP BY 1, 2")
def f14(s, d):
    return calls.merge_nodes(fx.dense(s, d), _nodes(s))


@query("f14_split_nodes", "SELECT x.cell, k.mut, x.state FROM (SELECT cell, mut // 3 AS node, max(state) AS state FROM dense GROUP BY 1, 2) x JOIN muts k ON k.mut // 3 = x.node")
def f14b(s, d):
    return calls.split_nodes(calls.merge_nodes(fx.dense(s, d), _nodes(s)), _nodes(s))


@query("f14_node_key", "SELECT mut, CASE WHEN concat('m', mut) < concat('m', mut + 5) THEN concat('m', mut, '|m', mut + 5) ELSE concat('m', mut + 5, '|m', mut) END AS key FROM muts")
def f14c(s, d):
    return fx.muts(s).select("mut", calls.node_key(F.expr("concat('m', mut + 5, '|m', mut)")).alias("key"))


@query(
    "f15_immune_split",
    """SELECT CASE WHEN t.cell IS NULL THEN g.cell::VARCHAR ELSE concat(g.cell, '-', side) END AS cell, g.mut, CASE WHEN t.cell IS NULL OR (side = 'immune') = (g.mut < 6) THEN g.state END AS state
 FROM geno g LEFT JOIN two t ON t.cell = g.cell CROSS JOIN (VALUES ('immune'), ('non')) AS v(side) WHERE t.cell IS NOT NULL OR side = 'non'""",
    "two AS (SELECT cell FROM geno WHERE state = 1 GROUP BY cell HAVING bool_or(mut < 6) AND bool_or(mut >= 6))",
)
def f15(s, d):
    return calls.immune_split(fx.geno(s, d), fx.muts(s).where("mut < 6"))


@query("f16_phred", "SELECT q, round(1 - pow(10, -q / 10.0), 9) AS p, CASE WHEN q = 0 THEN 0 ELSE q END AS back FROM range(0, 41) t(q)")
def f16(s, d):
    q = s.range(41).select(F.col("id").alias("q"))
    return q.select("q", F.round(X.phred_to_probability(F.col("q")), 9).alias("p"), X.probability_to_phred(X.phred_to_probability(F.col("q"))).cast("long").alias("back"))


@query("f17_log10_p", "SELECT mut, round(log10(CASE WHEN coalesce(p, 1) = 0 THEN 1e-300 ELSE coalesce(p, 1) END), 9) AS lp FROM (SELECT mut, CASE WHEN mut % 3 > 0 THEN (mut % 5) / 10.0::DOUBLE END AS p FROM muts)")
def f17(s, d):
    return fx.muts(s).select("mut", F.round(X.log10_p(F.expr("CASE WHEN mut % 3 > 0 THEN (mut % 5) / 10D END")), 9).alias("lp"))


@query(
    "f18_text_helpers",
    """SELECT mut, (mut + 3)::BIGINT AS total, least(mut, 7)::DOUBLE AS least, CASE WHEN mut = 2 THEN 'b' ELSE 'a' END AS often, mut % 2 = 0 AS flag, concat('v', mut) AS v FROM muts""",
)
def f18(s, d):
    m = F.col("mut").cast("string")
    return fx.muts(s).select(
        "mut", X.map_sum(F.concat(F.lit("A:"), m, F.lit(",T:1,A:2"))).alias("total"), X.list_min(F.concat(m, F.lit(",7"))).alias("least"),
        X.most_frequent(F.when(F.col("mut") == 2, F.lit("b,a,b")).otherwise(F.lit("b,a"))).alias("often"), X.str_to_bool(F.when(F.col("mut") % 2 == 0, F.lit("Yes")).otherwise(F.lit("no"))).alias("flag"),
        F.element_at(X.key_values(F.concat(F.lit("k=v"), m, F.lit(";x=1"))), "k").alias("v"),
    )


@query("f19_annotation_place", "SELECT site, concat('chr', chrom, ':', pos, ',A>T') AS place FROM sites")
def f19(s, d):
    return fx.sites(s, d).select("site", X.annotation_place(F.expr("concat('chr', chrom, '_', pos, '_A_T')")).alias("place"))


_B = "b AS (SELECT * FROM (VALUES ('A'), ('C'), ('G'), ('T')) AS v(x)), ctx AS (SELECT p.x AS before, r.x AS ref, a.x AS alt, n.x AS after FROM b p, b r, b a, b n WHERE r.x <> a.x)"


def _contexts(s):
    b = s.createDataFrame([(x,) for x in "ACGT"], "x string")
    return b.toDF("before").crossJoin(b.toDF("ref")).crossJoin(b.toDF("alt")).crossJoin(b.toDF("after")).where("ref <> alt")


@query(
    "f20_contexts",
    """SELECT before, ref, alt, after, CASE WHEN ref IN ('C', 'T') THEN concat(before, '[', ref, '>', alt, ']', after) ELSE concat(translate(after, 'ACGT', 'TGCA'), '[', translate(ref, 'ACGT', 'TGCA'), '>', translate(alt, 'ACGT', 'TGCA'), ']', translate(before, 'ACGT', 'TGCA')) END AS dna,
 concat(before, '[', ref, '>', alt, ']', after) AS rna, round(len(regexp_extract_all(concat(before, ref, alt, after), '[GC]')) / 4.0, 9)::DOUBLE AS gc, before = ref AND ref = after AND before = alt AS run FROM ctx""",
    _B,
)
def f20(s, d):
    c = [F.col(x) for x in ("before", "ref", "alt", "after")]
    whole = F.concat(*c)
    return _contexts(s).select(*c, X.dna_context(*c).alias("dna"), X.rna_context(*c, F.lit("+")).alias("rna"), F.round(X.gc_share(whole), 9).alias("gc"), X.in_base_run(whole).alias("run"))


@query(
    "f21_context_labels",
    "SELECT concat(before, '[', ref, '>', alt, ']', after) AS label, concat(translate(after, 'ACGT', 'TGCA'), '[', translate(ref, 'ACGT', 'TGCA'), '>', translate(alt, 'ACGT', 'TGCA'), ']', translate(before, 'ACGT', 'TGCA')) AS partner FROM ctx",
    _B,
)
def f21(s, d):
    c = [F.col(x) for x in ("before", "ref", "alt", "after")]
    return _contexts(s).select(X.rna_context(*c, F.lit("+")).alias("label"), X.rna_context(*c, F.lit("-")).alias("partner"))


@query("f22_bin_up", "SELECT cell, ((x + 6) // 7 * 7)::BIGINT AS bx FROM spots")
def f22(s, d):
    return fx.spots(s, d).select("cell", X.bin_up(F.col("x"), 7).cast("long").alias("bx"))


_CIGARS = ("10M", "5S20M", "3H5S10M2I8M4S", "12M3D9M2H", "4M100N6M", "2S8M1D3M1I5M7S")


@query(
    "f23_cigar",
    """SELECT cigar, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[M=X]', 1), lambda x: x::INT)), 0)::INT AS matched, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[ID]', 1), lambda x: x::INT)), 0)::INT AS indel,
 len(regexp_extract_all(cigar, '[ID]'))::INT AS indels, coalesce(nullif(regexp_extract(cigar, '^(?:[0-9]+H)?([0-9]+)S', 1), '')::INT, 0) AS lead_clip, CASE WHEN regexp_matches(cigar, '[A-Z][0-9]+S(?:[0-9]+H)?$') THEN regexp_extract(cigar, '([0-9]+)S(?:[0-9]+H)?$', 1)::INT ELSE 0 END AS tail_clip FROM c""",
    "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _CIGARS) + ") AS v(cigar))",
)
def f23(s, d):
    c = F.col("cigar")
    return s.createDataFrame([(x,) for x in _CIGARS], "cigar string").select("cigar", X.cigar_length(c, "M=X").alias("matched"), X.cigar_length(c, "ID").alias("indel"), X.cigar_count(c, "ID").alias("indels"), X.soft_clips(c)["left"].alias("lead_clip"), X.soft_clips(c)["right"].alias("tail_clip"))


@query(
    "f24_class_decode",
    "SELECT mut, CASE WHEN m > 0.4 THEN 'mosaic' WHEN 1 - m > 0.6 AND mut % 2 = 0 THEN 'artifact' WHEN m > 0.2 THEN 'mosaic' WHEN m >= (CASE WHEN mut % 2 = 0 THEN 1 - m ELSE 0.1 END) THEN 'mosaic' ELSE 'artifact' END AS label FROM (SELECT mut, mut / 48.0::DOUBLE AS m FROM muts)",
)
def f24(s, d):
    rows = fx.muts(s).select("mut", F.expr("mut / 48D").alias("p_mosaic")).withColumn("p_artifact", F.expr("CASE WHEN mut % 2 = 0 THEN 1 - p_mosaic ELSE 0.1D END"))
    return calls.class_decode(rows, calls.SCRNA_LADDER).select("mut", "label")


@query("f25_spatial_flags", "SELECT cell, vaf > 0 AS has_mutant_allele, vaf > 0.5 AS high_prob, depth / 4.0 > 0.5 AS high_likelihood, vaf > 0 AND vaf > 0.5 AND depth / 4.0 > 0.5 AS mutated, ceil(depth * vaf)::BIGINT AS mutant_allele_num FROM spots")
def f25(s, d):
    rows = fx.spots(s, d).withColumn("p", F.col("vaf")).withColumn("likelihood", F.expr("depth / 4D"))
    return calls.spatial_flags(rows).select("cell", "has_mutant_allele", "high_prob", "high_likelihood", "mutated", "mutant_allele_num")


@query("f26_log_helpers", "SELECT mut, round(ln(greatest(mut / 10.0, 1e-10)), 9)::DOUBLE AS lf, round(ln(exp(-mut / 3.0) + exp(-2)), 9) AS lse, round(ln(exp(-mut / 9.0) - exp(-4)), 9) AS lde FROM muts")
def f26(s, d):
    m = F.col("mut")
    return fx.muts(s).select("mut", F.round(X.log_floor(m / 10), 9).alias("lf"), F.round(X.log_sum_exp(F.array(-m / 3, F.lit(-2.0))), 9).alias("lse"), F.round(X.log_diff_exp(-m / 9, F.lit(-4.0)), 9).alias("lde"))


@query("f27_clone_key", "SELECT grp, string_agg(mut::VARCHAR, '|' ORDER BY mut) AS key FROM groups GROUP BY grp")
def f27(s, d):
    return fx.groups(s).groupBy("grp").agg(F.expr("array_join(transform(array_sort(collect_list(mut)), x -> cast(x AS string)), '|')").alias("key"))


@query("f28_nonnull_mean", "SELECT mut, round(avg(vaf), 9) AS mean, round(median(vaf), 9) AS middle FROM (SELECT mut, CASE WHEN cell % 2 = 0 THEN vaf END AS vaf FROM obs) GROUP BY mut")
def f28(s, d):
    rows = fx.obs(s, d).select("mut", F.expr("CASE WHEN cell % 2 = 0 THEN vaf END").alias("x"))
    return r9(rows.groupBy("mut").agg(X.nonnull_mean(F.collect_list("x")).alias("mean"), F.expr("median(x)").alias("middle")))


@query("f29_derived_site", "SELECT site, (40 - pos % 40)::INT AS exon_from_end, round((pos % 7) / nullif(pos % 7 + chrom, 0)::DOUBLE, 9) AS alt2_share FROM sites")
def f29(s, d):
    return r9(fx.sites(s, d).select("site", F.expr("40 - pos % 40").alias("exon_from_end"), F.expr("try_divide(pos % 7, pos % 7 + chrom)").alias("alt2_share")))


@query("f30_identifier", "SELECT site, concat('chr', chrom) AS chrom, pos, 'A' AS ref, a AS alt FROM sites CROSS JOIN (VALUES ('C'), ('T')) AS v(a)")
def f30(s, d):
    rows = X.split_alts(fx.sites(s, d).select("site", F.expr("concat('chr', chrom, '_', pos, '_A_C,T')").alias("mut")))
    return rows.select("site", X.identifier(F.col("mut")).alias("i")).select("site", "i.chrom", "i.pos", "i.ref", "i.alt")


# ---- joins


@query("j01_align", "SELECT p.cell, p.mut, coalesce(o.alt, 0)::BIGINT AS alt, coalesce(o.total, 0)::BIGINT AS total FROM dense p LEFT JOIN obs o ON o.cell = p.cell AND o.mut = p.mut")
def j01(s, d):
    return fx.dense(s, d).select("cell", "mut").join(fx.obs(s, d), ["cell", "mut"], "left").select("cell", "mut", F.coalesce("alt", F.lit(0)).alias("alt"), F.coalesce("total", F.lit(0)).alias("total"))


@query("j02_features_with_depth", "SELECT s.mut, s.mutant_cells, x.depth FROM stats s LEFT JOIN (SELECT mut, sum(total)::BIGINT AS depth FROM obs WHERE mut % 3 > 0 GROUP BY mut) x USING (mut)", STATS)
def j02(s, d):
    return _stats(s, d).select("mut", "mutant_cells").join(fx.obs(s, d).where("mut % 3 > 0").groupBy("mut").agg(F.sum("total").alias("depth")), "mut", "left")


@query("j03_with_cell_coverage", "SELECT o.cell, o.mut, round(o.total / c.m, 9) AS relative FROM obs o LEFT JOIN (SELECT cell, avg(total) AS m FROM obs GROUP BY cell) c USING (cell)")
def j03(s, d):
    o = fx.obs(s, d)
    return r9(o.join(o.groupBy("cell").agg(F.avg("total").alias("m")), "cell", "left").select("cell", "mut", F.expr("total / m").alias("relative")))


@query("j08_three_way", "SELECT o.cell, o.mut, o.total, g.state, c.cell_type FROM obs o JOIN geno g ON g.cell = o.cell AND g.mut = o.mut JOIN cells c ON c.cell = o.cell")
def j08(s, d):
    return fx.obs(s, d).select("cell", "mut", "total").join(fx.geno(s, d), ["cell", "mut"]).join(fx.cells(s, d), "cell").select("cell", "mut", "total", "state", "cell_type")


@query("j14_pair_rows", "SELECT a.cell, a.mut AS u, b.mut AS v FROM geno a JOIN geno b USING (cell) WHERE a.mut < b.mut AND a.state = 1 AND b.state = 1")
def j14(s, d):
    g = fx.geno(s, d).where("state = 1").select("cell", "mut")
    return g.toDF("cell", "u").join(g.toDF("cell", "v"), "cell").where("u < v")


@query("j16_membership", "SELECT mut FROM muts WHERE mut NOT IN (SELECT u FROM edges UNION SELECT v FROM edges) OR mut % 5 = 0", EDGES)
def j16(s, d):
    e = pairs.correlated(fx.geno(s, d))
    return fx.muts(s).join(pairs.neighbours(e).select("mut").distinct(), "mut", "left_anti").union(fx.muts(s).where("mut % 5 = 0")).distinct()


# ---- aggregations


@query("a01_mutant_fraction", "SELECT mut, mutant_cells, round(mutant_fraction, 9) AS mutant_fraction FROM stats", STATS)
def a01(s, d):
    return r9(_stats(s, d))


@query("a02_proportions", "SELECT mut, round(avg((state IS NOT DISTINCT FROM 0)::INT), 9) AS p0, round(avg((state IS NOT DISTINCT FROM 1)::INT), 9) AS p1, round(avg((state IS NULL)::INT), 9) AS pna FROM dense GROUP BY mut")
def a02(s, d):
    return r9(matrix.proportions(fx.dense(s, d), fx.muts(s)))


@query("a03_pair_counts", "SELECT * FROM pc", PAIRS)
def a03(s, d):
    return pairs.pair_counts(fx.geno(s, d))


@query("a04_jaccard", "SELECT u, v, round(jaccard, 9) AS jaccard FROM pj", EDGES)
def a04(s, d):
    return r9(pairs.jaccard(pairs.pair_counts(fx.geno(s, d))).select("u", "v", "jaccard"))


@query("a05_fractions", "SELECT u, v, round(fu, 9) AS fu, round(fv, 9) AS fv FROM pj", EDGES)
def a05(s, d):
    g = fx.geno(s, d)
    return r9(pairs.fractions(pairs.pair_counts(g), pairs.mutant_counts(g)).select("u", "v", "fu", "fv"))


@query("a06_correlated", "SELECT u, v, round(jaccard, 9) AS jaccard, round(fu, 9) AS fu, round(fv, 9) AS fv FROM edges", EDGES)
def a06(s, d):
    return r9(pairs.correlated(fx.geno(s, d)))


@query("a07_neighbour_sets", "SELECT r, string_agg(mut::VARCHAR, '|' ORDER BY mut) AS members FROM near GROUP BY r", EDGES)
def a07(s, d):
    return pairs.neighbour_sets(pairs.correlated(fx.geno(s, d))).select("r", F.expr("array_join(transform(members, x -> cast(x AS string)), '|')").alias("members"))


_U = (
    EDGES
    + """, sums AS (SELECT r, cell, count(*) AS s FROM geno JOIN near USING (mut) WHERE state = 1 GROUP BY 1, 2),
sh AS (SELECT r, s, count(*) / sum(count(*)) OVER (PARTITION BY r) AS share FROM sums GROUP BY r, s),
ru AS (SELECT r, s, share, round(sum(share) OVER (PARTITION BY r ORDER BY s DESC), 9) AS running, max(s) OVER (PARTITION BY r) AS top FROM sh),
cut AS (SELECT r, coalesce(min(s) FILTER (running <= 0.1), max(top) + 1) AS q FROM ru GROUP BY r HAVING max(top) > 2 AND coalesce(sum(share) FILTER (s <= 2), 0) <= 0.5 AND (SELECT count(*) FROM near n WHERE n.r = ru.r) >= 3),
uset AS (SELECT mut AS r, cell FROM geno WHERE state = 1 UNION SELECT sums.r, cell FROM sums JOIN cut USING (r) WHERE s >= q)"""
)


@query("a08_reference_cells", "SELECT r, count(*) AS cells, sum(cell)::BIGINT AS total FROM uset GROUP BY r", _U)
def a08(s, d):
    g = fx.geno(s, d)
    return pairs.reference_cells(g, pairs.correlated(g)).groupBy("r").agg(F.count("*").alias("cells"), F.sum("cell").alias("total"))


@query(
    "a09_false_positive_scores",
    "SELECT r, round(avg(f), 8) AS fp_mean, round(stddev_pop(f), 8) AS fp_std, round(coalesce(stddev_pop(f) / nullif(avg(f), 0), 0), 8) AS fp_cv FROM f GROUP BY r",
    _U
    + """, one AS (SELECT mut, cell FROM geno WHERE state = 1), tot AS (SELECT mut, count(*) AS n FROM one GROUP BY mut), hit AS (SELECT r, mut, count(*) AS k FROM one JOIN uset USING (cell) GROUP BY 1, 2),
f AS (SELECT x.r, t.mut, CASE WHEN n.mut IS NOT NULL THEN (t.n - coalesce(k, 0)) / t.n::DOUBLE ELSE coalesce(k, 0) / t.n::DOUBLE END AS f FROM (SELECT DISTINCT r FROM uset) x CROSS JOIN tot t LEFT JOIN hit h ON h.r = x.r AND h.mut = t.mut LEFT JOIN near n ON n.r = x.r AND n.mut = t.mut WHERE x.r <> t.mut)""",
)
def a09(s, d):
    g = fx.geno(s, d)
    out = pairs.false_positive_scores(g, pairs.correlated(g))
    return out.select("r", *[F.round(c, 8).alias(c) for c in ("fp_mean", "fp_std", "fp_cv")])


_NA = "na AS (SELECT k.mut, t.cell_type, t.n, 1 - coalesce(x.k, 0) / t.n::DOUBLE AS na FROM muts k CROSS JOIN (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1) t LEFT JOIN (SELECT mut, cell_type, count(*) AS k FROM geno JOIN cells USING (cell) GROUP BY 1, 2) x ON x.mut = k.mut AND x.cell_type = t.cell_type)"


@query("a10_missing_by_type", "SELECT mut, cell_type, round(na, 9) AS na FROM na", _NA)
def a10(s, d):
    return r9(matrix.missing_by_type(fx.geno(s, d), fx.cells(s, d), fx.muts(s)).select("mut", "cell_type", "na"))


@query("a10_informative", "SELECT mut FROM (SELECT *, quantile_cont(na, 0.75) OVER (PARTITION BY cell_type) AS cut FROM na) GROUP BY mut HAVING count(*) FILTER (na < cut) >= 2", _NA)
def a10b(s, d):
    return matrix.informative(matrix.missing_by_type(fx.geno(s, d), fx.cells(s, d), fx.muts(s)), None)


_UNI = "uni AS (SELECT mut, median(total) AS median, count(*) / n AS mean, sqrt(count(*) / n * (1 - count(*) / n)) AS std FROM obs CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM cells) GROUP BY mut, n)"


@query("a11_uniformity", "SELECT mut, median, round(mean, 9) AS mean, round(std, 9) AS std, round(std / mean, 9) AS cv, std / mean <= 1.6 AS pass FROM uni", _UNI)
def a11(s, d):
    return r9(matrix.uniformity(fx.obs(s, d), fx.cells(s, d), 1.6))


@query("a12_clone_uniformity", "SELECT mut, round(sqrt(m * (1 - m)) / m, 9) AS cv FROM (SELECT mut, count(*) / n AS m FROM obs CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM cells WHERE cell_type = 1) WHERE cell % 5 = 1 GROUP BY mut, n)")
def a12(s, d):
    return r9(matrix.uniformity(fx.obs(s, d), fx.cells(s, d).where("cell_type = 1")).select("mut", "cv"))


@query(
    "a13_site_summary",
    """SELECT mut, sum(total)::BIGINT AS cov_in_pseudobulk, round(avg(total) FILTER (total <> 0), 9) AS avg_cov_percell, round(avg(vaf) FILTER (vaf <> 0), 9) AS "avg_mutAF_percell", max(vaf) AS "max_mutAF_percell",
 arg_max(total, {'v': vaf, 'c': -cell}) AS "cov_in_maxmutAFcell", max(alt) AS "max_mutAllele_num", sum(alt)::BIGINT AS "total_mutAllele_num", count(*) FILTER (alt > 0) AS "mutAllele_cellnum", count(*) FILTER (p >= 0.5) AS "moreCutoff_cellnum",
 count(*) FILTER (alt > 0 AND p >= 0.5) AS mutant_cellnum, round(count(*) FILTER (alt > 0 AND p >= 0.5) / count(*)::DOUBLE, 9) AS mutant_cell_fraction FROM obs GROUP BY mut""",
)
def a13(s, d):
    return r9(matrix.site_summary(fx.obs(s, d)))


@query("a14_pseudo_bulk", "SELECT mut, sum(alt)::BIGINT AS alt, sum(total)::BIGINT AS total FROM obs GROUP BY mut")
def a14(s, d):
    return matrix.pseudo_bulk(fx.obs(s, d))


_CL = "cl AS (SELECT cluster, count(*) AS spots, count(*) FILTER (alt > 0) AS mutant_spots, sum(alt)::BIGINT AS alt, sum(depth)::BIGINT AS depth, avg(vaf) AS mean_vaf, count(*) FILTER (alt > 0) / count(*)::DOUBLE AS ratio FROM spots GROUP BY cluster), clo AS (SELECT *, ratio > (SELECT quantile_cont(ratio, 0.75) + 1.5 * (quantile_cont(ratio, 0.75) - quantile_cont(ratio, 0.25)) FROM cl) AS outlier FROM cl)"


@query("a15_cluster_summary", "SELECT cluster, spots, mutant_spots, alt, depth, round(mean_vaf, 9) AS mean_vaf, round(ratio, 9) AS ratio, outlier FROM clo", _CL)
def a15(s, d):
    return r9(matrix.cluster_summary(fx.spots(s, d)))


@query("a15_outlier_summary", "SELECT outlier, count(*) AS clusters, sum(spots)::BIGINT AS spots, sum(alt)::BIGINT AS alt, sum(depth)::BIGINT AS depth FROM clo GROUP BY outlier", _CL)
def a15b(s, d):
    return matrix.outlier_summary(matrix.cluster_summary(fx.spots(s, d)))


@query("a35_state_counts", "SELECT coalesce(state::VARCHAR, 'NA') AS value, count(*) AS n FROM dense GROUP BY 1")
def a35(s, d):
    return matrix.state_counts(fx.dense(s, d))


@query("a36_cell_quality", "SELECT cell, round(sum(total) FILTER (mut < 3) / sum(total)::DOUBLE, 9) AS mt, count(*) AS genes FROM obs GROUP BY cell HAVING sum(total) FILTER (mut < 3) / sum(total)::DOUBLE < 0.25 AND count(*) > 5")
def a36(s, d):
    counts = fx.obs(s, d).select("cell", F.expr("CASE WHEN mut < 3 THEN concat('MT-', mut) ELSE concat('G', mut) END").alias("gene"), F.col("total").alias("n"))
    return r9(matrix.cell_quality(counts, genes=5).where("mt > 0"))


_SIG = "sg AS (SELECT sig AS signature, count(*) AS cells FROM (SELECT cell, string_agg(mut::VARCHAR, '|' ORDER BY mut) AS sig FROM geno WHERE state = 1 GROUP BY cell) GROUP BY 1)"


@query("a39_clone_signatures", "SELECT * FROM sg", _SIG)
def a39(s, d):
    return matrix.clone_signatures(fx.geno(s, d))


_SUB = "sg AS (SELECT sig AS signature, count(*) AS cells FROM (SELECT cell, string_agg(mut::VARCHAR, '|' ORDER BY mut) AS sig FROM geno WHERE state = 1 AND mut < 6 GROUP BY cell) GROUP BY 1), sp AS (SELECT signature, cells, string_split(signature, '|') AS m FROM sg)"


@query(
    "a39_absorb_subsets",
    "SELECT a.signature, a.cells, (SELECT b.signature FROM sp b WHERE len(b.m) > len(a.m) AND len(list_filter(a.m, lambda x: NOT list_contains(b.m, x))) = 0 ORDER BY len(b.m) DESC, b.signature DESC LIMIT 1) AS \"into\" FROM sp a",
    _SUB,
)
def a39b(s, d):
    return matrix.absorb_subsets(matrix.clone_signatures(fx.geno(s, d).where("mut < 6")))


_ORDER = STATS + ", fo AS (SELECT mut, row_number() OVER (ORDER BY CASE WHEN mutant_cells >= 30 THEN 6 ELSE mutant_cells // 5 END DESC, round(mutant_fraction, 9) DESC, mut) AS place FROM stats)"


@query("a42_plot_order", "SELECT cell, cell_type, clone_order, n, row_number() OVER (PARTITION BY clone_order ORDER BY n DESC, cell) AS place FROM (SELECT cell, min(place) AS clone_order, count(*) AS n FROM geno JOIN fo USING (mut) WHERE state = 1 GROUP BY cell) JOIN cells USING (cell)", _ORDER)
def a42(s, d):
    return matrix.plot_order(fx.geno(s, d), fx.cells(s, d), _stats(s, d)).select("cell", "cell_type", F.col("clone_order").cast("long").alias("clone_order"), "n", F.col("place").cast("long").alias("place"))


# ---- windows and sets


@query("w01_final_order", "SELECT mut, place FROM fo", _ORDER)
def w01(s, d):
    return matrix.final_order(_stats(s, d)).select("mut", F.col("place").cast("long").alias("place"))


_FREEZE = STATS + ", fz AS (SELECT mut, row_number() OVER (ORDER BY grp, round(mutant_fraction, 9) DESC, mut) AS place FROM groups JOIN stats USING (mut))"


@query("w02_freeze_ones", "SELECT c.cell, coalesce(min(place), 1073741824)::BIGINT AS first FROM (SELECT DISTINCT cell FROM geno) c LEFT JOIN geno g ON g.cell = c.cell AND state = 1 LEFT JOIN fz USING (mut) GROUP BY c.cell", _FREEZE)
def w02(s, d):
    _, keyed = matrix.freeze_ones(fx.geno(s, d), fx.groups(s), _stats(s, d))
    return keyed.select("cell", F.col("first").cast("long").alias("first"))


@query("w03_founders", "SELECT * FROM founders", FOUNDERS)
def w03(s, d):
    return _founders(s, d)


@query("w04_group_backbone", "SELECT mut, grp, founder FROM groups JOIN founders USING (grp)", FOUNDERS)
def w04(s, d):
    return fx.groups(s).join(_founders(s, d), "grp").select("mut", "grp", "founder")


@query("w05_cumulative_share", "SELECT total, round(share, 9) AS share, round(sum(share) OVER (ORDER BY total DESC), 9) AS running FROM (SELECT total, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM obs GROUP BY total)")
def w05(s, d):
    return r9(matrix.cumulative_share(fx.obs(s, d).groupBy("total").agg(F.count("*").alias("n")), "total", "n").select("total", "share", "running"))


@query(
    "w06_trimmed_cut",
    "SELECT round(greatest(0.1, avg(p) + 1.5 * stddev_pop(p)), 9) AS cut FROM (SELECT mutant_fraction AS p, row_number() OVER (ORDER BY mutant_fraction, mut) AS r, count(*) OVER () AS n FROM stats) WHERE r > floor(n * 0.05) AND r <= n - floor(n * 0.05)",
    STATS,
)
def w06(s, d):
    return r9(matrix.trimmed_cut(_stats(s, d), "mutant_fraction"))


@query("w06_ladder_cut", "SELECT round(least(0.9, greatest(0.1, m + s * CASE WHEN m + 2.6 * s <= 0.9 THEN 2.6 WHEN m + 2 * s <= 0.9 THEN 2 WHEN m + 1.5 * s <= 0.9 THEN 1.5 ELSE 1 END)), 9)::DOUBLE AS cut FROM (SELECT avg(mutant_fraction) AS m, stddev_pop(mutant_fraction) AS s FROM stats)", STATS)
def w06b(s, d):
    return r9(matrix.ladder_cut(_stats(s, d), "mutant_fraction"))


@query("w10_overlap_candidates", "SELECT * FROM rg WHERE lo <= (SELECT max(hi) FROM rg WHERE lo = (SELECT min(lo) FROM rg))", "rg AS (SELECT mut AS id, (mut * 7) % 11 AS lo, (mut * 7) % 11 + mut % 4 AS hi FROM muts)")
def w10(s, d):
    return matrix.overlap_candidates(fx.muts(s).select(F.col("mut").alias("id"), F.expr("mut * 7 % 11").alias("lo"), F.expr("mut * 7 % 11 + mut % 4").alias("hi")))


@query("x01_union_kept", "SELECT mut FROM uni WHERE std / mean <= 1.6 UNION SELECT mut FROM (SELECT *, quantile_cont(na, 0.75) OVER (PARTITION BY cell_type) AS cut FROM na) GROUP BY mut HAVING count(*) FILTER (na < cut) >= 2", _UNI + ", " + _NA)
def x01(s, d):
    return matrix.quality_mutations(fx.obs(s, d), fx.geno(s, d), fx.cells(s, d), fx.muts(s), None, 1.6)


@query("x02_append_cells", "SELECT cell, mut, state FROM geno UNION ALL SELECT -1 - c.range, k.mut, 0 FROM range(3) c CROSS JOIN muts k")
def x02(s, d):
    new = s.range(3).select(F.expr("-1 - id").alias("cell")).crossJoin(fx.muts(s)).withColumn("state", F.lit(0))
    return fx.geno(s, d).unionByName(new)


@query("x03_equal_columns", "SELECT string_agg(mut::VARCHAR, '|' ORDER BY mut) AS node, count(*)::INT AS n FROM (SELECT mut, list_sort(list(cell)) AS s FROM geno WHERE state = 1 GROUP BY mut) GROUP BY s")
def x03(s, d):
    return matrix.equal_columns(fx.geno(s, d))


@query("k05_metric_lists", "SELECT mut, string_agg(cell::VARCHAR, ',' ORDER BY cell) AS cells, count(*) AS n FROM geno WHERE state = 1 GROUP BY mut")
def k05(s, d):
    rows = fx.geno(s, d).where("state = 1")
    return rows.groupBy("mut").agg(F.expr("array_join(transform(array_sort(collect_list(cell)), x -> cast(x AS string)), ',')").alias("cells"), F.count("*").alias("n"))


@query(
    "k06_bulk_table",
    "SELECT mut, 'pseudo_bulk' AS source, sum(alt)::BIGINT AS mutant, sum(total - alt)::BIGINT AS reference FROM obs GROUP BY mut UNION ALL SELECT mut, 'cell', alt, total - alt FROM (SELECT *, row_number() OVER (PARTITION BY mut ORDER BY total DESC, cell) AS r FROM obs) WHERE r = 1",
)
def k06(s, d):
    return matrix.bulk_table(fx.obs(s, d))


@query("k07_phylip", "SELECT cell, string_agg(CASE state WHEN 1 THEN 'A' WHEN 0 THEN 'R' ELSE '-' END, '' ORDER BY mut) AS sequence FROM dense GROUP BY cell")
def k07(s, d):
    return matrix.phylip(fx.geno(s, d), fx.muts(s))


# ---- groups and graphs


@query(
    "g01_first_clones",
    "SELECT members, count(*) AS weight FROM (SELECT k.mut, string_agg(x.m::VARCHAR, '|' ORDER BY x.m) AS members FROM muts k JOIN (SELECT mut AS r, mut AS m FROM muts UNION ALL SELECT r, mut FROM near) x ON x.r = k.mut GROUP BY k.mut) GROUP BY members",
    EDGES,
)
def g01(s, d):
    return pairs.first_clones(fx.geno(s, d)).select(F.expr("array_join(transform(members, x -> cast(x AS string)), '|')").alias("members"), "weight")


@query("g02_clone_edges", "SELECT a.m AS u, b.m AS v, count(*) AS w FROM c a JOIN c b ON a.r = b.r AND a.m < b.m GROUP BY 1, 2", EDGES + ", c AS (SELECT mut AS r, mut AS m FROM muts UNION ALL SELECT r, mut FROM near)")
def g02(s, d):
    return pairs.clone_edges(pairs.first_clones(fx.geno(s, d)))


@query("g02_drop_lone", "SELECT mut FROM stats WHERE NOT (mut % 3 = 0 AND mutant_fraction <= 0.17)", STATS)
def g02b(s, d):
    clones = fx.muts(s).select(F.array("mut").alias("members"), F.expr("CASE WHEN mut % 3 = 0 THEN 100D ELSE 50D END").alias("weight"))
    return pairs.drop_lone(clones, _stats(s, d), 100.0, 0.17, 0).select(F.col("members")[0].alias("mut"))


_GW = EDGES + ", gw AS (SELECT least(a.grp, b.grp) AS a, greatest(a.grp, b.grp) AS b, sum(jaccard) AS w FROM edges JOIN groups a ON a.mut = u JOIN groups b ON b.mut = v WHERE a.grp <> b.grp GROUP BY 1, 2)"


@query("g04_group_weights", "SELECT a, b, round(w, 8) AS w FROM gw", _GW)
def g04(s, d):
    e = pairs.correlated(fx.geno(s, d)).withColumnRenamed("jaccard", "w")
    return pairs.group_weights(e, fx.groups(s)).select("a", "b", F.round("w", 8).alias("w"))


@query("g05_hubs", "SELECT grp, round(degree, 6) AS degree FROM dg WHERE round(degree, 6) > (SELECT quantile_cont(round(degree, 6), 0.75) FROM dg)", _GW + ", dg AS (SELECT grp, coalesce(sum(round(w, 6)), 0) AS degree FROM (SELECT DISTINCT grp FROM groups) LEFT JOIN gw ON a = grp OR b = grp GROUP BY grp)")
def g05(s, d):
    e = pairs.correlated(fx.geno(s, d)).withColumnRenamed("jaccard", "w")
    return pairs.hubs(pairs.group_weights(e, fx.groups(s)).withColumn("w", F.round("w", 6)), fx.groups(s)).select("grp", F.round("degree", 6).alias("degree"))


@query(
    "g06_components",
    "SELECT mut, min(label) AS label FROM reach GROUP BY mut",
    EDGES + ", strong AS (SELECT r, mut FROM near JOIN edges ON (u = least(r, mut) AND v = greatest(r, mut)) WHERE jaccard >= 0.12), reach AS (SELECT r AS mut, r AS label FROM strong UNION SELECT s.mut, reach.label FROM reach JOIN strong s ON s.r = reach.mut)",
)
def g06(s, d):
    return pairs.components_of(pairs.correlated(fx.geno(s, d)).where("jaccard >= 0.12"))


@query("g07_intersecting", "SELECT mut, count(*) AS shared FROM geno WHERE mut <> 5 AND state = 1 AND cell IN (SELECT cell FROM geno WHERE mut = 5 AND state = 1) GROUP BY mut HAVING count(*) >= 2")
def g07(s, d):
    return pairs.intersecting(fx.geno(s, d), 5, 2)


_SUPPORT = FOUNDERS + ", sup AS (SELECT g.mut, c.grp, count(*) AS cells, count(*) / (SELECT count(*) FROM geno z WHERE z.mut = g.mut AND z.state = 1)::DOUBLE AS share FROM geno g JOIN (SELECT DISTINCT cell, grp FROM geno JOIN founders ON founder = mut WHERE state = 1) c USING (cell) WHERE g.state = 1 GROUP BY 1, 2), best AS (SELECT mut, grp, cells FROM (SELECT *, row_number() OVER (PARTITION BY mut ORDER BY cells DESC, share DESC, grp) AS r FROM sup) WHERE r = 1)"


@query("g08_misgrouped", "SELECT b.mut, g.grp, b.grp AS best FROM best b JOIN groups g USING (mut) WHERE b.grp <> g.grp AND mut NOT IN (SELECT founder FROM founders)", _SUPPORT)
def g08(s, d):
    f = _founders(s, d)
    best = pairs.best_backbone(pairs.backbone_support(fx.geno(s, d), fx.groups(s), f))
    return pairs.misgrouped(best, fx.groups(s), f)


@query("g09_conflicts", "SELECT u, v FROM pc WHERE n11 > 0 AND n10 > 0 AND n01 > 0", PAIRS)
def g09(s, d):
    return pairs.conflicts(fx.geno(s, d))


@query("a31_backbone_support", "SELECT mut, grp, cells, round(share, 9) AS share FROM sup", _SUPPORT)
def a31(s, d):
    return r9(pairs.backbone_support(fx.geno(s, d), fx.groups(s), _founders(s, d)))


@query("a31_best_backbone", "SELECT * FROM best", _SUPPORT)
def a31b(s, d):
    return pairs.best_backbone(pairs.backbone_support(fx.geno(s, d), fx.groups(s), _founders(s, d)))


_AFF = EDGES + ", " + FOUNDERS + ", af AS (SELECT n.r AS mut, g.grp, count(*) / z.size::DOUBLE AS ratio, max((n.mut = f.founder)::INT) AS rep, z.size FROM near n JOIN groups g ON g.mut = n.mut JOIN founders f ON f.grp = g.grp JOIN (SELECT grp, count(*) AS size FROM groups GROUP BY grp) z ON z.grp = g.grp GROUP BY n.r, g.grp, z.size)"


@query("a32_clone_affinity", "SELECT mut, grp, round(ratio, 9) AS ratio, rep, round(ratio * (0.7 + 0.3 * least(1, size / 10.0)), 9)::DOUBLE AS score FROM af", _AFF)
def a32(s, d):
    return r9(pairs.clone_affinity(pairs.correlated(fx.geno(s, d)), fx.groups(s), _founders(s, d)).drop("size"))


@query("a32_best_clone", "SELECT mut, grp, rep, round(ratio, 9) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY mut ORDER BY rep DESC, round(ratio, 9) DESC, size DESC, grp) AS r FROM af) WHERE r = 1", _AFF)
def a32b(s, d):
    return r9(pairs.best_clone(pairs.clone_affinity(pairs.correlated(fx.geno(s, d)), fx.groups(s), _founders(s, d))))


@query("a33_group_presence", "SELECT grp, round(count(DISTINCT cell) / (SELECT count(DISTINCT cell) FROM geno WHERE mut = 3 AND state = 1)::DOUBLE, 9) AS fraction FROM geno JOIN groups USING (mut) WHERE state = 1 AND cell IN (SELECT cell FROM geno WHERE mut = 3 AND state = 1) GROUP BY grp")
def a33(s, d):
    g = fx.geno(s, d)
    return r9(pairs.group_presence(g, fx.groups(s), g.where("mut = 3 AND state = 1").select("cell")))


@query("a34_clone_labels", "SELECT cell, concat('C', dense_rank) AS label, mut AS backbone FROM geno JOIN (SELECT founder AS mut, dense_rank() OVER (ORDER BY grp) AS dense_rank FROM founders) USING (mut) WHERE state = 1", FOUNDERS)
def a34(s, d):
    return matrix.clone_labels(fx.geno(s, d), _founders(s, d))

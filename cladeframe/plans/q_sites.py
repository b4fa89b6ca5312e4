"""Queries of reads, tests and genomic joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.functions import tests_of as T
from cladeframe.operators import genomic, readstats

from . import fixtures as fx
from .q_relational import r9
from .registry import query

B4 = ", ".join(f"count(*) FILTER (base = '{b}') AS \"{b}\"" for b in "ATCG")


@query("a16_base_counts", f"SELECT cell, mut, {B4} FROM reads GROUP BY cell, mut")
def a16(s, d):
    return readstats.base_counts(fx.reads(s, d))


@query("a16_umi_base_counts", f"SELECT cell, umi, mut, {B4} FROM reads GROUP BY ALL")
def a16b(s, d):
    return readstats.umi_base_counts(fx.reads(s, d))


_RIGHT = "(1 - pow(10, -qual / 10.0))"
_UL = f"""u0 AS (SELECT cell, umi, mut, base, count(*) AS n, product({_RIGHT}) AS ok, product(1 - {_RIGHT}) AS bad FROM reads GROUP BY ALL),
u1 AS (SELECT cell, umi, mut, sum(n) AS reads, product(ok) AS allok FROM u0 GROUP BY ALL),
u2 AS (SELECT u1.*, b.base, b.k, coalesce(u0.n, 0) AS n, u0.ok, pow(10, -6 * (coalesce(u0.n, 0) + 0.5) / (reads + 2)) AS p,
       coalesce((SELECT product(o.bad) FROM u0 o WHERE o.cell = u1.cell AND o.umi = u1.umi AND o.mut = u1.mut AND o.base <> b.base), 1) AS others
       FROM u1 CROSS JOIN (VALUES ('A', 0), ('T', 1), ('C', 2), ('G', 3)) b(base, k) LEFT JOIN u0 ON u0.cell = u1.cell AND u0.umi = u1.umi AND u0.mut = u1.mut AND u0.base = b.base),
u3 AS (SELECT x.*, y.least_p, y.all_p FROM u2 x JOIN (SELECT i.cell, i.umi, i.mut, i.base, min(j.p) AS least_p, product(j.p) AS all_p FROM u2 i JOIN u2 j ON i.cell = j.cell AND i.umi = j.umi AND i.mut = j.mut AND i.base <> j.base GROUP BY ALL) y
       ON x.cell = y.cell AND x.umi = y.umi AND x.mut = y.mut AND x.base = y.base),
u4 AS (SELECT *, CASE WHEN n > 0 THEN 0.5 * {(1 - 1e-6) ** 100!r} * ok * others + 0.5 * allok * least_p ELSE allok * all_p END AS l FROM u3),
u5 AS (SELECT *, l / sum(l) OVER (PARTITION BY cell, umi, mut) AS likelihood FROM u4),
lk AS (SELECT *, CASE WHEN likelihood = 1 THEN 40 ELSE ceil(round(-10 * log10(1 - likelihood), 9))::INT END AS quality FROM u5),
uc AS (SELECT cell, umi, mut, base, quality, reads FROM lk QUALIFY row_number() OVER (PARTITION BY cell, umi, mut ORDER BY quality DESC, base <> 'A', k) = 1)"""


@query("t13_umi_likelihood", "SELECT cell, umi, mut, base, round(likelihood, 9) AS likelihood, quality FROM lk", _UL)
def t13(s, d):
    return readstats.umi_likelihood(fx.reads(s, d)).select("cell", "umi", "mut", "base", F.round("likelihood", 9).alias("likelihood"), "quality")


@query("a17_umi_consensus", "SELECT cell, umi, mut, base, quality, reads::BIGINT AS reads FROM uc", _UL)
def a17(s, d):
    return readstats.umi_consensus(fx.reads(s, d))


@query(
    "a17_bulk_consensus",
    "SELECT x.mut, x.base, spots, coalesce(consensus, 0)::BIGINT AS consensus, coalesce(qualities, 'NA') AS qualities, raw FROM (SELECT k.mut, b.base, spots, (SELECT count(*) FROM reads r WHERE r.mut = k.mut AND r.base = b.base) AS raw FROM (SELECT mut, count(DISTINCT cell) AS spots FROM reads GROUP BY mut) k CROSS JOIN (VALUES ('A'), ('T'), ('C'), ('G')) b(base)) x LEFT JOIN (SELECT mut, base, sum(n) AS consensus, string_agg(concat(quality, ':', n), ',' ORDER BY quality) AS qualities FROM (SELECT mut, base, quality, count(*) AS n FROM uc GROUP BY ALL) GROUP BY mut, base) y ON x.mut = y.mut AND x.base = y.base",
    _UL,
)
def a17c(s, d):
    return readstats.bulk_consensus(fx.reads(s, d))


@query("a17_bulk_quality", "SELECT mut, base, sum(n)::BIGINT AS reads, round(sum(qual * n) / sum(n)::DOUBLE, 9) AS mean_quality, string_agg(concat(qual, ':', n), ',' ORDER BY qual) AS histogram FROM (SELECT mut, base, qual, count(*) AS n FROM reads GROUP BY ALL) GROUP BY mut, base")
def a17b(s, d):
    return r9(readstats.bulk_quality(fx.reads(s, d)))


@query(
    "a18_error_counts",
    """SELECT mut, sum(n)::BIGINT AS reads, count(*) AS umis, count(*) FILTER (pcr) AS pcr, coalesce((SELECT string_agg(DISTINCT v.base, ',' ORDER BY v.base) FROM e0 v JOIN e1 w USING (mut, cell, umi) WHERE w.pcr AND v.base <> 'A' AND v.n >= 1 AND v.mut = e1.mut), '.') AS pcr_alts,
 count(lone) AS lysis, CASE WHEN count(lone) = 1 THEN min(lone) ELSE '.' END AS lysis_alt FROM e1 GROUP BY mut""",
    """e0 AS (SELECT mut, cell, umi, base, count(*) AS n FROM reads GROUP BY ALL),
e1 AS (SELECT mut, cell, umi, sum(n) AS n, count(*) > 1 AND max(CASE WHEN base <> 'A' THEN n ELSE 0 END) >= 1 AS pcr, CASE WHEN count(*) = 1 AND min(base) <> 'A' AND sum(n) > 1 THEN min(base) END AS lone FROM e0 GROUP BY ALL)""",
)
def a18(s, d):
    return readstats.error_counts(fx.reads(s, d), least=1)


@query(
    "a19_umi_consistency",
    "SELECT mut, count(*) AS umis, round(avg(s), 9) AS mean, round(avg((s = 1)::INT), 9) AS hard, round(avg((s >= 0.75)::INT), 9) AS soft, round(avg(s) FILTER (n > 1), 9) AS mean_multi, round(avg((s = 1)::INT) FILTER (n > 1), 9) AS hard_multi FROM (SELECT mut, count(*) AS n, count(*) FILTER (base = 'T') / count(*)::DOUBLE AS s FROM reads GROUP BY mut, cell, umi) WHERE s > 0 GROUP BY mut",
)
def a19(s, d):
    return r9(readstats.umi_consistency(fx.reads(s, d)))


@query(
    "a20_depth_statistics",
    """SELECT mut, item, round(avg(x) FILTER (a), 9) AS avg_mutant, round(max(x) FILTER (a), 9) AS max_mutant, round(min(x) FILTER (a), 9) AS min_mutant, round(avg(x) FILTER (NOT a), 9) AS avg_unmutant, round(max(x) FILTER (NOT a), 9) AS max_unmutant, round(min(x) FILTER (NOT a), 9) AS min_unmutant, round(avg(x) FILTER (a) - avg(x) FILTER (NOT a), 9) AS difference
 FROM (SELECT mut, alt > 0 AS a, unnest(['ref', 'alt', 'total', 'vaf']) AS item, unnest([(total - alt)::DOUBLE, alt::DOUBLE, total::DOUBLE, vaf]) AS x FROM obs) GROUP BY mut, item""",
)
def a20(s, d):
    return r9(readstats.depth_statistics(fx.obs(s, d)))


@query("a20_depth_counts", "SELECT mut, count(*) AS spots, count(*) FILTER (alt > 0) AS mutant_spots, round(avg((alt > 0)::INT), 9) AS mutant_share, sum(alt)::BIGINT AS alt, sum(total)::BIGINT AS total, round(sum(alt) / sum(total)::DOUBLE, 9) AS bulk_vaf FROM obs GROUP BY mut")
def a20b(s, d):
    return r9(readstats.depth_counts(fx.obs(s, d)))


@query("a21_mean_read_length", "SELECT cell, round(avg(qual), 9) AS mean_length FROM reads GROUP BY cell")
def a21(s, d):
    return r9(readstats.mean_read_length(fx.reads(s, d)))


@query(
    "a22_allele_features",
    """SELECT mut, base, count(*) AS reads, count(DISTINCT cell) AS cells, count(DISTINCT umi) AS umis, round(avg(qual), 9) AS mean_quality, median(qual) AS median_quality, round(avg(mapq), 9) AS mean_mapq, round(avg(reverse::INT), 9) AS reverse_share,
 count(DISTINCT place) AS places, round(avg((mapq = 0)::INT), 9) AS multi_share, round((SELECT max(k) FROM (SELECT count(*) AS k FROM reads z WHERE z.mut = r.mut AND z.base = r.base GROUP BY place)) / count(*)::DOUBLE, 9) AS top_place, round(count(*) / count(DISTINCT umi)::DOUBLE, 9) AS per_umi, round(count(*) / count(DISTINCT cell)::DOUBLE, 9) AS per_cell FROM reads r GROUP BY mut, base""",
)
def a22(s, d):
    return r9(readstats.allele_features(fx.reads(s, d)))


@query("s20_majority_strand", "SELECT mut, count(*) FILTER (reverse) AS minus, count(*) FILTER (NOT reverse) AS plus, CASE WHEN 2 * count(*) FILTER (reverse) > count(*) THEN '-' WHEN 2 * count(*) FILTER (reverse) < count(*) THEN '+' ELSE 'unknown' END AS strand FROM reads GROUP BY mut")
def s20(s, d):
    return readstats.majority_strand(fx.reads(s, d))


@query("w08_best_candidate", "SELECT mut, base, q FROM (SELECT mut, base, sum(qual)::BIGINT AS q, row_number() OVER (PARTITION BY mut ORDER BY sum(qual) DESC, base = 'A' DESC, base) AS r FROM reads GROUP BY mut, base) WHERE r = 1")
def w08(s, d):
    return readstats.best_candidate(fx.reads(s, d))


@query("a23_context_counts", "SELECT label, count(mut) AS n FROM (VALUES ('A'), ('C'), ('G'), ('T')) v(label) LEFT JOIN reads ON base = label GROUP BY label")
def a23(s, d):
    return readstats.context_counts(fx.reads(s, d).select(F.col("base").alias("label")), s.createDataFrame([(b,) for b in "ACGT"], "label string"))


@query("a38_near_depths", "SELECT site, string_agg(dp::VARCHAR, ',' ORDER BY dp) AS depths, count(*) AS n FROM (SELECT s.site, p.dp FROM sites s CROSS JOIN (VALUES (-200), (-50), (50), (200), (500)) o(o) JOIN (SELECT (p_size % 5)::INT AS chrom, floor(p_retailprice)::INT AS pos, max(p_size) AS dp FROM part GROUP BY 1, 2) p ON p.chrom = s.chrom AND p.pos = s.pos + o.o) GROUP BY site")
def a38(s, d):
    depth = fx.intervals(s, d).groupBy("chrom", F.col("start").alias("pos")).agg(F.max(F.expr("end - start")).alias("dp"))
    return readstats.near_depths(depth, fx.sites(s, d), (-200, -50, 50, 200, 500))


@query("a37_expression", "SELECT mut AS gene, n, round(n * 1e9 / ((1000 + mut * 10) * (SELECT count(*) FROM reads)::DOUBLE), 6)::DOUBLE AS fpkm FROM (SELECT mut, count(*) AS n FROM reads GROUP BY mut)")
def a37(s, d):
    counts = fx.reads(s, d).groupBy(F.col("mut").alias("gene")).agg(F.count("*").alias("n"))
    return readstats.expression(counts, fx.muts(s).select(F.col("mut").alias("gene"), F.expr("1000 + mut * 10").alias("bases"))).withColumn("fpkm", F.round("fpkm", 6))


@query("a37_exon_lengths", 'SELECT chrom AS gene, sum("end" - "start")::BIGINT AS bases FROM intervals GROUP BY chrom')
def a37b(s, d):
    return genomic.exon_lengths(fx.intervals(s, d).withColumnRenamed("chrom", "gene"))


@query("a40_phase_rows", "SELECT chrom::BIGINT AS site, arg_min(site, {'d': pos % 13, 's': site}) AS nearest, arg_max(site, {'u': pos % 7, 's': -site}) AS supported FROM sites GROUP BY chrom")
def a40(s, d):
    rows = fx.sites(s, d).select(F.col("chrom").cast("long").alias("site"), F.col("site").alias("snp"), F.expr("pos % 13").alias("distance"), F.expr("pos % 7").alias("support"))
    return readstats.phase_rows(rows)


# ---- tests

_RK = "rk AS (SELECT mut, base = 'T' AS a, rank() OVER (PARTITION BY mut ORDER BY qual) + (count(*) OVER (PARTITION BY mut, qual) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY mut, qual) AS ties FROM reads), rs AS (SELECT mut, count(*) FILTER (a)::DOUBLE AS n1, count(*) FILTER (NOT a)::DOUBLE AS n2, sum(r) FILTER (a)::DOUBLE AS s, sum(ties * ties - 1)::DOUBLE AS t FROM rk GROUP BY mut)"


def _sided(s, d):
    return fx.reads(s, d).select("mut", "qual", (F.col("base") == "T").alias("a"))


@query("t01_rank_sum", "SELECT mut, n1::BIGINT AS n1, n2::BIGINT AS n2, round((s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 9) AS z, round(2 * (s - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 9) AS rbc FROM rs", _RK)
def t01(s, d):
    return r9(T.rank_sum(_sided(s, d), "qual", "a", "mut"))


@query("t01_rank_sum_p")
def t01b(s, d):
    return T.with_p(T.rank_sum(_sided(s, d), "qual", "a", "mut"))


@query("t02_signed_rank_effect", "SELECT mut, round(coalesce(sum(CASE WHEN d > 0 THEN r ELSE -r END) / sum(r), 0), 9)::DOUBLE AS effect FROM (SELECT mut, d, rank() OVER (PARTITION BY mut ORDER BY abs(d)) + (count(*) OVER (PARTITION BY mut, abs(d)) - 1) / 2.0 AS r FROM (SELECT mut, round((total - avg(total) OVER w) / nullif(stddev_pop(total) OVER w, 0) - (alt - avg(alt) OVER w) / nullif(stddev_pop(alt) OVER w, 0), 9) AS d FROM obs WINDOW w AS (PARTITION BY mut)) WHERE d <> 0) GROUP BY mut")
def t02(s, d):
    return r9(T.signed_rank_effect(fx.obs(s, d), "total", "alt", "mut"))


@query("t03_mann_whitney")
def t03(s, d):
    return T.mann_whitney_greater(_sided(s, d), "qual", "a", "mut")


@query("t03_mann_whitney_u", "SELECT mut, s - n1 * (n1 + 1) / 2 AS u FROM rs", _RK)
def t03b(s, d):
    return T.mann_whitney_greater(_sided(s, d), "qual", "a", "mut").select("mut", "u")


_ST = "st AS (SELECT mut, count(*) FILTER (base = 'A' AND NOT reverse) AS ref_fwd, count(*) FILTER (base = 'A' AND reverse) AS ref_rev, count(*) FILTER (base = 'T' AND NOT reverse) AS alt_fwd, count(*) FILTER (base = 'T' AND reverse) AS alt_rev FROM reads GROUP BY mut)"


@query("t04_strand_odds", "SELECT *, round(ref_fwd * alt_rev / nullif(ref_rev * alt_fwd, 0)::DOUBLE, 9) AS odds FROM st", _ST)
def t04(s, d):
    return r9(readstats.strand_table(fx.reads(s, d)))


@query("t04_fisher_p")
def t04b(s, d):
    t = readstats.strand_table(fx.reads(s, d))
    return t.select("mut", T.fisher_p(F.col("ref_fwd"), F.col("ref_rev"), F.col("alt_fwd"), F.col("alt_rev")).alias("p"))


@query("t05_depth_regression", "SELECT mut, round(CASE WHEN stddev_pop(total) = 0 THEN 1 WHEN stddev_pop(alt) = 0 THEN 0 ELSE regr_r2(alt, total) END, 9)::DOUBLE AS r2 FROM obs GROUP BY mut")
def t05(s, d):
    return r9(T.depth_regression(fx.obs(s, d), "total", "alt", "mut"))


@query(
    "t05_signed_rank_terms",
    """SELECT p.mut, pairs, coalesce(n, 0)::BIGINT AS n, coalesce(ties, 0)::BIGINT AS ties, coalesce(spread, 0)::BIGINT AS spread, coalesce(least, 0)::DOUBLE AS least FROM (SELECT mut, count(*) AS pairs FROM obs GROUP BY mut) p LEFT JOIN
 (SELECT mut, count(*) AS n, count(*) FILTER (c > 1) AS ties, sum((c * c * c - c) / c::DOUBLE)::BIGINT AS spread, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS least FROM
  (SELECT *, rank() OVER (PARTITION BY mut ORDER BY abs(d)) + (count(*) OVER (PARTITION BY mut, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY mut, abs(d)) AS c FROM
   (SELECT mut, round(coalesce((total - avg(total) OVER w) / nullif(stddev_pop(total) OVER w, 0), 0) - coalesce((alt - avg(alt) OVER w) / nullif(stddev_pop(alt) OVER w, 0), 0), 9) AS d FROM obs WINDOW w AS (PARTITION BY mut)) WHERE d <> 0) GROUP BY mut) q USING (mut)""",
)
def t05b(s, d):
    return T.signed_rank_terms(fx.obs(s, d), "total", "alt", "mut")


@query("t05_dropout")
def t05c(s, d):
    return T.dropout(fx.obs(s, d), "total", "alt", "mut")


@query(
    "t06_projected_ks",
    """SELECT cluster, max(dd) AS d FROM (SELECT cluster, k, round(max(abs(sa / na - sb / nb)), 9) AS dd FROM (SELECT cluster, k, v, sum(a) OVER (PARTITION BY cluster, k ORDER BY v)::DOUBLE AS sa, sum(a) OVER (PARTITION BY cluster, k) AS na, sum(b) OVER (PARTITION BY cluster, k ORDER BY v)::DOUBLE AS sb, sum(b) OVER (PARTITION BY cluster, k) AS nb
 FROM (SELECT cluster, k, round(cos(pi() * k / 4.0) * x + sin(pi() * k / 4.0) * y, 9) AS v, count(*) FILTER (alt > 0) AS a, count(*) FILTER (alt = 0) AS b FROM spots CROSS JOIN range(4) q(k) GROUP BY ALL)) WHERE na > 0 AND nb > 0 GROUP BY cluster, k) GROUP BY cluster""",
)
def t06(s, d):
    rows = fx.spots(s, d).withColumn("a", F.expr("alt > 0"))
    return T.projected_ks(rows, "cluster", "a", 4).where("d IS NOT NULL").select("cluster", "d")


@query("t07_morans_i", "SELECT round(count(*) * zw / (k * sum(z * z)), 9) AS i FROM z CROSS JOIN (SELECT sum(a.z * b.z) AS zw, count(*) AS k FROM z a JOIN z b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y)) GROUP BY zw, k", "z AS (SELECT x, y, vaf - (SELECT avg(vaf) FROM spots) AS z FROM spots)")
def t07(s, d):
    return r9(T.morans_i(fx.spots(s, d), "vaf"))


@query("t08_permutation")
def t08(s, d):
    return T.permutation_p(_sided(s, d).where("mut < 6"), "qual", "a", "mut", 100)


@query("t09_robust_scale", "SELECT cell, mut, round((total - median(total) OVER (PARTITION BY mut)) / nullif(quantile_cont(total, 0.75) OVER (PARTITION BY mut) - quantile_cont(total, 0.25) OVER (PARTITION BY mut), 0), 9) AS scaled FROM obs")
def t09(s, d):
    return r9(T.robust_scale(fx.obs(s, d), "total", "mut").select("cell", "mut", "scaled"))


@query("t10_fdr", "SELECT mut, p, round(least(1, min(p * 24 / k) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 9)::DOUBLE AS fdr FROM (SELECT mut, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k FROM (SELECT mut, ((mut * 7) % 24 // 2) / 40.0::DOUBLE AS p FROM muts))")
def t10(s, d):
    return r9(T.fdr(fx.muts(s).select("mut", F.expr("(mut * 7 % 24 div 2) / 40D").alias("p")), "p", "mut").select("mut", "p", "fdr"))


@query("t11_strand_skew")
def t11(s, d):
    rows = fx.reads(s, d).groupBy(F.concat("base", F.col("reverse").cast("string")).alias("label")).agg(F.count("*").alias("n")).withColumn("n", F.expr("n % 200"))
    return T.strand_skew(rows.withColumn("partner", F.expr("concat(substr(label, 1, 1), CASE WHEN label LIKE '%true' THEN 'false' ELSE 'true' END)")))


@query("t12_segregation_bias", "SELECT mut, round(CASE WHEN a > 0 THEN ln(0.5) + CASE WHEN w > 0 THEN w + ln(1 + exp(-w)) ELSE ln(1 + exp(w)) END END, 9) AS bias FROM (SELECT mut, a, ln(0.5) + a * ln(2) - a AS w FROM (SELECT mut, count(*) FILTER (base = 'T') AS a FROM reads GROUP BY mut))")
def t12(s, d):
    return r9(T.segregation_bias(fx.reads(s, d)))


_VALUES = ", ".join(f"({i}, {n}, {a}, {b})" for i, (n, a, b) in enumerate(T.DISTANCE_BIAS))


@query(
    "t12_distance_terms",
    f"""SELECT mut, depth, round(distance, 9) AS distance, round(CASE WHEN depth >= 200 THEN 0.7 WHEN hi.d = depth THEN hi.a ELSE (lo.a + hi.a) / 2 END, 9)::DOUBLE AS scale, round(CASE WHEN depth >= 200 THEN 23.7 WHEN hi.d = depth THEN hi.b ELSE (lo.b + hi.b) / 2 END, 9)::DOUBLE AS shift
 FROM (SELECT mut, count(*) AS depth, avg(abs(place - m)) AS distance FROM (SELECT mut, place, avg(place) OVER (PARTITION BY mut) AS m FROM reads WHERE base = 'T') GROUP BY mut) x
 LEFT JOIN par hi ON x.depth >= 3 AND hi.i = (SELECT min(i) FROM par WHERE d >= x.depth) LEFT JOIN par lo ON lo.i = hi.i - 1""",
    f"par AS (SELECT * FROM (VALUES {_VALUES}) v(i, d, a, b))",
)
def t12b(s, d):
    return r9(T.distance_terms(fx.reads(s, d)))


@query("t12_variant_distance")
def t12c(s, d):
    return T.variant_distance(fx.reads(s, d))


@query(
    "t12_rank_bias",
    """SELECT mut, round(CASE WHEN na = 0 OR nb = 0 THEN 'inf'::DOUBLE WHEN na * nb / 12 * ((na + nb + 1) - t / ((na + nb) * (na + nb - 1))) <= 0 THEN 0 ELSE (u - na * nb / 2) / sqrt(na * nb / 12 * ((na + nb + 1) - t / ((na + nb) * (na + nb - 1)))) END, 9) AS z FROM
 (SELECT mut, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb, sum(pow(a + b, 3) - (a + b)) AS t, sum(a * (over_ + b / 2.0)) AS u FROM (SELECT x.*, coalesce((SELECT sum(y.b) FROM pl y WHERE y.mut = x.mut AND y.place > x.place), 0) AS over_ FROM pl x) GROUP BY mut)""",
    "pl AS (SELECT mut, place, count(*) FILTER (base = 'A')::DOUBLE AS a, count(*) FILTER (base = 'T')::DOUBLE AS b FROM reads GROUP BY mut, place)",
)
def t12d(s, d):
    return r9(T.rank_bias(fx.reads(s, d)))


@query("t19_iqr_outliers", "SELECT cell, mut, total > (SELECT quantile_cont(total, 0.75) + 1.5 * (quantile_cont(total, 0.75) - quantile_cont(total, 0.25)) FROM obs) OR total < (SELECT quantile_cont(total, 0.25) - 1.5 * (quantile_cont(total, 0.75) - quantile_cont(total, 0.25)) FROM obs) AS outlier FROM obs")
def t19(s, d):
    return T.iqr_outliers(fx.obs(s, d), "total").select("cell", "mut", "outlier")


# ---- genomic joins


@query("j10_points_in", 'SELECT site, iid FROM sites s JOIN intervals i ON s.chrom = i.chrom AND pos >= "start" AND pos < "end"')
def j10(s, d):
    return genomic.points_in(fx.sites(s, d), fx.intervals(s, d)).select("site", "iid")


@query("j10_annotated", 'SELECT site, min(iid) AS hit FROM sites s LEFT JOIN intervals i ON s.chrom = i.chrom AND pos >= "start" AND pos < "end" GROUP BY site')
def j10b(s, d):
    return genomic.annotate_points(fx.sites(s, d), fx.intervals(s, d), "site", "iid").select("site", "hit")


@query("j11_nearest_boundary", 'SELECT site, min(abs(pos - b)) AS distance FROM sites s JOIN (SELECT chrom, unnest(["start", "end"]) AS b FROM intervals) i ON s.chrom = i.chrom GROUP BY site')
def j11(s, d):
    return genomic.nearest_boundary(fx.sites(s, d), fx.intervals(s, d), "site")


@query("j09_semi_match", "SELECT chrom, iid FROM intervals WHERE (chrom, \"start\") IN (SELECT chrom, pos FROM sites)")
def j09(s, d):
    return genomic.semi_match(fx.sites(s, d).select("chrom", F.col("pos").alias("start")), fx.intervals(s, d), ["chrom", "start"]).select("chrom", "iid")


@query("j06_with_signature", "SELECT site, s.chrom, round(x.p, 9) AS p FROM sites s LEFT JOIN (SELECT chrom, avg(pos) AS p FROM sites WHERE chrom < 3 GROUP BY chrom) x USING (chrom)")
def j06(s, d):
    t = fx.sites(s, d)
    return r9(t.join(t.where("chrom < 3").groupBy("chrom").agg(F.avg("pos").alias("p")), "chrom", "left").select("site", "chrom", "p"))


@query("j12_gene_lookup", "SELECT s.site, i.iid FROM sites s JOIN intervals i ON i.iid = s.pos")
def j12(s, d):
    return fx.sites(s, d).join(fx.intervals(s, d), F.col("iid") == F.col("pos")).select("site", "iid")


@query("j13_annotate_variants", "SELECT site, CASE WHEN pos % 4 = 0 THEN 'NONE' WHEN pos % 3 = 0 THEN 'exonic(syn)' ELSE 'intronic' END AS region, CASE WHEN pos % 4 = 0 THEN 'NONE' ELSE concat('G', chrom) END AS gene FROM sites")
def j13(s, d):
    t = fx.sites(s, d)
    functions = t.where("pos % 4 <> 0").select("site", F.expr("CASE WHEN pos % 3 = 0 THEN 'exonic' ELSE 'intronic' END").alias("region"), F.expr("concat('G', chrom, '(NM_1)')").alias("gene"))
    return genomic.annotate_variants(t.select("site"), functions, t.where("pos % 3 = 0 AND pos % 4 <> 0").select("site", F.lit("syn").alias("func")))


@query(
    "j17_allele_prior",
    "SELECT site, round(CASE WHEN pos % 3 = 0 THEN 0.97 ELSE 1 END, 9)::DOUBLE AS \"A\", round(CASE WHEN pos % 3 = 0 THEN 0.02 ELSE 0 END, 9)::DOUBLE AS \"T\", round(CASE WHEN pos % 3 = 0 THEN 0.01 ELSE 0 END, 9)::DOUBLE AS \"C\", 0::DOUBLE AS \"G\" FROM sites",
)
def j17(s, d):
    t = fx.sites(s, d).withColumn("ref", F.lit("A"))
    known = t.where("pos % 3 = 0").select("chrom", "pos").distinct().select("chrom", "pos", F.explode(F.expr("array(struct('T' AS alt, 0.02D AS af), struct('C' AS alt, 0.01D AS af))")).alias("x")).select("chrom", "pos", "x.alt", "x.af")
    return r9(genomic.allele_prior(t, known))


@query("s15_choose_table", "SELECT site, CASE WHEN pos % 2 = 0 THEN chrom::VARCHAR WHEN pos % 3 = 0 THEN pos::VARCHAR ELSE 'none' END AS value FROM sites")
def s15(s, d):
    t = fx.sites(s, d)
    return genomic.choose_table(t.select("site"), t.where("pos % 2 = 0").select("site", F.col("chrom").alias("value")), t.where("pos % 3 = 0").select("site", F.col("pos").alias("value")), "site", "value")


@query("m03_clean_features", "SELECT site, round(coalesce(TRY_CAST(f AS DOUBLE), (SELECT median(TRY_CAST(f AS DOUBLE)) FROM x)), 9) AS f FROM x", "x AS (SELECT site, CASE WHEN pos % 5 = 0 THEN 'no' ELSE (pos / 10.0)::DOUBLE::VARCHAR END AS f FROM sites)")
def m03(s, d):
    from cladeframe.operators.models import clean_features

    rows = fx.sites(s, d).select("site", F.expr("CASE WHEN pos % 5 = 0 THEN 'no' ELSE cast(pos / 10D AS string) END").alias("f"))
    return r9(clean_features(rows, ["f"]).select("site", "f"))


@query("m05_label_cleanup", "SELECT site, CASE WHEN chrom = 1 THEN 'T cell' ELSE concat('B', chrom) END AS label FROM sites")
def m05(s, d):
    from cladeframe.operators.models import clean_labels

    return clean_labels(fx.sites(s, d).select("site", F.expr("CASE WHEN chrom = 1 THEN ' T_cell.2 ' ELSE concat('B', chrom) END").alias("label")))


_LL = ("cell", "mut", "ln(0.05 + 0.9 * vaf) AS ll_mut", "ln(0.95 - 0.9 * vaf) AS ll_unmut")


@query("t14_carrier_counts")
def t14(s, d):
    from cladeframe.operators.posterior import carrier_counts

    return carrier_counts(fx.obs(s, d).selectExpr(*_LL))


@query(
    "t14_none_and_some",
    "SELECT mut, count(*) AS cells, round(exp(sum(ln((0.95 - 0.9 * vaf) / (1.0 - 0)))), 9) AS p_none, round(1 - exp(sum(ln(0.95 - 0.9 * vaf))), 9) AS p_one FROM obs GROUP BY mut",
)
def t14b(s, d):
    """The ends of the distribution of carriers, which have a closed form; the likelihoods of a cell add up to 1 here."""
    from cladeframe.operators.posterior import carrier_counts

    return r9(carrier_counts(fx.obs(s, d).selectExpr(*_LL)).select("mut", "cells", "p_none", "p_one"))


@query("t17_site_posteriors")
def t17(s, d):
    from cladeframe.operators.posterior import site_posteriors

    cells = fx.cells(s, d)
    kinds = cells.selectExpr("cell", "cell_type AS cluster", "'leaf' AS kind").unionByName(cells.where("cell_type < 3").selectExpr("cell", "10 AS cluster", "'internal' AS kind"))
    kinds = kinds.unionByName(cells.selectExpr("cell", "20 + cell_type div 2 AS cluster", "'pivot' AS kind").withColumn("cluster", F.col("cluster").cast("int")))
    return site_posteriors(fx.obs(s, d).selectExpr(*_LL), kinds)

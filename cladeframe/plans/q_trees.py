"""Queries of flips, false positives and negatives, and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import flips, matrix, pairs, trees

from . import fixtures as fx
from .q_relational import FOUNDERS, STATS, _founders, _stats, r9
from .registry import query

ROWS = "rows AS (SELECT d.cell, d.mut, d.state, coalesce(m.v, 0) AS v FROM dense d LEFT JOIN m ON m.cell = d.cell AND m.mut = d.mut)"
FN, FP, NA0, NA1 = "state = 0 AND v = 1", "state = 1 AND v = 0", "state IS NULL AND v = 0", "state IS NULL AND v = 1"
COUNTS = f"count(*) FILTER ({FN}) AS fn, count(*) FILTER ({FP}) AS fp, count(*) FILTER ({NA0}) AS na0, count(*) FILTER ({NA1}) AS na1, count(*) FILTER (state IS NOT NULL AND state = v) AS same"
#: an imputed matrix with false positives too: `m` without the mutations 3 and 7 in cells divisible by 3
ROWS2 = "m2 AS (SELECT * FROM m WHERE NOT (mut IN (3, 7, 10) AND cell % 3 = 0)), rows AS (SELECT d.cell, d.mut, d.state, coalesce(m2.v, 0) AS v FROM dense d LEFT JOIN m2 ON m2.cell = d.cell AND m2.mut = d.mut)"


def _rows(s, d):
    return flips.compare(fx.dense(s, d), fx.imputed(s, d))


def _imputed2(s, d):
    return fx.imputed(s, d).where("NOT (mut IN (3, 7, 10) AND cell % 3 = 0)")


def _rows2(s, d):
    return flips.compare(fx.dense(s, d), _imputed2(s, d))


@query("j15_observed_imputed", "SELECT cell, mut, state, v FROM rows WHERE state IS NOT NULL", ROWS)
def j15(s, d):
    return _rows(s, d).where("state IS NOT NULL").select("cell", "mut", "state", "v")


@query("a24_flips_total", f"SELECT {COUNTS} FROM rows", ROWS2)
def a24(s, d):
    return flips.flip_counts(_rows2(s, d))


@query("a24_flips_by_mutation", f"SELECT mut, {COUNTS} FROM rows GROUP BY mut", ROWS2)
def a24b(s, d):
    return flips.flip_counts(_rows2(s, d), "mut")


@query("a24_flips_by_cell", f"SELECT cell, {COUNTS} FROM rows GROUP BY cell", ROWS2)
def a24c(s, d):
    return flips.flip_counts(_rows2(s, d), "cell")


@query("k05_flip_lists", "SELECT mut, " + ", ".join(f"coalesce(string_agg(cell::VARCHAR, ',' ORDER BY cell) FILTER ({c}), '') AS {n}" for n, c in (("fn", FN), ("fp", FP), ("na0", NA0), ("na1", NA1))) + " FROM rows GROUP BY mut", ROWS2)
def k05b(s, d):
    return flips.flip_lists(_rows2(s, d))


@query("a41_flip_codes", "SELECT cell, mut, concat(coalesce(state, 3), '>', v) AS code FROM rows", ROWS2)
def a41(s, d):
    return flips.flip_codes(_rows2(s, d))


@query(
    "a25_across_tree_ratios",
    """SELECT k.mut, round(coalesce(sm.s / 23.0, 0), 9)::DOUBLE AS fp_ratio, round(coalesce(coalesce(z.n, 0) / nullif(coalesce(z.n, 0) + coalesce(o.n, 0), 0)::DOUBLE, 0), 9) AS fn_ratio FROM muts k
 LEFT JOIN (SELECT i.mut, sum(i.k / t.n::DOUBLE) AS s FROM (SELECT a.mut, b.mut AS o, count(*) AS k FROM rows a JOIN rows b ON a.cell = b.cell AND a.mut <> b.mut WHERE a.v = 1 AND b.state = 1 AND b.v = 0 GROUP BY 1, 2) i JOIN (SELECT mut, count(*) AS n FROM rows WHERE state = 1 AND v = 0 GROUP BY mut) t ON t.mut = i.o GROUP BY i.mut) sm ON sm.mut = k.mut
 LEFT JOIN (SELECT mut, count(*) AS n FROM rows WHERE v = 1 AND state = 0 GROUP BY mut) z ON z.mut = k.mut
 LEFT JOIN (SELECT mut, count(*) AS n FROM rows WHERE state = 1 AND cell IN (SELECT cell FROM rows WHERE state = 1 GROUP BY cell HAVING count(*) > 1) GROUP BY mut) o ON o.mut = k.mut""",
    ROWS2,
)
def a25(s, d):
    return r9(flips.across_tree_ratios(_rows2(s, d)))


@query(
    "a26_subclone_ratios",
    """SELECT c.mut, round(count(DISTINCT cell) FILTER (far) / z.n::DOUBLE, 9) AS out_ratio, round(count(DISTINCT cell) FILTER (near) / z.n::DOUBLE, 9) AS in_ratio
 FROM (SELECT a.mut, a.cell, b.mut % 4 <> a.mut % 4 AS far, b.mut % 4 = a.mut % 4 AS near FROM rows a LEFT JOIN rows b ON b.cell = a.cell AND b.mut <> a.mut AND b.state = 1 AND b.v = 0 WHERE a.v = 1) c JOIN (SELECT mut, count(*) AS n FROM rows WHERE v = 1 GROUP BY mut) z USING (mut) GROUP BY c.mut, z.n""",
    ROWS2,
)
def a26(s, d):
    return r9(flips.subclone_ratios(_rows2(s, d), fx.groups(s)))


@query("a27_site_ratio", "SELECT mut, count(*) FILTER (v = 0) AS fp, count(*) AS ones, round(count(*) FILTER (v = 0) / count(*)::DOUBLE, 9) AS ratio FROM rows a WHERE state = 1 AND EXISTS (SELECT 1 FROM rows b WHERE b.cell = a.cell AND b.v = 1 AND b.mut % 4 = a.mut % 4) GROUP BY mut", ROWS2)
def a27(s, d):
    return r9(flips.site_ratio(_rows2(s, d), fx.groups(s)))


_FPM = ROWS2 + ", fpm AS (SELECT a.mut, count(*) FILTER (v = 0) AS fp, count(*) FILTER (v = 0) / count(*)::DOUBLE AS ratio FROM rows a WHERE state = 1 GROUP BY mut)"


@query(
    "a28_false_positive_cells",
    "SELECT f.mut, f.fp, round(f.ratio, 9) AS ratio, coalesce((SELECT string_agg(DISTINCT b.mut::VARCHAR, ',' ORDER BY b.mut::VARCHAR) FROM rows a JOIN rows b ON a.cell = b.cell AND b.v = 1 AND b.mut <> a.mut WHERE a.mut = f.mut AND a.state = 1 AND a.v = 0), '') AS others FROM fpm f",
    _FPM,
)
def a28(s, d):
    return r9(flips.false_positive_cells(_rows2(s, d))).withColumn("others", F.expr("array_join(array_sort(split(others, ',')), ',')"))


@query("a28_false_positives_by_cell", "SELECT cell, count(*) FILTER (state = 1 AND v = 0) AS fp, count(*) FILTER (state = 1) AS ones, round(coalesce(count(*) FILTER (state = 1 AND v = 0) / nullif(count(*) FILTER (state = 1), 0)::DOUBLE, 0), 9) AS ratio FROM rows GROUP BY cell", ROWS2)
def a28b(s, d):
    return r9(flips.false_positives_by_cell(_rows2(s, d)))


@query("a28_summary", "SELECT round(avg(ratio), 9) AS mean, round(median(ratio), 9) AS median, sum(fp)::BIGINT AS fp FROM fpm", _FPM)
def a28c(s, d):
    return r9(flips.false_positive_summary(_rows2(s, d)))


@query(
    "a29_retention",
    """SELECT k.mut, coalesce(kept, 0) AS kept, coalesce(flips, 0) AS flips, round(coalesce(kept / nullif(kept + flips, 0)::DOUBLE, 1), 9) AS ratio, coalesce(cells, 0) AS cells FROM muts k LEFT JOIN
 (SELECT a.mut, count(*) FILTER (b.state = 1) AS kept, count(*) FILTER (b.state = 0 AND b.v = 1) AS flips, count(DISTINCT CASE WHEN b.state = 1 THEN a.cell END) AS cells FROM rows a JOIN up ON up.node = a.mut AND up.depth > 0 JOIN rows b ON b.cell = a.cell AND b.mut = up.ancestor WHERE a.state = 1 AND a.v = 1 GROUP BY a.mut) x USING (mut)""",
    ROWS2,
)
def a29(s, d):
    return r9(flips.retention(fx.dense(s, d), _imputed2(s, d), fx.tree(s)))


_SUP = ROWS2 + f", sup AS (SELECT cell, count(*) FILTER (state = 1 AND v = 1) AS \"both\", count(*) FILTER ({FN}) AS fn, count(*) FILTER (v = 1 AND coalesce(state, 0) = 0) AS to_one FROM rows GROUP BY cell)"


@query("a30_cell_support", "SELECT * FROM sup", _SUP)
def a30(s, d):
    return flips.cell_support(_rows2(s, d))


@query("a30_removable_cells", 'SELECT cell FROM sup WHERE "both" = 1 AND fn >= 1 AND to_one >= 2', _SUP)
def a30b(s, d):
    return flips.removable_cells(flips.cell_support(_rows2(s, d)))


_OUT = ROWS2 + ", oc AS (SELECT * FROM (SELECT cell, count(*) FILTER (mut < 18 AND v = 1) AS vm, count(*) FILTER (mut >= 18 AND v = 1) AS vo, count(*) FILTER (mut < 18 AND v = 1 AND state = 1) AS main, count(*) FILTER (mut >= 18 AND v = 1 AND state = 1) AS out FROM rows GROUP BY cell) WHERE vm > 0 AND vo > 0)"


def _outgroup(s):
    return fx.muts(s).where("mut >= 18")


@query("tr24_outgroup_conflicts", "SELECT cell, main, out, CASE WHEN main > out THEN 'main' ELSE 'outgroup' END AS decision FROM oc", _OUT)
def tr24(s, d):
    return flips.outgroup_conflicts(_rows2(s, d), _outgroup(s))


@query("g10_conflicting_cells", "SELECT cell FROM oc", _OUT)
def g10(s, d):
    return flips.conflicting_cells(_rows2(s, d), _outgroup(s))


@query("tr24_resolved", "SELECT cell, mut FROM m2 LEFT JOIN oc USING (cell) WHERE oc.cell IS NULL OR (main > out) = (mut < 18)", _OUT)
def tr24b(s, d):
    return flips.resolve_outgroup(_imputed2(s, d), flips.outgroup_conflicts(_rows2(s, d), _outgroup(s)), _outgroup(s))


@query("j04_full_outer_metrics", "SELECT coalesce(a.mut, b.mut) AS mut, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT mut, count(*) AS x FROM geno WHERE mut < 16 AND state = 1 GROUP BY mut) a FULL JOIN (SELECT mut, count(*) AS y FROM geno WHERE mut > 8 AND state = 0 GROUP BY mut) b ON a.mut = b.mut")
def j04(s, d):
    g = fx.geno(s, d)
    a, b = g.where("mut < 16 AND state = 1").groupBy("mut").agg(F.count("*").alias("x")), g.where("mut > 8 AND state = 0").groupBy("mut").agg(F.count("*").alias("y"))
    return a.join(b, "mut", "full").select("mut", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


@query("j05_metric_versions", "SELECT a.mut, a.n AS n_1, b.n AS n_2 FROM (SELECT mut, count(*) AS n FROM geno WHERE state = 1 GROUP BY mut) a LEFT JOIN (SELECT mut, count(*) AS n FROM geno WHERE state = 1 AND cell % 2 = 0 AND mut % 3 > 0 GROUP BY mut) b USING (mut)")
def j05(s, d):
    one = fx.geno(s, d).where("state = 1")
    return flips.metric_versions(one.groupBy("mut").agg(F.count("*").alias("n")), one.where("cell % 2 = 0 AND mut % 3 > 0").groupBy("mut").agg(F.count("*").alias("n")), "mut")


# ---- trees


@query("tr02_star", "SELECT founder AS node, -1::BIGINT AS parent FROM founders", FOUNDERS)
def tr02(s, d):
    return trees.star(_founders(s, d))


_CC = FOUNDERS + ", sc AS (SELECT cell, grp, count(*) AS n, max((mut = founder)::INT) AS f, sum(CASE WHEN mut = founder THEN 2 ELSE 1 END)::DOUBLE AS w FROM geno JOIN groups USING (mut) JOIN founders USING (grp) WHERE state = 1 GROUP BY 1, 2)"


@query("tr03_cell_clones", "SELECT cell, grp, n AS score FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, f DESC, grp) AS r FROM sc) WHERE r = 1", _CC)
def tr03(s, d):
    return trees.cell_clones(fx.geno(s, d), fx.groups(s), _founders(s, d))


@query("tr03_weighted", "SELECT cell, grp, w AS score FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY w DESC, grp) AS r FROM sc) WHERE r = 1", _CC)
def tr03b(s, d):
    return trees.weighted_cell_clones(fx.geno(s, d), fx.groups(s), _founders(s, d))


@query("tr03_prevalent", "SELECT cell, grp, n AS score FROM (SELECT sc.*, row_number() OVER (PARTITION BY cell ORDER BY n DESC, p.c DESC, sc.grp) AS r FROM sc JOIN (SELECT grp, count(DISTINCT cell) AS c FROM geno JOIN groups USING (mut) WHERE state = 1 GROUP BY grp) p ON p.grp = sc.grp) WHERE r = 1", _CC)
def tr03c(s, d):
    return trees.prevalent_cell_clones(fx.geno(s, d), fx.groups(s))


@query("tr04_closure", "SELECT * FROM up")
def tr04(s, d):
    return trees.closure(fx.tree(s))


@query("tr04_paths", "SELECT node, string_agg(ancestor::VARCHAR, '>' ORDER BY depth) AS path FROM up GROUP BY node")
def tr04b(s, d):
    return trees.paths_to_root(fx.tree(s))


@query("tr04_path_between", "SELECT ancestor AS node FROM up WHERE node = 21 AND depth <= 2 UNION ALL SELECT ancestor FROM up WHERE node = 11 AND depth < 1")
def tr04c(s, d):
    return trees.path_between(fx.tree(s), 21, 11)


@query("tr04_leaf_paths", "SELECT node, string_agg(ancestor::VARCHAR, '>' ORDER BY depth) AS path FROM up WHERE node NOT IN (SELECT parent FROM tree) GROUP BY node")
def tr04d(s, d):
    return trees.leaves_paths(fx.tree(s))


@query("tr05_first_level", "SELECT ancestor AS clone, node FROM up WHERE ancestor IN (SELECT node FROM tree WHERE parent = 1)")
def tr05(s, d):
    return trees.first_level(fx.tree(s), 1)


@query("tr05_clone_backbones", "SELECT clone, count(*) AS size, arg_max(node, {'a': mutant_cells, 'b': -node}) AS backbone FROM (SELECT ancestor AS clone, node FROM up WHERE ancestor IN (2, 3)) JOIN stats ON mut = node GROUP BY clone", STATS)
def tr05b(s, d):
    return trees.clone_backbones(fx.tree(s), _stats(s, d), 1)


@query("tr06_latest_nodes", "SELECT node, depth FROM (SELECT node, max(depth) AS depth FROM up WHERE node IN (2, 5, 9, 11, 6) GROUP BY node) WHERE depth = 4")
def tr06(s, d):
    t = fx.tree(s)
    return trees.latest_nodes(t, t.select("node", F.col("node").alias("mut")), fx.muts(s).where("mut IN (2, 5, 9, 11, 6)"))


@query("tr07_intersecting_nodes", "SELECT node, max(n) AS shared FROM (SELECT mut // 3 AS node, mut, count(*) AS n FROM geno WHERE state = 1 AND mut <> 5 AND cell IN (SELECT cell FROM geno WHERE mut = 5 AND state = 1) GROUP BY mut) GROUP BY node")
def tr07(s, d):
    return trees.intersecting_nodes(fx.geno(s, d), fx.muts(s).select(F.expr("mut div 3").alias("node"), "mut"), 5)


_CAND = """path AS (SELECT DISTINCT ancestor AS node FROM up WHERE node IN (9, 10, 11) UNION SELECT 0), kid AS (SELECT parent AS anchor, t.node AS child FROM tree t WHERE t.node IN (SELECT node FROM path) AND parent IN (SELECT node FROM path) AND parent <> 0),
cand AS (SELECT 'on_node' AS kind, node AS anchor, '' AS children FROM path UNION ALL SELECT 'new_leaf', node, '' FROM path WHERE node <> 0 UNION ALL SELECT 'on_edge', anchor, child::VARCHAR FROM kid
 UNION ALL SELECT 'new_parent_merge', a.anchor, concat(a.child, ',', b.child) FROM kid a JOIN kid b ON a.anchor = b.anchor AND a.child < b.child
 UNION ALL SELECT 'new_parent_merge', a.anchor, concat(a.child, ',', b.child, ',', c.child) FROM kid a JOIN kid b ON a.anchor = b.anchor AND a.child < b.child JOIN kid c ON c.anchor = a.anchor AND b.child < c.child)"""


def _candidates(s):
    t = fx.tree(s)
    return trees.candidates(t, trees.path_nodes(t, s.createDataFrame([(9,), (10,), (11,)], "node long")))


@query("tr08_candidates", "SELECT * FROM cand", _CAND)
def tr08(s, d):
    return _candidates(s).select("kind", "anchor", F.expr("array_join(transform(children, x -> cast(x AS string)), ',')").alias("children"))


_PEN = """ob AS (SELECT cell, state FROM dense WHERE mut = 6), im AS (SELECT mut AS candidate, cell FROM m WHERE mut IN (1, 2, 5, 6, 12)),
pen AS (SELECT c.candidate, count(*) FILTER (state = 1 AND i.cell IS NULL) AS fp, count(*) FILTER (state = 0 AND i.cell IS NOT NULL) AS fn, count(*) FILTER (state IS NULL AND i.cell IS NOT NULL) AS na1, count(*) FILTER (state IS NULL AND i.cell IS NULL) AS na0
 FROM (SELECT DISTINCT candidate FROM im) c CROSS JOIN ob LEFT JOIN im i ON i.candidate = c.candidate AND i.cell = ob.cell GROUP BY c.candidate),
penx AS (SELECT *, fp + 0.1 * fn + 0.001 * (na1 * (1 - p1) + na0 * p1) AS penalty FROM pen CROSS JOIN (SELECT coalesce(avg(state), 0.5) AS p1 FROM ob))"""


def _penalties(s, d):
    im = fx.imputed(s, d).where("mut IN (1, 2, 5, 6, 12)").select(F.col("mut").alias("candidate"), "cell")
    return trees.base_penalty(fx.dense(s, d).where("mut = 6").select("cell", "state"), im, 0.1, 0.001)


@query("tr09_base_penalty", "SELECT candidate, fp, fn, na1, na0, round(penalty, 6)::DOUBLE AS penalty FROM penx", _PEN)
def tr09(s, d):
    return _penalties(s, d).withColumn("penalty", F.round("penalty", 6))


@query(
    "tr10_dynamic_weights",
    """SELECT id, round(CASE WHEN r > 0.8 THEN 0.09 WHEN r > 0.6 THEN 0.07 WHEN r > 0.4 THEN 0.05 ELSE least(0.095, 0.001 * CASE WHEN r > 0.2 THEN 4 WHEN r > 0.1 THEN 2 WHEN r > 0.05 THEN 1.5 ELSE 1 END) END, 9)::DOUBLE AS omega,
 round(greatest(0.1, (CASE WHEN missing > 70 AND ones < 10 THEN 0.3 WHEN missing > 50 AND ones < 20 THEN 0.6 ELSE 1 END) * (CASE WHEN r > 0.4 AND leaf THEN 0.8 WHEN r > 0.4 THEN 1.2 WHEN r > 0.2 AND leaf THEN 0.9 WHEN r > 0.2 THEN 1.1 ELSE 1 END) * CASE WHEN leaf AND nodes > 20 THEN 0.9 ELSE 1 END), 9)::DOUBLE AS phi
 FROM (SELECT mut AS id, mut / 24.0::DOUBLE AS r, mut % 3 > 0 AS leaf, (mut % 5) * 6 + 1 AS ones, (mut * 7) % 100 AS missing, mut AS nodes FROM muts)""",
)
def tr10(s, d):
    rows = fx.muts(s).selectExpr("mut AS id", "mut AS na1", "24 - mut AS na0", "element_at(array('on_node', 'new_leaf', 'on_edge'), cast(mut % 3 AS int) + 1) AS kind", "mut % 5 * 6 + 1 AS ones", "mut * 7 % 100 AS missing", "100 AS cells", "mut AS nodes")
    return r9(trees.dynamic_weights(rows, 0.001, 0.1, 1.0).select("id", "omega", "phi"))


@query(
    "tr11_structural_penalty",
    "SELECT id, round(ln(n) * 1.8 + CASE WHEN k THEN 0.5 * ln(2 + id % 2) ELSE 0 END + CASE WHEN id % 5 = 0 THEN 0.5 * ln(n) ELSE 0 END, 9) AS structure FROM (SELECT mut AS id, mut + 1 + CASE WHEN mut % 3 = 0 THEN 1 ELSE 2 END AS n, mut % 3 = 1 AS k FROM muts)",
)
def tr11(s, d):
    rows = fx.muts(s).selectExpr("mut AS id", "CASE mut % 3 WHEN 0 THEN 'on_node' WHEN 1 THEN 'new_parent_merge' ELSE 'new_leaf' END AS kind", "mut % 5 = 0 AS anchor_is_root", "2 + mut % 2 AS children", "mut + 1 AS nodes", "0.8D AS phi")
    return r9(trees.structural_penalty(rows).select("id", "structure"))


@query(
    "tr12_imputed_leaf",
    "SELECT cell FROM geno WHERE mut = 13 AND state = 1 AND cell NOT IN (SELECT cell FROM m WHERE mut NOT IN (13, 6, 3, 1, 0))",
)
def tr12(s, d):
    return trees.imputed_leaf(fx.geno(s, d), fx.imputed(s, d), fx.tree(s), 13, 6)


@query(
    "tr13_chain_penalty",
    "SELECT c.mut, count(*) AS turned, sum(CASE WHEN g.state = 0 THEN 0.1 ELSE 0 END)::DOUBLE AS cost FROM (SELECT cell FROM geno WHERE mut = 9 AND state = 1) n CROSS JOIN (VALUES (2::BIGINT), (5::BIGINT)) c(mut) LEFT JOIN geno g ON g.cell = n.cell AND g.mut = c.mut WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.cell = n.cell AND m.mut = c.mut) GROUP BY c.mut",
)
def tr13(s, d):
    new = fx.geno(s, d).where("mut = 9 AND state = 1").select("cell")
    return trees.chain_penalty(fx.geno(s, d), fx.imputed(s, d), new, s.createDataFrame([(2,), (5,)], "mut long"), 0.1).select("mut", "turned", F.round("cost", 9).alias("cost"))


@query("w09_choose", "SELECT candidate, round(penalty, 6)::DOUBLE AS penalty FROM penx ORDER BY round(penalty, 9), candidate LIMIT 1", _PEN)
def w09(s, d):
    return trees.choose(_penalties(s, d).withColumn("size", F.lit(1))).select("candidate", F.round("penalty", 6).alias("penalty"))


@query("tr14_rename_on_node", "SELECT CASE WHEN node = 5 THEN '5|x' ELSE node::VARCHAR END AS node, CASE WHEN parent = 5 THEN '5|x' ELSE parent::VARCHAR END AS parent FROM tree")
def tr14(s, d):
    return trees.rename_on_node(fx.tree(s).select(F.col("node").cast("string"), F.col("parent").cast("string")), "5", "x")


@query("tr21_penalty_range", "SELECT mut, round(0.5 * fp + 0.05 * fn, 9)::DOUBLE AS lo, round(1.0 * fp + 0.1 * fn, 9)::DOUBLE AS hi FROM (SELECT mut, count(*) FILTER (state = 1 AND v = 0) AS fp, count(*) FILTER (state = 0 AND v = 1) AS fn FROM rows GROUP BY mut)", ROWS2)
def tr21(s, d):
    return r9(flips.flip_counts(_rows2(s, d), "mut").selectExpr("mut", "0.5D * fp + 0.05D * fn AS lo", "1D * fp + 0.1D * fn AS hi"))


@query("tr22_remove_nodes", "SELECT node, arg_min(ancestor, depth) AS parent FROM up WHERE depth > 0 AND node NOT IN (2, 5, 3) AND ancestor NOT IN (2, 5, 3) GROUP BY node")
def tr22(s, d):
    return trees.remove_nodes(fx.tree(s), s.createDataFrame([(2,), (5,), (3,)], "node long"))


@query(
    "tr23_branch_groups",
    "SELECT k AS key, array_to_string(ms, '|') AS members FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE b.k = a.k AND len(b.ms) > len(a.ms) AND len(list_filter(a.ms, lambda x: NOT list_contains(b.ms, x))) = 0)",
    "sets AS (SELECT DISTINCT ms, k FROM (SELECT node, list_sort(list(ancestor)) AS ms, arg_max(ancestor, depth) AS k FROM up WHERE node IN (2, 5, 10, 11, 7, 3) AND ancestor IN (2, 5, 10, 11, 7, 3) GROUP BY node))",
)
def tr23(s, d):
    return trees.branch_groups(fx.tree(s), fx.muts(s).where("mut IN (2, 5, 10, 11, 7, 3)").select(F.col("mut").alias("node")))


@query("tr28_add_to_group", "SELECT mut, grp FROM groups UNION ALL SELECT mut + 100, grp FROM (SELECT mut, mut % 4 AS grp FROM muts WHERE mut < 3)")
def tr28(s, d):
    return fx.groups(s).unionByName(fx.groups(s).where("mut < 3").select(F.expr("mut + 100").alias("mut"), "grp"))


@query(
    "t20_branch_sets",
    "SELECT a.mut, NOT EXISTS (SELECT 1 FROM sz b WHERE b.mut <> a.mut AND b.n > a.n AND (SELECT count(*) FROM m x JOIN m y ON x.cell = y.cell AND y.mut = b.mut WHERE x.mut = a.mut) = a.n) AS pivot, NOT EXISTS (SELECT 1 FROM sz b WHERE b.mut <> a.mut AND b.n < a.n AND (SELECT count(*) FROM m x JOIN m y ON x.cell = y.cell AND y.mut = b.mut WHERE x.mut = a.mut) = b.n) AS leaf FROM sz a",
    "sz AS (SELECT mut, count(*) AS n FROM m WHERE mut BETWEEN 1 AND 11 GROUP BY mut)",
)
def t20(s, d):
    from cladeframe.operators.posterior import branch_sets

    return branch_sets(fx.imputed(s, d).where("mut BETWEEN 1 AND 11").select("cell", "mut")).select("mut", "pivot", "leaf")

"""Quality rules (2) [native]: robust multivariate outliers by minimum covariance determinant.

Base rules count words, symbols, repeated lines and repeated five-word windows of whole texts. The texts that
pass are judged by their statistics: FEATURES, whole thousandths so that sums are exact. For each
language and source the share HALF of its texts with the least determinant of their covariance is sought, as the method does: from
several starts (medians and quartile ranges; all texts; SUBSETS subsets by a remainder of the statistics) STEPS concentration steps go to the texts
nearest to the mean so far, and the start that ends with the least determinant gives mean and covariance. The covariance is made
consistent for the normal law, with a floor on each deviation since most texts have no symbols at all. A text is rejected when its
squared Mahalanobis distance exceeds the chi-square quantile of TAIL.

Every language and source is a group of its own, however small: of n texts (n + p + 1) / 2 are taken at least, as the
determinant of p features needs, so up to p + 1 texts all are taken and none of them stands out. Everything is an
aggregation with a small state (percentiles are of rounded values), so a hot source is pre-aggregated
in every task; the parameters are one row a group and start.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HALF, STEPS, SUBSETS, TAIL = 0.75, 4, 2, 1e-5
BROADCAST_GROUPS = 50_000  # rows of parameters, at most, that are broadcast (about 200 bytes each)
WHITE = "[\\x20\\x09-\\x0D]"
# name, SQL in both engines, floor of its deviation in thousandths
FEATURES = (
    ("x1", "round(1000 * ln(1 + n_words))", 500),
    ("x2", "round(1000 * ln((word_chars + 150) / CAST(n_words + 30 AS DOUBLE)))", 60),
    ("x3", "round(1000 * sqrt(n_symbols / CAST(word_chars + 100 AS DOUBLE)))", 50),
    ("x4", "round(1000 * n_dup_lines / CAST(n_lines + 5 AS DOUBLE))", 120),
    ("x5", "round(1000 * sqrt((n_capitals + 3) / CAST(word_chars + 150 AS DOUBLE)))", 50),
)
P = len(FEATURES)
PAIRS = [(i, j) for i in range(1, P + 1) for j in range(1, i + 1)]


def chi_square(x: float, k: int) -> float:
    """Distribution function with k degrees of freedom (series of the incomplete gamma function)."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(tail: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi_square(mid, k) > tail else (lo, mid)
    return lo


CUTOFF = round(chi_square_quantile(TAIL, P), 6)
#: the covariance of the HALF nearest texts of a normal law is this much too small
CONSISTENT = round(HALF / chi_square(chi_square_quantile(1 - HALF, P), P + 2), 9)
CHOLESKY = []
for i, j in PAIRS:
    inner = " - ".join([f"c{i}_{j}", *(f"l{i}_{k} * l{j}_{k}" for k in range(1, j))])
    CHOLESKY.append((f"l{i}_{j}", f"sqrt(greatest({inner}, 1))" if i == j else f"({inner}) / l{j}_{j}"))
DISTANCE = [(f"y{i}", f"({' - '.join([f'(x{i} - m{i})', *(f'l{i}_{k} * y{k}' for k in range(1, i))])}) / l{i}_{i}") for i in range(1, P + 1)]
SQUARED = " + ".join(f"y{i} * y{i}" for i in range(1, P + 1))
GRID = f"round(ln(1 + {SQUARED}), 3)"
DETERMINANT = f"round({' + '.join(f'ln(l{i}_{i})' for i in range(1, P + 1))}, 6)"
# the share of n texts that is taken: HALF from 2 (P + 1) texts on, (n + P + 1) / 2 of fewer, all of P + 1 or fewer
SHARES = [HALF] + [(n + P + 1) / (2 * n) for n in range(2 * P + 1, P, -1)]
WHICH = f"greatest(0, least({len(SHARES) - 1}, {2 * P + 2} - n))"
#: from 1, where all are taken, to CONSISTENT in proportion
FACTOR = f"1 + {round(CONSISTENT - 1, 9)}D * least(1, greatest(0, {1 / (1 - HALF)}D * (1 - greatest({HALF}D, (of + {P + 1}D) / (2 * of)))))"
REST = f"pmod({' + '.join(f'{k} * x{i}' for i, k in zip(range(1, P + 1), (31, 17, 7, 5, 1)))}, 5)"


def _with(df: DataFrame, columns) -> DataFrame:
    for name, sql in columns:
        df = df.withColumn(name, F.expr(sql))
    return df


def base(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed."""
    df = common.pick(documents, "doc_id", "text", "lang", "source")
    df = df.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    windows = "sequence(1, n_words - 4)"
    return _with(
        df,
        [
            ("w", f"array_remove(split(text, '{WHITE.replace(chr(92), chr(92) * 2)}+'), '')"),
            ("n_words", "cast(size(w) AS long)"),
            ("word_chars", "cast(length(array_join(w, '')) AS long)"),
            ("n_symbols", "cast(regexp_count(text, '[#*$%&|<>]') AS long)"),
            ("n_capitals", "cast(regexp_count(text, '[A-Z]') AS long)"),
            ("lines", f"filter(split(text, '\\n'), x -> x rlike '[^{WHITE[1:-1].replace(chr(92), chr(92) * 2)}]')"),
            ("n_lines", "cast(size(lines) AS long)"),
            ("n_dup_lines", "cast(size(lines) - size(array_distinct(lines)) AS long)"),
            # distinct hashes of all windows prove that none repeats; only other texts compare the words themselves
            ("hashes", f"CASE WHEN n_words >= 5 THEN transform({windows}, i -> xxhash64(slice(w, cast(i AS int), 5))) ELSE array() END"),
            ("s", f"CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN array_sort(transform({windows}, i -> struct(array_join(slice(w, cast(i AS int), 5), ' ') AS w, cast(i AS int) AS p))) ELSE array() END"),
            ("p", "array_sort(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).w = x.w, false) OR coalesce(get(s, i + 1).w = x.w, false)), x -> x.p))"),
            ("n_repeat_words", "cast(aggregate(transform(p, (x, i) -> least(5, coalesce(get(p, i + 1) - x, 5))), 0, (a, x) -> a + x) AS long)"),
            ("base_failed", "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"),
        ],
    ).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "base_failed")


def _near(table: DataFrame, parameters: DataFrame, on) -> DataFrame:
    few = parameters.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return table.join(F.broadcast(parameters) if few else parameters, on, "left")


def parameters(table: DataFrame) -> DataFrame:
    """lang, source, m1.., l1_1.., determinant (half its logarithm): mean and Cholesky factor of each group. table: lang,
    source, x1.. of the texts to learn from."""
    group = ["lang", "source"]
    xs = [f"x{i}" for i in range(1, P + 1)]
    names = [*group, "start", *(f"m{i}" for i in range(1, P + 1)), *(f"l{i}_{j}" for i, j in PAIRS)]
    sums = [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(xs, 1)), *(F.sum(F.expr(f"x{i} * x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS)]

    def moments(factor: str) -> list[tuple[str, str]]:
        out = [(f"m{i}", f"s{i} / n") for i in range(1, P + 1)]
        return out + [(f"c{i}_{j}", f"({factor}) * (s{i}_{j} / n - m{i} * m{j})" + (f" + power({FEATURES[i - 1][2]}, 2)" if i == j else "")) for i, j in PAIRS]

    quartiles = table.groupBy(*group).agg(F.count("*").alias("n"), *[F.expr(f"percentile({x}, array(0.25D, 0.5D, 0.75D))").alias(f"q{i}") for i, x in enumerate(xs, 1)])
    middle = [(f"m{i}", f"q{i}[1]") for i in range(1, P + 1)]
    middle += [(f"c{i}_{j}", f"power((q{i}[2] - q{i}[0]) / 1.349, 2) + power({FEATURES[i - 1][2]}, 2)" if i == j else "0D") for i, j in PAIRS]
    now = _with(quartiles.withColumn("start", F.lit(0)), [*middle, *CHOLESKY]).select(*names)
    several = table.withColumn("start", F.explode(F.expr(f"CASE WHEN {REST} < {SUBSETS} THEN array(1, CAST(2 + {REST} AS INT)) ELSE array(1) END")))
    now = common.keep(now.unionByName(_with(several.groupBy(*group, "start").agg(*sums), [*moments("1D"), *CHOLESKY]).select(*names)), "parameters")
    sizes = common.keep(quartiles.select(*group, "n"), "sizes")
    for _ in range(STEPS):
        scored = _with(_near(table, now, group), DISTANCE).withColumn("d", F.expr(GRID)).select(*group, "start", "d", *xs)
        reach = scored.groupBy(*group, "start").agg(F.count("*").alias("n"), F.expr(f"percentile(d, array({', '.join(f'{x}D' for x in SHARES)}))").alias("q"))
        reach = common.keep(reach.select(*group, "start", F.expr(f"q[{WHICH}]").alias("reach")), "reach")
        inside = _near(scored, reach, [*group, "start"]).where("d <= reach").groupBy(*group, "start").agg(*sums)
        inside = _near(inside, sizes.withColumnRenamed("n", "of"), group)
        new = common.keep(_with(inside, [*moments(FACTOR), *CHOLESKY]).select(*names), "parameters")
        common.drop(now, reach)
        now = new
    least = now.withColumn("determinant", F.expr(DETERMINANT))
    best = least.groupBy(*group).agg(F.expr("min(struct(determinant, start)).start").alias("best"))
    return common.keep(least.join(best, group).where("start = best").drop("start", "best"), "parameters")


def quality_rules(documents: DataFrame) -> DataFrame:
    """documents: doc_id, text (null: no words), lang, source (null: empty).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance (squared, of
    texts that pass the base rules), one row per row. Repeated rows count as often as they occur; an empty table gives none.
    """
    table = common.keep(_with(base(documents), [(n, f"CAST({sql} AS DOUBLE)") for n, sql, _ in FEATURES]), "statistics")
    known = parameters(table.where("NOT base_failed").select("lang", "source", *(f"x{i}" for i in range(1, P + 1))))
    out = _with(_near(table, known, ["lang", "source"]), [*DISTANCE, ("distance", f"CASE WHEN NOT base_failed THEN round({SQUARED}, 6) END")])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"NOT base_failed AND distance <= {CUTOFF}D").alias("kept"), "distance")


def oracle() -> str:
    """The query in DuckDB SQL, without `distance`'s own derivation shared: windows are counted by joins, steps unrolled."""
    xs = ", ".join(f"x{i}" for i in range(1, P + 1))
    white = WHITE
    ctes = [
        f"""t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '{white}+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{white[1:-1]}]')) AS l FROM t),
g5 AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM w WHERE len(w) >= 5),
v5 AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p:p + 4], ' ')) AS c FROM g5),
rp AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM v5 WHERE c > 1) GROUP BY r),
b0 AS (SELECT t.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       len(l)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals
       FROM t JOIN w USING (r) LEFT JOIN rp USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"CAST({sql} AS DOUBLE) AS {n}" for n, sql, _ in FEATURES)} FROM b0),
x AS (SELECT lang, source, {xs} FROM b WHERE NOT base_failed),
o AS (SELECT lang, source, count(*)::DOUBLE AS n FROM x GROUP BY lang, source)"""
    ]
    start = [f"median(x{i}) AS m{i}" for i in range(1, P + 1)]
    start += [f"power((quantile_cont(x{i}, 0.75) - quantile_cont(x{i}, 0.25)) / 1.349, 2) + power({FEATURES[i - 1][2]}, 2) AS c{i}_{j}" if i == j else f"0::DOUBLE AS c{i}_{j}" for i, j in PAIRS]
    roots = ", ".join(f"{sql} AS {n}" for n, sql in CHOLESKY)
    far = ", ".join(f"{sql} AS {n}" for n, sql in DISTANCE)
    kept = ", ".join([*(f"m{i}" for i in range(1, P + 1)), *(f"c{i}_{j}" for i, j in PAIRS)])

    def sums(factor: str) -> str:
        mean = [f"avg(x{i}) AS m{i}" for i in range(1, P + 1)]
        return ", ".join(mean + [f"({factor}) * (sum(x{i} * x{j}) / count(*) - avg(x{i}) * avg(x{j}))" + (f" + power({FEATURES[i - 1][2]}, 2)" if i == j else "") + f" AS c{i}_{j}" for i, j in PAIRS])

    duck = lambda sql: sql.replace("D", "") if "DISTINCT" not in sql else sql
    rest = duck(REST).replace("pmod(", "(").rsplit(", 5)", 1)[0] + ") % 5"
    ctes.append(f"""k0 AS (SELECT *, {roots} FROM (
  SELECT lang, source, 0 AS start, {kept} FROM (SELECT lang, source, {', '.join(start)} FROM x GROUP BY lang, source)
  UNION ALL SELECT lang, source, 1 AS start, {kept} FROM (SELECT lang, source, {sums("1")} FROM x GROUP BY lang, source)
  UNION ALL SELECT lang, source, start, {kept} FROM (SELECT lang, source, (2 + {rest})::INT AS start, {sums("1")} FROM x WHERE {rest} < {SUBSETS} GROUP BY lang, source, (2 + {rest})::INT)))""")
    shares = "[" + ", ".join(str(x) for x in SHARES) + "]"
    for k in range(STEPS):
        ctes.append(f"d{k} AS (SELECT lang, source, start, {xs}, {GRID} AS d FROM (SELECT *, {far} FROM x JOIN k{k} USING (lang, source)))")
        ctes.append(f"e{k} AS (SELECT lang, source, start, quantile_cont(d, {shares})[({WHICH.replace('n)', 'count(*))')} + 1)::INT] AS reach FROM d{k} GROUP BY lang, source, start)")
        factor = duck(FACTOR).replace("of", "any_value(n)")
        ctes.append(f"k{k + 1} AS (SELECT *, {roots} FROM (SELECT lang, source, start, {sums(factor)} FROM d{k} JOIN e{k} USING (lang, source, start) JOIN o USING (lang, source) WHERE d <= reach GROUP BY lang, source, start))")
    ctes.append(f"best AS (SELECT * FROM k{STEPS} QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {DETERMINANT}, start) = 1)")
    ctes.append(f"z AS (SELECT *, CASE WHEN NOT base_failed THEN round({SQUARED}, 6) END AS distance FROM (SELECT *, {far} FROM b LEFT JOIN best USING (lang, source)))")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND distance <= {CUTOFF}, false) AS kept, distance FROM z"

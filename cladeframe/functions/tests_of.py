"""Statistical tests. Statistics are window and aggregate expressions; p values with no SQL form are Arrow-batched functions of a few
numbers a row, so no group is ever collected for them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cladeframe.session import ship


# ------------------------------------------------------------------ distributions


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def binomial_cdf(k: int, n: int, p: float) -> float:
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (i * math.log(p) if i else 0) + ((n - i) * math.log1p(-p) if n > i else 0) for i in range(min(k, n) + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Sum of the outcomes that are no likelier than the one seen."""
    pmf = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(n + 1)]
    if not 0 <= k <= n:
        return float("nan")
    return min(1.0, math.fsum(x for x in pmf if x <= pmf[k] * (1 + 1e-7)))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """p of a 2 x 2 table: tables of the same margins that are no likelier."""
    r, s, n = a + b, a + c, a + b + c + d
    log = lambda x: math.lgamma(r + 1) + math.lgamma(n - r + 1) + math.lgamma(s + 1) + math.lgamma(n - s + 1) - math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) - math.lgamma(s - x + 1) - math.lgamma(n - r - s + x + 1)
    own = log(a)
    return min(1.0, math.fsum(math.exp(log(x)) for x in range(max(0, r + s - n), min(r, s) + 1) if log(x) <= own + 1e-7))


def kolmogorov_sf(d: float, n: int, m: int) -> float:
    """Asymptotic p of a two-sample statistic."""
    x = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101)))) if x > 0.2 else 1.0


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return z.map(lambda x: normal_sf(x) if x == x else np.nan)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d)])


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(x), int(y)) if x <= y else np.nan for x, y in zip(k, n)])


@F.pandas_udf(DoubleType())
def binomial_lower(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_cdf(int(x), int(y), float(q)) for x, y, q in zip(k, n, p)])


@F.pandas_udf(DoubleType())
def kolmogorov_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov_sf(float(x), int(y), int(z)) for x, y, z in zip(d, n, m)])


# ------------------------------------------------------------------ tests on tables


def average_ranks(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds r, the average rank of equal values, and ties, how many are equal. Equal values are counted first, so that a hot value is one
    row in the window."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn("r", F.sum("ties").over(w) - (F.col("ties") - 1) / 2)
    return df.join(ranks, [*by, value])


def rank_sum(df: DataFrame, value: str, side: str, by: str) -> DataFrame:
    """by, n1, n2, z, rbc: Wilcoxon rank sum of rows where `side` is true against the others; z without tie or continuity correction; rbc is
    2 U / (n1 n2) - 1. Null where a side is empty."""
    ranked = average_ranks(df.where(F.col(value).isNotNull()), value, by)
    out = ranked.groupBy(by).agg(F.count_if(side).alias("n1"), F.count_if(~F.col(side)).alias("n2"), F.sum(F.when(F.col(side), F.col("r"))).alias("s"))
    return out.select(by, "n1", "n2", F.expr("try_divide(s - n1 * (n1 + n2 + 1) / 2, sqrt(n1 * n2 * (n1 + n2 + 1) / 12D))").alias("z"), F.expr("try_divide(2 * (s - n1 * (n1 + 1) / 2), n1 * n2) - 1").alias("rbc"))


def with_p(df: DataFrame, alternative: str = "two-sided") -> DataFrame:
    ship(df.sparkSession)
    tail = {"two-sided": 2 * normal_tail(F.abs("z")), "greater": normal_tail(F.col("z")), "less": normal_tail(-F.col("z"))}[alternative]
    return df.withColumn("p", F.least(tail, F.lit(1.0)))


def mann_whitney_greater(df: DataFrame, value: str, side: str, by: str) -> DataFrame:
    """by, u, p, log_p: U of the true side, p that it is greater by the normal law with tie and continuity correction, log10(p + 1e-300)."""
    ship(df.sparkSession)
    ranked = average_ranks(df.where(F.col(value).isNotNull()), value, by)
    out = ranked.groupBy(by).agg(
        F.count_if(side).alias("n1"), F.count_if(~F.col(side)).alias("n2"), F.sum(F.when(F.col(side), F.col("r"))).alias("s"), F.sum(F.expr("cast(ties AS double) * ties - 1")).alias("t"),
    )
    out = out.withColumn("u", F.expr("s - n1 * (n1 + 1) / 2")).withColumn("n", F.expr("n1 + n2"))
    z = F.expr("try_divide(u - n1 * n2 / 2D - 0.5D, sqrt(greatest(n1 * n2 / 12D * ((n + 1) - try_divide(t, n * (n - 1))), 0D)))")
    out = out.withColumn("p", normal_tail(z))
    return out.select(by, "u", "p", F.log10(F.col("p") + 1e-300).alias("log_p"))


def signed_rank_effect(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """by, effect: rank-biserial of the paired differences after both are z-scored (population deviation); 0 where that is undefined."""
    w = Window.partitionBy(by)
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w))
    diff = df.select(by, F.round(z(x) - z(y), 9).alias("d")).where("d IS NOT NULL AND d <> 0").withColumn("a", F.abs("d"))
    ranked = average_ranks(diff, "a", by)
    out = ranked.groupBy(by).agg(F.sum(F.expr("CASE WHEN d > 0 THEN r ELSE -r END")).alias("s"), F.sum("r").alias("t"))
    return df.select(by).distinct().join(out, by, "left").select(by, F.expr("coalesce(try_divide(s, t), 0D)").alias("effect"))


def depth_regression(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """by, r2: of the linear regression of y on x; 1 where x is constant, else 0 where y is."""
    r = f"try_divide(covar_pop({y}, {x}), stddev_pop({x}) * stddev_pop({y}))"
    return df.groupBy(by).agg(F.expr(f"CASE WHEN coalesce(stddev_pop({x}), 0) = 0 THEN 1D ELSE coalesce(pow({r}, 2), 0D) END").alias("r2"))


def signed_rank_terms(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """by, n, ties, least, spread: of the paired differences after both are z-scored (population deviation; 0 where constant) and without zeros: how many,
    how many share their size with another, the lesser sum of ranks, and the sum of t^3 - t over ties. Equal differences are one row."""
    w = Window.partitionBy(by)
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0))
    size = df.select(by, F.round(z(x) - z(y), 9).alias("d")).where("d <> 0").groupBy(by, F.abs("d").alias("a")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    below = F.sum("c").over(Window.partitionBy(by).orderBy("a").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    ranked = size.withColumn("r", below + (F.col("c") + 1) / 2)
    out = ranked.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.expr("CASE WHEN c > 1 THEN c ELSE 0 END")).alias("ties"), F.expr("least(sum(up * r), sum((c - up) * r))").alias("least"), F.expr("sum(c * c * c - c)").alias("spread"))
    every = df.groupBy(by).agg(F.count("*").alias("pairs"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "ties", "spread")]
    return every.join(out, by, "left").select(by, "pairs", *zero, F.coalesce("least", F.lit(0.0)).alias("least"))


def signed_rank_tail(n: int, least: int) -> float:
    """Two-sided probability that the lesser sum of ranks 1..n of one sign is `least` or below: counted."""
    ways = [1]
    for r in range(1, n + 1):
        grown = ways + [0] * r
        for i, v in enumerate(ways):
            grown[i + r] += v
        ways = grown
    return min(1.0, 2 * sum(ways[: least + 1]) / 2**n)


def paired_p(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """by, p of the paired signed-rank test of z-scored values: exact up to 50 pairs without ties or zeros, else by the normal law with ties; 1 where
    all differences are equal."""
    import pandas as pd

    @F.pandas_udf("double")
    def exact(n: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_tail(int(a), int(b)) for a, b in zip(n, least)])

    ship(df.sparkSession)
    t = signed_rank_terms(df, x, y, by)
    var = "(n * (n + 1) * (2 * n + 1) - spread / 2D) / 24D"
    t = t.withColumn("z", F.expr(f"try_divide(least - n * (n + 1) / 4D, sqrt({var}))"))
    small = "n > 0 AND n <= 50 AND ties = 0 AND n = pairs"
    t = t.withColumn("two", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))))
    return t.select(by, F.when(F.expr(small), exact(F.expr(f"CASE WHEN {small} THEN n ELSE 0 END"), F.expr(f"CASE WHEN {small} THEN least ELSE 0D END"))).otherwise(F.coalesce("two", F.lit(1.0))).alias("p"))


def no_dropout(df: DataFrame, r2: float = 0.8, alpha: float = 0.05) -> DataFrame:
    return df.withColumn("no_dropout", F.expr(f"r2 < {r2} OR p < {alpha}"))


def dropout(df: DataFrame, x: str, y: str, by: str, r2: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """by, r2, p, no_dropout: depths that a line explains badly, or that differ in their ranks, are no dropout."""
    return no_dropout(depth_regression(df, x, y, by).join(paired_p(df, x, y, by), by), r2, alpha)


def projected_ks(points: DataFrame, by: str, side: str, directions: int = 8) -> DataFrame:
    """by, d, direction: the greatest two-sample Kolmogorov-Smirnov distance over projections on `directions` axes of the half turn."""
    angles = [math.pi * k / directions for k in range(directions)]
    axes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(a)).alias("c"), F.lit(math.sin(a)).alias("s")) for k, a in enumerate(angles)]))
    rows = points.select(by, side, "x", "y", axes.alias("_axis")).select(by, side, F.col("_axis.k").alias("k"), F.round(F.expr("_axis.c * x + _axis.s * y"), 9).alias("v"))
    steps = rows.groupBy(by, "k", "v").agg(F.count_if(side).alias("a"), F.count_if(~F.col(side)).alias("b"))
    every, upto = Window.partitionBy(by, "k"), Window.partitionBy(by, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.try_divide(F.sum("a").over(upto), F.sum("a").over(every)) - F.try_divide(F.sum("b").over(upto), F.sum("b").over(every)))
    per = steps.select(by, "k", gap.alias("g")).groupBy(by, "k").agg(F.round(F.max("g"), 9).alias("d"))
    return per.groupBy(by).agg(F.max("d").alias("d"), F.expr("max_by(k, struct(d, -k))").alias("direction"))


def morans_i(points: DataFrame, value: str) -> DataFrame:
    """i: Moran's I with the eight neighbours on the integer grid as weights. Neighbours are found by an equi-join on the shifted place."""
    stats = points.agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    z = points.crossJoin(F.broadcast(stats)).select("x", "y", "n", (F.col(value) - F.col("m")).alias("z"))
    shifts = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    near = z.select(F.col("z").alias("w"), "x", "y", F.explode(F.array(*shifts)).alias("h")).select("w", F.expr("x + h.i").alias("x"), F.expr("y + h.j").alias("y"))
    cross = z.join(near, ["x", "y"]).agg(F.sum(F.expr("z * w")).alias("zw"), F.count("*").alias("k"))
    return z.agg(F.sum(F.expr("z * z")).alias("zz"), F.max("n").alias("n")).crossJoin(cross).select(F.expr("try_divide(n * zw, k * zz)").alias("i"))


def permutation_p(df: DataFrame, value: str, side: str, by: str, runs: int = 1000, seed: int = 42) -> DataFrame:
    """by, difference, p: share of shuffles whose difference of means is at least as far from 0. A group is one site's reads."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values([value, side])
        v, s = pdf[value].to_numpy(float), pdf[side].to_numpy(bool)
        k = int(s.sum())
        if not 0 < k < len(v):
            return pd.DataFrame([(key[0], None, 1.0)], columns=[by, "difference", "p"])
        own, rng, total, hits = v[s].mean() - v[~s].mean(), np.random.default_rng([seed, int(key[0])]), v.sum(), 0
        for _ in range(runs):
            a = v[rng.permutation(len(v))[:k]].sum()
            hits += abs(a / k - (total - a) / (len(v) - k)) >= abs(own) - 1e-12
        return pd.DataFrame([(key[0], float(own), (hits + 1) / (runs + 1))], columns=[by, "difference", "p"])

    ship(df.sparkSession)
    return df.select(by, value, side).groupBy(by).applyInPandas(one, f"{by} long, difference double, p double")


def robust_scale(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Adds scaled: (x - median) / (Q3 - Q1), null where the quartiles agree."""
    keys = [by] if by else []
    q = df.groupBy(*keys).agg(F.expr(f"percentile({value}, array(0.25D, 0.5D, 0.75D))").alias("q"))
    joined = df.join(q, by) if by else df.crossJoin(F.broadcast(q))
    return joined.withColumn("scaled", F.expr(f"try_divide({value} - q[1], q[2] - q[0])")).drop("q")


def fdr(df: DataFrame, p: str, key: str) -> DataFrame:
    """Adds fdr, Benjamini-Hochberg. One row a site; the two windows run over the distinct p values only."""
    n = df.agg(F.count(p).alias("n"))
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("k"))
    up = counts.withColumn("rank", F.sum("k").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(n))
    adjusted = up.withColumn("fdr", F.least(F.lit(1.0), F.min(F.expr(f"{p} * n / rank")).over(Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))))
    return df.join(adjusted.select(p, "fdr"), p, "left")


def iqr_outliers(df: DataFrame, value: str) -> DataFrame:
    q = df.agg(F.expr(f"percentile({value}, array(0.25D, 0.75D))").alias("q"))
    return df.crossJoin(F.broadcast(q)).withColumn("outlier", F.expr(f"{value} > q[1] + 1.5D * (q[1] - q[0]) OR {value} < q[0] - 1.5D * (q[1] - q[0])")).drop("q")


def strand_skew(counts: DataFrame, alpha: float = 0.01, of_sum: bool = False) -> DataFrame:
    """label, partner, n, m (partner's), p, remove: of each context and its reverse complement the test of the smaller count against the
    larger as the number of trials (of_sum: against their sum); a context goes if it is the greater one and p is below alpha."""
    ship(counts.sparkSession)
    other = counts.select(F.col("label").alias("partner"), F.col("n").alias("m"))
    both = counts.join(other, "partner", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    trials = F.col("n") + F.col("m") if of_sum else F.greatest("n", "m")
    return both.withColumn("p", binomial_p(F.least("n", "m"), trials)).withColumn("remove", F.expr(f"n > m AND p < {alpha}"))


def segregation_bias(reads: DataFrame, alt: str = "T") -> DataFrame:
    """mut, bias: log odds of the alt reads of one sample under a variant of frequency one half against none, null without alt reads."""
    per = reads.groupBy("mut").agg(F.count_if(F.col("base") == alt).alias("a"))
    real = "(ln(0.5D) + a * ln(2D) - a)"  # against 0, the logarithm of 2 (1 - 0.5)
    return per.select("mut", F.expr(f"CASE WHEN a > 0 THEN ln(0.5D) + greatest(0D, {real}) + ln(1 + exp(-abs({real}))) END").alias("bias"))


# Depth, scale and shift fitted to reads of a hundred bases
DISTANCE_BIAS = (
    (3, 0.079, 18), (4, 0.09, 19.8), (5, 0.1, 20.5), (6, 0.11, 21.5), (7, 0.125, 21.6), (8, 0.135, 22), (9, 0.14, 22.2), (10, 0.153, 22.3),
    (15, 0.19, 22.8), (20, 0.22, 23.2), (30, 0.26, 23.4), (40, 0.29, 23.5), (50, 0.35, 23.65), (100, 0.5, 23.7), (200, 0.7, 23.7),
)


def distance_terms(reads: DataFrame, alt: str = "T") -> DataFrame:
    """mut, depth, distance, scale, shift: alt reads, the mean absolute difference of their places from the mean place, and the parameters of that
    depth: those of an equal one, the mean of the two around it, the last from 200 on; null below 3."""
    per = reads.where(F.col("base") == alt).groupBy("mut", "place").agg(F.count("*").alias("n"))
    mean = per.groupBy("mut").agg(F.sum("n").alias("depth"), F.expr("sum(n * place) / sum(n)").alias("mean"))
    out = per.join(mean, "mut").groupBy("mut", "depth").agg(F.expr("sum(n * abs(place - mean)) / sum(n)").alias("distance"))
    for k, name in ((1, "scale"), (2, "shift")):
        cases, before = [], None
        for row in DISTANCE_BIAS:
            cases.append(f"WHEN depth = {row[0]} THEN {row[k]}D" + (f" WHEN depth < {row[0]} THEN ({before[k]}D + {row[k]}D) * 0.5D" if before else ""))
            before = row
        out = out.withColumn(name, F.expr(f"CASE WHEN depth < 3 THEN NULL {' '.join(cases)} ELSE {before[k]}D END"))
    return out


def variant_distance(reads: DataFrame, alt: str = "T", length: int = 120) -> DataFrame:
    """mut, bias: how likely alt reads lie this close together: 0.5 erfc(-(distance - shift) scale); of two reads exactly, by the whole
    part of their distance; infinite below two. The error function has no SQL form; it sees one row a mutation."""
    import pandas as pd

    @F.pandas_udf("double")
    def erfc(x: pd.Series) -> pd.Series:
        from math import erfc as one

        return x.map(lambda v: one(v) if v == v else float("nan"))

    two = f"(2 * {length} - 2 * (floor(distance) + 1) - 1) * (floor(distance) + 1) / {length - 1}D / {length * 0.5}D"
    wide = distance_terms(reads, alt).withColumn("e", erfc(F.expr("-(distance - shift) * scale")))
    return wide.select("mut", F.expr(f"CASE WHEN depth < 2 THEN double('inf') WHEN depth = 2 THEN {two} ELSE 0.5D * e END").alias("bias"))


def rank_bias(reads: DataFrame, value: str = "place", ref: str = "A", alt: str = "T") -> DataFrame:
    """mut, z: Mann-Whitney z of the values of ref reads against those of alt reads, variance with ties; infinite where either is missing,
    0 where nothing varies."""
    bins = reads.groupBy("mut", F.col(value).alias("v")).agg(F.count_if(F.col("base") == ref).alias("a"), F.count_if(F.col("base") == alt).alias("b"))
    above = Window.partitionBy("mut").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("above", F.coalesce(F.sum("b").over(above), F.lit(0)))
    per = bins.groupBy("mut").agg(F.expr("sum(a * above + 0.5D * a * b)").alias("u"), F.expr("cast(sum(a) AS double)").alias("na"), F.expr("cast(sum(b) AS double)").alias("nb"), F.expr("cast(sum(((a + b) * (a + b) - 1) * (a + b)) AS double)").alias("t"))
    per = per.withColumn("var", F.expr("try_divide(na * nb, 12) * ((na + nb + 1) - try_divide(t, (na + nb) * (na + nb - 1)))"))
    return per.select("mut", F.expr("CASE WHEN na = 0 OR nb = 0 THEN double('inf') WHEN var <= 0 THEN 0D ELSE (u - na * nb / 2) / sqrt(var) END").alias("z"))

"""URL filters (9) [native]: gradient-boosted trees on lexical features.

Host and path rules decide where one fits; the trees judge the rest. Features of a url are small
whole numbers (lengths on a logarithmic scale, depth, digit share, entropy, parameter counts, suffix
statistics), computed in SQL. Training never moves a url to the driver: labelled urls are
counted by feature vector, each level of a tree is one aggregation of gradients by (node, feature, value),
at most nodes x features x BINS rows, and the grown trees go back into the plan as CASE expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BINS, TREES, DEPTH, RATE, RIDGE, LEAST, FOLDS = 32, 10, 3, 0.3, 1.0, 5.0, 5
# The rules of the query (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PARSE = {
    "rest": "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END",
    "raw_host": "regexp_extract(rest, '^[^/?#]*', 0)",
    "host": f"translate(raw_host, '{_UPPER}', '{_LOWER}')",
    "path": "regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*', 0)",
}


def rule_sql(what: str, rules=RULES) -> str:
    """CASE expression over host and path; `what` 0: the verdict, 1: the rule. Longest first."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, path = rule[1].split("/", 1)
        fits = f"(host = {quote(host)} OR substr(host, -{len(host) + 1}) = {quote('.' + host)}) AND substr(path, 1, {len(path) + 1}) = {quote('/' + path)}"
        cases.append(f"WHEN {fits} THEN {quote(rule[what])}")
    return "CASE " + " ".join(cases) + " END"


def _scale(x: str) -> str:
    return f"CAST(least({BINS - 1}, floor(4 * log2(1 + {x}))) AS INT)"


def _entropy(x: str) -> str:
    one = f"((length({x}) - length(replace({x}, c, ''))) / CAST(length({x}) AS DOUBLE))"
    return f"CASE WHEN {x} = '' THEN 0 ELSE CAST(least({BINS - 1}, floor(6 * aggregate(array_distinct(split({x}, '')), 0D, (a, c) -> CASE WHEN c = '' THEN a ELSE a - {one} * log2({one}) END))) AS INT) END"


def _share(pattern: str, x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE CAST(least({BINS - 1}, floor({BINS} * regexp_count({x}, '{pattern}') / CAST(length({x}) AS DOUBLE))) AS INT) END"


def _number(x: str) -> str:
    return f"CAST(least({BINS - 1}, {x}) AS INT)"


FEATURES = (
    _scale("length(url)"), _scale("length(host)"), _scale("length(path)"), _number("regexp_count(path, '/')"), _number("regexp_count(host, '[.]')"),
    _share("[0-9]", "host"), _share("[0-9]", "path"), _entropy("host"), _entropy("path"), _number("regexp_count(host, '-')"),
    _number("CASE WHEN instr(url, '?') > 0 THEN 1 + regexp_count(url, '&') ELSE 0 END"), _number("regexp_count(url, '=')"),
    "CASE WHEN instr(url, '#') > 0 THEN 1 ELSE 0 END", "CASE WHEN startswith(url, 'https') THEN 1 ELSE 0 END",
    _scale("length(substring_index(path, '/', -1))"), _number("regexp_count(path, '[.]')"),
)
SUFFIX_FEATURES = 2  # share of blocked among labelled urls of the suffix, and how many urls have it
WIDTH = len(FEATURES) + SUFFIX_FEATURES


def parse(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """page_id, url, host, path, suffix (a host's last label). Null urls are empty."""
    out = common.pick(pages, key, "url").toDF("page_id", "url").withColumn("url", F.coalesce("url", F.lit("")))
    for name, sql in PARSE.items():
        out = out.withColumn(name, F.expr(sql))
    return out.select("page_id", "url", "host", "path", F.expr("substring_index(host, '.', -1)").alias("suffix"))


def with_features(parsed: DataFrame) -> DataFrame:
    """parsed: page_id, url, host, path, suffix, label (1 block, 0 allow, null unknown). Adds x, an array of WIDTH small
    whole numbers. Suffix statistics are counted by FOLDS parts of the urls; a labelled url takes the blocked share of the other
    parts, never of labels that it or its own copies carry, any other url that of all. Frequent suffixes are joined by broadcast."""
    parsed = parsed.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    part = parsed.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    whole = part.groupBy("suffix").agg(F.sum("n").alias("n_all"), F.sum("known").alias("known_all"), F.sum("blocked").alias("blocked_all"))
    rate = lambda b, k: F.expr(f"CAST(floor({BINS - 1} * ({b} + 1) / ({k} + 2D)) AS INT)")
    part = part.join(whole, "suffix").select("suffix", "fold", "n", rate("blocked_all", "known_all").alias("s_all"), rate("blocked_all - blocked", "known_all - known").alias("s_other"), F.expr(_scale("n_all")).alias("s1"))
    joined = common.join_hot(parsed, common.keep(part, "suffixes"), ["suffix", "fold"])
    x = F.array(*[F.expr(f) for f in FEATURES], F.expr("CASE WHEN label IS NULL THEN s_all ELSE s_other END"), "s1")
    return joined.withColumn("x", x).drop("s_all", "s_other", "s1", "fold")


def margin_sql(trees: list, bias: float) -> str:
    """The trees' sum over the array column x."""

    def node(t) -> str:
        return repr(float(t)) + "D" if not isinstance(t, tuple) else f"CASE WHEN x[{t[0]}] <= {t[1]} THEN {node(t[2])} ELSE {node(t[3])} END"

    return " + ".join([repr(float(bias)) + "D", *(node(t) for t in trees)])


def _place_sql(tree: dict, at: int = 1) -> str:
    """The leaf's number of a tree that is growing: {node: (feature, bin)}, children 2n and 2n + 1."""
    if at not in tree:
        return str(at)
    return f"CASE WHEN x[{tree[at][0]}] <= {tree[at][1]} THEN {_place_sql(tree, 2 * at)} ELSE {_place_sql(tree, 2 * at + 1)} END"


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE) -> tuple[list, float]:
    """labelled: x, label. Returns the trees and the bias. No rows, or one class only: no trees, and the
    bias of that class (allow without rows)."""
    vectors = common.keep(labelled.groupBy("x").agg(F.count("*").alias("n"), F.sum("label").alias("y")), "vectors")
    n, y = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    bias = math.log((y + 0.5) / (n - y + 0.5)) if n else -1.0
    grown: list = []
    for _ in range(trees if 0 < y < n else 0):
        scored = vectors.withColumn("p", F.expr(f"1 / (1 + exp(-({margin_sql(grown, bias)})))")).select("x", F.expr("y - n * p").alias("g"), F.expr("n * p * (1 - p)").alias("h"))
        split: dict[int, tuple[int, int]] = {}
        value: dict[int, float] = {}
        for level in range(depth + 1):
            place = scored.select(F.expr(_place_sql(split)).alias("node"), "x", "g", "h").where(f"node >= {1 << level}")
            table = place.select("node", F.posexplode("x").alias("f", "b"), "g", "h").groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in table:
                sums.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            for node, by in sums.items():
                g, h = (sum(v[i] for _, v in sorted(by[0].items())) for i in (0, 1))
                value[node] = rate * g / (h + ridge)
                best = (1e-6, None)
                for f in sorted(by) if level < depth else ():
                    gl = hl = 0.0
                    for b in sorted(by[f])[:-1]:
                        gl, hl = gl + by[f][b][0], hl + by[f][b][1]
                        if min(hl, h - hl) * 4 >= LEAST:
                            gain = round(gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge), 9)
                            if gain > best[0]:
                                best = (gain, (f, b))
                if best[1]:
                    split[node] = best[1]
            if level and not any(k >= 1 << level for k in split):
                break

        def build(at: int):
            return (*split[at], build(2 * at), build(2 * at + 1)) if at in split else value.get(at, 0.0)

        if 1 not in split:
            break
        grown.append(build(1))
    return grown, bias


def judge(pages: DataFrame, rules=RULES, **training) -> DataFrame:
    """pages: page_id, url. The urls that a rule fits are the labelled ones.

    Returns page_id, host, path, rule, verdict, score (the trees' probability of block), one row per row. A null url,
    or one without '://', has empty host and path and is judged by the trees like any other. An empty
    table gives none; without labelled urls of both verdicts all that rules don't decide get the one known, or allow.
    """
    parsed = parse(pages).withColumn("rule", F.expr(rule_sql(1, rules))).withColumn("ruled", F.expr(rule_sql(0, rules)))
    parsed = parsed.withColumn("label", F.expr("CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END"))
    table = common.keep(with_features(parsed), "urls")
    trees, bias = fit(table.where("label is not null").select("x", "label"), **training)
    scored = table.withColumn("score", F.expr(f"1 / (1 + exp(-({margin_sql(trees, bias)})))"))
    return scored.select("page_id", "host", "path", "rule", F.expr("coalesce(ruled, CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END)").alias("verdict"), "score")

"""Secret scans (6) [native]: multipart credential linking.

Base spans, leftmost and not overlapping for each kind: assignments of a password-like name, access
identifiers, long hexadecimal runs. Places come from SQL alone: splitting a text at a pattern gives
what lies between its matches, so running sums of lengths are the starts.

Weak parts are too common to report by themselves: a mixed token that may be a secret, a name that may
be an identifier, an endpoint. Weak secrets are reported (kind `linked`) only when a complementary
part, an access identifier or an endpoint, lies within SCOPE characters. That is an interval join:
parts are dealt to the stretches of SCOPE characters that they reach, a complement to its neighbours too, and
joined by text and stretch, so no group is larger than a stretch, however long the text or the part.
Only texts that have both parts reach the join; texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCOPE = 200  # characters between parts that belong together
# The patterns of the base spans, the kinds in their order
KINDS = ("assign", "access", "hex", "linked")
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# The method's own parts: a token of 20 characters or more with capitals, small letters and digits; a login
# name; an endpoint (a mailbox's name has 64 characters at most, without which a long word would be tried from each of its places)
TOKEN = r"[A-Za-z0-9+/]{20,}"
LOGIN = r"""(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD])["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"(?:https?|ftp|jdbc|s3|redis|amqp|postgres|postgresql|mysql|mongodb)://[^\x20\x09-\x0D\x22\x27<>]+|[A-Za-z0-9._-]{1,64}@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"
MARK = "[SECRET]"
_RUN = 256  # places summed in one go, so that many matches cost no square


def quote(pattern: str) -> str:
    """A Spark SQL literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(df: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds `name`: array<struct<s, e, m>>, all matches leftmost first without overlap, [s, e) in code points, m the
    text of `group`. Texts without a match are passed over after one look."""
    p = quote(pattern)
    some = f"text rlike {p}"
    df = df.withColumn("_m", F.expr(f"CASE WHEN {some} THEN regexp_extract_all(text, {p}, 0) ELSE array() END"))
    df = df.withColumn("_g", F.expr(f"CASE WHEN size(_m) > 0 THEN {'regexp_extract_all(text, ' + p + ', ' + str(group) + ')' if group else '_m'} ELSE array() END"))
    df = df.withColumn("_b", F.expr(f"CASE WHEN size(_m) > 0 THEN split(text, {p}, -1) ELSE array() END"))
    df = df.withColumn("_l", F.expr("transform(_m, (m, i) -> struct(length(get(_b, i)) AS gap, length(m) AS size, get(_g, i) AS m))"))
    df = df.withColumn("_c", F.expr(f"CASE WHEN size(_l) = 0 THEN array() ELSE transform(sequence(0, (size(_l) - 1) div {_RUN}), c -> slice(_l, c * {_RUN} + 1, {_RUN})) END"))
    df = df.withColumn("_o", F.expr("aggregate(_c, struct(0 AS at, cast(array() AS array<int>) AS v), (a, c) -> struct(a.at + aggregate(c, 0, (t, x) -> t + x.gap + x.size) AS at, array_append(a.v, a.at) AS v)).v"))
    kind = "array<struct<s:int,e:int,m:string>>"
    walk = f"aggregate(c, struct(get(_o, i) AS at, cast(array() AS {kind}) AS v), (a, x) -> struct(a.at + x.gap + x.size AS at, array_append(a.v, struct(a.at + x.gap AS s, a.at + x.gap + x.size AS e, x.m AS m)) AS v)).v"
    df = df.withColumn(name, F.expr(f"flatten(transform(_c, (c, i) -> {walk}))"))
    return df.drop("_m", "_g", "_b", "_l", "_c", "_o")


def parts(documents: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), base: array<struct<s, k, e>> sorted, weak and near: array<struct<s, e, role>>,
    role 0: an identifier or endpoint that completes a secret, 1: a secret that completes an identifier."""
    df = common.pick(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    for name, pattern, group in (("a", ASSIGN, 2), ("x", ACCESS, 0), ("h", HEX, 0), ("t", TOKEN, 0), ("g", LOGIN, 0), ("p", ENDPOINT, 0)):
        df = _spans(df, name, pattern, group)
    df = df.withColumn("a", F.expr("filter(a, v -> length(v.m) >= 12)"))
    df = df.withColumn("base", F.expr("array_sort(concat(transform(a, v -> struct(v.s AS s, 0 AS k, v.e AS e)), transform(x, v -> struct(v.s AS s, 1 AS k, v.e AS e)), transform(h, v -> struct(v.s AS s, 2 AS k, v.e AS e))))"))
    tokens = "transform(filter(t, v -> v.m rlike '[A-Z]' AND v.m rlike '[a-z]' AND v.m rlike '[0-9]'), v -> struct(v.s AS s, v.e AS e, 0 AS role))"
    df = df.withColumn("weak", F.expr(f"concat({tokens}, transform(g, v -> struct(v.s AS s, v.e AS e, 1 AS role)))"))
    df = df.withColumn("near", F.expr("concat(transform(concat(x, p), v -> struct(v.s AS s, v.e AS e, 0 AS role)), transform(concat(a, h), v -> struct(v.s AS s, v.e AS e, 1 AS role)))"))
    df = df.withColumn("weak", F.expr("CASE WHEN size(near) > 0 THEN weak ELSE array() END"))
    return df.select("doc_id", F.xxhash64("text").alias("h"), "base", "weak", F.expr("CASE WHEN size(weak) > 0 THEN near ELSE array() END").alias("near"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, h, links: array<struct<s, k, e>> of texts with weak parts that no base span touches, which are reported already,
    and that a complement of the needed role lies within `scope` characters of."""
    both = found.where("size(weak) > 0").select("doc_id", "h", "weak", "near", "base").dropDuplicates(["doc_id", "h"])
    stretches = lambda x, more: F.explode(F.expr(f"sequence(greatest(0, {x}.s - {more}) div {scope}, ({x}.e + {more}) div {scope})"))
    weak = both.select("doc_id", "h", F.explode("weak").alias("w")).select("doc_id", "h", "w", stretches("w", 0).alias("b"), "w.role")
    near = both.select(F.col("doc_id").alias("d"), F.col("h").alias("i"), F.explode("near").alias("n")).select("d", "i", "n", stretches("n", scope).alias("c"), F.col("n.role").alias("r"))
    base = both.select(F.col("doc_id").alias("d"), F.col("h").alias("i"), F.explode("base").alias("n")).select("d", "i", "n", stretches("n", 0).alias("c"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("i")) & (F.col("b") == F.col("c"))
    touches = F.expr("w.s < n.e AND n.s < w.e")
    close = F.expr(f"greatest(w.s - n.e, n.s - w.e) <= {scope}")
    hit = weak.join(near, same & (F.col("role") == F.col("r")) & close & ~touches, "left_semi").select("doc_id", "h", "w").distinct()
    hit = hit.withColumn("b", stretches("w", 0)).join(base, same & touches, "left_semi").select("doc_id", "h", "w").distinct().withColumn("told", F.lit(True)).unionByName(hit.withColumn("told", F.lit(False)))
    hit = hit.groupBy("doc_id", "h", "w").agg(F.max("told").alias("told")).where("NOT told")
    return hit.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.expr("struct(w.s AS s, 3 AS k, w.e AS e)"))).alias("links"))


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, v -> concat(get(array({names}), v.k), ':', v.s, ':', v.e)), ',')"


def _all(found: DataFrame, scope: int) -> DataFrame:
    links = linked(found, scope).toDF("d", "i", "links")
    out = found.join(links, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("i")), "left")
    return out.withColumn("found", F.expr("CASE WHEN links IS NULL THEN base ELSE array_sort(concat(base, links)) END"))


def secrets(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """documents: doc_id, text (null: empty).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, one row per row. Spans are kind:start:end by
    start, then kind in the order of KINDS, code points, end exclusive. Repeated rows get equal rows, a null doc_id stays null,
    an empty table gives none. Texts, parts and the blanks in them may be of any length.
    """
    out = _all(common.keep(parts(documents), "parts"), scope)
    count = lambda k: F.expr(f"cast(size(filter(found, v -> v.k = {k})) AS long)")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("found")).alias("spans"), count(3).alias("n_linked"))


def redact(documents: DataFrame, scope: int = SCOPE, mark: str = MARK) -> DataFrame:
    """All columns of documents (doc_id, text and any others); every found span of a text replaced by `mark`, spans
    that touch by one. A null text stays null."""
    found = _all(common.keep(parts(documents), "parts"), scope).where("size(found) > 0").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("found").alias("_f")).dropDuplicates(["_d", "_h"])
    rows, at = common.plain(documents), common.place(documents, "text")
    text = f"_in{at}"
    out = rows.join(found, F.col(f"_in{common.place(documents, 'doc_id')}").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_h")), "left")
    walk = f"aggregate(_f, struct(0 AS at, '' AS out), (a, x) -> CASE WHEN x.s < a.at OR (x.s = a.at AND a.at > 0) THEN struct(greatest(a.at, x.e) AS at, a.out AS out) ELSE struct(x.e AS at, concat(a.out, substring({text}, a.at + 1, x.s - a.at), {quote(mark)}) AS out) END, a -> concat(a.out, substring({text}, a.at + 1)))"
    return out.withColumn(text, F.expr(f"CASE WHEN _f IS NULL THEN {text} ELSE {walk} END")).drop("_d", "_h", "_f").toDF(*documents.columns)


def _duck(name: str, pattern: str, group: int = 0) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""list_transform(range(1, len(regexp_extract_all(text, {p})) + 1), lambda i: {{
        's': list_sum(list_transform(regexp_split_to_array(text, {p})[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(regexp_extract_all(text, {p})[1:i - 1], lambda v: length(v))), 0),
        'n': length(regexp_extract_all(text, {p})[i]), 'm': regexp_extract_all(text, {p}, {group})[i]}}) AS {name}"""


def oracle(scope: int = SCOPE) -> str:
    """The query in DuckDB SQL."""
    spans = lambda x, role: f"list_transform({x}, lambda v: {{'s': v.s, 'e': v.s + v.n, 'role': {role}}})"
    base = lambda x, k: f"list_transform({x}, lambda v: {{'s': v.s::INT, 'k': {k}, 'e': (v.s + v.n)::INT}})"
    name = "['assign', 'access', 'hex', 'linked']"
    joined = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda v: concat({name}[v.k + 1], ':', v.s, ':', v.e)), ','), '')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, doc_id, {_duck('a0', ASSIGN, 2)}, {_duck('x', ACCESS)}, {_duck('h', HEX)}, {_duck('t0', TOKEN)}, {_duck('g', LOGIN)}, {_duck('p', ENDPOINT)} FROM t),
f AS (SELECT *, list_filter(a0, lambda v: length(v.m) >= 12) AS a,
      list_filter(t0, lambda v: regexp_matches(v.m, '[A-Z]') AND regexp_matches(v.m, '[a-z]') AND regexp_matches(v.m, '[0-9]')) AS t FROM m),
b AS (SELECT r, doc_id, list_sort(list_concat({base('a', 0)}, {base('x', 1)}, {base('h', 2)})) AS base,
      list_concat({spans('t', 0)}, {spans('g', 1)}) AS weak, list_concat({spans('list_concat(x, p)', 0)}, {spans('list_concat(a, h)', 1)}) AS near FROM f),
w AS (SELECT r, unnest(weak) AS w, base FROM b), n AS (SELECT r, unnest(near) AS n FROM b),
l AS (SELECT r, list_sort(list(DISTINCT {{'s': w.s::INT, 'k': 3, 'e': w.e::INT}})) AS links FROM w JOIN n USING (r)
      WHERE w.role = n.role AND greatest(w.s - n.e, n.s - w.e) <= {scope} AND NOT (w.s < n.e AND n.s < w.e)
        AND len(list_filter(base, lambda z: z.s < w.e AND w.s < z.e)) = 0 GROUP BY r),
j AS (SELECT doc_id, base, CASE WHEN links IS NULL THEN base ELSE list_sort(list_concat(base, links)) END AS found FROM b LEFT JOIN l USING (r))
SELECT doc_id, len(list_filter(found, lambda v: v.k = 0))::BIGINT AS n_assign, len(list_filter(found, lambda v: v.k = 1))::BIGINT AS n_access,
       len(list_filter(found, lambda v: v.k = 2))::BIGINT AS n_hex, sha256({joined('base')}) AS base_sha256, {joined('found')} AS spans,
       len(list_filter(found, lambda v: v.k = 3))::BIGINT AS n_linked
FROM j"""

"""Column expressions: identifiers, phred values, logarithms, list texts, sequence context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phred_to_probability(q: Column) -> Column:
    return 1 - F.pow(F.lit(10.0), -q / 10)


def probability_to_phred(p: Column) -> Column:
    """Rounded up; 40 where the probability is 1."""
    return F.when(p == 1, F.lit(40)).otherwise(F.ceil(F.round(-10 * F.log10(1 - p), 9)).cast("int"))


def log10_p(p: Column) -> Column:
    """Of p values: 0 counts as 1e-300, missing as 1."""
    p = F.coalesce(p, F.lit(1.0))
    return F.log10(F.when(p == 0, F.lit(1e-300)).otherwise(p))


def identifier(mut: Column) -> Column:
    """chrom_pos_ref_alt as a struct."""
    parts = F.split(mut, "_")
    return F.struct(parts[0].alias("chrom"), parts[1].cast("int").alias("pos"), parts[2].alias("ref"), parts[3].alias("alt"))


def split_alts(df: DataFrame, mut: str = "mut") -> DataFrame:
    """One row for each alt of a comma list."""
    parts = F.split(F.col(mut), "_")
    return df.withColumn("_p", parts).withColumn("_alt", F.explode(F.split(F.col("_p")[3], ","))).withColumn(mut, F.concat_ws("_", F.col("_p")[0], F.col("_p")[1], F.col("_p")[2], "_alt")).drop("_p", "_alt")


def map_sum(text: Column) -> Column:
    """Sum of the counts of `A:9,T:1`; repeated keys add up."""
    return F.aggregate(F.transform(F.split(text, ","), lambda x: F.try_to_number(F.element_at(F.split(x, ":"), 2), F.lit("999999999")).cast("long")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def list_min(text: Column) -> Column:
    return F.array_min(F.transform(F.split(text, ","), lambda x: x.cast("double")))


def most_frequent(text: Column) -> Column:
    """Of a comma list; of equally frequent ones the least."""
    parts = F.split(text, ",")
    counted = F.transform(F.array_distinct(parts), lambda x: F.struct((-F.size(F.filter(parts, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.array_min(counted)["x"]


def str_to_bool(text: Column) -> Column:
    return F.when(F.lower(text).isin("yes", "true", "t", "y", "1"), True).when(F.lower(text).isin("no", "false", "f", "n", "0"), False)


def key_values(text: Column) -> Column:
    """`key=value;` pairs as a map."""
    pairs = F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring_index(x, "=", -1)).alias("v"))))


def annotation_place(mut: Column) -> Column:
    """chrom_pos_ref_alt -> chrom:pos,ref>alt"""
    return F.regexp_replace(mut, "^([^_]+)_([^_]+)_([^_]+)_([^_]+)$", "$1:$2,$3>$4")


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def dna_context(before: Column, ref: Column, alt: Column, after: Column) -> Column:
    """The 96-class context b[R>A]a on the pyrimidine strand."""
    plain = F.concat(before, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), after)
    other = F.concat(complement(after), F.lit("["), complement(ref), F.lit(">"), complement(alt), F.lit("]"), complement(before))
    return F.when(ref.isin("C", "T"), plain).otherwise(other)


def rna_context(before: Column, ref: Column, alt: Column, after: Column, strand: Column) -> Column:
    """The 192-class context: the transcript's strand decides."""
    plain = F.concat(before, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), after)
    other = F.concat(complement(after), F.lit("["), complement(ref), F.lit(">"), complement(alt), F.lit("]"), complement(before))
    return F.when(strand == "-", other).otherwise(plain)


def gc_share(bases: Column) -> Column:
    return F.try_divide(F.length(bases) - F.length(F.translate(bases, "GC", "")), F.length(bases))


def in_base_run(bases: Column, run: int = 4) -> Column:
    """Whether a stretch holds `run` equal bases in a row."""
    out = F.lit(False)
    for b in "ACGT":
        out = out | F.contains(bases, F.lit(b * run))
    return out


def bin_up(x: Column, width: int) -> Column:
    """Upward to a multiple of the width."""
    return F.ceil(x / width) * width


def cigar_parts(cigar: Column) -> Column:
    """array<struct<n, op>>"""
    n, op = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2))
    return F.transform(F.arrays_zip(n.alias("n"), op.alias("op")), lambda x: F.struct(x["n"].cast("int").alias("n"), x["op"].alias("op")))


def cigar_length(cigar: Column, ops: str) -> Column:
    """Sum over the named operations."""
    return F.aggregate(F.filter(cigar_parts(cigar), lambda x: F.contains(F.lit(ops), x["op"])), F.lit(0), lambda a, x: a + x["n"])


def cigar_count(cigar: Column, ops: str) -> Column:
    return F.size(F.filter(cigar_parts(cigar), lambda x: F.contains(F.lit(ops), x["op"])))


def soft_clips(cigar: Column) -> Column:
    """struct<left, right>: soft-clipped bases at each end."""
    left, right = F.regexp_extract(cigar, "^(?:[0-9]+H)?([0-9]+)S", 1), F.regexp_extract(cigar, "[^0-9]([0-9]+)S(?:[0-9]+H)?$", 1)
    zero = lambda c: F.when(c == "", F.lit(0)).otherwise(F.nullif(c, F.lit("")).cast("int"))
    return F.struct(zero(left).alias("left"), zero(right).alias("right"))


def indel_distance(cigar: Column, offset: Column) -> Column:
    """Least distance from a reference offset to an insertion or deletion of the read; null without any. A deletion spans
    its bases."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("near"))

    def step(a, x):
        span = F.when(x["op"] == "D", x["n"]).otherwise(F.lit(0))
        last = a["at"] + F.greatest(span - 1, F.lit(0))
        gap = F.when(offset < a["at"], a["at"] - offset).when(offset > last, offset - last).otherwise(F.lit(0))
        near = F.when(x["op"].isin("I", "D"), F.least(a["near"], gap)).otherwise(a["near"])
        return F.struct((a["at"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(F.lit(0))).alias("at"), near.alias("near"))

    return F.aggregate(cigar_parts(cigar), start, step)["near"]


def log_floor(x: Column, floor: float = 1e-10) -> Column:
    return F.log(F.greatest(x, F.lit(floor)))


def log_sum_exp(values: Column) -> Column:
    """Of an array."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def log_diff_exp(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)), a > b."""
    return a + F.log1p(-F.exp(b - a))


def log_normalise_pair(a: Column, b: Column) -> Column:
    """The first of two log values after both are normalised to add up to 1."""
    return a - log_sum_exp(F.array(a, b))


def nonnull_mean(values: Column) -> Column:
    """Of an array; null when it has no value."""
    some = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), F.size(some))

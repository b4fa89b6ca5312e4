import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from cladeframe.sources import bam, sinks, tables
from cladeframe.streaming import counts


def put(path, text):
    path.write_text(text)
    return str(path)


def test_matrices(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "ID\tchr1:5_A>T\tm2\nc1\t1\tNA\nc2\t0\t1\n\n")
    got = {(r.cell, r.mut): (r.state, r.alt, r.total) for r in tables.read_binary_matrix(spark, p).collect()}
    assert got == {("c1", "chr1_5_A>T"): (1, 10, 10), ("c1", "m2"): (None, 0, 0), ("c2", "chr1_5_A>T"): (0, 0, 10), ("c2", "m2"): (1, 10, 10)}
    assert {r.mut: r.entry for r in tables.bulk_of(tables.read_binary_matrix(spark, p)).collect()} == {"chr1_5_A>T": "10/20", "m2": "10/10"}
    n = tables.read_numbers(spark, put(tmp_path / "n.tsv", "x\ta\tb\nr\t1.5\tword\n"))
    assert sorted((r.column, r.value) for r in n.collect()) == [("a", 1.5), ("b", None)]


def test_load_all(spark, tmp_path):
    for k, name in tables.FILES.items():
        head = "mut\tbulk\tc1\tc2" if k == "entry" else "mut\tc1\tc2"
        put(tmp_path / name, f"{head}\nm1\t" + ("4/9\t1/2\tNA" if k == "entry" else "0.9\tNA") + "\n")
    put(tmp_path / tables.FEATURES, "mut\tf\nm1\t3\n")
    obs, bulk, features = tables.load_all(spark, str(tmp_path))
    assert sorted((r.cell, r.p, r.alt, r.total, r.vaf) for r in obs.collect()) == [("c1", 0.9, 1, 2, 0.5), ("c2", None, 0, 0, None)]
    assert bulk.first().total == 9 and features.first().value == "3"


def test_lists(spark, tmp_path):
    p = put(tmp_path / "muts", "#head\nchr1_5_A_T,C\nchr1\t7\tG\tA\nchr1_5_A_T\n")
    assert [r.mut for r in tables.read_mutations(spark, p).orderBy("place").collect()] == ["chr1_5_A_T", "chr1_5_A_C", "chr1_7_G_A"]
    b = tables.read_barcodes(spark, put(tmp_path / "b.csv", "barcode,in_tissue,x,y,real_x,real_y\nA,1,1,2,10,20\nB,0,3,4,30,40\n"), pos=2)
    assert [(r.barcode, r.x, r.y) for r in b.collect()] == [("A", 10.0, 20.0)]
    assert tables.read_barcodes(spark, put(tmp_path / "l", "A\nB\n")).count() == 2
    bed = tables.read_bed(spark, put(tmp_path / "x.bed", "#c\nchr1\t5\t9\tname\nchr2\t1\t2\n"))
    assert sorted((r.chrom, r.start, r.end, r.rest) for r in bed.collect()) == [("chr1", 5, 9, ["name"]), ("chr2", 1, 2, [])]
    vcf = tables.read_vcf(spark, put(tmp_path / "x.vcf", "##h\nchr1\t5\t.\tA\tC,T\t.\t.\tAF=0.1;DB\n"))
    assert sorted((r.alt, r.info["AF"]) for r in vcf.collect()) == [("C", "0.1"), ("T", "0.1")]
    tables.by_chromosome(bed.drop("rest"), str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).where("chrom = 'chr1'").count() == 1
    prior = tables.read_typed(spark, put(tmp_path / "prior", "chr1\t5\tA\t0.9\t0.1\t0\t0\n"), "prior").first()
    assert (prior.pos, prior.fT) == (5, 0.1)
    ref = tables.read_reference(spark, put(tmp_path / "r.fa", ">chr1 x\nACg\nT\n>chr2\nGG\n"))
    assert sorted((r.chrom, r.pos, r.base) for r in ref.collect()) == [("chr1", 1, "A"), ("chr1", 2, "C"), ("chr1", 3, "G"), ("chr1", 4, "T"), ("chr2", 1, "G"), ("chr2", 2, "G")]
    assert tables.config({"a": {"b": 1, "c": 2}}, put(tmp_path / "c.yaml", "a:\n  b: 5\n")) == {"a": {"b": 5, "c": 2}}


def test_tree_input_round_trip(spark, tmp_path):
    obs = spark.createDataFrame([("c1", "chr1_5_A_T", 0.9, -1.0, -3.0, 2, 5), ("c2", "chr1_5_A_T", 0.1, -4.0, -0.5, 0, 3)], "cell string, mut string, p double, ll_mut double, ll_unmut double, alt long, total long")
    bulk = spark.createDataFrame([("chr1_5_A_T", 0.8, "2/8")], "mut string, posterior double, entry string")
    lines = sinks.tree_input_lines(obs, bulk, "s", ["c1", "c2"])
    lines.write.text(str(tmp_path / "in"))
    back, sites = tables.read_tree_input(spark, str(tmp_path / "in"), ["c1", "c2"])
    assert sorted((r.cell, r.p, r.ll_mut, r.ll_unmut, r.entry) for r in back.collect()) == [("c1", 0.9, -1.0, -3.0, "2/5"), ("c2", 0.1, -4.0, -0.5, "0/3")]
    assert (sites.first().bulk, sites.first().posterior) == ("2/8", 0.8)
    out = tables.read_caller_output(spark, put(tmp_path / "call", "chr1_5\t('A', 'T')\t['c1', 'c2']\t[{'A': 3, 'T': 1}, {}]\n")).first()
    assert (out.ref, out.alt, out.cells, out.counts) == ("A", "T", ["c1", "c2"], [{"A": 3, "T": 1}, {}])


def test_bam(spark, tmp_path):
    name, seq = b"r1\0", "ACGTA"
    packed = bytes(bam.BASES.index(a) << 4 | bam.BASES.index(b) for a, b in zip(seq[::2] , seq[1::2] + "="))
    tags = b"CBZcell1\0UBZumi1\0NHC\2nMi" + struct.pack("<i", 1) + b"xxBc" + struct.pack("<i", 2) + b"\1\2"
    body = struct.pack("<iiBBHHHiiii", 0, 9, len(name), 60, 0, 3, 16, len(seq), -1, -1, 0) + name + struct.pack("<3I", 1 << 4 | 4, 2 << 4, 2 << 4) + packed + bytes([30, 31, 32, 33, 34]) + tags
    other = struct.pack("<iiBBHHHiiii", 0, 9, len(name), 60, 0, 1, 0, 1, -1, -1, 0) + name + struct.pack("<I", 1 << 4) + b"\x10" + b"\x1e"
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for b in (body, other):
        data += struct.pack("<i", len(b)) + b
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    got = list(bam.rows(str(tmp_path / "x.bam"), "CB", "UB"))
    assert [(r[0], r[1], r[2], r[3], r[4], r[5], r[7], r[8], r[9], r[10]) for r in got] == [("cell1", "umi1", "chr1", p, b, q, True, "1S2M2M", 1, 2) for p, b, q in zip((10, 11, 12, 13), "CGTA", (31, 32, 33, 34))]
    spark.dataSource.register(bam.BamSource)
    from cladeframe.session import ship

    ship(spark)
    assert spark.read.format("bam").load(str(tmp_path / "x.bam")).count() == 4


def test_sinks(spark, tmp_path):
    ok = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a")], "cell string, mut string")
    sinks.write_cf_matrix(ok, ["a", "b"], str(tmp_path / "cf"))
    rows = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "cf")).collect()
    assert sorted(tuple(r) for r in rows) == [("c1", "1", "1"), ("c2", "1", "0")] and rows[0].__fields__[0] == "cellIDxmutID"
    bad = ok.union(spark.createDataFrame([("c3", "b")], "cell string, mut string"))
    with pytest.raises(ValueError):
        sinks.write_cf_matrix(bad, ["a", "b"], str(tmp_path / "bad"))
    g = spark.createDataFrame([("c1", "a", 1), ("c1", "b", None)], "cell string, mut string, state int")
    sinks.write_states(g, ["a", "b"], str(tmp_path / "na3"))
    assert tuple(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "na3")).first()) == ("c1", "1", "3")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i % 3, i % 2, i) for i in range(60)], "cell long, mut long, state int, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.repartition(4).write.parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "obs"))
    q = counts.windowed_mutant_fraction(stream, width="20 seconds").writeStream.outputMode("complete").format("memory").queryName("frac").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.window.start, r.mut, r.mutant_cells, r.covered)
    assert sorted(map(key, spark.table("frac").collect())) == sorted(map(key, counts.windowed_mutant_fraction(rows, width="20 seconds").collect()))
    q = counts.append_batches(stream, lambda b: counts.read_lengths(b.withColumn("length", F.col("s"))), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("total")).first()[0] == sum(range(60))

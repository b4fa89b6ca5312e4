"""Reads of BAM files as a Spark data source, in plain Python: BGZF is gzip members, alignments are fixed fields and tags.

spark.dataSource.register(BamSource); spark.read.format("bam").option("cell", "CB").option("umi", "UB").load(path)

One partition a file: split a large file by region first, or keep the result as Parquet, the contract of all operators. Reads without the tags are
dropped. Rows are one per aligned reference base (match operations), so a site is an equality filter on chrom and pos.
"""

from __future__ import annotations

import glob
import gzip
import os
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "cell string, umi string, chrom string, pos int, base string, baseq int, mapq int, is_reverse boolean, cigar string, nm int, nh int, gene_id string, gene_name string, transcript string"
# Fixed values of the format: bases, operations, sizes of tag types; tags of the run types (cell, umi)
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
CODES = {"A": "c", "c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
RUN_TYPES = {"visium": ("CB", "UB"), "stereo": ("Cx_Cy", "UR"), "ST": ("B0", "B3")}


def tags(data: bytes) -> dict:
    out, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + n * SIZES[sub]
        else:
            value = struct.unpack_from(CODES[kind], data, at)[0]
            out[name], at = value.decode() if kind == "A" else value, at + SIZES[kind]
    return out


def alignments(stream):
    """(chrom, pos from 0, mapq, flag, cigar pairs, bases, qualities, tags)"""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        names.append(stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode())
        stream.read(4)
    while len(head := stream.read(4)) == 4:
        data = stream.read(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
        at = 32 + l_name
        cigar = [(c >> 4, OPS[c & 15]) for c in struct.unpack_from(f"<{n_cigar}I", data, at)]
        at += 4 * n_cigar
        packed = data[at : at + (l_seq + 1) // 2]
        bases = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
        at += (l_seq + 1) // 2
        yield names[ref] if ref >= 0 else None, pos, mapq, flag, cigar, bases, data[at : at + l_seq], tags(data[at + l_seq :])


def rows(path: str, cell: str, umi: str):
    with gzip.open(path) as stream:
        for chrom, pos, mapq, flag, cigar, bases, quals, t in alignments(stream):
            c = "_".join(str(t[k]) for k in cell.split("_")) if all(k in t for k in cell.split("_")) else None
            if chrom is None or c is None or umi not in t or flag & 4:
                continue
            text = "".join(f"{n}{op}" for n, op in cigar)
            at, ref = 0, pos
            for n, op in cigar:
                if op in "M=X":
                    for i in range(n):
                        if bases[at + i] in "ACGT":
                            yield c, str(t[umi]), chrom, ref + i + 1, bases[at + i], quals[at + i], mapq, bool(flag & 16), text, t.get("nM", t.get("NM")), t.get("NH"), t.get("GX"), t.get("GN"), t.get("TX")
                at += n if op in "MIS=X" else 0
                ref += n if op in "MDN=X" else 0


class BamFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for p in (glob.glob(os.path.join(options["path"], "*.bam")) if os.path.isdir(options["path"]) else glob.glob(options["path"])))
        self.tags = RUN_TYPES.get(options.get("run_type", ""), (options.get("cell", "CB"), options.get("umi", "UB")))

    def partitions(self):
        return [BamFile(p) for p in self.paths]

    def read(self, partition):
        yield from rows(partition.path, *self.tags)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)

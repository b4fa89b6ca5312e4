"""Streams of reads or observations. The reference semantics have no event time; what streams unchanged are sums: pair counts of complete
cells, mutant fractions, mean read lengths. Late rows are dropped by a watermark where there is a time column; without one the state is one row
a key and grows with keys only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mutant_fraction(obs: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """window, mut, mutant_cells, covered of a stream or a table of cell, mut, state, ts."""
    w = obs.withWatermark(time, late) if obs.isStreaming else obs
    return w.groupBy(F.window(time, width).alias("window"), "mut").agg(F.count_if(F.col("state") == 1).alias("mutant_cells"), F.count("state").alias("covered"))


def read_lengths(reads: DataFrame, length: str = "length") -> DataFrame:
    """cell, total, reads: running sums in complete or update mode."""
    return reads.groupBy("cell").agg(F.sum(length).alias("total"), F.count("*").alias("reads"))


def append_batches(stream: DataFrame, fold, path: str, checkpoint: str):
    """Each micro-batch goes through `fold` (a batch operator) and is appended with its number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

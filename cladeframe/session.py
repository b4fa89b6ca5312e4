"""What a session needs: the package on the executors, and tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, wherever the driver imported it from. Once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_cladeframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cladeframe")) / "cladeframe_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    sc._cladeframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The cluster names it in spark.checkpoint.dir; a local session
    without the setting (a test) gets a temporary one, any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_cladeframe_shared", None)
        if not named:
            named = spark.sparkContext._cladeframe_shared = tempfile.mkdtemp(prefix="cladeframe-shared")
    return named.rstrip("/")


def keep(df: DataFrame, what: str) -> DataFrame:
    """Writes a frame as a table in the shared folder and reads it: lineage ends there, and lost
    executors lose nothing of it. It goes with the driver, unless `drop` is called before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def drop(*kept: DataFrame) -> None:
    """Deletes kept tables that nothing lazy reads any more."""
    for df in kept:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at, files = _files(df.sparkSession, parent)
            files.delete(at, True)

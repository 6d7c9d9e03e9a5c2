"""Parquet tables of a data folder, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A table that is one file between these sizes is spread over the cores; folders of part files are left as they lie.
SPREAD_BYTES = (256 << 10, 128 << 20)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (a file or a folder of part files)."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    return spread(df) if SPREAD_BYTES[0] <= single_file(spark, path) <= SPREAD_BYTES[1] else df


def single_file(spark: SparkSession, path: str) -> int:
    """Bytes of ``path`` if it is one file, else -1."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    return found.getLen() if found.isFile() else -1


def spread(df: DataFrame, most: int = 8) -> DataFrame:
    """``df`` over the cores, ``most`` at most.

    A file of one row group is read by one task, which would then do all work on its texts. Filters and column choices
    still reach the scan through the exchange.
    """
    return df.repartition(min(df.sparkSession.sparkContext.defaultParallelism, most))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a session on one machine (tests) gets a fresh folder there; on a cluster, whose executors couldn't
    read each other's part of it, this is refused with ValueError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="chunkwright-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage with a copy that outlives the loss of any executor, in compressed columns, and
    is used where several later stages need the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

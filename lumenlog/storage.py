"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of a settled table, which a task that writes holds in memory.
ROW_GROUP_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one for a session in one machine
    (tests); on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: set it to a folder that driver and executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lumenlog-")
        shared_dir.own = base
    return base.rstrip("/")


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it again: cuts lineage, and survives lost executors.

    The shuffle files that the write needed go once it is done; the caller's setting for that is put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenlog/{tag}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(clean, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more: what was made of them is itself settled."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

"""Makes the package importable on executors, wherever the driver found it, and bounds what readers and Python workers hold at a time."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession

#: Bytes of an Arrow batch, unless the session has its own setting: documents are large, and workers hold copies of a batch.
BATCH_BYTES = "8m"
#: Rows that the Parquet reader decodes at once, unless the session has its own setting: 4096 rows of whole texts are tens of MB a task.
READER_ROWS = 512


def built(make: Callable[..., Column], *key: object) -> Column:
    """make(), an expression over columns by name, made once for a Spark context and key. Building a large one takes seconds, which each micro-batch would pay anew."""
    held = SparkContext._active_spark_context.__dict__.setdefault("_lumenlog_built", {})
    at = (make.__module__, make.__qualname__, repr(key))
    if at not in held:
        held[at] = make()
    return held[at]


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors' Python workers, once a Spark context, and sets the bounds of batches where they are Spark's own."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64MB", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)
    if not getattr(sc, "_lumenlog_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lumenlog-ship-")) / "lumenlog.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._lumenlog_shipped = True
    return spark

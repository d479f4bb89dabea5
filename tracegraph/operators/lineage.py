"""Cutting the lineage of iterative plans, and folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh name in the folder of ``spark.checkpoint.dir``; only a session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tracegraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Rows, and bytes of them as JSON text, up to which a table is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks ``df`` for broadcast if a look at its first ``rows`` rows shows that there are no more and that they are not large; else Spark chooses the join.

    The look runs ``df``, so give it something cheap or settled.
    """
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")).first()
    return F.broadcast(df) if found.n <= rows and (found.size or 0) <= size else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, the lineage ends there, and Spark knows its size. Shuffle files go as the write ends."""
    spark, path, name = df.sparkSession, shared_folder(df.sparkSession), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)

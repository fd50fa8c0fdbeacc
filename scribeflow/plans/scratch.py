"""Tables written once and read again, which cuts long plans; they outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in single-process local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="scribeflow-"))
        root = _LOCAL[0]
    return root.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` from a new table in that folder, in a folder of its own for each value of ``by``."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Tables between stages, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a local folder serves a local session, and
    any other session, whose executors share no local folder, gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_plinth_tables", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = spark._plinth_tables = tempfile.mkdtemp(prefix="plinth-tables-")
    return f"{base.rstrip('/')}/plinth-tables/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Deal rows to so many tasks by their keys; 0 leaves the number to Spark. A table that is read back comes in as few
    tasks as its files allow, and what they hold before an exchange grows with it."""
    return df.repartition(tasks, *keys) if tasks else df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to a scratch path and read back: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

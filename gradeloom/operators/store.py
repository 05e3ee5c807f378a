"""Tables written to the folder that the driver and all executors share, and small tables dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one of our own in local mode only; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints/gradeloom"


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet and read again: what reads it later neither runs nor plans it anew, and no lost executor undoes it."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, part_bytes: int = 256 << 10) -> DataFrame:
    """A table too small for Spark to read with all cores, dealt to them for work that is heavy on the CPU: one task for each
    `part_bytes` by the plan's own estimate, at most one a core. Larger tables and streams stay as they are."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes", "4194304")))
    parts = min(cores, -(-size // part_bytes))
    return df.repartition(parts) if parts > 1 and size < cores * split else df


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of tables of one row each, in one row."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in both.columns))

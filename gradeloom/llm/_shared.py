"""Tables in the cluster's shared folder, and streaming over runs of sorted rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
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


class Scratch:
    """Written tables of one operator call. A table cuts the lineage and outlives any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, name: str) -> None:
        """Delete every table but one."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in fs.listStatus(base):
            if found.getPath().getName() != name:
                fs.delete(found.getPath(), True)


def split_by(docs: DataFrame, ids: DataFrame, column: str = "id", bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` whose `column` is surely not in `ids` (of the one column id), and the rest, which an exact join can then
    shuffle alone. What is broadcast is a bitmap of hashed ids that always has `bits` bits; where it fills up, the rest is more."""
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    named = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    maps = ids.select(F.bitmap_bucket_number(named).alias("__bucket"), F.bitmap_bit_position(named).alias("p")).groupBy("__bucket").agg(F.bitmap_construct_agg("p").alias("__bits"))
    marked = docs.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "__bucket", "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(__bits, 1 + cast(__at div 8 as int), 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(__byte, cast(__at % 8 as int)) & 1") == 1, F.lit(False))
    marked = marked.withColumn("__at", at).withColumn("__byte", byte).withColumn("__hit", hit)
    return marked.where(~F.col("__hit")).select(docs.columns), marked.where("__hit").select(docs.columns)


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes as well as rows, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def runs(batches, key: str):
    """Yield record batches cut so that rows with equal `key` stay together. The input is sorted by `key`."""
    carry = None
    for batch in batches:
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0] if carry.num_rows else batch
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield batch.slice(0, cut)
        carry = batch.slice(cut)
    if carry is not None and carry.num_rows:
        yield carry

"""Choosing and partitioning rows by position."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import written

MAX_DRAW = 10_000_000  # positions that the driver draws; hashed_rows() has no such bound


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds 0-based positions in a total order without putting all rows into one task.

    Rows are range-partitioned and sorted; a count for each partition (one small row each) gives its offset. Ties in `order` get
    positions in no fixed order, so name enough columns.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    split = parts.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    split = written(split)  # the ranges must not be drawn anew for the counts
    counts = sorted((r["__p"], r["n"]) for r in split.groupBy("__p").agg(F.count("*").alias("n")).collect())
    start, offsets = 0, []
    for p, n in counts:
        offsets.append((p, start))
        start += n
    table = spark.createDataFrame(offsets, T.StructType.fromDDL("__p long, __o long"))
    return split.join(F.broadcast(table), "__p").withColumn(name, F.col("__i") + F.col("__o")).drop("__m", "__p", "__i", "__o")


def head(df: DataFrame, n: int, position: str = "position") -> DataFrame:
    """The first n rows by position."""
    return df.orderBy(position).limit(_positive(n))


def tail(df: DataFrame, n: int, position: str = "position") -> DataFrame:
    """The last n rows, in ascending order."""
    return df.orderBy(F.desc(position)).limit(_positive(n)).orderBy(position)


def random_positions(total: int, n: int | None, seed: int) -> list[int]:
    """n of `total` positions in drawing order, without replacement; all of them, shuffled, for None. The draw of one generator can't
    be dealt out, so MAX_DRAW positions at most."""
    if (total if n is None else min(n, total)) > MAX_DRAW:
        raise ValueError(f"more than {MAX_DRAW} positions; use hashed_rows()")
    return random.Random(seed).sample(range(total), total if n is None else min(n, total))


def random_rows(df: DataFrame, n: int | None, seed: int, total: int, position: str = "position") -> DataFrame:
    """The rows at random_positions(), with their drawing order as `ordinal`."""
    if n is not None:
        _positive(n)
    chosen = df.sparkSession.createDataFrame(list(enumerate(random_positions(total, n, seed))), T.StructType.fromDDL(f"ordinal long, {position} long"))
    return df.join(chosen, position).orderBy("ordinal")


def hashed_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """A fixed pseudo-random choice of n rows that needs no positions."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(_positive(n))


def select_rows(df: DataFrame, order: str, n: int | None, total: int, seed: int = 0, position: str = "position") -> DataFrame:
    """order is head, tail or random; n at most total."""
    if order not in ("head", "tail", "random"):
        raise ValueError(f"order {order!r} is not head, tail or random")
    n = None if n is None else min(_positive(n), total)
    if order == "random":
        return random_rows(df, n, seed, total, position)
    return df.orderBy(position) if n is None else (head if order == "head" else tail)(df, n, position)


def without_done(df: DataFrame, done: DataFrame, key: str = "eval_id") -> DataFrame:
    """Rows whose key is not in `done`."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def stride_shard(df: DataFrame, shards: int, rank: int, position: str = "position") -> DataFrame:
    """Every `shards`-th row by position, from `rank` on."""
    return df.where(F.col(position) % shards == rank)


def contiguous_chunk(df: DataFrame, chunks: int, k: int, total: int, position: str = "position") -> DataFrame:
    """The k-th of `chunks` stretches of ceil(total / chunks) rows; late ones may be short or empty."""
    return df.where(F.floor(F.col(position) / -(-total // chunks)) == k)


def batches(df: DataFrame, size: int, position: str = "position") -> DataFrame:
    """Adds the number of the fixed-size batch each row is in."""
    return df.withColumn("batch", F.floor(F.col(position) / size))


def least_loaded(df: DataFrame, n: int, utilisation: str = "util", free: str = "free") -> DataFrame:
    """The n rows with least utilisation, then most free."""
    return df.orderBy(utilisation, F.desc(free)).limit(_positive(n))


def nth_of_key(df: DataFrame, key: list[str], order: list[str], name: str = "k") -> DataFrame:
    """1-based occurrence number of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def _positive(n: int) -> int:
    if n <= 0:
        raise ValueError("n must be positive")
    return n

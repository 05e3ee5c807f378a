"""Connected components of a distributed edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) for every node that has a smaller node in its component; component is the smallest id.

    `edges` has long columns a and b. Self-loops, repeats and nulls are ignored; no edges give no rows. Each round
    links a node's larger neighbours, then its smaller ones, to the smallest node around it, until nothing changes.
    The edges stay distributed; the driver sees a count and a checksum a round.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen, turn = scratch.keep(clean, f"{name}-0"), None, 0
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen, turn = mark, turn + 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")

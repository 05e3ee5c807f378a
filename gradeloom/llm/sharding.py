"""Sharding through a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, a permutation given by an offset and a step taken
from a hash of its name. The shards take turns, each claiming its most preferred free slot, until the table is full; a shard of
weight w has w turns a round. A row's key hashes to a slot, and the broadcast table names the shard: constant time a row, no
shuffle. When a shard comes or goes, few slots change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _number(text: str) -> int:
    """The first 60 bits of the text's md5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's walk through the table."""
    return _number(f"{shard}/offset") % size, _number(f"{shard}/step") % (size - 1) + 1


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str] | Mapping[str, int], size: int) -> list[str]:
    """The shard of each slot. `size` must be a prime of at least the number of shards; names must differ."""
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1)
    if not weights or len(weights) != len(shards) or min(weights.values()) < 1 or not is_prime(size) or size < len(weights):
        raise ValueError("shards need distinct names, weights from 1 and a prime table size of at least their number")
    table: list[str | None] = [None] * size
    walks = {s: preference(s, size) for s in weights}
    turn = dict.fromkeys(weights, 0)
    free = size
    while free:
        for shard, weight in weights.items():
            offset, step = walks[shard]
            for _ in range(weight):
                if not free:
                    break
                while table[slot := (offset + step * turn[shard]) % size] is not None:
                    turn[shard] += 1
                table[slot] = shard
                turn[shard] += 1
                free -= 1
    return table  # type: ignore[return-value]


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: the first 60 bits of the md5 of its text, modulo the table's size. Null goes as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("long")


def lookup(spark: SparkSession, shards: Sequence[str] | Mapping[str, int], size: int) -> DataFrame:
    """(slot, shard) for each slot."""
    return spark.createDataFrame(list(enumerate(fill_table(shards, size))), "slot long, shard string")


def assign_shards(rows: DataFrame, shards: Sequence[str] | Mapping[str, int], key_col: str = "doc_id", size: int = 65537) -> DataFrame:
    """All columns of `rows`, then slot and shard.

    The key may have any type with a text form; rows with equal keys, repeated rows among them, share a shard; a null key goes
    to the slot of the empty text. Choose a key without heavy values (an id, not a source) for even shards. Columns slot and
    shard are replaced. An empty table gives an empty one. The broadcast holds `size` rows whatever the input.
    """
    base = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key_col), size))
    return base.join(F.broadcast(lookup(rows.sparkSession, shards, size)), "slot").select(*base.columns, "shard")


def write_shards(rows: DataFrame, path: str, shards: Sequence[str] | Mapping[str, int], key_col: str = "doc_id", size: int = 65537, files_per_shard: int = 4) -> None:
    """Write one folder per shard. A shard's rows go to `files_per_shard` tasks by slot, so no task holds a whole shard."""
    placed = assign_shards(rows, shards, key_col, size)
    parts = len(shards) * files_per_shard
    placed.repartition(parts, "shard", F.col("slot") % files_per_shard).drop("slot").write.partitionBy("shard").parquet(path)

"""Incremental runs: keyed cache, overlays, and what is left to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import one_row


def latest(log: DataFrame, key: str = "k", sequence: str = "seq") -> DataFrame:
    """The last version of each key of an append-only log: one aggregation, no window."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("__r")).select(key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def overlay(base: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Rows of both, the newer winning; columns as in `base`."""
    both = base.withColumn("__s", F.lit(0)).unionByName(newer.withColumn("__s", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, "__s").select(base.columns)


def duplicate_keys(rows: DataFrame, key: Column | str) -> DataFrame:
    """Keys, as text, that occur more than once, with their counts."""
    k = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(k.cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def reusable(cache: DataFrame, fingerprint: str) -> DataFrame:
    """Cached rows of the same configuration that did not fail in a model call."""
    return cache.where((F.col("fingerprint") == fingerprint) & ~F.coalesce(F.startswith("reason", F.lit("llm_error")), F.lit(False)))


def split_work(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached result, rows still to do). Keys that are not unique are always done anew."""
    k = F.col(key).cast("string")
    unique = cache.where(F.col(key).isNotNull()).select(k.alias("__k")).distinct().join(duplicate_keys(rows, key).select(F.col("key").alias("__k")), "__k", "left_anti")
    keyed = rows.withColumn("__k", k)
    return keyed.join(unique, "__k", "left_semi").drop("__k"), keyed.join(unique, "__k", "left_anti").drop("__k")


def by_prefix(log: DataFrame, prefix: str, key: str = "k", wildcards: bool = False) -> DataFrame:
    """Rows whose key begins with `prefix`, in text order. With `wildcards`, % and _ match anything and case is ignored."""
    hit = F.col(key).ilike(prefix + "%") if wildcards else F.startswith(key, F.lit(prefix))
    return log.where(hit).orderBy(key)


def longest_match(keys: DataFrame, patterns: DataFrame, key: str, pattern: str, lengths: Sequence[int]) -> DataFrame:
    """For each key the longest pattern that equals, begins or ends it; null without one.

    Instead of comparing all pairs, keys are cut at the known pattern lengths and joined by equality.
    """
    n = F.length(key)
    cuts = F.array(*(F.when(n >= length, F.substring(F.col(key), 1, length)) for length in lengths), *(F.when(n >= length, F.right(F.col(key), F.lit(length))) for length in lengths))
    tried = keys.select(key, F.explode(F.array_distinct(F.array_compact(cuts))).alias(pattern)).join(patterns.select(pattern).distinct(), pattern)
    best = tried.groupBy(key).agg(F.max_by(pattern, F.struct(F.length(pattern), pattern)).alias(pattern))
    return keys.join(best, key, "left")


def incomplete(dataset: DataFrame, cache: DataFrame, key: str = "eval_id") -> DataFrame:
    """One row: how many rows of the dataset have no cached result."""
    return dataset.join(cache.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("incomplete"))


def shard_counts(runs: DataFrame, exit_code: str = "exit_code", rank: str = "rank") -> DataFrame:
    """One row: shards in all, succeeded and failed, and the ranks of the failed ones in order. A shard without exit code failed."""
    bad = F.coalesce(F.col(exit_code) != 0, F.lit(True))
    return runs.agg(F.count("*").alias("shards"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.array_sort(F.collect_list(F.when(bad, F.col(rank)))).alias("failed_ranks"))


def duplicate_stats(rows: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """One row: how many keys repeat, the rows they hold, the greatest count, and the smallest `examples` such keys as text."""
    again = duplicate_keys(rows, key)
    few = again.orderBy("key").limit(examples).agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return one_row(again.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("n").alias("most")), few)


def series_of(models: DataFrame, registry: DataFrame, model: str = "model", strict: bool = False) -> DataFrame:
    """`models` with series, and what else `registry` (series, models array<string>, ...) tells of it. A path counts by its last part. A
    model in several series gets the first in the order of their names; an unknown one gets null, or raises when read if `strict`."""
    rest = [c for c in registry.columns if c != "models"]
    known = registry.select(F.explode("models").alias("__m"), F.struct(*rest).alias("__s")).groupBy("__m").agg(F.min_by("__s", F.col("__s.series")).alias("__s"))
    out = models.withColumn("__m", F.substring_index(model, "/", -1)).join(F.broadcast(known), "__m", "left")
    series = F.col("__s.series")
    if strict:
        series = F.when(series.isNull(), F.raise_error(F.concat(F.lit("no series for "), F.col(model)))).otherwise(series)
    return out.select(*models.columns, series.alias("series"), *(F.col(f"__s.{c}").alias(c) for c in rest if c != "series"))

"""A corpus pipeline over `documents`: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm._shared import Scratch, split_by
from gradeloom.llm.minhash_dedup import near_duplicates
from gradeloom.llm.mixing import mix_to_targets
from gradeloom.llm.packing import pack
from gradeloom.llm.quality_rules import apply_quality_rules
from gradeloom.llm.queries import LANGUAGE_TARGETS
from gradeloom.llm.toxicity import learn, score_toxicity


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns under names that no operator gives."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))


def _back(rows: DataFrame, docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of docs out of _apart()'s."""
    return rows.select(*(F.col(c if c in ("doc_id", "text") else f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)), *more)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule keeps. Each row is judged by itself, so repeated rows and rows without an id stay or go by their
    text; null and empty texts go; texts of any length are read whole. An empty table gives an empty one. Columns of the input
    keep their values whatever their names."""
    return _back(apply_quality_rules(_apart(docs)).where("kept"), docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5, by a grammar whose weights come from the labels of documents that are here.

    Each row is judged by itself, as above; null and empty texts stay, as no clause of theirs is toxic. Without labelled documents
    (an empty table too) the grammar's own weights judge."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _back(score_toxicity(_apart(docs), learn(docs.select("doc_id", "text"), labels)).where("toxicity < 0.5"), docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows without an id and texts without words stay. Rows with one id are one document: they stay or go together, and of those with
    equal texts one stays. An empty table gives an empty one. Only rows that go or have a repeated id are shuffled with their texts."""
    found = near_duplicates(docs).where("doc_id is not null")
    gone = found.where("not kept").select(F.col("doc_id").alias("id")).distinct()
    twice = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    named = _apart(docs)
    sure, doubt = split_by(named, gone.union(twice), "doc_id")
    doubt = doubt.join(gone, doubt["doc_id"] == gone["id"], "left_anti")
    if not twice.isEmpty():
        again = doubt.join(twice, doubt["doc_id"] == twice["id"], "left_semi").dropDuplicates(["doc_id", "text"])
        doubt = doubt.join(twice, doubt["doc_id"] == twice["id"], "left_anti").unionByName(again)
    return _back(sure.unionByName(doubt), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages' expected tokens meet their targets; no document goes.

    Each row gets copies of its own, repeated rows too; null and empty texts have no tokens and stay once. Rows whose lang is null or
    not a target teach nothing. An empty table gives an empty one."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    mixed, _ = mix_to_targets(_apart(docs), labelled, LANGUAGE_TARGETS, cover=True, least=1.0)
    copies = F.array_repeat(F.lit(0), F.col("mix_copies").cast("int"))
    return _back(mixed.withColumn("__copy", F.explode(copies)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2048. Each row is packed, repeated ones too; a null text is empty and gives
    its closing id alone. An empty table gives an empty one."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing to target weights", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

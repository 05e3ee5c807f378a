"""Audit rules as tables of issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Folders that only exist on one machine, and task types.
LOCAL_PATH = r"(?:/(?:home|mnt|data|root|Users)/[^\s\"']+)"
TASK_TYPES = ("vqa", "multiple_choice_vqa", "captioning", "multiple_choice_qa")


def issues(rows: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """(key, issue) for every check that holds; null counts as not."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in checks.items())))
    return rows.select(key, F.explode(found).alias("issue"))


def path_leaks(c: Column) -> Column:
    """Local paths inside a text."""
    return T.all_matches(F.coalesce(c, F.lit("")), f"({LOCAL_PATH})")


def unknown_values(values: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(values, F.array(*map(F.lit, allowed)))


def placeholder_issues(rows: DataFrame, key: str, text: Column, media: Column) -> DataFrame:
    n = F.size(T.placeholders(text))
    return issues(rows, key, {"placeholder mismatch": n != F.size(media), "placeholder without media": (n > 0) & (F.size(media) == 0)})


def id_collisions(rows: DataFrame, source: str = "source_id", id_col: str = "id") -> DataFrame:
    """Source ids whose rows repeat an id: n rows, n_ids different ones."""
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("n_ids")).where("n > n_ids")


def split_profile(rows: DataFrame, split: str, text: Column, media: Column) -> DataFrame:
    """By split: rows, placeholder mismatches and numbered image references."""
    n = F.size(T.placeholders(text))
    return rows.groupBy(split).agg(F.count("*").alias("n_rows"), F.count_if(n != F.size(media)).alias("mismatches"), F.sum(F.regexp_count(text, F.lit(r"<image\s*\d+>"))).alias("numbered_refs"))


def answered_by_assistant(messages: Column) -> Column:
    """Whether each user message is followed by an assistant's with a response."""
    after = F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1)))
    pairs = F.zip_with(messages, after, lambda m, n: (m["role"] != "user") | F.coalesce((n["role"] == "assistant") & n["response"].isNotNull(), F.lit(False)))
    return F.forall(pairs, lambda ok: ok)


def missing_files(media: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Referenced paths that are not listed or have no bytes; `listing` has path and length, as binaryFile gives."""
    return media.join(listing.select(F.col("path").alias("__p"), "length"), F.col(path) == F.col("__p"), "left").where("length is null or length = 0").drop("__p", "length")


def url_keys_outside(blocks: DataFrame, splits: Column, urls: Column) -> DataFrame:
    """Blocks whose url map names splits that they don't have."""
    return blocks.where(F.size(F.array_except(F.map_keys(urls), splits)) > 0)


# What a manifest may say.
ORIGINS = ("official", "source_column", "fallback")
STORAGE = ("files", "archives")
ARCHIVES = ("zip", "tar", "tar.gz")


def source_issues(blocks: DataFrame, key: str = "name") -> DataFrame:
    """Of manifest blocks (source_fields array<string>, url map<string,string>, splits): deprecated fields, and url maps that lack or name too much."""
    return issues(
        blocks, key,
        {
            "source.repo is deprecated": F.array_contains("source_fields", "repo"), "source.links is deprecated": F.array_contains("source_fields", "links"),
            "source.url is missing": F.col("url").isNull(), "source.url names unknown splits": (F.size("splits") > 0) & (F.size(F.array_except(F.map_keys("url"), F.col("splits"))) > 0),
        },
    )


def template_issues(blocks: DataFrame, key: str = "name") -> DataFrame:
    """Of manifest blocks: whether prompt_template_source (struct<origin, reference>) tells where the prompt comes from."""
    s = F.col("prompt_template_source")
    return issues(
        blocks, key,
        {
            "prompt_template_source is missing": s.isNull(), "unknown origin": s.isNotNull() & ~F.coalesce(s["origin"].isin(*ORIGINS), F.lit(False)),
            "no reference": s.isNotNull() & (T.strip(F.coalesce(s["reference"], F.lit(""))) == ""),
        },
    )


def video_storage_issues(blocks: DataFrame, key: str = "name") -> DataFrame:
    """Of manifest blocks (modalities, video_storage struct<format, media_root, archive_format, archive_files>): the rules for videos."""
    s, video = F.col("video_storage"), F.exists("modalities", lambda m: F.contains(m, F.lit("video")))
    there = video & s.isNotNull()
    archives = there & F.coalesce(s["format"] == "archives", F.lit(False))
    return issues(
        blocks, key,
        {
            "videos without video_storage": video & s.isNull(), "unknown format": there & ~F.coalesce(s["format"].isin(*STORAGE), F.lit(False)), "no media_root": there & (F.coalesce(s["media_root"], F.lit("")) == ""),
            "unknown archive_format": archives & ~F.coalesce(s["archive_format"].isin(*ARCHIVES), F.lit(False)), "no archive_files": archives & (F.coalesce(F.size("video_storage.archive_files"), F.lit(0)) <= 0),
        },
    )


def result_contract(rows: DataFrame, key: str = "eval_id", expected: int | None = None) -> DataFrame:
    """(key as text, issue): what a result set must satisfy before it is graded. `rows` has id, media, answer and messages
    (array<struct<role, question, prompt, response>>, response an array<string>); other columns are not read.

    One issue more, with a null key, if the set is empty or has another number of rows than expected, and one for each repeated id.
    """
    first, second = F.try_element_at("messages", F.lit(1)), F.try_element_at("messages", F.lit(2))
    some = F.size("messages") > 0
    prompt = F.coalesce(first["prompt"], F.lit(""))
    shown, media = T.placeholders(prompt), F.coalesce("media", F.array().cast("array<string>"))
    videos = F.filter(media, lambda m: T.is_video(m))
    count = lambda kind: F.size(F.filter(shown, lambda x: x == kind))
    asked = some & (T.strip(prompt) != "")
    found = issues(
        rows.withColumn("__key", F.col(key).cast("string")), "__key",
        {
            "id missing": T.strip(F.coalesce(F.col("id").cast("string"), F.lit(""))) == "", "no messages": ~some, "prompt empty": some & (T.strip(prompt) == ""), "placeholder mismatch": asked & (F.size(shown) != F.size(media)),
            "video path empty": asked & F.exists(media, lambda m: T.strip(F.coalesce(m, F.lit(""))) == ""), "video placeholder mismatch": asked & (F.size(videos) > 0) & (count("video") != F.size(videos)),
            "response empty": asked & (T.strip(T.flat_text(second["response"])) == ""), "second message is not the assistant's": asked & (F.size("messages") >= 2) & (second["role"] != "assistant"),
            "user without reply": some & ~answered_by_assistant(F.col("messages")), "no eval id": F.col(key).isNull(), "no answer": F.col("answer").isNull(),
            "placeholders left in the response": F.exists(second["response"], lambda r: F.size(T.placeholders(r)) > 0),
        },
    )
    again = rows.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("string").alias("__key")).count().where("count > 1").select("__key", F.concat(F.lit("id appears "), F.col("count").cast("string"), F.lit(" times")).alias("issue"))
    n = rows.agg(F.count("*").alias("n"))
    whole = issues(n.withColumn("__key", F.lit(None).cast("string")), "__key", {"no rows": F.col("n") == 0, f"not {expected} rows": F.lit(expected is not None) & (F.col("n") != F.lit(expected or 0))})
    return found.union(again).union(whole).withColumnRenamed("__key", key)


def gate(summary: DataFrame, llm_errors: bool = True) -> DataFrame:
    """A summary row with passed: no invalid rows and, if asked for, no failed model calls."""
    ok = F.col("invalid") == 0
    return summary.withColumn("passed", ok & (F.col("llm_errors") == 0) if llm_errors else ok)

"""Turning source rows into samples: mapping, messages, nested rows, ids, manifest aggregates, merging."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .store import one_row


def parse_mapping(pairs: Sequence[str], required: Sequence[str] = ("id", "question")) -> dict[str, str]:
    """canonical=source pairs as a dict; repeats, empty sides and missing required names are errors."""
    out: dict[str, str] = {}
    for pair in pairs:
        name, eq, source = (x.strip() for x in pair.partition("="))
        if not (name and eq and source) or name in out:
            raise ValueError(f"bad or repeated mapping {pair!r}")
        out[name] = source
    if missing := [r for r in required if r not in out]:
        raise ValueError(f"mapping lacks {missing}")
    return out


def merge_mappings(base: Mapping[str, str], override: Mapping[str, str]) -> dict[str, str]:
    return {**base, **override}


def project(rows: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Canonical names over source columns; an unknown source is an error before anything runs."""
    if unknown := sorted(set(mapping.values()) - set(rows.columns)):
        raise ValueError(f"no such columns: {unknown}")
    return rows.select(*(F.col(f"`{s}`").alias(c) for c, s in mapping.items()))


def options_of(columns: Mapping[str, Column]) -> Column:
    """struct<letter, text> of wide columns, blanks dropped."""
    pairs = F.array(*(F.struct(F.lit(k).alias("letter"), c.cast("string").alias("text")) for k, c in columns.items()))
    return F.filter(pairs, lambda o: o["text"].isNotNull() & (T.strip(o["text"]) != ""))


def options_of_list(choices: Column) -> Column:
    """struct<letter, text> by position."""
    return F.zip_with(F.slice(T.letters(), 1, F.size(choices)), F.slice(choices, 1, 26), lambda k, c: F.struct(k.alias("letter"), c.alias("text")))


def mapping_of_manifest(mapping: Mapping) -> dict[str, str]:
    """canonical=source pairs of a manifest's mapping block: each field that names a column in `from`, those of `extra` too."""
    found = {k: v["from"] for k, v in mapping.items() if k not in ("source", "extra") and isinstance(v, Mapping) and isinstance(v.get("from"), str)}
    return found | {k: v["from"] for k, v in (mapping.get("extra") or {}).items() if isinstance(v, Mapping) and isinstance(v.get("from"), str)}


def filter_source(rows: DataFrame, predicate: str | None) -> DataFrame:
    """Source rows for which a SQL predicate holds, before anything is exploded or counted; null does not hold."""
    return rows if not predicate else rows.where(F.expr(predicate))


def limit_source(rows: DataFrame, n: int | None, position: str = "position") -> DataFrame:
    """The first n source rows by position; all for None."""
    return rows if n is None else rows.where(F.col(position) < n)


def inject_meta(rows: DataFrame, meta: Mapping, column: str = "dataset_meta") -> DataFrame:
    """A constant block, as JSON with sorted keys, where a row has none."""
    block = F.lit(json.dumps(meta, sort_keys=True))
    return rows.withColumn(column, F.coalesce(F.col(column), block) if column in rows.columns else block)


def scrub_media(rows: DataFrame, messages: str = "messages", media: str = "media") -> DataFrame:
    """Rows fit to be saved: no message holds media, and the sample's own binary media are named "Image Object"; paths stay."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    if messages in kinds and "media" in kinds[messages].elementType.fieldNames():
        rows = rows.withColumn(messages, F.transform(messages, lambda m: m.dropFields("media")))
    if media in kinds and kinds[media].elementType.simpleString() != "string":
        rows = rows.withColumn(media, F.transform(media, lambda m: F.when(m.isNotNull(), F.lit("Image Object"))))
    return rows


def message(question: Column, answer: Column, options: Column | None = None, choices: Column | None = None, hint: Column | None = None, answer_join: str | None = ", ", extra: Mapping[str, Column] | None = None) -> Column:
    """A user message; what is missing becomes empty. A list answer is joined unless answer_join is None. `extra` fields are passed
    through as a map of texts without nulls."""
    none = F.array().cast("array<string>")
    joined = answer if answer_join is None else F.array(F.array_join(answer, answer_join))
    return F.struct(
        F.lit("user").alias("role"), F.coalesce(question, F.lit("")).alias("question"), F.coalesce(joined, none).alias("answer"),
        F.coalesce(options if options is not None else F.lit(None), F.array().cast("array<struct<letter:string,text:string>>")).alias("options"),
        F.coalesce(choices if choices is not None else F.lit(None), none).alias("choices"), F.coalesce(hint if hint is not None else F.lit(None), F.lit("")).alias("hint"),
        F.map_filter(F.create_map(*(x for k, c in (extra or {}).items() for x in (F.lit(k), c.cast("string")))).cast("map<string,string>"), lambda _, v: v.isNotNull()).alias("extra"),
    )


def require_ids(rows: DataFrame, id_col: str = "id", auto_id: str | None = None, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with a reason). Null ids are made from `auto_id`, a format of the position, or rejected; / becomes _."""
    made = F.format_string(auto_id, F.col(position)) if auto_id else F.lit(None).cast("string")
    named = rows.withColumn(id_col, T.sanitize_id(F.coalesce(F.col(id_col).cast("string"), made)))
    return named.where(F.col(id_col).isNotNull()), named.where(F.col(id_col).isNull()).withColumn("reason", F.lit(f"missing_required:{id_col}"))


def explode_rows(rows: DataFrame, nested: str, id_col: str = "id", template: str | None = None) -> DataFrame:
    """One row for each element; a struct's fields overwrite outer columns, a scalar becomes _explode_value. Empty lists drop the row.

    Adds _explode_idx, _outer_id and _unique_id (`template` formats outer id and index).
    """
    kind = rows.schema[nested].dataType.elementType
    out = rows.select("*", F.posexplode(nested).alias("_explode_idx", "__e"), F.col(id_col).cast("string").alias("_outer_id")).drop(nested)
    if hasattr(kind, "fieldNames"):
        inner = kind.fieldNames()
        out = out.select(*(c for c in out.columns if c not in inner and c != "__e"), *(F.col(f"__e.{c}").alias(c) for c in inner))
    else:
        out = out.withColumnRenamed("__e", "_explode_value")
    return out.withColumn("_unique_id", F.format_string(template or "%s_%d", "_outer_id", "_explode_idx"))


def unique_ids(rows: DataFrame, order: Sequence[str], id_col: str = "id", always: bool = False, base: int = 1) -> DataFrame:
    """Repeated ids become {id}_q{k} in `order`, the old id going to source_id; with `always` every row is numbered."""
    w = Window.partitionBy(id_col, F.when(F.col(id_col).isNull(), F.xxhash64(*order)))  # null ids are no repeats and don't meet
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1 + base
    return rows.select("*", n.alias("__n"), k.alias("__k")).withColumn("source_id", F.col(id_col)).withColumn(
        id_col, F.when(F.lit(always) | (F.col("__n") > 1), F.concat_ws("_q", F.col(id_col).cast("string"), F.col("__k"))).otherwise(F.col(id_col).cast("string"))
    ).drop("__n", "__k")


def skip_reasons(rejected: DataFrame) -> DataFrame:
    """Counts by reason, those with details by their category."""
    category = F.when(F.col("reason").rlike("^(encode_failed|unknown_video_ext)(:|$)"), F.substring_index("reason", ":", 1)).otherwise(F.col("reason"))
    return rejected.groupBy(category.alias("reason")).agg(F.count("*").alias("n"))


def conversion_summary(kept: DataFrame, rejected: DataFrame, position: str = "position", examples: int = 50) -> DataFrame:
    """One row: rows kept, rows skipped, counts by reason as a map, and the first `examples` skipped (position, id, reason)."""
    reasons = skip_reasons(rejected).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skip_reason_counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("skipped"))
    few = rejected.select(F.col(position).alias("position"), F.col("id").cast("string").alias("id"), "reason").orderBy("position").limit(examples)
    few = few.agg(F.array_sort(F.collect_list(F.struct("position", "id", "reason"))).alias("skipped_samples"))
    return one_row(kept.agg(F.count("*").alias("rows")), reasons, few).select("rows", "skipped", "skip_reason_counts", "skipped_samples")


def media_range(kept: DataFrame, media: str = "media", by: Sequence[str] = ()) -> DataFrame:
    """Rows, and the least and the greatest number of media of one, in all or by columns."""
    n = F.size(media).cast("long")
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.min(n).alias("media_min"), F.max(n).alias("media_max"))


# Modalities in their canonical order.
MODALITIES = ("text", "single_image_start", "multi_image_start", "multi_image_interleave", "single_video_start", "multi_video_start", "multi_video_interleave", "multi_image_video_interleave")


def modality_profile(kind_counts: Mapping[str, Column], interleaved: Column) -> Column:
    """A row's modality by its numbers of images and videos and whether media stand inside the text."""
    images, videos = kind_counts["image"], kind_counts["video"]
    return (
        F.when((images == 0) & (videos == 0), "text").when((images > 0) & (videos > 0), "multi_image_video_interleave").when(images == 1, "single_image_start").when(videos == 1, "single_video_start")
        .when(images > 1, F.when(interleaved, "multi_image_interleave").otherwise("multi_image_start")).otherwise(F.when(interleaved, "multi_video_interleave").otherwise("multi_video_start"))
    )


def dataset_modalities(rows: DataFrame, images: Column, videos: Column) -> DataFrame:
    """One row: the modalities of a whole set, in canonical order, by what its rows hold together: one for the media of the set (both
    kinds, in a row or in different ones; else videos; else several images in a row; else images) and text for rows without any."""
    n = rows.select(images.alias("i"), videos.alias("v"))
    some = n.agg(*(F.coalesce(F.bool_or(F.expr(c)), F.lit(False)).alias(k) for k, c in (("text", "i + v = 0"), ("multi", "i >= 2 and v = 0"), ("video", "v > 0"), ("image", "i > 0"))))
    media = F.when(F.col("video") & F.col("image"), "multi_image_video_interleave").when(F.col("video"), "single_video_start").when(F.col("multi"), "multi_image_start").when(F.col("image"), "single_image_start")
    text = F.when(F.col("text") | media.isNull(), "text")
    known = F.array(*map(F.lit, MODALITIES))
    return some.select(F.filter(known, lambda m: F.array_contains(F.array_compact(F.array(media, text)), m)).alias("modalities"))


def ordered_modalities(rows: DataFrame, column: str = "modality") -> DataFrame:
    """One row: the distinct modalities in canonical order, unknown ones last."""
    known = F.array(*map(F.lit, MODALITIES))
    place = lambda m: F.when(F.array_contains(known, m), F.array_position(known, m)).otherwise(len(MODALITIES) + 1)
    ranked = F.array_sort(F.transform(F.collect_set(column), lambda m: F.struct(place(m).alias("p"), m.alias("m"))))
    return rows.agg(F.transform(ranked, lambda s: s["m"]).alias("modalities"))


def merge_splits(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union by name with a split column; schemas must be equal."""
    names = list(parts)
    for n in names[1:]:
        if parts[n].schema != parts[names[0]].schema:
            raise ValueError(f"split {n} has another schema than {names[0]}")
    out = None
    for n in names:
        part = parts[n].withColumn("split", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def merge_subsets(parts: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """merge_splits with {subset}_{split} names; equal names are an error."""
    named = {}
    for (subset, split), df in parts.items():
        if f"{subset}_{split}" in named:
            raise ValueError(f"{subset}_{split} occurs twice")
        named[f"{subset}_{split}"] = df
    return merge_splits(named)


def merged_ranges(blocks: DataFrame) -> DataFrame:
    """Least minimum, greatest maximum and latest date of manifest blocks."""
    return blocks.agg(F.min("media_min").alias("media_min"), F.max("media_max").alias("media_max"), F.max("release_date").alias("release_date"))


def same_blocks(a: Mapping, b: Mapping, ignore: Sequence[str] = ("splits", "media", "release_date")) -> bool:
    """Whether two manifest blocks agree but for fields that merging combines."""
    return {k: v for k, v in a.items() if k not in ignore} == {k: v for k, v in b.items() if k not in ignore}


def regroup(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str, name: str = "questions") -> DataFrame:
    """Rows back into one record for each key, with an ordered list of structs."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *fields)))
    return rows.groupBy(*keys).agg(F.transform(packed, lambda s: F.struct(*(s[f].alias(f) for f in fields))).alias(name))


def build_manifest(name: str, release_date: str, subset: str, block: Mapping, seed: Mapping | None = None) -> dict:
    """A manifest with one subset's block written in. `block` has modalities, media_min, media_max, source (format, url by split) and
    mapping, and may have language, task_type, prompt_template, prompt_template_source and extra.

    A seed keeps what the block does not name: its other subsets, its languages, task type and template, its url entries; the later
    release date stays. Deprecated source fields (links, repo, path) go, links into url. A seed without the subset is an error.
    """
    root = json.loads(json.dumps(seed)) if seed else {"name": name, "subsets": {}}
    root.setdefault("name", name)
    root["release_date"] = max(str(root.get("release_date") or ""), release_date)
    old = dict(root.setdefault("subsets", {}).get(subset) or {})
    if seed and not old:
        raise ValueError(f"the seed has no subset {subset!r}")
    mapping = dict(old.get("mapping_from_source") or block.get("mapping") or {})
    source = dict(mapping.get("source") or {})
    url = dict(source["url"]) if isinstance(source.get("url"), Mapping) else {}
    url = dict(source.get("links") or {}) | url | dict(block.get("source", {}).get("url") or {})
    mapping["source"] = {k: v for k, v in source.items() if k not in ("links", "repo", "path")} | {"format": block.get("source", {}).get("format") or source.get("format"), "url": url}
    mapping["media"] = dict(mapping.get("media") or {}) | {"min_items": block["media_min"], "max_items": block["media_max"]}
    if block.get("extra"):
        mapping["extra"] = dict(mapping.get("extra") or {}) | {k: {"from": v} for k, v in block["extra"].items()}
    new = {"modalities": list(block["modalities"]), "mapping_from_source": mapping}
    for key, default in (("language", ["en"]), ("task_type", "vqa"), ("prompt_template", ""), ("prompt_template_source", None)):
        new[key] = block[key] if block.get(key) is not None else old.get(key) or default
    root["subsets"][subset] = old | new
    return root

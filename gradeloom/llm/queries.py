"""Registered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


# Target shares of the four languages' tokens, and the names of the shards.
LANGUAGE_TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op2_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_to_targets

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    mixed, _ = mix_to_targets(docs.drop("lang"), docs.select("doc_id", F.col("lang").alias("domain")), LANGUAGE_TARGETS, carry=["doc_id"])
    posterior = [F.round(F.get("mix_posterior", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(LANGUAGE_TARGETS)]
    return mixed.select("doc_id", F.col("mix_tokens").alias("n_tokens"), *posterior, F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").alias("copies"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_lookup_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.col("license_score").alias("score"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_quality_rules

    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = apply_quality_rules(docs, figures=base).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    return judged.select("doc_id", *base, "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"))


def op9_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import score_quality, train
    from .toxicity import held_out

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, learn, score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"), "toxic_clauses")


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_soft_membership_mixing, op3_sum_of_squares_packing, op4_lookup_table_sharding, op5_nn_descent, op6_license_scan, op7_url_rules, op8_quality_rules, op9_nb_svm_quality, op10_toxicity_grammar)}

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
ALNUM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _sharding_sql() -> str:
    from .sharding import fill_table

    slots = [SHARDS.index(s) for s in fill_table(SHARDS, 65537)]
    slot = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 65537"
    return f"WITH t AS MATERIALIZED (SELECT {slots} AS s) SELECT doc_id, {slot} AS slot, 'shard-' || lpad(CAST(t.s[{slot} + 1] AS VARCHAR), 3, '0') AS shard FROM documents, t"


def _url_sql() -> str:
    from .url_filter import BAD_WORDS, PLACES

    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    places = sorted(((v, *n.partition("/")) for v, n in PLACES), key=lambda x: -len(x[1] + x[3]))
    rule = "CASE " + " ".join(f"WHEN {fit(h, s + p)} THEN '{h}{s}{p}'" for _, h, s, p in places) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fit(h, s + p)} THEN '{v}'" for v, h, s, p in places)
    bad = f"(^|[^a-z0-9])({'|'.join(BAD_WORDS)})([^a-z0-9]|$)"
    return f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, host, path, {rule} AS rule, {verdict} WHEN regexp_matches(lower(host || ' ' || path), '{bad}') THEN 'block' ELSE 'allow' END AS verdict FROM u"""


def _quality_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents), w AS (SELECT *, {WORDS} AS w FROM d),
    g AS (SELECT r, i, array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT r, w, unnest(range(len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
    t AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1), c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, unnest(range(8)) AS k FROM t) GROUP BY r),
    f AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS le FROM w),
    a AS (SELECT f.*, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM f LEFT JOIN c USING (r)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_symbols <= 25 * n_words AND word_chars >= 2 * n_words AND word_chars <= 30 * n_words
    AND 100 * n_dup_lines <= 50 * len(l) AND NOT (100 * up > 60 * le AND le >= 20) AS kept FROM b"""


def _license_sql() -> str:
    from .license_scan import PHRASES, TEMPLATES, template_words

    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', {sorted(set(template_words(t)))})" for label, t in TEMPLATES.items())
    return f"""WITH p(words, label) AS (VALUES {phrases}), t(label, words) AS (VALUES {templates}), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT r, doc_id, {ALNUM} AS w FROM d),
    h AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(words)] = words)) AS i FROM w, p), b AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list_distinct(list(label)) AS l FROM h GROUP BY r),
    x AS (SELECT r, list_distinct({ALNUM}) AS own FROM (SELECT r, unnest(string_split(text, chr(10))) AS text FROM d)), m AS (SELECT r, label, max(len(list_intersect(own, words)) / len(words)) AS share FROM x, t WHERE len(own) > 0 GROUP BY ALL),
    k AS (SELECT r, max(share) AS share, list(label) AS l FROM m WHERE share >= 0.9 GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(list_sort(b.l), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(k.l, [])))), ',') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(k.share, 0.0) END AS score FROM w LEFT JOIN b USING (r) LEFT JOIN k USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op4_lookup_table_sharding": _sharding_sql(),
    "op6_license_scan": _license_sql(),
    "op7_url_rules": _url_sql(),
    "op8_quality_rules": _quality_sql(),
}

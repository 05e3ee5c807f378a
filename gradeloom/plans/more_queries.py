"""More queries with their DuckDB SQL: stages that read texts as they are or ask a table, options, prompts, conversion, audits.

Inputs are made from table columns by the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import audit, convert, grading, prompts, resume, select
from .. import schema
from .protocol import resolve_protocol
from .queries import POSITIONS, _placed, pick, pick_sql, query, table

OPTION = "array<struct<letter:string,text:string>>"
DIGITS, WIDE = "0123456789", "０１２３４５６７８９"


def sheet(rows: DataFrame, gt, pred, *keep, is_list=False, question=None, options=None, choices=None, flat=None, prompt=None) -> DataFrame:
    """Scoring input of expressions: gt and pred are arrays of texts."""
    none = F.lit(None)
    text = lambda c: none.cast("string") if c is None else c
    return rows.select(
        *keep, gt.alias("gt"), (F.lit(is_list) if isinstance(is_list, bool) else is_list).alias("gt_is_list"), pred.alias("pred"), F.coalesce(text(question), F.lit("")).alias("question"),
        (none if options is None else options).cast(OPTION).alias("options"), (none if choices is None else choices).cast("array<string>").alias("choices"), (none if flat is None else flat).cast(OPTION).alias("flat_options"), text(prompt).alias("prompt"),
    )


def graded(rows: DataFrame, pipeline: str, *keep: str, more: dict | None = None, **knobs) -> DataFrame:
    return grading.grade(grading.with_context(rows), resolve_protocol({"score_pipeline": pipeline, **knobs}), **(more or {})).select(*keep, "qtype", "decided_by", "matched", "score", "is_correct", "status", "reason", "judge_prob")


# Stages over texts with characters that NFKC changes.


@query(f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS normal, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS DOUBLE) / 100 ELSE CAST(o_orderkey AS DOUBLE) END AS number FROM orders")
def unicode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width digits and per cent signs, brought to their plain forms."""
    wide = F.translate(F.col("o_orderkey").cast("string"), DIGITS, WIDE)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", wide.alias("t"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(wide, F.lit(" ％"))).otherwise(wide).alias("p"))
    rows = rows.select("o_orderkey", T.normalize_text(F.col("t")).alias("normal"), T.normalize_exact(F.col("p")).alias("p"))
    return rows.select("o_orderkey", "normal", T.parse_number_text(F.col("p")).alias("number"))


@query(f"SELECT s_suppkey, 'numeric' AS qtype, s_suppkey % 3 <> 2 AS ok FROM supplier")
def unicode_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in full-width digits against plain ground truths."""
    key = F.col("s_suppkey")
    pred = F.when(key % 3 == 2, (key + 1).cast("string")).otherwise(F.translate(key.cast("string"), DIGITS, WIDE))
    out = graded(sheet(table(spark, sf_dir, "supplier"), F.array(key.cast("string")), F.array(pred), "s_suppkey"), "exact-match", "s_suppkey")
    return out.select("s_suppkey", "qtype", (F.col("is_correct") == 1).alias("ok"))


@query("SELECT s_suppkey, round(CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1 - 2.0 / length('FISH ' || s_suppkey) ELSE 0 END, 6) AS score, 'ok' AS status FROM supplier")
def anls_stage_raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit-distance grader on texts with a ligature, which it must not undo."""
    key = F.col("s_suppkey").cast("string")
    pred = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("ﬁsh "), key)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("fish "), key)).otherwise("q")
    out = graded(sheet(table(spark, sf_dir, "supplier"), F.array(F.concat(F.lit("ﬁsh "), key)), F.array(pred), "s_suppkey"), "anls", "s_suppkey")
    return out.select("s_suppkey", F.round("score", 6).alias("score"), "status")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'invalid' ELSE 'ok' END AS status, round(CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 3 = 2 THEN 0 ELSE (6 * least(1, 5 / 3.0) + 4 * least(1, 6 / 3.0)) / 10 - CASE WHEN s_suppkey % 3 = 1 THEN 1 - (2 * (1 / 3.0) + 8 * (2 / 3.0)) / 10 ELSE 0 END END, 6) AS score FROM supplier")
def vqa_stage_raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus grader: six or two of ten annotators agree; one reference is no consensus."""
    key = F.col("s_suppkey")
    word = F.concat(F.lit("ﬁsh "), key.cast("string"))
    refs = F.when(key % 5 == 0, F.array(word)).otherwise(F.concat(F.array_repeat(word, F.when(key % 3 == 1, 2).otherwise(6)), F.array_repeat(F.lit("other"), F.when(key % 3 == 1, 8).otherwise(4))))
    pred = F.when(key % 3 == 2, "nothing").otherwise(F.concat(word, F.lit(",")))
    out = graded(sheet(table(spark, sf_dir, "supplier"), refs, F.array(pred), "s_suppkey", is_list=key % 5 != 0), "vqa-accuracy", "s_suppkey")
    return out.select("s_suppkey", "status", F.round("score", 6).alias("score"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"SELECT unnest({sql_list(N.CONTRACTIONS)}) AS word, unnest({sql_list(N.CONTRACTIONS.get(w.lower(), w.lower()) for w in N.CONTRACTIONS)}) AS normal, count(*) OVER () AS n FROM region WHERE r_regionkey = 0")
def vqa_contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the contraction table through the normaliser, by itself."""
    words = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, N.CONTRACTIONS))).alias("word"))
    return words.select("word", N.vqa_words(F.col("word")).alias("normal"), F.lit(1).cast("long").alias("n"))


# Stages that ask; here a table answers.


@query(
    """WITH s AS (SELECT event_id, event_id % 4 AS k, user_id FROM events),
    r AS (SELECT CASE WHEN k = 3 THEN NULL ELSE 'llm-judge' END AS decided_by, CASE WHEN k = 0 THEN 1 ELSE 0 END AS ok, CASE WHEN k IN (0, 1) THEN exp(-(user_id % 7) / 10.0) END AS p, k = 3 AS bad FROM s)
    SELECT count(*) AS total, count(*) AS valid, sum(ok) AS correct, round(avg(ok), 6) AS mean_score, 0 AS invalid, count(*) FILTER (WHERE bad) AS llm_errors, round(avg(p), 6) AS judge_prob_mean FROM r"""
)
def judge_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a judging stage from a table of replies, with token probabilities, rolled up."""
    k, p = F.col("event_id") % 4, -(F.col("user_id") % 7) / 10.0
    events = table(spark, sf_dir, "events")
    token = lambda t, q: F.struct(F.lit(t).alias("token"), q.cast("double").alias("logprob"))
    replies = events.select(
        "event_id", F.when(k == 0, '{"is_correct": 1, "reason": "so"}').when(k == 1, 'Well: {"is_correct": 0}').when(k == 2, '{"is_correct": "no"}').otherwise("no idea").alias("reply"),
        F.when(k == 0, F.array(token('{"', F.lit(-9.0)), token(' "1"', p))).when(k == 1, F.array(token("0", p), token("1", F.lit(0.0)))).when(k == 2, F.array(token("1", p))).alias("reply_tokens"),
    )
    rows = sheet(events, F.array(F.lit("a wide river")), F.array(F.lit("water")), "event_id")
    out = graded(rows, "exact-match,llm-judge", "event_id", more={"replies": {"llm-judge": replies}, "key": "event_id"})
    return grading.summarize(out).select("total", "valid", F.col("correct"), F.round("mean_score", 6).alias("mean_score"), F.col("invalid").cast("int").alias("invalid"), "llm_errors", F.round("judge_prob_mean", 6).alias("judge_prob_mean"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE CASE WHEN p_partkey % 5 IN (0, 2) THEN 'llm-match' END END AS decided_by, CASE p_partkey % 5 WHEN 0 THEN 'B' WHEN 2 THEN 'A, C' END AS matched,
    CASE p_partkey % 5 WHEN 4 THEN 'llm_error: empty_response' END AS reason FROM part"""
)
def option_named_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that has the picked options named: one letter out of a sentence, a wrong one, several, none of them, no reply."""
    k = F.col("p_partkey") % 5
    options = convert.options_of({"A": F.col("p_brand"), "B": F.lit("green field"), "C": F.lit("grey sky")})
    rows = sheet(table(spark, sf_dir, "part"), F.array(F.when(k == 2, "A, C").otherwise("B")), F.array(F.lit("what one sees from there")), "p_partkey", question=F.lit("Which? <image>"), options=options)
    reply = F.when(k == 0, "I would say that it is B.").when(k == 1, "C").when(k == 2, "C, A").when(k == 3, "Z")
    replies = table(spark, sf_dir, "part").select("p_partkey", reply.alias("reply"))
    return graded(rows, "exact-match,llm-match", "p_partkey", more={"replies": {"llm-match": replies}, "key": "p_partkey"}).select("p_partkey", "decided_by", "matched", "reason")


@query("SELECT s_suppkey, s_nationkey % 2 = 0 AND s_suppkey % 3 <> 0 AS passed FROM supplier")
def gate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 2).alias("invalid"), F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0).alias("llm_errors"))
    return audit.gate(rows).select("s_suppkey", "passed")


# Options and letters.


@query("SELECT p_partkey, array_to_string(list_slice(['A','B','C','D','E'], 1, p_size % 5), '') AS in_question, list_slice(['A','B','C'], 1, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 1 ELSE 3 END) AS flat, CASE WHEN p_size % 2 = 0 THEN 'CA' ELSE 'AB' END AS by_choice, p_name AS bare FROM part")
def option_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters inside a question, per-letter columns up to the first gap, letters of choices, a label taken off."""
    k = F.col("p_size")
    inside = F.array_join(F.transform(F.slice(T.letters(), 1, (k % 5).cast("int")), lambda x: F.concat(F.lit("("), x, F.lit(") some "))), "")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.concat(F.lit("Which one?\n"), inside, F.lit(" (G)")).alias("q"))
    blank = F.lit(" ")
    flat = T.flat_letter_options([("A", F.when(k % 3 != 0, F.col("p_name"))), ("B", F.when(k % 3 == 2, F.lit("x")).otherwise(blank)), ("C", F.lit("y"))])
    chosen = T.choices_to_letters(F.when(k % 2 == 0, F.array(F.lit("c"), F.lit(" A"))).otherwise(F.array(F.lit("red"), F.lit("b"))))
    return rows.select("p_partkey", F.array_join(T.question_letters(F.col("q")), "").alias("in_question"), F.transform(flat, lambda o: o["letter"]).alias("flat"), F.array_join(chosen, "").alias("by_choice"), T.strip_letter_prefix(F.concat(F.lit("B) "), "p_name"), F.lit("B")).alias("bare"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'ABCD' WHEN p_size % 4 = 1 THEN 'AB' WHEN p_size % 4 = 2 THEN 'ABC' ELSE 'ABCDEF' END AS candidates, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_brand WHEN p_size % 4 = 2 THEN p_type ELSE '' END AS second FROM part")
def option_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate letters and option texts from the question, option pairs, choices, or nowhere; widened by the ground truth."""
    k, none = F.col("p_size") % 4, F.lit(None)
    options = F.when(k == 1, convert.options_of({"A": F.lit("x"), "B": F.col("p_brand")})).cast(OPTION)
    choices = F.when(k == 2, F.array(F.lit("A. one"), F.concat(F.lit("B. "), "p_type"))).cast("array<string>")
    question = F.when(k == 0, F.lit("(A) a (B) b (C) c (D) d")).otherwise("Which?")
    parsed = T.parsed_options(options, choices, none.cast(OPTION), question, none.cast("string"))
    gt = F.when(k == 2, F.array(F.lit("C"))).otherwise(F.array().cast("array<string>"))
    texts = T.option_texts(options, choices, F.array().cast(OPTION))
    second = F.coalesce(F.try_element_at(texts, F.lit(2))["text"], F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.widen_options(T.candidate_options(parsed), gt), "").alias("candidates"), second.alias("second"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN NULL ELSE NULL END AS by_text, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE 'x{y}' END AS boxed, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS idx, 'ab' || p_partkey AS longest FROM part")
def answers_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option found by its text, what a box holds, a choice's index and the longest repeat."""
    k = F.col("p_partkey") % 3
    texts = convert.options_of({"A": F.lit("red fox"), "B": F.lit("green field"), "C": F.lit("a lake in the hills")})
    answer = F.when(k == 0, "a Green Field there").when(k == 1, "red fox or green field").otherwise(F.repeat(F.lit("green field and so on "), F.lit(9)))
    box = F.when(k == 0, F.concat(F.lit("so \\boxed{"), "p_name", F.lit("} it is"))).otherwise("\\boxed{x{y}} and \\boxed{z}")
    idx = T.choice_index(F.when(F.col("p_partkey") % 2 == 0, "Answer: (B)").otherwise("it is blue, I think"), F.array(F.lit("red."), F.lit("green."), F.lit("blue.")))
    return table(spark, sf_dir, "part").select("p_partkey", T.infer_text(answer, texts).alias("by_text"), T.boxed(box).alias("boxed"), idx.alias("idx"), T.longest_repeat(F.concat(F.lit("ab"), "p_partkey", F.lit("ab"), "p_partkey")).alias("longest"))


# Placeholders, media, small texts.


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN '<image> and <image> there' ELSE repeat('<image>', p_size % 3) || 'and  there' END AS question, CASE p_size % 4 WHEN 0 THEN 'a.png,b.png' WHEN 1 THEN 'x.png' ELSE '' END AS paths,
    CASE WHEN p_size % 2 = 0 THEN 'one |<image>| two |<video>' ELSE 'none' END AS chunks, p_size % 2 = 0 AS video, 'a<image>b' AS refs, 'p_' || p_size || '-x.y' AS slug, 'a_' || p_size || '_b' AS id, p_name || 'x' AS flat FROM part"""
)
def media_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders renamed or put in front, paths of lists, pieces of a prompt, endings, references, slugs, ids, nested texts."""
    k = F.col("p_size")
    q = T.question_with_media(F.lit("<image 1> and <image_2> there"), k % 3)
    url = F.when(k % 4 == 0, "['a.png', 'b.png']").when(k % 4 == 1, "x.png")
    chunks = T.split_chunks(F.when(k % 2 == 0, "one <image> two <video>").otherwise("none"))
    path = F.when(k % 2 == 0, "http://h/a.MP4?x=1.png").otherwise("a.png?b.mp4")
    nested = F.array(F.array("p_name", F.lit(None).cast("string")), F.lit(None).cast("array<string>"), F.array(F.lit("x")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", q.alias("question"), F.array_join(T.media_paths(url, F.lit(None).cast("string")), ",").alias("paths"), F.array_join(chunks, "|").alias("chunks"), T.is_video(path).alias("video"),
        T.normalize_image_refs(F.lit("a<image 12>b")).alias("refs"), T.slug(F.concat(F.lit("  p /"), k, F.lit("-x.y!"))).alias("slug"), T.sanitize_id(F.concat(F.lit("a/"), k, F.lit("/b"))).alias("id"), T.flat_text(nested, 2).alias("flat"),
    )


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'i1,i2' WHEN 1 THEN 'i2' WHEN 2 THEN 'i2,i1,i1' END AS images FROM part")
def images_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered references in a question and its options, looked up among image columns."""
    k = F.col("p_size") % 4
    texts = F.array(F.when(k == 0, "no reference").when(k == 1, "see <image 2>").when(k == 2, "<image 2> or <image 1>?").otherwise("<image 7>"), F.when(k == 2, "<image 1>"))
    images = F.array(F.lit("i1"), F.lit("i2"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(prompts.images_by_reference(texts, images), ",").alias("images"))


# Prompts.


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Hint: ' || p_type || chr(10) ELSE '' END || 'Question: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Options:' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. x' || chr(10) || 'Please select the correct answer from the options above.' ELSE '' END AS mcq,
    p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '(A) ' || p_brand || chr(10) || '(B) x' || chr(10) || chr(10) || 'Answer with the option''s letter from the given choices directly.' ELSE chr(10) || chr(10) || 'Answer the question using a single word or phrase.' END AS several,
    CASE WHEN p_size % 5 = 0 THEN 'made' ELSE 'set: ' || p_name END AS chosen, CASE WHEN p_size % 5 = 0 THEN 'think first. made' ELSE 'think first. ' || p_name END AS prefixed,
    p_name || CASE WHEN p_size % 2 = 0 THEN ' of A) ' || p_brand || '; B) x; ' ELSE '' END || '!' AS own FROM part"""
)
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in templates, the order of precedence, a prefix that is put once, a user's own template."""
    options = F.when(F.col("p_size") % 2 == 0, convert.options_of({"A": F.col("p_brand"), "B": F.lit("x")}))
    hint, made = F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.when(F.col("p_size") % 5 == 0, "made").otherwise("")
    base = F.when(F.col("p_size") % 5 == 0, "think first. made").otherwise(F.col("p_name"))
    source = "{{ q }}{% if options %} of {% for k, v in options.items() %}{{ k }}) {{ v }}; {% endfor %}{% endif %}!"
    return table(spark, sf_dir, "part").select(
        "p_partkey", prompts.mcq_prompt(F.col("p_name"), options, hint).alias("mcq"), prompts.indexed_prompt(F.col("p_name"), options).alias("several"),
        prompts.choose_prompt(None, made, F.concat(F.lit("set: "), "p_name"), F.lit("default")).alias("chosen"), prompts.with_prefix(base, "think first. ").alias("prefixed"),
        prompts.template_prompt(source, {"q": F.col("p_name"), "options": options}, ("options",)).alias("own"),
    )


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '/d/m' || turn || '.png' ELSE 'http://h/m.png' END AS path, CASE WHEN turn % 3 = 0 THEN '' ELSE array_to_string(list_transform(range(turn % 3), lambda i: 'm' || i), ',') END AS slice FROM conversations")
def media_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a folder, and the media that a message's placeholders stand for; each message a sample of its own here."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("key"), F.expr("repeat('<image> ', cast(turn % 3 as int))").alias("t"), F.array(F.lit("m0"), F.lit("m1")).alias("media"))
    out = prompts.message_media(rows, "key", "turn", "t", "media")
    path = prompts.media_paths(F.array(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("m"), "turn", F.lit(".png"))).otherwise("http://h/m.png")), "/d/")
    return out.select("conv_id", "turn", F.element_at(path, 1).alias("path"), F.array_join("media_slice", ",").alias("slice"))


# Conversion.


@query(f"SELECT o_orderkey, position FROM {POSITIONS} WHERE o_custkey % 3 = 0 AND position < 700")
def source_filter_and_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows below a limit for which a predicate holds."""
    return convert.filter_source(convert.limit_source(_placed(spark, sf_dir), 700), "o_custkey % 3 = 0").select("o_orderkey", "position")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'own' ELSE '{"split": "test"}' END AS dataset_meta, CASE WHEN p_size % 3 = 0 THEN 'row_' || p_partkey ELSE replace(p_brand, '#', '_') END AS id, p_size % 4 <> 0 AS brand_there, CASE WHEN p_size % 4 <> 0 THEN 2 ELSE 1 END AS extras FROM part""")
def sample_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant metadata, made ids, and a message's pass-through fields without nulls."""
    rows = table(spark, sf_dir, "part").withColumn("position", F.col("p_partkey")).withColumn("dataset_meta", F.when(F.col("p_size") % 2 == 0, "own"))
    rows = convert.inject_meta(rows, {"split": "test"}).withColumn("id", F.when(F.col("p_size") % 3 != 0, F.replace("p_brand", F.lit("#"), F.lit("/"))))
    kept, _ = convert.require_ids(rows, auto_id="row_%d")
    extra = convert.message(F.col("p_name"), F.array("p_type"), extra={"brand": F.when(F.col("p_size") % 4 != 0, F.col("p_brand")), "size": F.col("p_size")})["extra"]
    return kept.select("p_partkey", "dataset_meta", "id", F.map_contains_key(extra, "brand").alias("brand_there"), F.size(extra).alias("extras"))


@query("""SELECT count(*) FILTER (WHERE p_size % 7 <> 0) AS rows, count(*) FILTER (WHERE p_size % 7 = 0) AS skipped, count(*) FILTER (WHERE p_size % 7 = 0 AND p_partkey % 2 = 0) AS failed, CAST(least(50, count(*) FILTER (WHERE p_size % 7 = 0)) AS INT) AS examples, min(p_partkey) FILTER (WHERE p_size % 7 = 0) AS first FROM part""")
def conversion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and skipped rows, counts by reason and the first examples."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.col("p_name").alias("id"), "p_size", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("encode_failed:"), "p_name")).otherwise("missing_required:id").alias("reason"))
    out = convert.conversion_summary(rows.where("p_size % 7 <> 0"), rows.where("p_size % 7 = 0"))
    return out.select("rows", "skipped", F.coalesce(F.col("skip_reason_counts")["encode_failed"], F.lit(0)).alias("failed"), F.size("skipped_samples").alias("examples"), F.col("skipped_samples")[0]["position"].alias("first"))


@query("SELECT [x FOR x IN ['text', 'single_image_start', 'multi_image_start', 'single_video_start', 'multi_image_video_interleave'] IF x = m OR x = t] AS modalities FROM (SELECT CASE WHEN bool_or(p_size % 9 = 8) AND bool_or(p_size % 3 > 0) THEN 'multi_image_video_interleave' WHEN bool_or(p_size % 9 = 8) THEN 'single_video_start' WHEN bool_or(p_size % 3 = 2) THEN 'multi_image_start' ELSE 'single_image_start' END AS m, CASE WHEN bool_or(p_size % 3 = 0 AND p_size % 9 <> 8) THEN 'text' END AS t FROM part)")
def modalities_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.dataset_modalities(table(spark, sf_dir, "part"), F.col("p_size") % 3, (F.col("p_size") % 9 == 8).cast("int"))


@query("SELECT min(p_size) AS media_min, max(p_size) AS media_max, CAST(max(p_partkey) AS VARCHAR) AS release_date FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part) OR p_size IN (SELECT min(p_size) FROM part UNION ALL SELECT max(p_size) FROM part)")
def ranges_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("media_min"), F.col("p_size").alias("media_max"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("release_date"))
    return convert.merged_ranges(rows).withColumn("release_date", F.ltrim("release_date", F.lit("0")))


# Resume and registries.


@query("SELECT count(*) AS incomplete FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def incomplete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").withColumnRenamed("l_orderkey", "o_orderkey")
    return resume.incomplete(table(spark, sf_dir, "orders"), cache, "o_orderkey")


@query("SELECT count(*) AS shards, count(*) FILTER (WHERE s_suppkey % 4 = 1) AS succeeded, count(*) FILTER (WHERE s_suppkey % 4 <> 1) AS failed, list(s_suppkey ORDER BY s_suppkey) FILTER (WHERE s_suppkey % 4 <> 1) AS failed_ranks FROM supplier WHERE s_suppkey <= 64")
def shards_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 4 - 1)
    return resume.shard_counts(table(spark, sf_dir, "supplier").where("s_suppkey <= 64").select(F.col("s_suppkey").alias("rank"), code.alias("exit_code")))


@query("WITH d AS (SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows, max(n) AS most, list_slice(list(key ORDER BY key), 1, 5) AS examples FROM d")
def duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.duplicate_stats(table(spark, sf_dir, "orders"), "o_custkey")


SERIES = {"alpha": ["BUILDING", "MACHINERY"], "beta": ["MACHINERY", "HOUSEHOLD"]}


@query("SELECT c_custkey, 'org/' || c_mktsegment AS model, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'alpha' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'beta' END AS series, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'alpha.py' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'beta.py' END AS runner FROM customer")
def series_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's series and runner out of a registry; a name in two series counts for the first."""
    registry = spark.createDataFrame([(k, v, f"{k}.py") for k, v in SERIES.items()], "series string, models array<string>, runner string")
    return resume.series_of(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("org/"), "c_mktsegment").alias("model")), registry)


@query("SELECT s_suppkey, round(ln(0.5) * (s_suppkey % 3 + 1) / (s_suppkey % 3 + 1), 6) AS pooled, round(-1.0, 6) AS in_bits, round(1 / 2.0, 6) AS share FROM supplier")
def pooled_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of token log-probabilities, in bits too, and shares of choices."""
    logs = F.array_repeat(F.log(F.lit(0.5)), (F.col("s_suppkey") % 3 + 1).cast("int"))
    share = N.choice_probabilities(F.array(F.lit(0.25), F.lit(0.25)))[0]
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(N.pooled_logprob(logs), 6).alias("pooled"), F.round(N.pooled_logprob(logs, True), 6).alias("in_bits"), F.round(share, 6).alias("share"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r <= 0")
def selection_of_nothing_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is left to do once everything is done."""
    events = table(spark, sf_dir, "events").select("event_id")
    return select.without_done(events, events, "event_id")


# Layout and audits.


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 3 = 1 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS key, CASE WHEN p_size % 2 = 0 THEN 'top' ELSE 'inner' END AS answer, p_size % 2 <> 0 AS misplaced FROM part")
def sample_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result keys, an answer hoisted out of the first message, and rows where it is misplaced."""
    k = F.col("p_size")
    message = F.struct(F.lit("user").alias("role"), F.array(F.lit("inner")).alias("answer"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, k.cast("long")).alias("eval_id"), F.when(k % 3 == 1, F.col("p_name")).alias("id"), F.col("p_partkey").alias("position"), F.when(k % 2 == 0, F.array(F.lit("top"))).alias("answer"), F.array(message).alias("messages"))
    wrong = schema.layout_errors(rows).select(F.col("p_partkey").alias("w"))
    out = schema.hoist(rows).join(wrong, F.col("p_partkey") == F.col("w"), "left")
    return out.select("p_partkey", schema.eval_key().alias("key"), F.element_at("answer", 1).alias("answer"), F.col("w").isNotNull().alias("misplaced"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS leaks, CASE WHEN p_size % 3 = 0 THEN 'odd' ELSE '' END AS unknown FROM part")
def leaks_and_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("see /home/me/"), "p_partkey", F.lit("/x.png now"))).otherwise("see home/me")
    values = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("text"), F.lit("odd"))).otherwise(F.array(F.lit("text")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(audit.path_leaks(text)).alias("leaks"), F.array_join(audit.unknown_values(values, convert.MODALITIES), ",").alias("unknown"))


@query(
    """WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS name, 'prompt_template_source is missing' AS issue FROM s WHERE k % 4 = 0 UNION ALL SELECT k, 'unknown origin' FROM s WHERE k % 4 = 1 UNION ALL SELECT k, 'no reference' FROM s WHERE k % 4 IN (1, 2)
    UNION ALL SELECT k, 'source.repo is deprecated' FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'source.url is missing' FROM s WHERE k % 5 = 0 UNION ALL SELECT k, 'source.url names unknown splits' FROM s WHERE k % 5 = 1
    UNION ALL SELECT k, 'videos without video_storage' FROM s WHERE k % 2 = 1 AND k % 3 = 0 UNION ALL SELECT k, 'no media_root' FROM s WHERE k % 2 = 1 AND k % 3 = 1 UNION ALL SELECT k, 'unknown archive_format' FROM s WHERE k % 2 = 1 AND k % 3 = 1
    UNION ALL SELECT k, 'no archive_files' FROM s WHERE k % 2 = 1 AND k % 3 = 1 UNION ALL SELECT k, 'unknown format' FROM s WHERE k % 2 = 1 AND k % 3 = 2"""
)
def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of templates, sources and storage of videos, as tables of issues."""
    k, none = F.col("name"), F.lit(None)
    origin = F.struct(F.when(k % 4 == 1, "somewhere").otherwise("official").alias("origin"), F.when(k % 4 == 3, "paper").otherwise(" ").alias("reference"))
    storage = F.struct(F.when(k % 3 == 1, "archives").otherwise("disk").alias("format"), F.when(k % 3 == 2, "m").alias("media_root"), F.lit("rar").alias("archive_format"), none.cast("array<string>").alias("archive_files"))
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("name")).select(
        "name", F.when(k % 4 != 0, origin).alias("prompt_template_source"), F.when(k % 3 == 0, F.array(F.lit("repo"))).otherwise(F.array().cast("array<string>")).alias("source_fields"), F.array(F.lit("test")).alias("splits"),
        F.when(k % 5 == 1, F.create_map(F.lit("train"), F.lit("u"))).when(k % 5 != 0, F.create_map(F.lit("test"), F.lit("u"))).alias("url"), F.array(F.when(k % 2 == 1, "single_video_start").otherwise("text")).alias("modalities"), F.when(k % 3 != 0, storage).alias("video_storage"),
    )
    return audit.template_issues(rows).union(audit.source_issues(rows)).union(audit.video_storage_issues(rows))


@query(
    """WITH s AS (SELECT p_partkey AS k FROM part) SELECT CAST(k AS VARCHAR) AS eval_id, 'placeholder mismatch' AS issue FROM s WHERE k % 6 = 1 UNION ALL SELECT CAST(k AS VARCHAR), 'response empty' FROM s WHERE k % 6 = 2 UNION ALL SELECT CAST(k AS VARCHAR), 'prompt empty' FROM s WHERE k % 6 = 3
    UNION ALL SELECT CAST(k AS VARCHAR), 'video placeholder mismatch' FROM s WHERE k % 6 = 4 UNION ALL SELECT CAST(k AS VARCHAR), 'no answer' FROM s WHERE k % 6 = 5 UNION ALL SELECT NULL, 'not 7 rows' UNION ALL SELECT 'same', 'id appears ' || count(*) || ' times' FROM s WHERE k % 50 = 0 HAVING count(*) > 1"""
)
def result_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What result rows violate, each issue one row, with those of the whole set."""
    k = F.col("eval_id")
    prompt = F.when(k % 6 == 3, " ").when(k % 6 == 1, "<image> <image>").otherwise("<image> what?")
    user = F.struct(F.lit("user").alias("role"), F.lit("q").alias("question"), prompt.alias("prompt"), F.lit(None).cast("array<string>").alias("response"))
    reply = F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("prompt"), F.when(k % 6 == 2, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit("fine"))).alias("response"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("eval_id")).select("eval_id", F.when(k % 50 == 0, "same").otherwise(k.cast("string")).alias("id"), F.array(F.when(k % 6 == 4, "v.mp4").otherwise("i.png")).alias("media"), F.when(k % 6 != 5, F.array(F.lit("x"))).alias("answer"), F.array(user, reply).alias("messages"))
    return audit.result_contract(rows, expected=7)


@query("SELECT p_partkey, 'f' || p_partkey AS path FROM part WHERE p_partkey % 10 = 0 OR p_size = 1")
def files_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referenced paths that are not listed or are empty."""
    rows = table(spark, sf_dir, "part")
    listing = rows.where("p_partkey % 10 <> 0").select(F.concat(F.lit("f"), "p_partkey").alias("path"), (F.col("p_size") - 1).cast("long").alias("length"))
    return audit.missing_files(rows.select("p_partkey", F.concat(F.lit("f"), "p_partkey").alias("path")), listing)

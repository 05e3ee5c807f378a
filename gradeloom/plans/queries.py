"""Queries over the driver's tables that exercise the operators, each with the same result in DuckDB SQL.

Answer sheets are derived from table columns by the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import audit, convert, grading, prompts, resume, select
from ..operators.store import spread
from .protocol import resolve_protocol

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key, *values):
    """The key-th of literal texts, counted from 0, modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def pick_sql(key: str, *values: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST({key} % {len(values)} AS INT) + 1]"


SHARE = "count(*) AS total, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy"


def share(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("ok").alias("correct"), F.round(F.count_if("ok") / F.count("*"), 6).alias("accuracy"))


# Numbers, yes or no, letters, text.


def numbers(rows: DataFrame) -> DataFrame:
    """Adds p and g, the numbers of pred and gt, each normal form being a column of its own."""
    rows = spread(rows)
    for make, before, after in ((lambda c: T.normalize_exact(c, False), ("pred", "gt"), ("__p", "__g")), (T.open_of_plain, ("__p", "__g"), ("__p", "__g")), (T.parse_number_text, ("__p", "__g"), ("p", "g"))):
        rows = rows.withColumns({new: make(F.col(old)) for old, new in zip(before, after, strict=True)})
    return rows.drop("__p", "__g")


@query(
    f"""WITH s AS (SELECT l_returnflag, l_quantity AS g, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity ELSE l_quantity + 1 END AS p FROM lineitem)
    SELECT l_returnflag, {SHARE} FROM (SELECT l_returnflag, p = g AS ok FROM s) GROUP BY ALL"""
)
def score_numeric_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-answer numbers, equal as numbers."""
    q = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", q.cast("string").alias("gt"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(".0"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("'"), q, F.lit("'"))).otherwise((q + 1).cast("string")).alias("pred"))
    return share(numbers(rows).withColumn("ok", N.numbers_match(F.col("p"), F.col("g"))), "l_returnflag")


@query(
    f"""WITH s AS (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS c, 90 + o_orderkey % 21 AS k FROM orders)
    SELECT o_orderpriority, {SHARE} FROM (SELECT o_orderpriority, abs(CAST(c * k AS DOUBLE) - CAST(c * 100 AS DOUBLE)) / CAST(c * 100 AS DOUBLE) <= 0.05 AS ok FROM s) GROUP BY ALL"""
)
def score_numeric_reltol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers within 5 percent."""
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (c * 100).cast("string").alias("gt"), (c * (90 + F.col("o_orderkey") % 21)).cast("string").alias("pred"))
    return share(numbers(rows).withColumn("ok", N.numbers_match(F.col("p"), F.col("g"), rel_tol=0.05)), "o_orderpriority")


YES_NO = ("Yes.", "no", "Yes and no", "Well, NO way", "I know nothing", "the answer is yes!")


@query(
    f"""WITH s AS (SELECT event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 'yes' ELSE 'no' END AS g, regexp_extract_all(lower({pick_sql('event_id', *YES_NO)}), '[a-z]+') AS w FROM events),
    t AS (SELECT event_type, g, CASE WHEN list_contains(w, 'yes') AND NOT list_contains(w, 'no') THEN 'yes' WHEN list_contains(w, 'no') AND NOT list_contains(w, 'yes') THEN 'no' END AS p FROM s)
    SELECT event_type, count(*) FILTER (WHERE p IS NULL) AS unknown, {SHARE} FROM (SELECT event_type, p, coalesce(p = g, false) AS ok FROM t) GROUP BY event_type"""
)
def score_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yes xor no among an answer's words."""
    rows = table(spark, sf_dir, "events").withColumn("p", T.extract_yes_no(pick(F.col("event_id"), *YES_NO), False))
    gt = F.when(F.col("event_type").isin("purchase", "signup"), "yes").otherwise("no")
    rows = rows.withColumn("ok", F.coalesce(F.col("p") == gt, F.lit(False)))
    return rows.groupBy("event_type").agg(F.count_if(F.col("p").isNull()).alias("unknown"), F.count("*").alias("total"), F.count_if("ok").alias("correct"), F.round(F.count_if("ok") / F.count("*"), 6).alias("accuracy"))


SETS = ("C and A", "b", "AD", "A; D", "none of them", "a,c", "B, B")


@query(
    f"""WITH s AS (SELECT p_partkey, {pick_sql('p_partkey', *SETS)} AS pred FROM part),
    t AS (SELECT p_partkey, pred, list_filter(string_split_regex(trim(pred), '(?i)[,;/&\\s]+|\\band\\b'), lambda x: x <> '') AS w FROM s),
    u AS (SELECT pred, w, flatten(list_transform(w, lambda x: string_split(upper(x), ''))) AS l FROM t)
    SELECT pred, CASE WHEN len(list_filter(l, lambda x: NOT list_contains(['A', 'B', 'C', 'D', 'E', 'F'], x))) = 0 AND len(l) = len(list_distinct(l)) THEN array_to_string(list_sort(l), '') END AS letters, count(*) AS n FROM u GROUP BY ALL"""
)
def mcq_letter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of answers that hold nothing but letters and separators."""
    rows = table(spark, sf_dir, "part").select(pick(F.col("p_partkey"), *SETS).alias("pred"))
    return rows.withColumn("letters", F.array_join(T.letters_of_plain(T.normalize_text(F.col("pred"), unicode=False), T.letters(6)), "")).groupBy("pred", "letters").agg(F.count("*").alias("n"))


# Answers with the letter that the rules must find; an empty text for none.
ROBUST = (
    ("The final answer is (B) because of the sky", "B"), ("**Answer: C**", "C"), (r"So we get $\boxed{\text{A}}$", "A"), ("D is right", "D"), ("it shows a cute cat on a mat near the old door", ""), ("the answer is b", "B"),
    ("<think>A or B</think><answer>c</answer>", "C"), ("I thought of A, then B, then C, and it was hard to say which", ""), ("C: A man surfing", "C"), ("correct option: (D)", "D"), ("Between A and B the better is **B:** no doubt about that at all", "B"),
)


@query(
    f"""WITH s AS (SELECT o_orderpriority, {pick_sql('o_orderkey', *(a for _, a in ROBUST))} AS letter FROM orders)
    SELECT o_orderpriority, nullif(letter, '') AS letter, count(*) AS n FROM s GROUP BY ALL"""
)
def mcq_robust_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters out of reasoning: tags, boxes, cues, position, labels."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", pick(F.col("o_orderkey"), *(q for q, _ in ROBUST)).alias("pred"))
    none = F.array().cast("array<struct<letter:string,text:string>>")
    rows = spread(rows).withColumn("plain", T.normalize_text(F.col("pred"), unicode=False)).withColumn("tag", T.answer_tag(F.col("pred")))
    return rows.withColumn("letter", T.option_robust(F.col("pred"), F.col("plain"), F.col("tag"), T.letters(4), none)).groupBy("o_orderpriority", "letter").agg(F.count("*").alias("n"))


@query(
    f"""WITH s AS (SELECT p_brand, lower(p_type) AS g, lower(CASE p_partkey % 3 WHEN 0 THEN 'I think it is ' || p_type || '.' WHEN 1 THEN p_name ELSE upper(p_type) END) AS p FROM part)
    SELECT p_brand, {SHARE} FROM (SELECT p_brand, contains(p, g) AS ok FROM s) GROUP BY ALL"""
)
def score_open_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference inside a normalised answer."""
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("gt"), F.when(k == 0, F.concat(F.lit("I think it is "), "p_type", F.lit("."))).when(k == 1, F.col("p_name")).otherwise(F.upper("p_type")).alias("pred"))
    ok = F.contains(T.normalize_open(F.col("pred"), False), T.normalize_open(F.col("gt"), False))
    return share(rows.withColumn("ok", ok), "p_brand")


@query(
    """WITH s AS (SELECT p_partkey, p_name AS g, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'oo') WHEN 2 THEN p_type ELSE p_name || '  ' || p_brand END AS p FROM part),
    t AS (SELECT p_partkey, 1 - levenshtein(regexp_replace(trim(lower(g)), '\\s+', ' ', 'g'), regexp_replace(trim(lower(p)), '\\s+', ' ', 'g')) / greatest(length(g), length(p)) AS s FROM s)
    SELECT p_partkey, round(CASE WHEN s < 0.5 THEN 0 ELSE s END, 6) AS score FROM t"""
)
def score_anls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-distance similarity with a threshold."""
    k = F.col("p_partkey") % 4
    pred = F.when(k == 0, F.upper("p_name")).when(k == 1, F.replace("p_name", F.lit("e"), F.lit("oo"))).when(k == 2, F.col("p_type")).otherwise(F.concat_ws("  ", "p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(N.anls(pred, F.array("p_name")), 6).alias("score"))


@query(
    """WITH p AS (SELECT l_orderkey, max(l_returnflag) AS pred, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 2),
    r AS (SELECT l.l_orderkey, p.n, CAST(l.l_returnflag = p.pred AS INT) AS same, sum(CAST(l.l_returnflag = p.pred AS INT)) OVER (PARTITION BY l.l_orderkey) AS m FROM lineitem l JOIN p USING (l_orderkey))
    SELECT n, round(avg(least(1.0, (m - same) / 3.0)), 6) AS consensus, count(*) AS refs FROM r GROUP BY n"""
)
def score_vqa_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out consensus of each order's flags with its greatest flag, in closed form, averaged by the number of flags."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("refs"), F.max("l_returnflag").alias("pred")).withColumn("n", F.size("refs")).where("n >= 2")
    m = F.size(F.filter("refs", lambda r: r == F.col("pred")))
    scored = orders.withColumn("s", N.vqa_consensus_of(m, F.col("n")))
    return scored.groupBy(F.col("n").cast("long").alias("n")).agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 6).alias("consensus"), F.sum("n").cast("long").alias("refs"))


TYPES = (("yes", "yes_no"), ("B", "mcq"), ("A, C", "mcq"), ("3.5%", "numeric"), ("blue sky", "open"), ("(D)", "mcq"), ("1,200", "numeric"), ("BED", "open"), ("No.", "yes_no"), ("-1e3", "numeric"), ("C and A", "mcq"), ("5d", "open"))


@query(
    f"""SELECT o_orderstatus, {pick_sql('o_orderkey', *(t for _, t in TYPES))} AS question_type, count(*) AS n FROM orders GROUP BY ALL"""
)
def infer_question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question types by the shape of the ground truth."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", pick(F.col("o_orderkey"), *(g for g, _ in TYPES)).alias("gt"))
    rows = spread(rows).withColumn("plain", T.normalize_exact(F.col("gt"), False)).withColumn("norm", T.open_of_plain(F.col("plain")))
    rows = rows.withColumns({"bare": T.gt_letters(F.col("gt"), F.lit(False)), "number": T.parse_number_text(F.col("norm"))})
    typed = T.question_type_of("auto", F.lit(None).cast("string"), F.col("gt"), F.col("norm"), F.col("bare"), F.col("number"))
    return rows.withColumn("question_type", typed).groupBy("o_orderstatus", "question_type").agg(F.count("*").alias("n"))


# A whole sheet: ground truth, answer, and by hand the type and the stage that must decide it (empty: none; invalid: no grade).
SHEET = (
    ("B", "b", "mcq", "exact-match"), ("A, C", "C and A", "mcq", "exact-match"), ("D", "I would say the answer is D.", "mcq", "exact-match"), ("C", "So it is **(C)** after all, as option A and B fail; final answer (C)", "mcq", "rule-match"),
    ("yes", "Yes.", "yes_no", "exact-match"), ("no", "I don't think so, no way", "yes_no", "rule-match"), ("yes", "yes and no", "yes_no", ""), ("42", "42.0", "numeric", "exact-match"),
    ("42", "first 7, then the answer is 42 apples", "numeric", "rule-match"), ("42", "41", "numeric", ""), ("blue sky", "Blue  sky!", "open", "exact-match"), ("blue sky", "I see it. Final answer: blue sky", "open", "rule-match"),
    ("blue sky", "red", "open", ""), (" ", "anything", "mcq", "invalid"),
)


@query(
    f"""WITH s AS (SELECT {pick_sql('o_orderkey', *(t for _, _, t, _ in SHEET))} AS question_type, {pick_sql('o_orderkey', *(d for *_, d in SHEET))} AS d FROM orders),
    t AS (SELECT question_type, CASE WHEN d IN ('', 'invalid') THEN 'undecided' ELSE d END AS stage, d IN ('exact-match', 'rule-match') AS ok, d = 'invalid' AS bad FROM s)
    SELECT CASE WHEN grouping(stage) = 0 THEN 'stage' WHEN grouping(question_type) = 0 THEN 'type' ELSE 'all' END AS part, stage, question_type, count(*) AS total, count(*) FILTER (WHERE NOT bad) AS valid, count(*) FILTER (WHERE ok) AS correct,
    round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy, round(coalesce(count(*) FILTER (WHERE ok) / nullif(count(*) FILTER (WHERE NOT bad), 0), 0), 6) AS accuracy_valid, count(*) FILTER (WHERE bad) AS invalid FROM t GROUP BY GROUPING SETS ((stage), (question_type), ())"""
)
def grade_mixed_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All question types through exact-match and rule-match, rolled up by stage, by type and in all, in one pass."""
    none = F.lit(None)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array(pick(F.col("o_orderkey"), *(s[0] for s in SHEET))).alias("gt"), F.lit(False).alias("gt_is_list"), F.array(pick(F.col("o_orderkey"), *(s[1] for s in SHEET))).alias("pred"), F.lit("").alias("question"),
        none.cast("array<struct<letter:string,text:string>>").alias("options"), none.cast("array<string>").alias("choices"), none.cast("array<struct<letter:string,text:string>>").alias("flat_options"), none.cast("string").alias("prompt"),
    )
    graded = grading.grade(grading.with_context(rows, unicode=False), resolve_protocol({"score_pipeline": "exact-match,rule-match"}))
    return grading.report(graded).select("part", "stage", "question_type", "total", "valid", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("accuracy_valid", 6).alias("accuracy_valid"), "invalid")


# Selection.


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


POSITIONS = "(SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS total FROM orders)"


@query(f"SELECT o_orderkey, o_custkey, position FROM {POSITIONS} WHERE position < 100")
def sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.head(_placed(spark, sf_dir), 100)


@query(f"SELECT o_orderkey, o_custkey, position FROM {POSITIONS} WHERE position >= total - 100")
def sample_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.tail(_placed(spark, sf_dir), 100)


@query(f"SELECT o_orderkey, o_custkey, position FROM {POSITIONS} WHERE position % 7 = 3")
def stride_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.stride_shard(_placed(spark, sf_dir), 7, 3)


@query(f"SELECT o_orderkey, o_custkey, position FROM {POSITIONS} WHERE position // CAST(ceil(total / 7.0) AS BIGINT) = 6")
def contiguous_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    return select.contiguous_chunk(placed, 7, 6, table(spark, sf_dir, "orders").count())


def drawn_sql(totals: tuple[int, ...], n: int, seed: int) -> str:
    """(total, position, ordinal) of a seeded draw of n from each of some totals, the row counts of the tables at hand."""
    return "(VALUES " + ", ".join(f"({t}, {p}, {i})" for t in totals for i, p in enumerate(select.random_positions(t, n, seed))) + ") d(total, position, ordinal)"


@query(f"SELECT o_orderkey, o_custkey, position, ordinal FROM {POSITIONS} JOIN {drawn_sql((1500, 15000, 150000), 50, 11)} USING (total, position)")
def sample_random_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty of all positions, as a seeded generator draws them. The SQL holds the draws for the three sizes of the driver's tables."""
    return select.random_rows(_placed(spark, sf_dir), 50, 11, table(spark, sf_dir, "orders").count()).select("o_orderkey", "o_custkey", "position", "ordinal")


@query("SELECT position // 64 AS batch, count(*) AS n, min(o_orderkey) AS first_key FROM " + POSITIONS + " GROUP BY 1")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.batches(_placed(spark, sf_dir), 64).groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(12, 2)) AS util, s_nationkey AS free FROM supplier ORDER BY util, free DESC, s_suppkey LIMIT 5")
def least_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(12,2)").alias("util"), F.col("s_nationkey").alias("free"))
    return select.least_loaded(rows, 5)


# Resume, joins, windows.


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view' AND event_id % 2 = 0)")
def resume_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return select.without_done(events.select("event_id", "user_id"), events.where("event_type = 'view' and event_id % 2 = 0"), "event_id")


@query("SELECT user_id, event_id AS seq, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def cache_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.latest(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type"), "user_id")


@query("SELECT coalesce(b.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.tag, b.tag) AS tag FROM (SELECT c_custkey, c_mktsegment AS tag FROM customer WHERE c_custkey % 3 <> 0) b FULL JOIN (SELECT c_custkey, 'new' AS tag FROM customer WHERE c_custkey % 5 = 0) n USING (c_custkey)")
def cache_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return resume.overlay(rows.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("tag")), rows.where("c_custkey % 5 = 0").select("c_custkey", F.lit("new").alias("tag")), "c_custkey")


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.duplicate_keys(table(spark, sf_dir, "events"), "user_id")


@query(
    """WITH c AS (SELECT event_id, user_id % 3 AS f, event_type = 'error' AS bad FROM events WHERE event_id % 2 = 0), u AS (SELECT event_id FROM c WHERE f = 1 AND NOT bad)
    SELECT event_type, event_id IN (SELECT event_id FROM u) AS reused, count(*) AS n FROM events GROUP BY ALL"""
)
def split_work_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a cached result of the same configuration, and rows still to do."""
    events = table(spark, sf_dir, "events")
    cache = events.where("event_id % 2 = 0").select("event_id", (F.col("user_id") % 3).cast("string").alias("fingerprint"), F.when(F.col("event_type") == "error", "llm_error: x").alias("reason"))
    done, todo = resume.split_work(events, resume.reusable(cache, "1"), "event_id")
    return done.withColumn("reused", F.lit(True)).unionByName(todo.withColumn("reused", F.lit(False))).groupBy("event_type", "reused").agg(F.count("*").alias("n"))


@query("SELECT c_name FROM customer WHERE c_name ILIKE 'customer#00000_1%'")
def prefix_with_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.by_prefix(table(spark, sf_dir, "customer").select("c_name"), "customer#00000_1", "c_name", wildcards=True)


PATTERNS = ("BUILDING", "BUILD", "ING", "MACHINERY", "HOUSE", "HOUSEHOLD", "Y")


@query(
    f"""WITH p AS (SELECT unnest({list(PATTERNS)}) AS pattern), k AS (SELECT DISTINCT c_mktsegment AS key FROM customer)
    SELECT key, (SELECT pattern FROM p WHERE starts_with(key, pattern) OR ends_with(key, pattern) ORDER BY length(pattern) DESC, pattern DESC LIMIT 1) AS pattern FROM k"""
)
def split_subset_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest subset name that begins or ends each split name."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key")).distinct()
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return resume.longest_match(keys, patterns, "key", "pattern", sorted({len(p) for p in PATTERNS}))


@query(
    """SELECT CASE WHEN n > 1 THEN l_partkey || '_q' || k ELSE CAST(l_partkey AS VARCHAR) END AS id, l_partkey AS source_id FROM
    (SELECT l_partkey, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem)"""
)
def disambiguate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber")
    return convert.unique_ids(rows, ["l_orderkey", "l_linenumber"]).select("id", "source_id")


@query("SELECT l_orderkey || '_q' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) AS id FROM lineitem")
def number_every_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey")
    return convert.unique_ids(rows, ["l_linenumber", "l_partkey"], always=True, base=0).select("id")


# Conversion, prompts, audits.


@query("SELECT conv_id AS source, turn AS idx, conv_id || '_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS unique_id, length(text) AS n_chars FROM conversations WHERE text IS NOT NULL")
def explode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested records, exploded again with made ids."""
    packed = convert.regroup(table(spark, sf_dir, "conversations").where("text is not null"), ["conv_id"], ["turn", "role", "text"], "turn").withColumnRenamed("conv_id", "id")
    rows = convert.explode_rows(packed, "questions", "id")
    return rows.select(F.col("id").alias("source"), F.col("turn").alias("idx"), F.col("_unique_id").alias("unique_id"), F.length("text").cast("long").alias("n_chars"))


@query(
    """WITH t AS (SELECT conv_id, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations)
    SELECT conv_id, bool_and(role <> 'user' OR coalesce(nr = 'assistant' AND nt IS NOT NULL, false)) AS answered FROM t GROUP BY 1"""
)
def user_followed_by_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = convert.regroup(table(spark, sf_dir, "conversations").withColumnRenamed("text", "response"), ["conv_id"], ["turn", "role", "response"], "turn", "messages")
    return packed.select("conv_id", audit.answered_by_assistant(F.col("messages")).alias("answered"))


@query(
    """WITH m AS (SELECT conv_id, turn, turn % 3 AS n FROM conversations), w AS (SELECT conv_id, turn, n, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o,
    sum(n) OVER (PARTITION BY conv_id) AS t FROM m)
    SELECT conv_id, turn, CAST(n AS BIGINT) AS n_placeholders, CAST(o AS BIGINT) AS media_offset, CASE WHEN o + n > 4 THEN 'too few media' WHEN t < 4 THEN 'too many media' END AS media_error FROM w"""
)
def placeholder_media_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running media offsets over messages with turn % 3 placeholders, against four media."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.expr("repeat('<image> ', cast(turn % 3 as int))"), F.lit("text")).alias("text"), F.array(*(F.lit(f"m{i}.png") for i in range(4))).alias("media"))
    out = prompts.message_media(rows, "conv_id", "turn", "text", "media")
    return out.select("conv_id", "turn", F.col("n_placeholders").cast("long").alias("n_placeholders"), F.col("media_offset").cast("long").alias("media_offset"), "media_error")


@query("SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Options:' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type ELSE '' END || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'Hint: ' || p_type ELSE '' END AS prompt FROM part")
def prompt_default_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.when(F.col("p_size") % 2 == 0, convert.options_of({"A": F.col("p_brand"), "B": F.col("p_type")}))
    return table(spark, sf_dir, "part").select("p_partkey", prompts.default_prompt(F.col("p_name"), options, F.when(F.col("p_size") % 3 == 0, F.col("p_type"))).alias("prompt"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(text, ' \n'), '\\s+', ' ', 'g')), '[.!?]+$', ''), '\\s+', ' ', 'g')) AS normal FROM benchmark")
def normalize_open_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_open(F.col("text"), False).alias("normal"))


@query("SELECT p_brand, p_size % 5 <> 0 AS kept, count(*) AS n, min(p_partkey % 4) AS media_min, max(p_partkey % 4) AS media_max FROM part GROUP BY ALL")
def media_range_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of media by brand, of kept and of skipped rows."""
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 5 != 0).alias("kept"), F.array_repeat(F.lit("m"), (F.col("p_partkey") % 4).cast("int")).alias("media"))
    return convert.media_range(rows, by=("p_brand", "kept"))


@query("SELECT CASE p_size % 3 WHEN 0 THEN 'encode_failed' WHEN 1 THEN 'missing_required:id' ELSE 'unknown_video_ext' END AS reason, count(*) AS n FROM part GROUP BY 1")
def skip_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    rows = table(spark, sf_dir, "part").select(F.when(k == 0, F.concat(F.lit("encode_failed:"), "p_name")).when(k == 1, "missing_required:id").otherwise("unknown_video_ext").alias("reason"))
    return convert.skip_reasons(rows)


@query("SELECT l_orderkey AS source_id, count(*) AS n, count(DISTINCT l_suppkey) AS n_ids FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT l_suppkey)")
def source_id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.id_collisions(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("id")))


@query("SELECT lang AS split, count(*) AS n_rows, count(*) FILTER (WHERE doc_id % 3 <> 1) AS mismatches, CAST(0 AS BIGINT) AS numbered_refs FROM documents GROUP BY 1")
def split_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.expr("repeat('<image>', cast(doc_id % 3 as int))").alias("q"), F.array(F.lit("m")).alias("media"))
    return audit.split_profile(rows, "split", F.col("q"), F.col("media"))


@query("SELECT unnest(['AFRICA', 'ASIA', 'EUROPE']) AS r_name, 'train' AS split UNION ALL SELECT r_name, 'all' FROM region")
def merge_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_name")
    return convert.merge_splits({"train": rows.where(F.col("r_name").isin("AFRICA", "ASIA", "EUROPE")), "all": rows})


# Roll-ups of prediction logs.


@query("SELECT event_type AS task_type, count(*) AS total, round(100.0 * avg(CAST(user_id % 4 = event_id % 4 AS INT)), 6) AS accuracy FROM events GROUP BY ROLLUP (event_type)")
def accuracy_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "task_type")
    return grading.accuracy_by(rows, "task_type", F.col("user_id") % 4 == F.col("event_id") % 4).select("task_type", "total", F.round("accuracy", 6).alias("accuracy"))


@query(
    """WITH q AS (SELECT o_orderstatus, o_orderpriority, o_orderkey % 5 <> 0 AS answered, o_orderkey % 3 = 0 AS hit FROM orders)
    SELECT o_orderstatus, o_orderpriority, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE answered AND hit) AS correct, round(count(*) FILTER (WHERE answered AND hit) / count(*) FILTER (WHERE answered), 6) AS accuracy
    FROM q GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())"""
)
def nested_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of answered questions over two dimensions, each alone and in all: grouping sets, one pass."""
    rows = table(spark, sf_dir, "orders")
    sets = (("o_orderstatus", "o_orderpriority"), ("o_orderstatus",), ("o_orderpriority",), ())
    pred = T.video_choice(F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 3 == 0, "The best answer is A.").otherwise("(B)"))
    rows = rows.withColumn("pred", pred)
    out = grading.nested_accuracy(rows, sets, F.col("pred") != "", F.col("pred") == "A")
    return out.select("o_orderstatus", "o_orderpriority", "answered", "correct", F.round("accuracy", 6).alias("accuracy"))


REPLIES = (
    ('{"is_correct": 1, "reason": "fine"}', "1"), ('Sure: {"is_correct": 0, "reason": ""} done', "0"), ('{"is_correct": true}', "1"), ('{"is_correct": 1, ""}', "1"), ('{"is_correct": 1} {"is_correct": 0}', ""), ("no idea", ""), ('{"verdict": 1}', "0"), ('{"is_correct": "yes"}', "0"), ('{"is_correct": "1"}', "1"),
)


@query(f"""SELECT event_type, CAST(nullif({pick_sql('event_id', *(v for _, v in REPLIES))}, '') AS INT) AS verdict, count(*) AS n FROM events GROUP BY ALL""")
def judge_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", pick(F.col("event_id"), *(r for r, _ in REPLIES)).alias("reply"))
    return spread(rows).withColumn("v", grading.judge_verdict(F.col("reply"))).groupBy("event_type", F.col("v.is_correct").alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS yes, count(*) FILTER (WHERE event_id % 3 = 1) AS no, round(count(*) FILTER (WHERE event_id % 3 = 0) / count(*) FILTER (WHERE event_id % 3 < 2), 6) AS accuracy, round(avg(event_id % 6), 6) AS average_score FROM events")
def judged_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(pick(F.col("event_id"), "yes", "No.", "maybe").alias("pred"), (F.col("event_id") % 6 + 0.75).alias("score"))
    out = grading.judged_accuracy(rows)
    return out.select("yes", "no", F.round("accuracy", 6).alias("accuracy"), F.round("average_score", 6).alias("average_score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= l_extendedprice / 1000 AND l_quantity >= l_discount * 100 THEN 'A' WHEN l_extendedprice / 1000 >= l_discount * 100 THEN 'B' ELSE 'C' END AS choice FROM lineitem")
def choice_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.best_choice(T.letters(3), scores).alias("choice"))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_size <= 8 THEN list_transform(range(p_size), lambda x: CAST(x AS INT)) ELSE list_transform(range(8), lambda i: CAST(round_even(i * ((p_size - 1) / 7.0::DOUBLE), 0) AS INT)) END, ',') AS frames FROM part")
def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(N.uniform_frames(F.col("p_size"), 8).cast("array<string>"), ",").alias("frames"))


GRIDS = """WITH g AS (SELECT i, j, row_number() OVER (ORDER BY i * j, i, j) AS r FROM range(1, 13) a(i), range(1, 13) b(j) WHERE i * j <= 12),
    s AS (SELECT p_partkey, p_size * 40 + 200 AS w, p_partkey % 17 * 90 + 300 AS h FROM part),
    d AS (SELECT p_partkey, w, h, i, j, r, abs(w::DOUBLE / h - i::DOUBLE / j) AS d, w * h > 0.5 * 448 * 448 * i * j AS large FROM s, g),
    m AS (SELECT * FROM d QUALIFY d = min(d) OVER (PARTITION BY p_partkey)),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN large THEN -r ELSE r END, r) = 1)"""


@query(
    GRIDS + """, f AS (SELECT *, least(448::DOUBLE / w, 448::DOUBLE / h) AS k FROM b), x AS (SELECT *, CAST(trunc(w * k) AS INT) AS fw, CAST(trunc(h * k) AS INT) AS fh FROM f)
    SELECT p_partkey, i AS cols, j AS rows, fw AS width, fh AS height, (448 - fw) // 2 AS "left", (448 - fh) // 2 AS top, CASE WHEN i * j > 1 THEN i * j + 1 ELSE 1 END AS tiles,
    CAST((i * j - 1) % i * 448 AS INT) AS last_left, CAST((i * j - 1) // i * 448 AS INT) AS last_top FROM x"""
)
def tile_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile grids, their last tiles and fitted boxes of made-up image sizes."""
    w, h = F.col("p_size") * 40 + 200, F.col("p_partkey") % 17 * 90 + 300
    rows = table(spark, sf_dir, "part").select("p_partkey", N.tile_grid(w, h).alias("g"), N.fit_box(w, h, 448, 448).alias("b"))
    rows = rows.withColumn("t", F.element_at(N.tile_boxes(F.col("g")), -1))
    return rows.select("p_partkey", "g.cols", "g.rows", "b.width", "b.height", "b.left", "b.top", N.tile_count(F.col("g"), True).alias("tiles"), F.col("t.left").alias("last_left"), F.col("t.top").alias("last_top"))


@query(
    """SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name) || ' isn''t 1000 2', ' '), lambda x: x NOT IN ('a', 'an', 'the', '')), ' ') AS normal FROM part"""
)
def vqa_normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public VQA normalisation over part names with punctuation put in."""
    return table(spark, sf_dir, "part").select("p_partkey", N.evalai_process(F.concat(F.lit("The "), F.col("p_name"), F.lit(", isnt 1,000 - two?"))).alias("normal"))

"""Grading: an ordered chain of deciders over canonical rows, and the roll-up of verdicts.

Each stage is a nullable struct column; the first that decides wins. Rule stages are one projection inside the JVM. A stage that
asks a model runs in one pass over a written table, asking only for the rows that need it, and its result is written before
anything reads it: a row is asked for once, whatever is done with the result, and no stage is planned into the next.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..plans.protocol import LLM_STAGES, Protocol
from ..schema import STAGE, blank
from .store import spread, written


@dataclass(frozen=True)
class Reply:
    """A model's text, and its tokens with their log-probabilities if the model tells them."""

    text: str | None
    tokens: tuple[tuple[str, float | None], ...] | None = None


Client = Callable[[list[str]], "list[str | Reply | Exception | None]"]
"""Replies to prompts; None, a blank text or an exception for a failure. Made once per partition."""

# Failures that another try may cure.
RETRYABLE_STATUS = (408, 409, 429)
RETRYABLE_ERRORS = ("APIConnectionError", "APITimeoutError", "RateLimitError", "InternalServerError")


def retryable(error: Exception) -> bool:
    """By HTTP status where the error has one, else by its class's name."""
    status = getattr(error, "status_code", None)
    return status in RETRYABLE_STATUS or status >= 500 if isinstance(status, int) else type(error).__name__ in RETRYABLE_ERRORS


# Patterns of numeric and final answers.
NUMERIC_CUE = r"(?:final answer|the answer is|answer is|answer\s*[:\-]|=)"
NUMBER = r"-?\d+(?:\.\d+)?%?"
FINAL_ANSWER = r"(?i)(?:final answer|answer is|the answer is)\s*[:\-]?\s*(.+)$"


def scored(when: Column, score: Column | float = 1.0, matched: Column | None = None, reason: Column | None = None, prob: Column | None = None) -> Column:
    nothing = F.lit(None)
    value = F.struct(
        F.lit("score").alias("outcome"), (F.lit(score) if isinstance(score, float) else score).cast("double").alias("score"), (nothing if matched is None else matched).cast("string").alias("matched"),
        (nothing if reason is None else reason).cast("string").alias("reason"), (nothing if prob is None else prob).cast("double").alias("judge_prob"),
    )
    return F.when(when, value).cast(STAGE)


def invalid(reason: str) -> Column:
    return F.struct(F.lit("invalid").alias("outcome"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("matched"), F.lit(reason).alias("reason"), F.lit(None).cast("double").alias("judge_prob"))


def shown(values: Column, is_list: Column) -> Column:
    """A ground truth as text; a list with brackets and quotes."""
    return F.when(is_list, F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))).otherwise(T.to_text(values))


def _reading(side: str) -> list[tuple[str, Column]]:
    """What the rules read of one text of a multiple-choice row, each form once: tag, segment after a cue, normal forms, letter set, letter."""
    col = lambda name: F.col(f"{side}_{name}")
    text, cand, mcq = col("text"), F.col("candidates"), F.col("qtype") == "mcq"
    return [
        ("tag", F.when(mcq, T.answer_tag(text))), ("after", F.when(mcq, T.after_cue(text))),
        ("tag_plain", F.when(col("tag").isNotNull(), T.normalize_text(col("tag"), unicode=False))), ("after_plain", F.when(col("after").isNotNull(), T.normalize_text(col("after"), unicode=False))),
        ("set", F.when(mcq, F.coalesce(T.letters_of_plain(col("tag_plain"), cand), T.letters_of_plain(col("after_plain"), cand), T.letters_of_plain(col("plain"), cand)))),
        ("strict", F.when(mcq & col("set").isNull(), T.option_strict(F.coalesce(col("tag_plain"), col("plain")), cand))),
    ]


def _steps(forced_type: str, field: Column, unicode: bool) -> list[dict[str, Column]]:
    """The columns of with_context(), in steps that read what earlier ones made."""
    form = T.nfkc if unicode else (lambda c: c)
    sides = ("gt", "pred")
    both = lambda make: {k: v for side in sides for k, v in make(side).items()}
    mcq = F.col("qtype") == "mcq"
    steps = [
        {"gt_refs": T.nfkc_each(_refs()) if unicode else _refs(), "gt_shown": shown(F.col("gt"), F.col("gt_is_list")), **both(lambda s: {f"{s}_text": form(T.to_text(F.col(s)))})},
        both(lambda s: {f"{s}_plain": T.normalize_text(F.col(f"{s}_text"), unicode=False)}),
        both(lambda s: {f"{s}_norm": T.open_of_plain(F.col(f"{s}_plain"))}),
        {**both(lambda s: {f"{s}_number": T.parse_number_text(F.col(f"{s}_norm"))}), "gt_bare": T.gt_letters(F.col("gt_text"), F.col("gt_is_list"))},
        {"qtype": T.question_type_of(forced_type, field, F.when(F.col("gt").isNotNull(), F.col("gt_text")), F.col("gt_norm"), F.col("gt_bare"), F.col("gt_number"))},
        {"parsed": F.when(mcq, T.parsed_options(F.col("options"), F.col("choices"), F.col("flat_options"), F.col("question"), F.col("prompt"))), "texts": T.option_texts(F.col("options"), F.col("choices"), F.col("flat_options"))},
        {"candidates": F.when(mcq, T.widen_options(T.candidate_options(F.col("parsed")), F.coalesce("gt_bare", F.array().cast("array<string>"))))},
    ]
    for (name, g), (_, p) in zip(_reading("gt"), _reading("pred"), strict=True):
        steps.append({f"gt_{name}": g, f"pred_{name}": p})
    steps.append({"gt_letters": F.when(mcq, F.coalesce("gt_bare", F.when(F.col("parsed").isNotNull(), F.col("gt_set"))))})
    return steps


def with_context(rows: DataFrame, forced_type: str = "auto", declared: str | None = "question_type", unicode: bool = True) -> DataFrame:
    """Adds what the stages share, each form of a text once: type, candidate letters, option texts, letters of the ground truth.

    `rows` has gt and pred (array<string>), gt_is_list, question, options, choices, flat_options and prompt. Texts are brought to
    NFKC first, by the only Python step of the rule stages; unicode=False leaves it out.
    """
    known = bool(declared) and declared in rows.columns
    steps = T.made_once(("context", forced_type, declared if known else None, unicode), lambda: _steps(forced_type, F.col(declared) if known else F.lit(None).cast("string"), unicode))
    rows = spread(rows)
    for step in steps:
        rows = rows.withColumns(step)
    return rows


def _robust(side: str, need: Column) -> Column:
    """The letter that reasoning names, where it is needed."""
    col = lambda name: F.col(f"{side}_{name}")
    return F.when(need & (F.col("qtype") == "mcq") & (col("text") != ""), T.option_robust(col("text"), col("plain"), col("tag"), F.col("candidates"), F.col("texts")))


def _reasoned(rows: DataFrame) -> DataFrame:
    """Adds gt_robust and pred_robust, read only in rows that no stage has decided and where no clean letters were found."""
    if "gt_robust" in rows.columns:
        return rows
    still = F.col("__fin").isNull()
    return rows.withColumns(T.made_once(("reasoned",), lambda: {"gt_robust": _robust("gt", still & F.col("gt_letters").isNull()), "pred_robust": _robust("pred", still & F.col("pred_set").isNull())}))


def _refs() -> Column:
    return N.references(F.col("gt"))


def _open_match(pred: Column, pred_norm: Column, p: Protocol) -> Column:
    if p.string_match == "anls":
        return F.coalesce(N.anls(pred, _refs(), p.anls_threshold) > 0, F.lit(False))
    hit = (lambda r: (r != "") & F.contains(pred_norm, r)) if p.string_match == "contains" else (lambda r: (r != "") & (r == pred_norm))
    return (pred_norm != "") & F.exists(F.transform("gt_refs", lambda r: T.normalize_open(r, False)), hit)


def _letters_of(one: Column) -> Column:
    return F.when(one.isNotNull() & (one != ""), F.array(one))


def exact_match(p: Protocol) -> Column:
    """Only unambiguous answers: a letter or clean letter set, yes or no, a number or text as a whole. Never decides a miss."""
    gt = F.coalesce("gt_letters", _letters_of(F.coalesce(F.col("gt_strict"), F.upper("gt_plain"))))
    mcq = scored(gt == F.coalesce("pred_set", _letters_of(F.col("pred_strict"))), matched=F.array_join(gt, ", "))
    yes_no = scored(F.col("pred_norm").isin("yes", "no") & (F.col("pred_norm") == F.col("gt_norm")), matched=F.col("pred_norm"))
    same = N.numbers_match(F.col("pred_number"), F.col("gt_number"), p.numeric_rel_tol, p.numeric_abs_tol)
    open_text = scored(_open_match(T.to_text(F.col("pred")), F.col("pred_norm"), p), matched=F.col("gt_shown"))
    numeric = scored(same, matched=F.col("gt_shown")) if N.numeric_active(p.string_match, p.numeric_rel_tol, p.numeric_abs_tol) else open_text
    return F.when(F.col("qtype") == "mcq", mcq).when(F.col("qtype") == "yes_no", yes_no).when(F.col("qtype") == "numeric", numeric).otherwise(open_text)


def rule_match(p: Protocol) -> Column:
    """Answers out of reasoning: cued letters, yes xor no, the first number after the last cue, a final answer. Never decides a miss."""
    gt = F.coalesce("gt_letters", _letters_of(F.coalesce(F.col("gt_robust"), F.upper("gt_plain"))))
    mcq = scored(gt == F.coalesce("pred_set", _letters_of(F.col("pred_robust"))), matched=F.array_join(gt, ", "))
    said = T.yes_no_text(F.lower("pred_plain"))
    yes_no = scored(said == F.col("gt_norm"), matched=said)

    segment = T.last(F.split(F.col("pred_norm"), NUMERIC_CUE, -1))
    value = T.parse_number_text(F.coalesce(T.first_match(segment, NUMBER, 0), T.first_match(F.col("pred_norm"), NUMBER, 0)))
    close = F.exists("gt_refs", lambda r: N.numbers_match(value, T.parse_number(r, False), p.numeric_rel_tol, p.numeric_abs_tol))

    final = T.first_match(F.col("pred_plain"), FINAL_ANSWER)
    hit = F.coalesce(_open_match(final, T.open_of_plain(T.collapse(final)), p), F.lit(False)) | _open_match(F.col("pred_plain"), F.col("pred_norm"), p)
    open_text = scored(hit, matched=F.col("gt_shown"))
    numeric = scored(close, matched=F.col("gt_shown")) if N.numeric_active(p.string_match, p.numeric_rel_tol, p.numeric_abs_tol) else open_text
    return F.when(F.col("qtype") == "mcq", mcq).when(F.col("qtype") == "yes_no", yes_no).when(F.col("qtype") == "numeric", numeric).otherwise(open_text)


def vqa_accuracy(p: Protocol) -> Column:
    """Consensus with the annotators' answers, of the texts as they are; fewer than two are invalid."""
    score = N.vqa_consensus(T.to_text(F.col("pred")), _refs())
    return F.when(score.isNull(), invalid("vqa-accuracy needs at least two references")).otherwise(scored(F.lit(True), score))


def anls_grader(p: Protocol) -> Column:
    score = N.anls(T.to_text(F.col("pred")), _refs(), p.anls_threshold)
    return F.when(score.isNull(), invalid("anls: empty ground truth")).otherwise(scored(F.lit(True), score))


RULE_STAGES: dict[str, Callable[[Protocol], Column]] = {"exact-match": exact_match, "rule-match": rule_match, "vqa-accuracy": vqa_accuracy, "anls": anls_grader}


# Stages that ask a model.


def judge_prompt(include_reason: bool = False) -> Column:
    """The text that asks whether a response is right."""
    lines = F.when((F.col("qtype") == "mcq") & (F.size("texts") > 0), F.concat(F.lit("\nOptions:\n"), F.array_join(F.transform("texts", lambda o: F.concat_ws(". ", o["letter"], o["text"])), "\n"))).otherwise("")
    plain = lambda c: _as_said(F.col(c))
    return F.concat(
        F.lit("Decide whether RESPONSE answers QUESTION as TRUTH does.\nType: "), F.col("qtype"), F.lit("\nQUESTION: "), plain("question"), lines, F.lit("\nRESPONSE: "), plain("pred_text"), F.lit("\nTRUTH: "), plain("gt_text"),
        F.lit('\n\nReply only with JSON: {"is_correct": 0 or 1, "reason": "text"}\n' + ("Give a short reason." if include_reason else "Leave the reason empty.")),
    )


def _as_said(text: Column) -> Column:
    """A text for a prompt: normal form with boxes and LaTeX left in."""
    return T.normalize_text(text, extract_boxed=False, strip_latex=False, unicode=False)


def extract_prompt() -> Column:
    """The text that asks which options a response picks; without the question's media placeholders."""
    question = T.strip(F.regexp_replace(_as_said(F.col("question")), "<(?:image|video)>", " "))
    return F.concat(
        F.lit("Which option letters does ANSWER pick? Reply with upper-case letters, separated by commas; with Z if it picks none.\nQuestion: "), question, F.lit("\nOptions: "),
        F.array_join(F.transform("texts", lambda o: F.concat_ws(". ", o["letter"], o["text"])), " "), F.lit("\nAnswer: "), _as_said(F.col("pred_text")),
    )


def judge_verdict(reply: Column) -> Column:
    """struct<is_correct, reason> of a judge's reply: strict JSON, else the outermost braces, else one agreed verdict; else null."""
    t = T.strip(F.coalesce(reply, F.lit("")))

    def of(text: Column) -> Column:
        def read(listed: Column) -> Column:
            v = F.try_variant_get(listed, "$[0]", "variant")
            value = F.lower(F.try_variant_get(v, "$.is_correct", "string"))
            right = F.coalesce((value == "true") | (F.regexp_extract(value, r"^([+-]?\d+)(?:\.\d*)?$", 1).try_cast("int") == 1), F.lit(False))
            told = F.struct(right.cast("int").alias("is_correct"), F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason"))
            alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.schema_of_variant(v).startswith("OBJECT")
            return F.when(alone, told)

        json = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))  # else no object
        return F.when(json, T.let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), read))  # a list, so that nothing may follow the object

    said = F.array_distinct(F.transform(T.all_matches(t, r'(?i)"is_correct"\s*:\s*(true|false|0|1)\b'), lambda x: F.when(F.lower(x).isin("1", "true"), 1).otherwise(0)))
    raw = F.array_distinct(F.transform(T.all_matches(t, r'(?i)"is_correct"\s*:\s*(true|false|0|1)\b'), F.lower))
    agreed = F.when(F.size(raw) == 1, F.struct(F.try_element_at(said, F.lit(1)).alias("is_correct"), F.coalesce(T.first_match(t, r'"reason"\s*:\s*"([^"]*)"'), F.lit("")).alias("reason")))
    return F.coalesce(of(t), T.let(F.regexp_extract(t, r"(?s)(\{.*\})", 1), of), agreed)


ASKED = "reply string, reply_error string, reply_tokens array<struct<token:string,logprob:double>>"


def ask(rows: DataFrame, prompt: Column, need: Column, make_client: Callable[[], Client], partitions: int | None = None, attempts: int = 3, pause: float = 1.5) -> DataFrame:
    """`rows` with reply, reply_error and reply_tokens, which are null where `need` does not hold.

    One client a partition; `partitions` bounds how many calls run at once. A failure that another try may cure, and a blank
    reply, are tried `attempts` times with pauses of `pause` seconds that double; others fail at once. A failure is a row's
    result, not the job's. The result is written, so that nothing is asked twice.
    """
    base = rows.withColumn("__prompt", F.when(need, prompt))
    base = base if partitions is None else base.repartition(partitions)
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(ASKED)

    def answers(client, prompts: list[str]) -> list[tuple]:
        out: list[tuple | None] = [None] * len(prompts)
        errors, left = ["no_attempt"] * len(prompts), list(range(len(prompts)))
        for attempt in range(max(1, attempts)):
            if attempt:
                time.sleep(pause * 2 ** (attempt - 1))
            try:
                got = list(client([prompts[i] for i in left]))
                if len(got) != len(left):
                    raise ValueError(f"{len(got)} replies to {len(left)} prompts")
            except Exception as e:
                got = [e] * len(left)
            again = []
            for i, r in zip(left, got, strict=True):
                r = Reply(r) if r is None or isinstance(r, str) else r
                if isinstance(r, Reply) and (r.text or "").strip():
                    out[i] = (r.text, None, None if r.tokens is None else [{"token": t, "logprob": p} for t, p in r.tokens])
                    continue
                errors[i] = f"{type(r).__name__}: {r}" if isinstance(r, Exception) else "empty_response"
                if not isinstance(r, Exception) or retryable(r):
                    again.append(i)
            left = again
            if not left:
                break
        return [x or (None, errors[i], None) for i, x in enumerate(out)]

    def work(batches):
        client = None
        for batch in batches:
            prompts = batch.column("__prompt").to_pylist()
            at = [i for i, p in enumerate(prompts) if p is not None]
            client = client or (make_client() if at else None)
            told: list[tuple] = [(None, None, None)] * len(prompts)
            for i, x in zip(at, answers(client, [prompts[i] for i in at]) if at else (), strict=True):
                told[i] = x
            text, error, tokens = zip(*told, strict=True) if told else ((), (), ())
            token = pa.list_(pa.struct([("token", pa.string()), ("logprob", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(error, pa.string()), pa.array(tokens, token)], names=[*batch.schema.names, "reply", "reply_error", "reply_tokens"])

    return written(base.mapInArrow(work, StructType([*base.schema.fields, *kind.fields])).drop("__prompt"))


def from_table(rows: DataFrame, need: Column, replies: DataFrame, key: str = "eval_id") -> DataFrame:
    """`rows` with the replies of a table (key, reply and, if it has them, reply_error and reply_tokens) in place of a model's; a key
    without a row has no reply. Keys of `replies` must be unique."""
    given = [f.name for f in replies.schema.fields if f.name in ("reply", "reply_error", "reply_tokens")]
    told = replies.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in given))
    out = rows.withColumn("__need", need).join(told, F.col(key) == F.col("__key"), "left")
    kinds = {"reply": "string", "reply_error": "string", "reply_tokens": "array<struct<token:string,logprob:double>>"}
    for name, kind in kinds.items():
        out = out.withColumn(name, F.when(F.col("__need"), F.col(f"__{name}").cast(kind)) if name in given else F.lit(None).cast(kind))
    missing = F.when(F.col("__need") & (F.coalesce("reply", F.lit("")) == ""), F.coalesce("reply_error", F.lit("empty_response")))
    return out.withColumn("reply_error", missing).drop("__key", "__need", *(f"__{c}" for c in given))


def passed(reason: Column) -> Column:
    return F.struct(F.lit("pass").alias("outcome"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("matched"), reason.cast("string").alias("reason"), F.lit(None).cast("double").alias("judge_prob"))


def run_llm_judge(rows: DataFrame, asker: Callable[[DataFrame, Column, Column], DataFrame], need: Column | None = None, include_reason: bool = False) -> DataFrame:
    """`rows` with a stage column, where `need` holds: both verdicts decide, with the probability of the verdict's token if the
    model tells it; a failure passes with llm_error. `asker` takes rows, prompt and need."""
    need = F.lit(True) if need is None else need
    out = asker(rows, judge_prompt(include_reason), need).withColumn("__v", judge_verdict(F.col("reply")))
    right = F.col("__v.is_correct") == 1
    prob = N.verdict_probability(F.col("reply_tokens"), F.col("__v.is_correct"))
    made = scored(F.lit(True), right.cast("double"), F.when(right, F.col("gt_shown")), F.col("__v.reason") if include_reason else None, prob)
    fail = passed(F.concat(F.lit("llm_error: "), F.coalesce("reply_error", F.lit("unparseable reply"))))
    return out.withColumn("stage", F.when(need, F.when(F.col("__v").isNull(), fail).otherwise(made))).drop("reply", "reply_error", "reply_tokens", "__v")


def run_llm_match(rows: DataFrame, asker: Callable[[DataFrame, Column, Column], DataFrame], need: Column | None = None) -> DataFrame:
    """`rows` with a stage column, where `need` holds: a model only names the picked options, for multiple choice, where rules see
    none; a miss passes."""
    need = F.lit(True) if need is None else need
    cand, texts, mcq = F.col("candidates"), F.col("texts"), F.col("qtype") == "mcq"
    several = F.size(F.coalesce("gt_letters", F.array())) > 1
    rows = rows.withColumn("__said", F.when(need & mcq, _as_said(F.col("pred_text"))))
    single = F.coalesce(T.infer_option(F.col("__said"), cand), T.infer_text(F.col("__said"), texts))
    rows = rows.withColumn("__known", F.when(need & mcq, F.when(several, F.col("pred_set")).otherwise(_letters_of(single))))
    out = asker(rows, extract_prompt(), need & mcq & F.col("__known").isNull())
    out = out.withColumn("__up", F.upper("reply")).withColumn("__plain", T.normalize_text(F.col("reply"), unicode=False))
    valid = F.array_append(cand, F.lit("Z"))
    alone = F.filter(T.all_matches(F.col("__up"), r"(?U)\b([A-Z])\b"), lambda x: F.array_contains(valid, x))
    one = F.coalesce(T.infer_option(F.col("__up"), valid), F.try_element_at(alone, F.lit(1)))
    after = T.after_cue(F.col("reply"))
    sets = (F.when(x.isNotNull(), T.letters_of_plain(T.normalize_text(x, unicode=False), cand)) for x in (T.answer_tag(F.col("reply")), after))
    got = F.coalesce("__known", F.when(several, F.coalesce(*sets, T.letters_of_plain(F.col("__plain"), cand))).otherwise(_letters_of(one)))
    gt = F.coalesce("gt_letters", _letters_of(F.coalesce(F.col("gt_robust"), F.upper("gt_plain"))))
    why = F.when(~mcq, "llm-match is for mcq only").when(F.col("reply_error").isNotNull(), F.concat(F.lit("llm_error: "), "reply_error"))
    hit = F.coalesce(got == gt, F.lit(False)) & mcq
    stage = F.when(hit, scored(F.lit(True), matched=F.array_join(gt, ", "))).otherwise(passed(why))
    return out.withColumn("stage", F.when(need, stage)).drop("__said", "__known", "__up", "__plain", "reply", "reply_error", "reply_tokens")


RESULT = ("decided_by", "matched", "score", "is_correct", "status", "reason", "judge_prob")


def grade(rows: DataFrame, protocol: Protocol, make_client: Callable[[], Client] | None = None, trace: bool = False, include_reason: bool = False, replies: dict[str, DataFrame] | None = None, key: str = "eval_id", **ask_options) -> DataFrame:
    """Rows of with_context() with decided_by, matched, score, is_correct, status, reason, judge_prob and, if asked for, trace.

    A null gt or pred, or a blank single gt, is invalid; a blank pred or an empty list is not. Rows keep everything they had. A
    stage that asks a model takes its replies from `replies[stage]` by `key` if that is given (see from_table), else from a client.
    """
    missing = F.col("gt").isNull() | F.col("pred").isNull() | blank(F.col("gt"), F.col("gt_is_list"))
    none = F.lit(None).cast(STAGE)
    rows = rows.withColumn("__fin", F.when(missing, invalid("missing_gt_or_pred")).otherwise(none)).withColumn("__by", F.lit(None).cast("string")).withColumn("__why", F.lit(None).cast("string"))
    rows = rows.withColumn("__trace", F.array().cast(f"array<struct<stage:string,result:{STAGE}>>"))
    knobs = (protocol.numeric_rel_tol, protocol.numeric_abs_tol, protocol.string_match, protocol.anls_threshold)
    for name in protocol.pipeline:
        ran = F.col("__fin").isNull()
        if name in ("rule-match", "llm-match"):
            rows = _reasoned(rows)
        if name in LLM_STAGES:
            table = (replies or {}).get(name)
            if make_client is None and table is None:
                raise ValueError(f"{name} needs a client or a table of replies")
            asker = (lambda r, _, need, t=table: from_table(r, need, t, key)) if table is not None else (lambda r, prompt, need: ask(r, prompt, need, make_client, **ask_options))
            rows = written(rows)
            rows = run_llm_judge(rows, asker, ran, include_reason) if name == "llm-judge" else run_llm_match(rows, asker, ran)
        else:
            rows = rows.withColumn("stage", T.made_once((name, *knobs), lambda n=name: F.when(F.col("__fin").isNull(), RULE_STAGES[n](protocol))))
        done = ran & F.col("stage.outcome").isin("score", "invalid")
        entry = F.struct(F.lit(name).alias("stage"), F.coalesce("stage", passed(F.lit(None))).alias("result"))
        rows = rows.select(
            *(c for c in rows.columns if c not in ("__fin", "__by", "__why", "__trace", "stage")),
            F.when(done, F.col("stage")).otherwise(F.col("__fin")).alias("__fin"),
            F.when(done & (F.col("stage.outcome") == "score"), F.lit(name)).otherwise(F.col("__by")).alias("__by"),
            (F.when(ran & ~done, F.coalesce("stage.reason", "__why")).otherwise(F.col("__why")) if name in LLM_STAGES else F.col("__why")).alias("__why"),
            F.when(ran, F.array_append("__trace", entry)).otherwise(F.col("__trace")).alias("__trace"),
        )
    fin = F.col("__fin")
    decided = F.coalesce(fin["outcome"] == "score", F.lit(False))
    told = (F.when(decided, fin["reason"] if include_reason else F.lit(None).cast("string")).when(fin["outcome"] == "invalid", fin["reason"]), F.col("__why"))
    score = F.when(decided, fin["score"]).otherwise(0.0)
    out = rows.select(
        *(c for c in rows.columns if c not in ("__fin", "__by", "__why", "__trace", "gt_robust", "pred_robust")),
        F.col("__by").alias("decided_by"), F.when(decided, fin["matched"]).alias("matched"), score.alias("score"), (score >= 1.0).cast("int").alias("is_correct"),
        F.when(fin["outcome"] == "invalid", "invalid").otherwise("ok").alias("status"), F.coalesce(*told).alias("reason"), fin["judge_prob"].alias("judge_prob"), F.col("__trace").alias("trace"),
    )
    return out if trace else out.drop("trace")


# Roll-ups.


def _shares() -> list[Column]:
    right, all_rows = F.count_if(F.col("is_correct") == 1), F.count("*")
    valid = all_rows - F.count_if(F.col("status") == "invalid")
    return [
        all_rows.alias("total"), valid.alias("valid"), right.alias("correct"), F.coalesce(F.try_divide(right, all_rows), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(right, valid), F.lit(0.0)).alias("accuracy_valid"),
        F.coalesce(F.avg(F.coalesce("score", (F.col("is_correct") == 1).cast("double"))), F.lit(0.0)).alias("mean_score"), (all_rows - valid).alias("invalid"),
        F.count_if(F.startswith("reason", F.lit("llm_error"))).alias("llm_errors"), F.avg("judge_prob").alias("judge_prob_mean"),
    ]


def summarize(rows: DataFrame) -> DataFrame:
    """One row: total, valid, correct, accuracy over all, accuracy_valid, mean_score, invalid, llm_errors, judge_prob_mean."""
    return rows.agg(*_shares())


def by_stage(rows: DataFrame) -> DataFrame:
    """Totals by deciding stage; rows that none decided, invalid ones too, are undecided."""
    return rows.groupBy(F.coalesce(F.nullif("decided_by", F.lit("")), F.lit("undecided")).alias("stage")).agg(F.count("*").alias("total"), F.count_if(F.col("is_correct") == 1).alias("correct"))


def by_type(rows: DataFrame, column: str = "qtype") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")).alias("question_type")).agg(F.count("*").alias("total"), F.count_if(F.col("is_correct") == 1).alias("correct"))


def report(rows: DataFrame, column: str = "qtype") -> DataFrame:
    """summarize, by_stage and by_type in one pass over the rows: grouping sets; `part` says which a row belongs to."""
    keyed = rows.withColumn("stage", F.coalesce(F.nullif("decided_by", F.lit("")), F.lit("undecided"))).withColumn("question_type", F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown")))
    out = keyed.groupingSets([[F.col("stage")], [F.col("question_type")], []], F.col("stage"), F.col("question_type")).agg(*_shares(), F.grouping_id().alias("g"))
    return out.withColumn("part", F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "stage").otherwise("type")).drop("g")


def accuracy_by(rows: DataFrame, task: str, right: Column) -> DataFrame:
    """Accuracy in percent of each task and, with a null task, of all rows; 0 of none."""
    share = F.coalesce(100 * F.try_divide(F.count_if(right), F.count("*")), F.lit(0.0))
    return rows.rollup(task).agg(F.count("*").alias("total"), share.alias("accuracy"))


def nested_accuracy(rows: DataFrame, sets: Sequence[Sequence[str]], answered: Column, right: Column) -> DataFrame:
    """Accuracy of answered questions over several groupings at once; a column is null where its grouping does not use it."""
    names = list(dict.fromkeys(n for s in sets for n in s))
    flagged = rows.withColumn("__a", answered).withColumn("__r", answered & right)
    out = flagged.groupingSets([[F.col(n) for n in s] for s in sets], *map(F.col, names)).agg(F.count_if("__a").alias("answered"), F.count_if("__r").alias("correct"), F.grouping_id().alias("grouping"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide("correct", "answered"), F.lit(0.0)))


def judged_accuracy(rows: DataFrame, pred: str = "pred", score: str = "score") -> DataFrame:
    """One row: yes share of yes and no verdicts, and mean of scores cut to integers. yes is looked for first."""
    low = F.lower(pred)
    yes, no = F.contains(low, F.lit("yes")), ~F.contains(low, F.lit("yes")) & F.contains(low, F.lit("no"))
    return rows.agg(F.count_if(yes).alias("yes"), F.count_if(no).alias("no"), F.coalesce(F.try_divide(F.count_if(yes), F.count_if(yes) + F.count_if(no)), F.lit(0.0)).alias("accuracy"), F.avg(F.col(score).cast("int")).alias("average_score"))


# Models that answer.


class TooManyFailures(RuntimeError):
    """More rows failed in one pass than its budget allows."""


def respond(rows: DataFrame, prompt: str, make_client: Callable[[], Client], passes: int = 1, budget: int | None = None, **options) -> DataFrame:
    """`rows` with pred (array<string>, one response; null where none came) and response_error.

    Rows without a response are asked again in further passes, each of which may leave at most `budget` failures, counted over all
    rows of the pass; more end the run. A null prompt is not asked for. Options are those of ask().
    """
    rows = rows.withColumn("pred", F.lit(None).cast("array<string>")).withColumn("response_error", F.lit(None).cast("string"))
    for _ in range(max(1, passes)):
        need = F.col("pred").isNull() & F.col(prompt).isNotNull()
        told = ask(rows, F.col(prompt), need, make_client, **options)
        rows = told.withColumn("pred", F.coalesce("pred", F.when(F.col("reply").isNotNull(), F.array("reply")))).withColumn("response_error", F.when(F.col("pred").isNull(), F.coalesce("reply_error", "response_error")))
        rows = rows.drop("reply", "reply_error", "reply_tokens")
        failed = rows.where(need).count()
        if budget is not None and failed > budget:
            raise TooManyFailures(f"{failed} rows failed, {budget} may")
        if not failed:
            break
    return rows

"""Text normalisation and answer extraction as Column builders.

Everything is built-in Spark but `nfkc`, an Arrow UDF, as Spark has no Unicode normalisation; pass unicode=False where the text is
known to be in that form. Letters are arrays of one-character strings; option texts are arrays of struct<letter, text>.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Letters, and replacements made while normalising, in order.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUESTION_TYPES = ("mcq", "yes_no", "numeric", "open")
ARTIFACTS = (("```", " "), ("<|end_of_sentence|>", ""), ("<|end▁of▁sentence|>", ""), ("</s>", ""), ("<CONCLUSION>", ""), ("</CONCLUSION>", ""), ("Falcon: ", ""))
OPERATORS = ("−–—×·÷", "---**/")
NEEDS_WORK = r"(?U)[\\<`|" + OPERATORS[0] + r"]|Falcon: |^\s|\s$|\s\s|[^\S ]"  # what normalize_text looks for
CHOICE_PUNCTUATION = ".()[],:;!*#{}：；，。、！？「」『』（）【】《》"

# Patterns of answers, in Java's syntax.
ANSWER_TAG = r"(?is)<answer\s*>\s*(.*?)\s*</answer\s*>"
STRICT_CUES = (
    r"(?i)^(?:answer|option|choice)\s*[:\-]?\s*(?-i:([A-Z]))(?:[\s\.\),:;]|$)",
    r"(?i)(?:final answer|the answer is|answer is|choice is|option is)\s*[:\-]?\s*(?-i:([A-Z]))(?:[\s\.\),:;]|$)",
)
ANSWER_CUE = (
    r"(?i)(?:final answer|the answer is|answer is|answer\s*:|option is|(?:the\s+)?correct\s+(?:option|answer|choice)(?:\s+is)?|最终答案|答案|选)\s*[:\-：]?\s*"
    r"[\(（\*]{0,4}(?-i:([A-Z]))[\)）\*]{0,4}(?:[\s\.\),:;、，。]|$)"
)
CUE_TAIL = r"(?i)(?:final answer|the answer is|answer is|answer\s*[:\-：]|option is|choice is)\s*[\(（\*]{0,4}([A-Za-z])[\)）\*]{0,4}\s*[\.。!！]?\s*$"
BOXED_LETTER = r"\\boxed\{\s*(?:\\[a-zA-Z]+\s*\{\s*)?[\(\*]*\s*([A-Za-z])"
HEAD_LABEL = r"^\s*\*{0,2}\(?([A-Z])\)?\s*[:\.\)]\s"
BOLD_LABEL = r"\*\*\s*\(?([A-Z])\)?\s*[:\.]"
MULTI_CUE = r"(?i)(?:final answers?|the answers? (?:are|is)|answers? (?:are|is)|answers?\s*[:\-：]|最终答案|答案)"
GT_LABEL = r"[()\[\].:;\s\*]"
SEPARATOR = r"(?i)[,;/&\s]+|\band\b"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC; null stays null."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_each(values: pd.Series) -> pd.Series:
    """nfkc of each element."""
    return values.map(lambda row: row if row is None else [v if v is None else unicodedata.normalize("NFKC", v) for v in row])


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often `use` names it. Outside generated code: over many rows, make the value
    a column of its own first and call the form that takes it (open_of_plain, parse_number_text and so on)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_MADE: dict = {}


def made_once(key: tuple, make):
    """make(), kept under `key` for as long as the Spark context that its columns belong to: a long expression is some hundred calls to
    the JVM."""
    context = SparkContext._active_spark_context
    if context is None:
        return make()
    if _MADE.get("context") is not context:
        _MADE.clear()
        _MADE["context"] = context
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.try_element_at(all_matches(c, pattern, group), F.lit(1))


def letters(n: int = 26) -> Column:
    return F.array(*map(F.lit, ALPHABET[:n]))


def to_text(values: Column) -> Column:
    """The first element of an array<string>; empty for null or an empty array."""
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))


def boxed(c: Column) -> Column:
    r"""What the first \boxed{ holds, braces balanced; the whole text if there is none or it never closes."""
    return F.when(F.contains(c, F.lit("\\boxed{")), let(c, _boxed)).otherwise(c)


def _boxed(c: Column) -> Column:
    marker = "\\boxed{"
    tail = F.split(F.substring(c, F.instr(c, marker) + len(marker), F.length(c)), "")
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, ch: Column) -> Column:
        depth = F.when(s["depth"] == 0, 0).when(ch == "{", s["depth"] + 1).when(ch == "}", s["depth"] - 1).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when((s["depth"] == 0) | (depth == 0), s["out"]).otherwise(F.concat(s["out"], ch)).alias("out"))

    closed = lambda found: F.when(found["depth"] == 0, strip(found["out"])).otherwise(c)
    return let(F.aggregate(tail, start, step), closed)


def normalize_text(c: Column, lower: bool = False, extract_boxed: bool = True, strip_latex: bool = True, unicode: bool = True) -> Column:
    """Syntax only: NFKC, boxed content, thinking tags, inference artifacts, light LaTeX, operators, white space. Null is empty.

    Texts without any character that a step looks for, most of them, pass one test instead of the steps.
    """
    t = F.coalesce(c, F.lit(""))
    t = nfkc(t) if unicode else t
    marked = boxed(t) if extract_boxed else t
    marked = F.regexp_replace(marked, r"(?i)</?(?:think|answer)\s*>", " ")
    for old, new in ARTIFACTS:
        marked = F.replace(marked, F.lit(old), F.lit(new))
    if strip_latex:
        marked = F.regexp_replace(marked, r"\\(?:left|right|displaystyle|mathrm|textbf|textit|text)\b", " ")
        marked = F.regexp_replace(marked, r"\\(?:,|;|!|:)", " ")
        marked = F.replace(marked, F.lit("\\%"), F.lit("%"))
    marked = collapse(F.translate(marked, *OPERATORS))
    t = F.when(t.rlike(NEEDS_WORK), marked).otherwise(t)
    return F.lower(t) if lower else t


def normalize_exact(c: Column, unicode: bool = True) -> Column:
    return normalize_text(c, lower=True, unicode=unicode)


def normalize_open(c: Column, unicode: bool = True) -> Column:
    """normalize_exact without wrapping quotes and closing punctuation."""
    return let(normalize_exact(c, unicode), open_of_plain)


def open_of_plain(plain: Column) -> Column:
    """normalize_open of a text that is in its normal form."""
    t = F.regexp_replace(F.regexp_replace(F.lower(plain), "^[\"'`]+|[\"'`]+$", ""), r"[\.。!！?？]+$", "")
    return F.when(plain.rlike("^[\"'`]|[\"'`.。!！?？]$"), collapse(t)).otherwise(F.lower(plain))


def _contiguous(found: Column, n: int = 8) -> Column:
    """Letters A, B, ... as long as each is in `found`."""
    alphabet = letters(n)
    return F.filter(alphabet, lambda x, i: F.forall(F.slice(alphabet, 1, i + 1), lambda y: F.array_contains(found, y)))


def question_letters(question: Column) -> Column:
    """Option labels inside a question, "(A)" or "A." at a token's beginning: the run from A on."""
    q = F.coalesce(question, F.lit(""))
    return _contiguous(F.array_union(all_matches(q, r"\(([A-H])\)"), all_matches(q, r"(?:^|[\n\s])([A-H])[\.\):]")))


def are_letters(choices: Column) -> Column:
    return (F.size(choices) > 0) & F.forall(choices, lambda c: F.upper(strip(c)).rlike("^[A-Z]$"))


def choices_to_letters(choices: Column) -> Column:
    """The choices themselves if all are single letters, else A, B, ... by position."""
    return F.when(are_letters(choices), F.transform(choices, lambda c: F.upper(strip(c)))).otherwise(F.slice(letters(), 1, F.size(choices)))


def strip_letter_prefix(text: Column, letter: Column) -> Column:
    r"""The rest of "B. text" when its letter is `letter`."""
    pattern = r"^\s*([A-Z])\s*[\.\):]\s*(.+)$"
    return F.when(first_match(text, pattern) == letter, strip(first_match(text, pattern, 2))).otherwise(text)


def flat_letter_options(columns: Iterable[tuple[str, Column]]) -> Column:
    """struct<letter, text> of per-letter columns, up to the first null or blank one."""
    pairs = F.array(*(F.struct(F.lit(k).alias("letter"), v.cast("string").alias("text")) for k, v in columns))
    return F.filter(pairs, lambda x, i: F.forall(F.slice(pairs, 1, i + 1), lambda y: y["text"].isNotNull() & (strip(y["text"]) != "")))


def nonempty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def parsed_options(options: Column, choices: Column, flat: Column, question: Column, prompt: Column) -> Column:
    """Candidate letters from option pairs, choices, per-letter columns or the question (else the prompt); null without any."""
    text = F.when(F.coalesce(question, F.lit("")) != "", question).otherwise(prompt)
    return F.coalesce(
        F.transform(nonempty(options), lambda o: F.upper(strip(o["letter"]))), choices_to_letters(nonempty(choices)), F.transform(nonempty(flat), lambda o: o["letter"]), nonempty(question_letters(text))
    )


def candidate_options(parsed: Column) -> Column:
    """The parsed letters, else A to F."""
    return F.coalesce(parsed, letters(6))


def option_texts(options: Column, choices: Column, flat: Column) -> Column:
    """Letter and text of each option, from the first source that has texts."""
    named = F.transform(nonempty(options), lambda o: F.struct(F.upper(strip(o["letter"])).alias("letter"), o["text"].alias("text")))
    placed = F.zip_with(F.slice(choices, 1, 26), F.slice(letters(), 1, F.size(choices)), lambda c, k: F.struct(k.alias("letter"), strip_letter_prefix(c, k).alias("text")))
    valued = F.when((F.size(choices) > 0) & ~are_letters(choices), placed)
    return F.coalesce(named, valued, nonempty(flat), F.array().cast("array<struct<letter:string,text:string>>"))


def widen_options(candidates: Column, gt: Column) -> Column:
    """The candidates, or A to the greatest letter seen if a ground-truth letter is missing from them."""
    seen = F.transform(F.array_union(candidates, gt), lambda x: F.instr(F.lit(ALPHABET), x))
    return F.when(F.size(F.array_except(gt, candidates)) > 0, F.slice(letters(), 1, F.array_max(seen))).otherwise(candidates)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(strip(c), SEPARATOR), lambda t: t != "")


def gt_letters(gt: Column, is_list: Column) -> Column:
    """Sorted letters of a ground truth: one bare letter, or two and more separated ones of A to H; null otherwise and for lists."""
    bare = F.upper(F.regexp_replace(gt, GT_LABEL, ""))
    tokens = F.transform(_tokens(gt), F.upper)
    several = (F.size(tokens) >= 2) & F.forall(tokens, lambda t: t.rlike("^[A-H]$")) & (F.size(F.array_distinct(tokens)) == F.size(tokens))
    return F.when(F.coalesce(is_list, F.lit(False)), F.lit(None)).when(bare.rlike("^[A-Z]$"), F.array(bare)).when(several, F.array_sort(tokens))


def parse_number_text(t: Column) -> Column:
    """A number that makes up all of an open-normalised text; a closing % divides by 100; null otherwise."""
    plain = F.replace(t, F.lit(","), F.lit(""))
    percent = F.endswith(plain, F.lit("%"))
    value = _plain_number(F.when(percent, strip(F.regexp_replace(plain, "%+$", ""))).otherwise(plain))
    return F.when(t.rlike(r"^[\d.,_eE+\-% naifty]+$"), F.when(percent, value / 100.0).otherwise(value))


def _plain_number(t: Column) -> Column:
    plain = t.rlike(r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
    named = F.when(t.rlike("(?i)^[+-]?nan$"), F.lit(float("nan"))).when(t.rlike(r"(?i)^\+?inf(inity)?$"), F.lit(float("inf"))).when(t.rlike("(?i)^-inf(inity)?$"), F.lit(float("-inf")))
    return F.when(plain, F.replace(t, F.lit("_"), F.lit("")).try_cast("double")).otherwise(named)


def parse_number(c: Column, unicode: bool = True) -> Column:
    return let(normalize_open(c, unicode), parse_number_text)


def yes_no_text(normal: Column) -> Column:
    """yes or no if exactly one of the two words occurs in a lower-cased text."""
    words = all_matches(normal, "[a-z]+", 0)
    yes, no = F.array_contains(words, "yes"), F.array_contains(words, "no")
    return F.when(yes & ~no, "yes").when(no & ~yes, "no")


def extract_yes_no(c: Column, unicode: bool = True) -> Column:
    return yes_no_text(normalize_text(c, lower=True, unicode=unicode))


def infer_question_type(forced: str, declared: Column, gt: Column, is_list: Column, unicode: bool = True) -> Column:
    """Forced type, else a declared one of the four, else by the shape of the ground truth, else mcq."""
    norm = normalize_open(gt, unicode)
    return question_type_of(forced, declared, gt, norm, gt_letters(gt, is_list), parse_number_text(norm))


def question_type_of(forced: str, declared: Column, gt: Column, norm: Column, bare: Column, number: Column) -> Column:
    """infer_question_type from the ground truth's open form, its letters and its number."""
    if forced.strip().lower() in QUESTION_TYPES:
        return F.lit(forced.strip().lower())
    field = F.lower(strip(F.coalesce(declared, F.lit(""))))
    by_shape = F.when(norm.isin("yes", "no"), "yes_no").when(bare.isNotNull(), "mcq").when(number.isNotNull(), "numeric").when(F.regexp_replace(gt, GT_LABEL, "") != "", "open").otherwise("mcq")
    return F.when(field.isin(*QUESTION_TYPES), field).when(gt.isNotNull(), by_shape).otherwise("mcq")


def answer_tag(text: Column) -> Column:
    """What the last <answer> tag holds; null without one."""
    return last(all_matches(text, ANSWER_TAG))


def after_cue(text: Column) -> Column:
    """What follows the last answer cue; null without one."""
    return F.when(text.rlike(MULTI_CUE), last(F.split(text, MULTI_CUE, -1)))


def option_strict(clean: Column, candidates: Column) -> Column:
    """One letter from a normalised answer that is bare, labelled ("B. ...") or cued."""
    upper, head = F.upper(clean), F.upper(F.substring(clean, 1, 1))
    found = F.coalesce(
        F.filter(F.array(upper, F.when(clean.rlike(r"^\p{Lu}[.):]"), head), *(first_match(clean, p) for p in STRICT_CUES)), lambda c: F.array_contains(candidates, c)),
        F.array().cast("array<string>"),
    )
    return F.try_element_at(found, F.lit(1))


def infer_option(answer: Column, candidates: Column) -> Column:
    """The one candidate among the answer's tokens, if among the last five or alone in an answer of at most five. Case counts."""
    spaced = F.translate(answer, CHOICE_PUNCTUATION, " " * len(CHOICE_PUNCTUATION))
    tokens = F.filter(F.split(spaced, r"(?U)\s+"), lambda t: t != "")
    one = F.array(F.struct(tokens.alias("t")))  # names the tokens for the expression below

    def pick(x: Column) -> Column:
        present = F.filter(candidates, lambda c: F.array_contains(x["t"], c))
        return F.filter(present, lambda c: (F.size(present) == 1) & ((F.array_position(x["t"], c) - 1 > F.size(x["t"]) - 5) | (F.size(x["t"]) <= 5) & (F.size(F.filter(x["t"], lambda t: t == c)) == 1)))

    return F.try_element_at(F.flatten(F.transform(one, pick)), F.lit(1))


def infer_text(answer: Column, texts: Column) -> Column:
    """The option whose text alone occurs in the answer, if the answer is no longer than twice all option texts."""
    low = F.lower(answer)
    total = F.aggregate(texts, F.lit(0), lambda a, o: a + F.length(o["text"]))
    held = F.filter(texts, lambda o: (F.length(o["text"]) > 0) & F.contains(low, F.lower(strip(o["text"]))))
    return F.when((F.length(low) <= 2 * total) & (F.size(held) == 1), F.try_element_at(held, F.lit(1))["letter"])


def option_robust(raw: Column, plain: Column, tag: Column, candidates: Column, texts: Column) -> Column:
    """One letter from free reasoning, by the first rule that gives one: bare letter, last <answer> tag, last boxed letter, last cue,
    closing lower-case cue, token position, leading label of a short answer, the only bold label, option text.

    raw, plain and tag are the answer, its normal form and answer_tag() of it.
    """
    known = lambda found: F.filter(F.transform(found, F.upper), lambda x: F.array_contains(candidates, x))
    first = lambda found: F.try_element_at(known(found), F.lit(1))
    bold = F.array_distinct(known(all_matches(raw, BOLD_LABEL)))
    whole = strip(F.regexp_replace(plain, r"^[\(\[]|[\)\]\.]$", ""))
    return F.coalesce(
        first(F.array(whole, strip(tag))),
        infer_option(strip(tag), candidates),
        infer_text(strip(tag), texts),
        last(known(all_matches(raw, BOXED_LETTER))),
        last(known(all_matches(raw, ANSWER_CUE))),
        first(F.slice(all_matches(raw, CUE_TAIL), 1, 1)),
        infer_option(raw, candidates),
        F.when(F.length(strip(raw)) <= 80, first(F.slice(all_matches(raw, HEAD_LABEL), 1, 1))),
        F.when(F.size(bold) == 1, F.try_element_at(bold, F.lit(1))),
        infer_text(raw, texts),
    )


def letters_of_plain(plain: Column, candidates: Column) -> Column:
    """Sorted letters of a normalised text made of candidates and separators only, also written together ("AC"); null otherwise."""
    parts = F.transform(_tokens(F.regexp_replace(plain, r"[.。]+$", "")), lambda t: F.filter(F.split(F.upper(t), ""), lambda c: c != ""))
    one = F.array(F.struct(parts.alias("p")))

    def check(x: Column) -> Column:
        good = F.forall(x["p"], lambda p: F.forall(p, lambda c: F.array_contains(candidates, c)) & ((F.size(p) == 1) | (F.size(p) <= F.size(candidates)) & (F.size(F.array_distinct(p)) == F.size(p))))
        flat = F.flatten(x["p"])
        return F.when(good & (F.size(flat) > 0) & (F.size(F.array_distinct(flat)) == F.size(flat)), F.array_sort(flat))

    return F.when(plain.isNotNull(), F.try_element_at(F.transform(one, check), F.lit(1)))


# Placeholders and media.

# Endings of video files.
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv", ".wmv", ".m4v")


def placeholders(c: Column) -> Column:
    """image and video for each <image> or <video>, in order."""
    return all_matches(F.coalesce(c, F.lit("")), "<(video|image)>")


def question_with_media(question: Column, count: Column) -> Column:
    """Numbered placeholders renamed to <image> if as many as media, else all removed and as many put in front."""
    pattern = r"(?i)<image[ _]?\d*>"
    same = F.regexp_count(question, F.lit(pattern)) == count
    bare = strip(F.regexp_replace(question, pattern, ""))
    return F.when(same, F.regexp_replace(question, pattern, "<image>")).otherwise(F.concat(F.repeat(F.lit("<image>"), count), bare))


def media_paths(image_url: Column, image: Column) -> Column:
    """image_url before image; a list literal is read as a list."""
    raw = F.coalesce(image_url, image)
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(strip(raw).rlike(r"^\[.*\]$") & listed.isNotNull(), listed).otherwise(F.array(raw))


def split_chunks(c: Column) -> Column:
    """Text and placeholder pieces in order, blank text dropped."""
    return F.filter(F.split(c, r"(?=<(?:image|video)>)|(?<=<image>)|(?<=<video>)"), lambda x: strip(x) != "")


def is_video(path: Column, extensions: tuple[str, ...] = VIDEO_EXTENSIONS) -> Column:
    """By extension, without query string."""
    return F.lower(F.regexp_extract(F.substring_index(path, "?", 1), r"(\.[A-Za-z0-9]+)$", 1)).isin(*extensions)


def normalize_image_refs(c: Column) -> Column:
    return F.regexp_replace(c, r"<image\s*\d+>", "<image>")


def flat_text(parts: Column, depth: int = 1) -> Column:
    """All texts of lists nested `depth` deep, one after the other; nulls are empty."""
    for _ in range(depth - 1):
        parts = F.flatten(F.filter(parts, lambda x: x.isNotNull()))
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def sanitize_id(c: Column) -> Column:
    return F.translate(c.cast("string"), "/", "_")


# Choice answers of video benchmarks.

# Prefixes removed from an answer (two of them run together, as they stand in the public code), and words for digits.
CHOICE_PREFIXES = ("The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:")
DIGIT_WORDS = (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four"), ("5", "five"), ("6", "six"), ("7", "seven"), ("8", "eight"), ("9", "nine"))


def video_choice(c: Column) -> Column:
    """First A to D after known prefixes are removed; empty if none is there."""
    t = strip(F.coalesce(c, F.lit("")))
    for prefix in CHOICE_PREFIXES:
        t = F.replace(t, F.lit(prefix), F.lit(""))
    return F.regexp_extract(t, "([ABCD])", 1)


def choice_index(answer: Column, options: Column, digits: bool = False, default: int = 2) -> Column:
    """0-based choice: first letter after "answer" is removed, else the first option whose text occurs, else `default`."""
    t = F.replace(F.replace(F.coalesce(answer, F.lit("")), F.lit("answer"), F.lit("")), F.lit("Answer"), F.lit(""))
    letter = F.instr(F.lit("ABCDE"), first_match(t, r"\(?([A-E])\)?"))
    low = F.lower(t)
    match = lambda o: F.contains(low, F.lower(F.regexp_replace(o, r"\.$", "")))
    if digits:
        for d, w in DIGIT_WORDS:
            low = F.replace(low, F.lit(d), F.lit(w))
    held = F.transform(options, lambda o: match(o))
    return F.coalesce(F.when(letter > 0, letter - 1), F.when(F.array_contains(held, True), F.array_position(held, True).cast("int") - 1), F.lit(default))


@F.pandas_udf(StringType())
def longest_repeat(values: pd.Series) -> pd.Series:
    """The longest substring that occurs twice without overlap; the first of equals; empty without one."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        low, high, best = 1, len(text) // 2, ""
        while low <= high:
            n, seen, hit = (low + high) // 2, {}, ""
            for i in range(len(text) - n + 1):
                j = seen.setdefault(text[i : i + n], i)
                if i - j >= n:
                    hit = text[i : i + n]
                    break
            if hit:
                best, low = hit, n + 1
            else:
                high = n - 1
        return best

    return values.map(one)

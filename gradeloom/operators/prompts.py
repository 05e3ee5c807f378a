"""Prompt rendering, and media against placeholders."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def option_lines(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat_ws(". ", o["letter"], o["text"])), "\n")


def default_prompt(question: Column, options: Column, hint: Column) -> Column:
    """Question, then "Options:" with lines and "Hint:" where there are any."""
    shown = F.when(F.size(options) > 0, F.concat(F.lit("\nOptions:\n"), option_lines(options))).otherwise("")
    told = F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit("\nHint: "), hint)).otherwise("")
    return F.concat(F.coalesce(question, F.lit("")), shown, told)


def mcq_prompt(question: Column, options: Column, hint: Column) -> Column:
    """Hint first, then question and options, and the request for a letter."""
    told = F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit("Hint: "), hint, F.lit("\n"))).otherwise("")
    shown = F.when(F.size(options) > 0, F.concat(F.lit("\nOptions:\n"), option_lines(options), F.lit("\nPlease select the correct answer from the options above."))).otherwise("")
    return F.concat(told, F.lit("Question: "), F.coalesce(question, F.lit("")), shown)


def indexed_prompt(question: Column, options: Column) -> Column:
    """For questions about several images: options as "(A) text" lines and the request for a letter, else for a word or phrase."""
    lines = F.array_join(F.transform(options, lambda o: F.concat(F.lit("("), o["letter"], F.lit(") "), o["text"], F.lit("\n"))), "")
    chosen = F.concat(F.lit("\n\n"), lines, F.lit("\nAnswer with the option's letter from the given choices directly."))
    return F.concat(F.coalesce(question, F.lit("")), F.when(F.size(options) > 0, chosen).otherwise("\n\nAnswer the question using a single word or phrase."))


def images_by_reference(texts: Column, images: Column) -> Column:
    """The images that <image k> in `texts` (array<string>) name, in order, out of `images` (image_1, image_2, ...); all that there are
    without any reference; null if one is named that is not there."""
    numbers = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"<image\s*(\d+)>"), F.lit(1))))
    found = F.transform(numbers, lambda k: F.when(k.cast("long").between(1, F.size(images)), F.try_element_at(images, k.cast("int"))))
    return F.when(F.size(numbers) == 0, F.array_compact(images)).when(F.forall(found, lambda x: x.isNotNull()), found)


def choose_prompt(user: Column | None, existing: Column, dataset: Column | None, default: Column) -> Column:
    """A user template wins; else a prompt already there, else the dataset's template, else the default."""
    if user is not None:
        return user
    made = existing.isNotNull() & (existing != "")
    return F.when(made, existing).otherwise(default if dataset is None else dataset)


def with_prefix(prompt: Column, prefix: str) -> Column:
    return F.when(F.contains(prompt, F.lit(prefix)), prompt).otherwise(F.concat(F.lit(prefix), prompt))


_TAG = re.compile(r"\{\{\s*(\w+(?:\.\w+)?)\s*\}\}|\{%\s*(if|for|endif|endfor)\s*([^%]*?)\s*%\}")


def compile_template(source: str) -> list:
    """A template of {{ name }}, {% if name %} and {% for k, v in name %} as nested lists."""
    root: list = []
    stack, at = [root], 0
    for m in _TAG.finditer(source):
        stack[-1].append(source[at : m.start()])
        at = m.end()
        name, word, rest = m.groups()
        if name:
            stack[-1].append(("value", name))
        elif word in ("if", "for"):
            body: list = []
            stack[-1].append((word, rest, body))
            stack.append(body)
        else:
            stack.pop()
            if not stack:
                raise ValueError(f"{word} without a beginning")
    if len(stack) > 1:
        raise ValueError("a block is not closed")
    root.append(source[at:])
    return root


def render(nodes: list, values: dict) -> str:
    out = []
    for node in nodes:
        if isinstance(node, str):
            out.append(node)
        elif node[0] == "value":
            v = values.get(node[1])
            out.append("" if v is None else str(v))
        elif node[0] == "if":
            if values.get(node[1]):
                out.append(render(node[2], values))
        else:
            names, _, source = node[1].partition(" in ")
            names = [n.strip() for n in names.split(",")]
            items = values.get(source.strip().removesuffix(".items()")) or []
            for item in items.items() if isinstance(items, dict) else items:
                row = item if len(names) > 1 else (item,)
                out.append(render(node[2], values | dict(zip(names, row, strict=False))))
    return "".join(out)


def template_column(nodes: list, fields: dict[str, Column], options: frozenset[str]) -> Column:
    """A compiled template as one expression: values and conditions over fields, loops over `options` (struct<letter, text>) ones."""
    parts = []
    for node in nodes:
        if isinstance(node, str):
            parts.append(F.lit(node))
        elif node[0] == "value":
            parts.append(F.coalesce(fields[node[1]].cast("string"), F.lit("")) if node[1] in fields else F.lit(""))
        elif node[0] == "if":
            c = fields.get(node[1])
            if c is not None:
                some = F.size(c) > 0 if node[1] in options else F.coalesce(c.cast("string"), F.lit("")) != ""
                parts.append(F.when(some, template_column(node[2], fields, options)).otherwise(""))
        else:
            names, _, source = node[1].partition(" in ")
            letter, text = (n.strip() for n in names.split(","))
            parts.append(F.coalesce(F.array_join(F.transform(fields[source.strip().removesuffix(".items()")], _loop(node[2], letter, text, fields, options)), ""), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _loop(body: list, letter: str, text: str, fields: dict[str, Column], options: frozenset[str]):
    return lambda o: template_column(body, {**fields, letter: o["letter"], text: o["text"]}, options - {letter, text})


def _plain(nodes: list, fields: dict[str, Column], options: frozenset[str]) -> bool:
    """Whether a template stays within what template_column() can say."""
    for node in nodes:
        if isinstance(node, tuple) and node[0] == "for":
            names, _, source = node[1].partition(" in ")
            if len(names.split(",")) != 2 or source.strip().removesuffix(".items()") not in options:
                return False
        if isinstance(node, tuple) and len(node) > 2 and not _plain(node[2], fields, options):
            return False
        if isinstance(node, tuple) and node[0] == "value" and ("." in node[1] or node[1] in options):
            return False
    return True


def template_prompt(source: str, fields: dict[str, Column], options: tuple[str, ...] = ()) -> Column:
    """A user template over named columns. Where its loops run over fields named in `options` (struct<letter, text>) and all else
    are texts, it becomes one expression of the JVM; other templates are rendered by an Arrow UDF."""
    nodes, names = compile_template(source), list(fields)
    if _plain(nodes, fields, frozenset(options)):
        return template_column(nodes, fields, frozenset(options))

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        def plain(v):
            if hasattr(v, "tolist"):
                v = v.tolist()
            if isinstance(v, list) and v and isinstance(v[0], dict) and set(v[0]) == {"letter", "text"}:
                return {x["letter"]: x["text"] for x in v}
            return v

        return pd.Series([render(nodes, {n: plain(v) for n, v in zip(names, row, strict=True)}) for row in rows[names].itertuples(index=False, name=None)])

    return run(F.struct(*(c.alias(n) for n, c in fields.items())))


def media_paths(media: Column, folder: str) -> Column:
    """Paths below `folder`; absolute ones and URLs stay."""
    return F.transform(media, lambda m: F.when(m.rlike(r"^(/|[a-z]+://)"), m).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), m)))


def message_media(rows: DataFrame, key: str, order: str, text: str, media: str, strict: bool = False) -> DataFrame:
    """For one row per message: n_placeholders, media_offset (those of earlier messages), media_slice and media_error.

    media is the sample's whole list, repeated on each of its rows. The error names too few media, or at the last message too many;
    with `strict` such a row raises when it is read.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum("n_placeholders").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_placeholders").over(Window.partitionBy(key))
    out = rows.withColumn("n_placeholders", F.size(T.placeholders(F.col(text)))).withColumn("media_offset", before).withColumn("__t", total)
    out = out.withColumn("media_slice", F.slice(F.col(media), F.col("media_offset") + 1, F.col("n_placeholders")))
    error = F.when(F.col("media_offset") + F.col("n_placeholders") > F.size(media), "too few media").when(F.col("__t") < F.size(media), "too many media")
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(F.concat(error, F.lit(" for "), F.col(key).cast("string"))).cast("string"))
    return out.withColumn("media_error", error).drop("__t")


def rotated_options(options: Column, by: int) -> Column:
    """Option texts moved round by `by` letters, letters staying: an extension for circular evaluation."""
    n = F.size(options)
    return F.transform(options, lambda o, i: F.struct(o["letter"].alias("letter"), F.element_at(options, F.pmod(i + by, n) + 1)["text"].alias("text")))

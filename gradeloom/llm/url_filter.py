"""URL filter: pattern rules found through their rarest literal token.

A rule is a regular expression with the literal tokens that any URL it matches must hold. The tokens of all rules are counted
over the whole URL table; each rule is filed under its rarest one. Every row is then judged where it stands: its URL's own tokens
fetch candidate rules from that index, and only those rules' expressions run. No URL is shuffled; the counts are one row a token.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_RULES = 100_000  # the index goes to every worker


@dataclass(frozen=True)
class UrlRule:
    """name: as reported; pattern: searched in the lower-cased host and the path, one after the other; tokens: literals of a-z and 0-9
    that any match must hold between other characters, lower-cased (none: the rule is tried on every URL); rank: the highest fitting rule wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = True


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", text.lower()) if t))


def place_rule(name: str, verdict: str) -> UrlRule:
    """A rule for a host with its subdomains and the beginning of a path, as in "example.com/en/"; longer names win."""
    host, slash, path = name.partition("/")  # a host holds no slash, and a path begins with one
    return UrlRule(name, verdict, r"\A(?:[^/]*\.)?" + re.escape(host) + (re.escape(slash + path) if slash else r"(?:/|\Z)"), tokens_of(host), 1000 + len(name))


# Listed places, in the order of the contract.
PLACES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# Word patterns of this method: a host or path token that marks spam, gambling, adult or piracy sites.
BAD_WORDS = ("spam", "casino", "porn", "xxx", "viagra", "warez", "torrent", "phishing", "malware", "betting", "escort", "payday")


def bad_word_rule(word: str) -> UrlRule:
    return UrlRule(f"word:{word}", "block", r"(?i)(?:^|[^a-z0-9])" + word + r"(?:[^a-z0-9]|$)", (word,), 1, listed=False)


DEFAULT_RULES = tuple(place_rule(name, verdict) for verdict, name in PLACES) + tuple(map(bad_word_rule, BAD_WORDS))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rarest_tokens(urls: DataFrame, rules: Sequence[UrlRule]) -> dict[str, list[int]]:
    """The rules' numbers under the token of theirs that the fewest rows of `urls` (host, path) hold; under "" those without tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {"": list(range(len(rules)))}
    asked = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string"))  # the tokens of MAX_RULES rules at most
    tokens = F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))
    seen = {r.token: r["count"] for r in urls.select(F.explode(tokens).alias("token")).join(asked, "token").groupBy("token").count().collect()}
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (seen.get(t, 0), t), default=""), []).append(i)
    return index


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule] = DEFAULT_RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of `pages`, then host, path, rule, verdict and pattern_rule.

    The highest fitting rule gives the verdict, else `default` does. rule is the name of the highest listed rule, or null;
    pattern_rule that of the highest rule of any kind. Ties of rank go to the smaller name. A null or odd URL has an empty
    host and path, and a URL of any length is read whole. Repeated rows are judged each; an empty table gives an empty one; columns
    of the new names are replaced. At most MAX_RULES rules; what the driver holds is they and one count for each of their tokens.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    base = pages.drop("host", "path", "rule", "verdict", "pattern_rule")
    named = base.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    index = rarest_tokens(named.select("host", "path"), rules)
    columns = named.columns

    def work(batches):
        patterns: dict[int, re.Pattern] = {}
        order = {i: k for k, i in enumerate(sorted(range(len(rules)), key=lambda i: (-rules[i].rank, rules[i].name)))}
        always, split = index.get("", []), re.compile("[^a-z0-9]+")
        for batch in batches:
            out: list[tuple] = []
            for host, path in zip(batch.column(columns.index("host")).to_pylist(), batch.column(columns.index("path")).to_pylist(), strict=True):
                text, rule, best = host + path, None, None
                asked = {i for t in set(split.split(text.lower())) if t for i in index.get(t, ())}.union(always)
                for i in sorted(asked, key=order.__getitem__):
                    if i not in patterns:
                        patterns[i] = re.compile(rules[i].pattern)
                    if patterns[i].search(text):
                        best = best or rules[i]
                        if rules[i].listed:
                            rule = rules[i].name
                            break
                out.append((rule, best.verdict if best else default, best.name if best else None))
            told = [pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*columns, "rule", "verdict", "pattern_rule"])

    return named.mapInArrow(work, StructType([*named.schema.fields, *StructType.fromDDL("rule string, verdict string, pattern_rule string").fields]))

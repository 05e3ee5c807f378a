"""Soft-membership mixing of documents to target domain weights, in DataFrame functions only.

A naive Bayes classifier over hashed words, counted on a bounded sample of a labelled table, gives every document its domain
posteriors; the log-likelihoods are averaged over the text and weighed as `evidence` words, so that mixed texts stay between
domains. Nonnegative rates r then minimise the squared distance between the expected domain token totals sum(r * tokens *
posterior) and the targets, in the metric of the domains' token covariance, by projected gradient steps. A step needs one
distributed sum per domain; only these few numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

BUCKETS = 4096
WORDS = r"[ \t\n\x0B\f\r]+"


def words_of(text: Column) -> Column:
    """Whitespace-separated words, lower-cased; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000) -> list[float]:
    """Log-probabilities of each bucket in each domain, at bucket * len(domains) + domain.

    Counts come from at most `max_rows` labelled documents, those with the smallest hashes of id; null domains, null ids and
    domains that are not asked for are no labels. Without labelled words all domains are alike.
    """
    import math

    rows = labelled.select(F.col(id_col).alias("__id"), F.col("domain")).where(F.col("domain").isin(domains) & F.col("__id").isNotNull())
    rows = F.broadcast(rows.orderBy(F.xxhash64("__id"), "__id", "domain").limit(max_rows))  # max_rows ids and labels
    words = docs.join(rows, F.col(id_col) == F.col("__id")).select("domain", F.explode(words_of(F.col(text_col))).alias("w"))
    counts = {(r.domain, r.b): r["count"] for r in words.groupBy("domain", _bucket(F.col("w")).alias("b")).count().collect()}  # BUCKETS rows a domain
    total = {d: sum(counts.get((d, b), 0) for b in range(BUCKETS)) for d in domains}
    return [math.log((counts.get((d, b), 0) + 0.5) / (total[d] + 0.5 * BUCKETS)) for b in range(BUCKETS) for d in domains]


def with_posteriors(docs: DataFrame, model: list[float], domains: list[str], text_col: str = "text", evidence: int = 20) -> DataFrame:
    """`docs` with mix_tokens (words of the text) and mix_posterior (an array in the order of `domains`, sum 1)."""
    k = len(domains)
    table = F.split(F.lit(",".join(f"{x:.3f}" for x in model)), ",").cast("array<double>")  # folded to one literal
    at = F.transform(words_of(F.col(text_col)), lambda w: _bucket(w) * k)
    start = F.struct(*(F.lit(0.0).alias(f"s{i}") for i in range(k)))
    sums = F.aggregate("__at", start, lambda s, b: F.struct(*((s[f"s{i}"] + F.get(table, b + i)).alias(f"s{i}") for i in range(k))))
    out = docs.withColumn("__at", at).withColumn("mix_tokens", F.size("__at").cast("long")).withColumn("__s", sums).drop("__at")
    weight = F.least(F.col("mix_tokens"), F.lit(evidence)) / F.greatest(F.col("mix_tokens"), F.lit(1))
    logs = F.array(*(F.col(f"__s.s{i}") * weight for i in range(k)))
    out = out.withColumn("__l", logs).withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("mix_posterior", F.transform("__e", lambda x: x / total)).drop("__s", "__l", "__e")


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gauss elimination with pivots, for a matrix of domains by domains."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(rows[r][c]))
        rows[c], rows[p] = rows[p], rows[c]
        for r in range(n):
            if r != c and rows[c][c]:
                f = rows[r][c] / rows[c][c]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [rows[i][n] / rows[i][i] if rows[i][i] else 0.0 for i in range(n)]


def _rate(steps: list[list[float]], least: float) -> Column:
    """The rate after all steps: each adds posterior . step and projects onto rates of `least` or more."""
    r = F.lit(1.0)
    if steps:
        dot = lambda s: F.aggregate(F.zip_with("mix_posterior", s, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        r = F.aggregate(F.array(*(F.array(*map(F.lit, s)) for s in steps)), F.lit(1.0), lambda acc, s: F.greatest(F.lit(least), acc + dot(s)))
    return F.when(F.col("mix_tokens") > 0, r).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class Mix:
    """shares: each domain's share before; totals: expected tokens after over targets' total; steps: the gradient steps."""

    domains: list[str]
    shares: list[float]
    reached: list[float]
    wanted: list[float]
    steps: list[list[float]]


def fit_rates(scored: DataFrame, targets: Mapping[str, float], cover: bool = False, least: float = 0.0, rounds: int = 40, tolerance: float = 1e-4) -> Mix:
    """Projected gradient on the rates. `scored` has mix_tokens and mix_posterior, in the order of `targets`.

    The total stays as it is, or with `cover` grows until no domain has to shrink. Shares are fractions of the present total.
    """
    domains, k = list(targets), len(targets)
    share = [targets[d] / sum(targets.values()) for d in domains]
    p = [F.get("mix_posterior", F.lit(i)) for i in range(k)]
    t = F.col("mix_tokens").cast("double")
    first = scored.agg(F.sum(t).alias("t"), *(F.sum(t * p[i]).alias(f"a{i}") for i in range(k)), *(F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
    total = first["t"] or 0.0
    if not total:
        return Mix(domains, [0.0] * k, [0.0] * k, share, [])
    now = [first[f"a{i}"] / total for i in range(k)]
    gram = [[first[f"g{i}_{j}"] / total + (1e-9 if i == j else 0.0) for j in range(k)] for i in range(k)]
    grow = max(a / s for a, s in zip(now, share, strict=True) if s) if cover else 1.0
    wanted, before, steps = [s * grow for s in share], now, []
    for _ in range(rounds):
        error = [w - a for w, a in zip(wanted, now, strict=True)]
        if max(map(abs, error)) <= tolerance * grow:
            break
        steps.append(_solve(gram, error))
        sums = scored.withColumn("r", _rate(steps, least)).agg(*(F.sum(F.col("r") * t * p[i]).alias(f"a{i}") for i in range(k))).first()
        now = [sums[f"a{i}"] / total for i in range(k)]
    return Mix(domains, before, now, wanted, steps)


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", cover: bool = False, least: float = 0.0, max_rows: int = 4000, carry: list[str] | None = None) -> tuple[DataFrame, Mix]:
    """The columns `carry` of `docs`, all unless named, with mix_tokens, mix_posterior, mix_rate and mix_copies, and the fit.

    `labelled` has id_col and domain. mix_rate is the expected number of copies of a row; mix_copies is its whole part, and one
    more with the probability of the rest by a hash of id and text, so that equal rows get equal copies. A null, empty or blank
    text has no tokens, equal posteriors and rate 1. Repeated rows are rated each. An empty table gives an empty one. Columns of
    the new names are replaced.
    """
    domains = list(targets)
    base = docs.drop("mix_tokens", "mix_posterior", "mix_rate", "mix_copies")
    model = fit_domains(base, labelled, domains, id_col, text_col, max_rows)
    scored = with_posteriors(base, model, domains, text_col)
    even = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    wanted = base.columns if carry is None else carry
    kept = Scratch(docs.sparkSession, "mixing").keep(scored.select(*wanted, "mix_tokens", "mix_posterior", even.alias("__even")), "scored")  # words are looked up once
    fit = fit_rates(kept, targets, cover, least)
    out = kept.withColumn("mix_rate", _rate(fit.steps, least))
    copies = (F.floor("mix_rate") + (F.col("__even") < F.col("mix_rate") - F.floor("mix_rate")).cast("int")).cast("long")
    return out.withColumn("mix_copies", copies).drop("__even"), fit

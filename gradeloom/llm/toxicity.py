"""Toxicity by a weighted finite-state pattern grammar.

Words of a clause become classes (insult, threat, target, negation, report, intent, other). Small weighted transducers rewrite the
class sequence one after another. One reads from right to left and marks insults and threats with a target close behind them.
The others read from left to right: negation softens what follows it closely, reported speech marks what follows a verb of
saying, the insult machine raises what has a target before or behind it, the threat machine tells a bare verb, one with a target
before it, one said with intent and one aimed at somebody, alone or with intent. The latter four are composed once into a single
deterministic machine, and the two directions together yield the clause's weight. The strength of each insult comes from labelled
documents. A document's score is a logistic function of its matched clauses and its length, fitted on the same labelled documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text as X
from ._shared import Scratch, small_batches

# English word lists of the grammar.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "fool", "jerk", "filth", "vermin")
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "crush")
TARGETS = ("you", "your", "yours", "yourself", "he", "she", "they", "them", "him", "her")
NEGATIONS = ("not", "never", "no", "isn", "aren", "don", "nobody", "without", "hardly")
INTENTS = ("will", "gonna", "going", "shall", "must", "should", "want", "let", "ll")
REPORTS = ("said", "says", "called", "wrote", "claimed", "quoted", "reported", "alleged")
CLAUSE_ENDS = b".!?;:\n"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = range(7)
INSULT_AT, THREAT_AT = 7, 8  # with a target close behind
MILD = 9  # an insult or threat that is negated
SAID = 10  # an insult or threat in reported speech
HIT = 11  # an insult or threat as such
CLASSES = 12
HITS = (INSULT, THREAT, INSULT_AT, THREAT_AT)

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(97, 123), *range(0x80, 0x100)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[list(CLAUSE_ENDS)] = True


@dataclass
class Transducer:
    """arcs[state][input class] = (output class, factor, next state); state 0 begins."""

    arcs: list[dict[int, tuple[int, float, int]]] = field(default_factory=list)

    def step(self, state: int, symbol: int) -> tuple[int, float, int]:
        return self.arcs[state].get(symbol, (symbol, 1.0, state))

    def then(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's output to `other`; only reachable states are made."""
        number, queue, out = {(0, 0): 0}, [(0, 0)], Transducer()
        for a, b in queue:
            arcs = {}
            for symbol in range(CLASSES):
                mid, f, a2 = self.step(a, symbol)
                last, g, b2 = other.step(b, mid)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    queue.append((a2, b2))
                arcs[symbol] = (last, f * g, number[a2, b2])
            out.arcs.append(arcs)
        return out


def behind_machine(reach: int = 3) -> Transducer:
    """Read from right to left: marks an insult or threat with a target at most `reach` words behind it."""
    arcs: list[dict[int, tuple[int, float, int]]] = [{TARGET: (TARGET, 1.0, 1)}]
    for k in range(1, reach + 1):
        after = k + 1 if k < reach else 0
        arcs.append({s: (s, 1.0, after) for s in range(CLASSES)} | {INSULT: (INSULT_AT, 1.0, after), THREAT: (THREAT_AT, 1.0, after), TARGET: (TARGET, 1.0, 1)})
    return Transducer(arcs)


def negation_machine(reach: int = 3, factor: float = 0.4) -> Transducer:
    """Softens every insult and threat within `reach` words after a negation."""
    arcs: list[dict[int, tuple[int, float, int]]] = [{NEGATION: (NEGATION, 1.0, 1)}]
    for k in range(1, reach + 1):
        after = k + 1 if k < reach else 0
        arcs.append({s: (s, 1.0, after) for s in range(CLASSES)} | {s: (MILD, factor, after) for s in HITS} | {NEGATION: (NEGATION, 1.0, 1)})
    return Transducer(arcs)


def report_machine(reach: int = 6, factor: float = 0.6) -> Transducer:
    """Marks insults and threats within `reach` words after a verb of saying."""
    arcs: list[dict[int, tuple[int, float, int]]] = [{REPORT: (REPORT, 1.0, 1)}]
    for k in range(1, reach + 1):
        after = k + 1 if k < reach else 0
        arcs.append({s: (s, 1.0, after) for s in range(CLASSES)} | {s: (SAID, factor, after) for s in HITS} | {REPORT: (REPORT, 1.0, 1)})
    return Transducer(arcs)


def insult_machine(aimed: float = 1.25) -> Transducer:
    """Insults become hits, raised by a target before them in the clause or close behind them."""
    plain = {INSULT: (HIT, 1.0, 0), INSULT_AT: (HIT, aimed, 0), TARGET: (TARGET, 1.0, 1)}
    after = {INSULT: (HIT, aimed, 1), INSULT_AT: (HIT, aimed, 1), MILD: (MILD, aimed, 1), SAID: (SAID, aimed, 1)}
    return Transducer([plain, after])


def threat_machine(bare: float = 0.3, told: float = 0.5, meant: float = 0.8, aimed: float = 1.25, sworn: float = 2.0) -> Transducer:
    """Threats become hits: bare, after a target, after a verb of intent, with a target behind, or with both of the latter."""
    by_state = (bare, told, meant)  # nothing, a target or a verb of intent before it in the clause
    arcs = []
    for state, factor in enumerate(by_state):
        arcs.append({THREAT: (HIT, factor, state), THREAT_AT: (HIT, sworn if state == 2 else aimed, state), TARGET: (TARGET, 1.0, max(state, 1)), INTENT: (INTENT, 1.0, 2)})
    return Transducer(arcs)


def grammar() -> Transducer:
    """The machine that reads from left to right; behind_machine() goes before it."""
    return negation_machine().then(report_machine()).then(insult_machine()).then(threat_machine())


def clause_factors(kinds: list[int], behind: Transducer, machine: Transducer) -> list[float]:
    """The factor of each word of a clause, given the words' classes: read backwards, then forwards."""
    state, marked = 0, []
    for kind in reversed(kinds):
        out, _, state = behind.step(state, kind)
        marked.append(out)
    state, factors = 0, []
    for kind in reversed(marked):
        _, factor, state = machine.step(state, kind)
        factors.append(factor)
    return factors


class Lexicon:
    """Classes and strengths of words. An entry is a whole word, or with a final * a beginning."""

    def __init__(self, strengths: dict[str, float], threat: float = 2.0):
        self.words: dict[bytes, tuple[int, float]] = {}
        for names, kind in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENTS, INTENT)):
            self.words.update({w.encode(): (kind, 0.0) for w in names})
        self.starts: dict[bytes, float] = {}
        hits = {w.encode(): (THREAT, threat) for w in THREATS}
        for w, s in strengths.items():
            if w.endswith("*"):
                self.starts[w[:-1].encode()] = s
            else:
                hits[w.encode()] = (INSULT, s)
        self.words.update(hits)
        self.lengths = sorted({len(w) for w in self.starts}, reverse=True)
        self.first = np.zeros(1 << 16, bool)  # the first two bytes of every hit
        for w in [*hits, *self.starts]:
            self.first[w[0] << 8 | (w[1] if len(w) > 1 else 32)] = True

    def look(self, word: bytes) -> tuple[int, float]:
        found = self.words.get(word)
        if found is not None:
            return found
        for n in self.lengths:
            s = self.starts.get(word[:n])
            if s is not None:
                return INSULT, s
        return OTHER, 0.0


def clause_scores(column, lexicon: Lexicon, machine: Transducer):
    """For a string column: per row its word count, matched clauses, the sum and the greatest of the clauses' weights."""
    n, behind = len(column), behind_machine()
    counts, clauses, total, top = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for a, b in X.row_blocks(column):
        data, offsets = X.utf8(pc.utf8_lower(column.slice(a, b - a)))
        starts, ends, rows = X.spans(data, offsets, _NOT_LETTER)
        counts[a:b] = np.bincount(rows, minlength=b - a)
        if not len(starts):
            continue
        second = np.where(ends - starts > 1, data[np.minimum(starts + 1, len(data) - 1)], 32)
        maybe = np.flatnonzero(lexicon.first[data[starts].astype(np.int64) << 8 | second])
        hits = [i for i in maybe if lexicon.look(data[starts[i] : ends[i]].tobytes())[1]]
        if not hits:
            continue
        stops = np.flatnonzero(_ENDS[data])
        done, last_row = -1, -1
        seen: dict[bytes, int] = {}
        for i in hits:
            if i < done:
                continue
            row = rows[i]
            if row != last_row:
                last_row, seen = row, {}
            at = int(np.searchsorted(stops, starts[i]))
            low = max(int(stops[at - 1]) if at else 0, int(offsets[row]))
            high = min(int(stops[at]) if at < len(stops) else len(data), int(offsets[row + 1]))
            first, done = int(np.searchsorted(starts, low)), int(np.searchsorted(starts, high))
            words = [data[starts[j] : ends[j]].tobytes() for j in range(first, done)]
            found, weight = [lexicon.look(w) for w in words], 0.0
            for word, (_, strength), factor in zip(words, found, clause_factors([k for k, _ in found], behind, machine), strict=True):
                if strength:  # a word said again in the document adds less each time
                    seen[word] = seen.get(word, 0) + 1
                    weight += strength * factor / seen[word]
            clauses[a + row] += 1
            total[a + row] += weight
            top[a + row] = max(top[a + row], weight)
    return counts, clauses, total, top


def _figures(counts, clauses, total, top) -> np.ndarray:
    size = np.maximum(counts, 1)
    return np.stack([np.ones(len(size)), np.log1p(total), np.log1p(100 * total / size), np.minimum(top, 6.0) / 2, np.log1p(counts), np.log1p(clauses)], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    strengths: dict[str, float]
    weights: tuple[float, ...]


def held_out(id_col: str) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, max_rows: int, scratch: Scratch, name: str) -> DataFrame:
    """(text, y) of at most `max_rows` labelled documents outside the held-out fold, those with the smallest hashes."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    rows = rows.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return scratch.keep(text.join(F.broadcast(rows), "id").select("text", "y"), name)  # max_rows ids of 12 bytes


_LETTERS = bytes(0x20 if _NOT_LETTER[i] else i for i in range(256))


def _word_starts(text: str, sizes: range, only: frozenset[str] | None) -> dict[str, int]:
    """How many distinct words of a text are, or begin with, each candidate."""
    found: dict[str, int] = {}
    for raw in set(text.lower().encode().translate(_LETTERS).split()):
        word = raw.decode("utf-8", "ignore")
        for key in [word, *(word[:k] + "*" for k in sizes if len(word) >= k)]:
            if only is None or key in only:
                found[key] = found.get(key, 0) + 1
    return found


def _apart(sample: DataFrame) -> DataFrame:
    """One row for each label and least shingle, so that copies of one document do not pass for evidence."""

    def work(batches):
        for batch in batches:
            least = [int(v[0]) >> 1 if len(v) else 0 for v in X.shingle_sets(batch.column(0).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "y", "least"])

    return sample.mapInArrow(work, "text string, y int, least long").dropDuplicates(["y", "least"]).drop("least")


def _start_counts(sample: DataFrame, sizes: range, only: frozenset[str] | None) -> DataFrame:
    def work(batches):
        for batch in batches:
            keys, times = [], []
            for text in batch.column(0).to_pylist():
                found = _word_starts(text, sizes, only)
                keys += found.keys()
                times += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64())], names=["key", "n"])

    return sample.select("text").mapInArrow(work, "key string, n long").groupBy("key").agg(F.count("*").alias("docs"), F.sum("n").alias("times"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 6000, sizes: range = range(3, 9), least_ratio: float = 4.0, least_deviations: float = 6.0) -> ToxicityModel:
    """Strengths of words and word beginnings, and the document weights, from at most `max_rows` labelled documents.

    A candidate must stand in 1% of the toxic documents of the sample, and more often than chance by `least_deviations`. Its
    strength is the log of its rate in their texts over that in other texts, repeats within a text not counted. Of a beginning and its extensions only the one with the most evidence stays.
    Without labels the built-in insults get equal strengths and no document reaches a score of 0.5 without one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    sample = scratch.keep(_apart(labelled_sample(docs, labels, label, id_col, text_col, max_rows, scratch, "labelled")), "sample")
    size = {r.y: (r.n, r.w) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("w")).collect()}
    strengths = {w: 3.0 for w in INSULTS}
    if size.get(1, (0, 0))[1] and size.get(0, (0, 0))[1]:
        least = max(4, math.ceil(size[1][0] / 100))
        share = size[1][1] / (size[1][1] + size[0][1])
        bad = {r.key: (r.docs, r.times) for r in _start_counts(sample.where("y = 1"), sizes, None).where(F.col("docs") >= least).collect()}
        good = {r.key: r.times for r in _start_counts(sample.where("y = 0"), sizes, frozenset(bad)).collect()}
        told = []
        for key, (n, times) in bad.items():
            other = good.get(key, 0)
            ratio = (times / size[1][1]) / ((other + 0.5) / size[0][1])
            chance = (times + other) * share
            if ratio >= least_ratio and times - chance >= least_deviations * math.sqrt(chance):
                told.append((n * math.log(ratio), key, math.log(ratio)))
        chosen: dict[str, float] = {}
        for _, key, strength in sorted(told, key=lambda t: (-t[0], -len(t[1].rstrip("*")), t[1])):
            stem = key.rstrip("*")
            if not any(stem.startswith(c.rstrip("*")) or c.rstrip("*").startswith(stem) for c in chosen):
                chosen[key] = min(strength, 6.0)
        known = Lexicon(chosen)
        strengths = {w: s for w, s in strengths.items() if not known.look(w.encode())[1]} | chosen
    lexicon, machine = Lexicon(strengths), grammar()

    def figures(batches):
        for batch in batches:
            counts, clauses, total, top = clause_scores(batch.column(0), lexicon, machine)
            yield pa.RecordBatch.from_arrays([pa.array(counts), pa.array(clauses), pa.array(total), pa.array(top), batch.column(1)], names=["a", "b", "c", "d", "y"])

    rows = sample.mapInArrow(figures, "a long, b long, c double, d double, y int").collect()  # max_rows rows of five numbers
    x = _figures(*(np.array([r[k] for r in rows], float) for k in range(4))) if rows else np.zeros((0, 6))
    y = np.array([r.y for r in rows], float)
    weights = fit_logistic(x, y) if 0 < y.sum() < len(y) else np.array([-3.0, 2.0, 0.5, 0.5, 0.0, 0.0])
    return ToxicityModel(strengths, tuple(weights))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, then toxicity (0 to 1) and toxic_clauses (matched clauses).

    A null or empty text has no clauses and the score of a document without matches. Repeated rows are scored each; texts of any
    length are read whole, in blocks of a few MB; an empty table gives an empty one; columns of the new names are replaced.
    """
    small_batches(docs.sparkSession)
    added = ["toxicity", "toxic_clauses"]
    base = docs.drop(*added)
    columns, weights = base.columns, np.array(model.weights)
    at, strengths = columns.index(text_col), model.strengths

    def work(batches):
        lexicon, machine = Lexicon(strengths), grammar()
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            counts, clauses, total, top = clause_scores(text, lexicon, machine)
            score = 1 / (1 + np.exp(-np.clip(_figures(counts, clauses, total, top) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(clauses)], names=[*columns, *added])

    return base.mapInArrow(work, StructType(list(base.schema.fields) + list(StructType.fromDDL("toxicity double, toxic_clauses long").fields)))

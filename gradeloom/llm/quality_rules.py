"""Quality rules as a short-circuit cascade.

Each rule's cost and share of rejections are measured on a small sample of rows; the rules then run in the order of rejections per
second, each only on the documents that all earlier ones kept. The order changes the work, never the verdict: a document is
kept if every rule keeps it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text as X
from ._shared import small_batches

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array over each row."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Block:
    """A few MB of texts whose figures are worked out as they are asked for, for some rows or for all."""

    def __init__(self, column):
        self.column, self.rows = column, len(column)
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        """The figure for `rows` (sorted row numbers)."""
        group, make = FIGURES[name]
        for each in group:
            if each not in self._known:
                self._known[each] = (np.zeros(self.rows, np.int64), np.zeros(self.rows, bool))
        new = rows[~self._known[name][1][rows]]
        if len(new):
            part = self.column if len(new) == self.rows else self.column.take(pa.array(new))
            for each, values in zip(group, make(*X.utf8(part)), strict=True):
                self._known[each][0][new] = values
                self._known[each][1][new] = True
        return self._known[name][0][rows]


def _words(data, offsets):
    starts, ends, rows = X.spans(data, offsets, X.SPACE)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    n = len(offsets) - 1
    return np.bincount(rows, minlength=n), np.bincount(rows, points[ends] - points[starts], minlength=n).astype(np.int64)


def _symbols(data, offsets):
    return (_per_row(SYMBOLS[data], offsets),)


def _case(data, offsets):
    return _per_row(_UPPER[data], offsets), _per_row(_LETTER[data], offsets)


def _lines(data, offsets):
    starts, ends, rows = X.spans(data, offsets, X.NEWLINE)
    ink = np.concatenate([[0], np.cumsum(~X.SPACE[data], dtype=np.int64)])
    some = ink[ends] > ink[starts]
    starts, ends, rows = starts[some], ends[some], rows[some]
    key = np.sort(X.mix(X.hash_spans(data, starts, ends) + X.mix(rows.astype(X.U))))
    n = np.bincount(rows, minlength=len(offsets) - 1)
    if len(key) and (key[1:] == key[:-1]).any():
        key = X.mix(X.hash_spans(data, starts, ends) + X.mix(rows.astype(X.U)))
        _, first = np.unique(key, return_index=True)
        return n, n - np.bincount(rows[first], minlength=len(n))
    return n, np.zeros(len(n), np.int64)


def _repeats(data, offsets, window: int = 8):
    h, rows, _, _ = X.words(data, offsets)
    g, first = X.ngrams(h, rows, window)
    n = len(offsets) - 1
    key = X.mix(g + X.mix(rows[first].astype(X.U)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + window, -1)
    return (np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n),)


FIGURES: dict[str, tuple[tuple[str, ...], Callable]] = {}
for _group, _make in (
    (("n_words", "word_chars"), _words),
    (("n_symbols",), _symbols),
    (("n_upper", "n_letters"), _case),
    (("n_lines", "n_dup_lines"), _lines),
    (("n_repeat_words",), _repeats),
):
    for _name in _group:
        FIGURES[_name] = (_group, _make)


@dataclass(frozen=True)
class Rule:
    """A name, the figures it reads, and which rows it rejects given them."""

    name: str
    reads: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda w: w < 20),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda w, r: 100 * r > 30 * w),
)
MORE_RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda w, s: 100 * s > 25 * w),
    Rule("word_length", ("n_words", "word_chars"), lambda w, c: (c < 2 * w) | (c > 30 * w)),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 50 * n),
    Rule("shouting", ("n_upper", "n_letters"), lambda u, n: (100 * u > 60 * n) & (n >= 20)),
)


def run_cascade(block: Block, rules: Iterable[Rule]) -> np.ndarray:
    """The index of the rule that rejects each row, or -1."""
    out, alive = np.full(block.rows, -1, np.int64), np.arange(block.rows)
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(*(block.get(name, alive) for name in rule.reads))
        out[alive[bad]] = i
        alive = alive[~bad]
    return out


def rank_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 512, longest: int = 1 << 16) -> tuple[Rule, ...]:
    """The rules by rejections per second of work, as measured on the driver on at most `sample_rows` texts of at most `longest`
    characters each, taken from as few partitions as hold them."""
    some = docs.select(F.col(text_col).cast("string").alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= longest).sample(0.1, 7).take(sample_rows)
    column = pa.array([r.text for r in some], pa.string())
    seconds, rejected = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
    for a, b in X.row_blocks(column):
        for i, rule in enumerate(rules):
            block, began = Block(column.slice(a, b - a)), time.perf_counter()
            rejected[i] += int(rule.rejects(*(block.get(n, np.arange(b - a)) for n in rule.reads)).sum())
            seconds[i] += time.perf_counter() - began
    worth = (rejected + 0.5) / (seconds + 1e-6)
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth[i], i)))


def apply_quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text", figures: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """All columns of `docs`, then kept (boolean), rejected_by (the first rule in cascade order; null if kept) and `figures`.

    Null texts count as empty and have no words. Repeated rows are judged each; texts of any length are read whole. An empty table
    gives an empty one. Should `docs` have columns of the new names, those are replaced. `ordered` keeps the rules as given;
    otherwise their order, and so rejected_by of a text that several rules reject, follows measured seconds and may differ from
    run to run. kept never does.
    """
    small_batches(docs.sparkSession)
    if not ordered:
        rules = rank_rules(docs, rules, text_col)
    names = [r.name for r in rules]
    added = ["kept", "rejected_by", *figures]
    base = docs.drop(*added)
    columns = base.columns
    at = columns.index(text_col)

    def work(batches):
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            for a, b in X.row_blocks(text):
                block = Block(text.slice(a, b - a))
                by = run_cascade(block, rules)
                more = [pa.array(block.get(f, np.arange(b - a))) for f in figures]
                told = pa.array([names[i] if i >= 0 else None for i in by], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(by < 0), told, *more], names=[*columns, *added])

    out = ", ".join(["kept boolean", "rejected_by string", *(f"{f} long" for f in figures)])
    return base.mapInArrow(work, StructType(list(base.schema.fields) + list(StructType.fromDDL(out).fields)))

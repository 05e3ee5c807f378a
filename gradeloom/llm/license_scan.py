"""License scan: an exact set-similarity join of text blocks with license templates.

The words of every template are put in one global order, rarest first by the number of text blocks that hold them, counted
over the whole corpus. A block that holds a share `threshold` of a template's distinct words must hold one of the template's
first |T| - needed + 1 words in that order (prefix filter), have enough words at all (length filter), and still be able to
reach the needed overlap from where the first common words stand (positional filter). Blocks that pass are counted exactly.
A notice wrapped over lines is found by the same join with whole texts as blocks, then by a window of at most twice the
template's words that slides over the texts that pass. Fixed phrases are found beside, as places where their words stand in a row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text as X
from ._shared import small_batches

# Phrases and their labels; license notices and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-any": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike International License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights": "Copyright. All rights reserved. No part of this publication may be reproduced without permission",
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str) -> list[str]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters."""
    return _WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


def _hash(words: list[str]) -> np.ndarray:
    data, offsets = X.utf8(pa.array(words, pa.string()))
    return X.words(data, offsets, X.NOT_ALNUM, True)[0] if words else np.zeros(0, X.U)


class _Vocabulary:
    """Numbers of the words of all templates by their hash."""

    def __init__(self, templates: Mapping[str, str]):
        self.words = sorted({w for t in templates.values() for w in template_words(t)})
        hashes = _hash(self.words)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of known words and their numbers."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[at] == hashes)
        return known, self.numbers[at[known]]


def _block_words(data, offsets, separator, vocabulary: _Vocabulary):
    """Words of texts, distinct (block, word number) pairs of known words, and those words' indices, numbers and blocks; blocks are numbered by first byte."""
    h, rows, starts, ends = X.words(data, offsets, X.NOT_ALNUM, True)
    known, numbers = vocabulary.find(h)
    cuts = np.unique(np.concatenate([np.flatnonzero(separator[data]), offsets]))
    block = np.searchsorted(cuts, starts[known], "right")
    pairs = np.unique(block << 20 | numbers) if len(known) else np.zeros(0, np.int64)
    return h, rows, starts, cuts, pairs >> 20, pairs & ((1 << 20) - 1), known, numbers, block


def word_frequencies(docs: DataFrame, templates: Mapping[str, str], text_col: str = "text", separator: np.ndarray = X.NEWLINE) -> dict[str, int]:
    """For each template word, in how many text blocks of the whole table it stands."""
    names = sorted({w for t in templates.values() for w in template_words(t)})

    def work(batches):
        vocabulary = _Vocabulary(templates)
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for a, b in X.row_blocks(batch.column(0)):
                data, offsets = X.utf8(batch.column(0).slice(a, b - a))
                total += np.bincount(_block_words(data, offsets, separator, vocabulary)[5], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int64()), pa.array(total)], names=["word", "blocks"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "word long, blocks long").groupBy("word").agg(F.sum("blocks").alias("blocks"))
    found = {r.word: r.blocks for r in counts.collect()}  # a row for each template word
    return {w: found.get(i, 0) for i, w in enumerate(names)}


def wrapped_windows(places: list[int], ranks: list[int], blocks: list[int], own: frozenset[int], need: int, length: int, taken: set[int]) -> list[tuple[int, int, int]]:
    """(first block, last block, distinct words) of disjoint windows of at most `length` words with `need` words of a template.

    places, ranks and blocks tell where the words of `own` stand in a text. Blocks in `taken` end a window. Of windows that
    overlap the one with most distinct words is kept, the first of equals.
    """
    at = [i for i, r in enumerate(ranks) if r in own]
    found, low, counts = [], 0, {}
    for high, i in enumerate(at):
        if blocks[i] in taken:
            low, counts = high + 1, {}
            continue
        counts[ranks[i]] = counts.get(ranks[i], 0) + 1
        while places[i] - places[at[low]] >= length or counts[ranks[at[low]]] > 1:
            r = ranks[at[low]]
            counts[r] -= 1
            if not counts[r]:
                del counts[r]
            low += 1
        if len(counts) >= need:
            found.append((len(counts), at[low], i))
    kept: list[tuple[int, int, int]] = []
    for seen, a, b in sorted(found, key=lambda w: (-w[0], w[1])):
        if all(b < x or a > y for x, y, _ in kept):
            kept.append((a, b, seen))
    return [(blocks[a], blocks[b], seen) for a, b, seen in sorted(kept)]


class TemplateIndex:
    """Templates by the words of their prefixes, in the global order of `frequencies`."""

    def __init__(self, templates: Mapping[str, str], frequencies: Mapping[str, int], threshold: float):
        self.vocabulary = _Vocabulary(templates)
        order = sorted(range(len(self.vocabulary.words)), key=lambda i: (frequencies.get(self.vocabulary.words[i], 0), self.vocabulary.words[i]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        number = {w: i for i, w in enumerate(self.vocabulary.words)}
        self.labels, self.sets, self.needed, self.window = [], [], [], []
        self.by_word: dict[int, list[tuple[int, int]]] = {}
        for label, text in sorted(templates.items()):
            ranks = sorted({int(self.rank[number[w]]) for w in template_words(text)})
            if not ranks:
                continue
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            for position, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.by_word.setdefault(r, []).append((len(self.sets), position))
            self.labels.append(label)
            self.sets.append(frozenset(ranks))
            self.needed.append(need)
            self.window.append(2 * len(template_words(text)))
        self.prefix = np.zeros(max(len(order), 1), bool)
        self.prefix[list(self.by_word)] = True

    def matches(self, ranks: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of those that a block with these sorted word ranks meets."""
        first: dict[int, tuple[int, int]] = {}
        for at, r in enumerate(ranks):
            for template, position in self.by_word.get(r, ()):
                first.setdefault(template, (at, position))
        out, own = [], None
        for template, (at, position) in first.items():
            size, need = len(self.sets[template]), self.needed[template]
            if len(ranks) < need or 1 + min(len(ranks) - at - 1, size - position - 1) < need:
                continue
            own = own or frozenset(ranks)
            common = len(own & self.sets[template])
            if common >= need:
                out.append((template, common / size))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.9, text_col: str = "text", separator: bytes = b"\n") -> DataFrame:
    """All columns of `docs`, then n_words, n_base, first_word, last_word, base_labels, labels, blocks and license_score.

    n_base counts the places of the phrases; first_word and last_word are the least and greatest word number of one (null
    without). base_labels are the phrases' labels, labels also the templates', sorted and comma-joined. blocks lists each
    matching text block (a stretch between `separator` bytes): label, first byte, last byte and share of the template's words. A
    notice that no single block holds is found over several: a window of at most twice the template's words, outside the blocks
    that match alone; it is listed from the start of its first block to the end of its last, with the share of the window.
    license_score is 1 with a phrase, else the greatest share, else 0. A null text counts as empty: no words, empty labels.
    Ties of share list every template that has it. Repeated rows are scanned each; texts of any length are read whole, in blocks of a
    few MB; an empty table gives an empty one; columns of the new names are replaced.
    """
    small_batches(docs.sparkSession)
    cut = np.zeros(256, bool)
    cut[list(separator)] = True
    frequencies = word_frequencies(docs, templates, text_col, cut)
    out = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, blocks array<struct<label:string,first:long,last:long,share:double>>, license_score double"
    added = StructType.fromDDL(out)
    base = docs.drop(*added.names)
    columns, at = base.columns, base.columns.index(text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def work(batches):
        index = TemplateIndex(templates, frequencies, threshold)
        told = [(_hash(p.split()), label) for p, label in phrases.items()]
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            for a, b in X.row_blocks(text):
                n = b - a
                data, offsets = X.utf8(text.slice(a, n))
                h, rows, starts, cuts, block, number, known, each, where = _block_words(data, offsets, cut, index.vocabulary)
                word_at = X.bounds(rows, n)
                places: list[list[int]] = [[] for _ in range(n)]
                labels: list[set[str]] = [set() for _ in range(n)]
                for sequence, label in told:
                    k = len(sequence)
                    if len(h) < k:
                        continue
                    hit = rows[: len(h) - k + 1] == rows[k - 1 :]
                    for j in range(k):
                        hit &= h[j : len(h) - k + 1 + j] == sequence[j]
                    for i in np.flatnonzero(hit):
                        row = int(rows[i])
                        places[row].append(int(i - word_at[row]))
                        labels[row].add(label)
                found: list[list[dict]] = [[] for _ in range(n)]
                alone: dict[tuple[int, int], set[int]] = {}
                ranks = index.rank[number] if len(number) else number
                for k in np.unique(block[index.prefix[ranks]]) if len(ranks) else ():
                    own = np.sort(ranks[block == k] if len(block) < 4096 else ranks[np.searchsorted(block, k) : np.searchsorted(block, k, "right")])
                    for template, share in index.matches(own.tolist()):
                        low = int(cuts[k - 1])
                        row = int(np.searchsorted(offsets, low, "right")) - 1
                        start = low - int(offsets[row]) + bool(cut[data[low]])
                        high = int(min(cuts[k], offsets[row + 1])) - int(offsets[row])
                        found[row].append({"label": index.labels[template], "first": start, "last": high, "share": share})
                        alone.setdefault((row, template), set()).add(int(k))
                each = index.rank[each] if len(each) else each
                known_at = X.bounds(rows[known], n)
                for row in np.unique(rows[known[index.prefix[each]]]) if len(each) else ():
                    i, j = int(known_at[row]), int(known_at[row + 1])
                    if where[i] == where[j - 1]:
                        continue
                    for template, _ in index.matches(np.unique(each[i:j]).tolist()):
                        size, need = len(index.sets[template]), index.needed[template]
                        windows = wrapped_windows(known[i:j].tolist(), each[i:j].tolist(), where[i:j].tolist(), index.sets[template], need, index.window[template], alone.get((int(row), template), set()))
                        for first, last, seen in windows:
                            low = int(cuts[first - 1])
                            start = low - int(offsets[row]) + bool(cut[data[low]])
                            high = int(min(cuts[last], offsets[row + 1])) - int(offsets[row])
                            found[row].append({"label": index.labels[template], "first": start, "last": high, "share": seen / size})
                values = [
                    np.diff(word_at), [len(p) for p in places], [min(p, default=None) for p in places], [max(p, default=None) for p in places],
                    [",".join(sorted(x)) for x in labels], [",".join(sorted(x | {m["label"] for m in f})) for x, f in zip(labels, found, strict=True)],
                    found, [1.0 if p else max((m["share"] for m in f), default=0.0) for p, f in zip(places, found, strict=True)],
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, n).columns, *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=[*columns, *added.names])

    return base.mapInArrow(work, StructType(list(base.schema.fields) + list(added.fields)))

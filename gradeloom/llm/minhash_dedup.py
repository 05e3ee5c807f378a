"""MinHash near-dedup by a multi-index Hamming join.

Every text becomes a set of word shingles and a signature of `positions` b-bit MinHash values. The signature is cut into
chunks of `chunk` values. If two signatures differ in at most 2 * chunks - 1 places, the pigeonhole principle gives them a
chunk with at most one difference; so each document files itself, for every chunk, under the chunk with each one of its
values left out, and the pairs that meet under some key hold all pairs within that distance. No meeting is given up: a pair
that meets is compared on its full shingle sets, or stands in one component already.

No group's pairs leave a task. Under each key, documents are compared with the next two by size first, which settles keys of up
to three documents and joins most of what is linked at all. What then lies in different components under one key is compared
in blocks of bounded bytes: documents outside the key's largest component visit the blocks of that component, and the blocks
of each other. Blocks of a large component are bands of distance from a pivot, and the triangle inequality of Jaccard distance
tells which bands a visitor can be linked with. Only links that join components leave a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Scratch, small_batches, split_by
from .components import connected_components

U = np.uint64


@dataclass(frozen=True)
class Signature:
    """positions: MinHash values; chunk: values a chunk; local: a key with more documents of one block of rows is salted."""

    shingle: int = 5
    positions: int = 80
    chunk: int = 5
    local: int = 64
    seed: int = 11

    @property
    def factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(1, 2**63, self.positions, dtype=U) | U(1)

    def of(self, shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
        least = np.full(self.positions, 2**64 - 1, U)
        for i in range(0, len(shingles), 2048):
            np.minimum(least, (shingles[i : i + 2048, None] * factors).min(0), out=least)
        return (X.mix(least) & U(0xFFFF)).astype("<u2")

    def keys(self, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of values its keys, one for each chunk and left-out value, and the chunk of each key."""
        chunks = self.positions // self.chunk
        values = X.mix(signatures.astype(U) + (np.arange(self.positions, dtype=U) << U(20))[None, :])
        values = values.reshape(len(signatures), chunks, self.chunk)
        keys = X.mix(values.sum(2, dtype=U)[:, :, None] - values + np.arange(chunks * self.chunk, dtype=U).reshape(1, chunks, self.chunk))
        return keys.reshape(len(signatures), -1), np.repeat(np.arange(chunks), self.chunk)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def signatures(docs: DataFrame, id_col: str, text_col: str, how: Signature) -> DataFrame:
    """id, n (distinct shingles), f1 and f2 (a 128-bit fingerprint of the set), sig (binary; null for an empty set)."""

    def work(batches):
        factors = how.factors
        for batch in batches:
            n, f1, f2, sig = [], [], [], []
            for s in X.shingle_sets(batch.column(1), how.shingle):
                n.append(len(s))
                f1.append(int(X.mix(s).sum(dtype=U)) if len(s) else 0)
                f2.append(int(X.mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) if len(s) else 0)
                sig.append(how.of(s, factors).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _signed(np.array(f1, U)), _signed(np.array(f2, U)), pa.array(sig, pa.binary())], names=["id", "n", "f1", "f2", "sig"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, n long, f1 long, f2 long, sig binary")


def filed(classes: DataFrame, how: Signature, block: int = 4096) -> DataFrame:
    """(key, salt, n, rep, extra) for every chunk of every signature with one value left out.

    A key that holds more than `how.local` documents of one block of rows is crowded: there the block's documents are filed under
    the key with a salt of their own, and only the block's two first and two last ones, marked extra, under the key itself too.
    So no task gets more of a key than its blocks have, and the extra ones hold the salted runs together.
    """

    def work(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                if not part.num_rows:
                    continue
                n, rep = part.column("n").to_numpy(), part.column("rep").to_numpy()
                order = np.lexsort((rep, n))
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(part.num_rows, -1)[order]
                keys, _ = how.keys(sig)
                n, rep = np.repeat(n[order], keys.shape[1]), np.repeat(rep[order], keys.shape[1])
                keys = keys.reshape(-1)
                by_key = np.argsort(keys, kind="stable")  # within a key by n and rep
                first = np.flatnonzero(np.r_[True, keys[by_key][1:] != keys[by_key][:-1]])
                size = np.diff(np.r_[first, len(keys)])
                full = np.flatnonzero(size > how.local)
                salt = np.zeros(len(keys), np.int32)
                ends = []
                for f, s in zip(first[full], size[full], strict=True):
                    salt[by_key[f : f + s]] = 1 + (int(rep.min()) * 0x9E3779B1 >> 7) % 0x7FFFFFF0
                    ends.append(by_key[[f, f + 1, f + s - 2, f + s - 1]])
                extra = np.concatenate(ends) if ends else np.zeros(0, np.int64)
                at = np.r_[np.arange(len(keys)), extra]
                salt = np.r_[salt, np.zeros(len(extra), np.int32)]
                marked = np.r_[np.zeros(len(keys), bool), np.ones(len(extra), bool)]
                yield pa.RecordBatch.from_arrays([_signed(keys[at]), pa.array(salt), pa.array(n[at]), pa.array(rep[at]), pa.array(marked)], names=["key", "salt", "n", "rep", "extra"])

    return classes.select("rep", "n", "sig").mapInArrow(work, "key long, salt int, n long, rep long, extra boolean")


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """What is under the same key: (null, a, b) for documents next to each other by size, all pairs where a key has up to three, and
    (key, rep, null) for every document of a key with more, whose other pairs are still to be looked at.

    Streams over sorted rows; no run is held.
    """

    def work(batches):
        carry, done = None, 0  # the last rows, and how many of them have been told
        for batch in batches:
            table = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
            carry, done = (yield from told(table, done, 3))
        if carry is not None:
            yield from told(pa.Table.from_batches([carry]), done, 0)

    def told(table, done, ahead):
        """Rows from `done` to `ahead` before the end; the rows to carry on, and how many of them are done."""
        count = table.num_rows
        upto = count - ahead
        if upto <= done:
            return (table.to_batches()[0] if count else None), done
        key, salt, n, rep, extra = (table.column(c).to_numpy() for c in ("key", "salt", "n", "rep", "extra"))
        same = lambda s: (key[:-s] == key[s:]) & (salt[:-s] == salt[s:])
        crowded = np.zeros(count, bool)
        if count > 3:
            four = same(3)
            for s in range(4):
                crowded[s : count - 3 + s] |= four
        a, b = [], []
        for s in (1, 2):
            if count > s:
                i = np.flatnonzero(same(s) & (100 * n[:-s] >= percent * n[s:]) & (rep[:-s] != rep[s:]))
                i = i[(i >= done) & (i < upto)]
                i = i if s == 1 else i[~crowded[i]]
                a.append(np.minimum(rep[i], rep[i + s]))
                b.append(np.maximum(rep[i], rep[i + s]))
        left = np.flatnonzero(crowded & ~extra)
        left = left[(left >= done) & (left < upto)]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        none = len(a)
        keys = pa.array(np.r_[np.zeros(none, np.int64), key[left]], mask=np.r_[np.ones(none, bool), np.zeros(len(left), bool)])
        ends = pa.array(np.r_[b, np.zeros(len(left), np.int64)], mask=np.r_[np.zeros(none, bool), np.ones(len(left), bool)])
        out = pa.RecordBatch.from_arrays([keys, pa.array(np.r_[a, rep[left]]), ends], names=["key", "a", "b"])
        if out.num_rows:
            yield out
        keep = max(0, upto - 3)
        return table.slice(keep).combine_chunks().to_batches()[0], upto - keep

    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "rep")
    return dealt.mapInArrow(work, "key long, a long, b long")


def _dealt_sets(texts: DataFrame, calls: DataFrame, how: Signature) -> DataFrame:
    """(cell, kind, id, comp, s): the sorted 64-bit shingle hashes of each document, as bytes, in each of its cells.

    `calls` has id and a bounded list `calls` of struct<base, blocks, mode, comp>: of `blocks` cells of `base`, mode 0 asks for the
    document's own one, mode 2 for all, as a visitor, and mode 1 for both. kind is 0 for a document that is at home in a cell, 1
    for one that also visits it and 2 for a visitor. Texts are shuffled once, with their lists; a set is made in the task that
    deals it out.
    """
    names = ["cell", "kind", "id", "comp", "s"]

    def table(out: list[tuple]) -> pa.RecordBatch:
        cell, kind, one, comp, s = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(kind, pa.int32()), pa.array(one, pa.int64()), pa.array(comp, pa.int64()), pa.array(s, pa.binary())], names=names)

    def work(batches):
        out, held = [], 0
        for batch in batches:
            for one, asked, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), X.shingle_sets(batch.column(1), how.shingle), strict=True):
                if not len(s):
                    continue
                data, h = s.tobytes(), int(X.mix(np.array([one], np.int64).view(U))[0])
                for call in asked:
                    own = h % call["blocks"]
                    at = np.arange(call["blocks"], dtype=U) if call["mode"] else np.array([own], U)
                    cells = X.mix(np.array([call["base"]], np.int64).view(U) + at * U(0x9E3779B97F4A7C15)).view(np.int64)
                    for k, cell in zip(at.tolist(), cells.tolist(), strict=True):
                        out.append((cell, call["mode"] if k == own else 2, one, call["comp"], data))
                        held += len(data)
                        if held > 4 << 20:
                            yield table(out)
                            out, held = [], 0
        if out:
            yield table(out)

    _, maybe = split_by(texts, calls.select("id"))
    return maybe.join(calls, "id").select("id", "text", "calls").mapInArrow(work, "cell long, kind int, id long, comp long, s binary")


CALL = "array<struct<base:bigint,blocks:int,mode:int,comp:bigint>>"


class _Forest:
    """Union-find over the documents of one cell."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _confirmed(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, how: Signature, percent: int, scratch: Scratch, part_bytes: int) -> DataFrame:
    """Links among `pairs` by their full shingle sets: enough of them that their components are those of all links.

    A document is labelled with the smallest id among itself and its partners, so that a group of copies mostly has one label. A
    label is one part, or as many as the size of its sets asks for, and a pair is worked on in the cell of its two parts, which
    holds at most about 2 * `part_bytes`. A cell gets the set of each of its documents once, however many pairs it stands in,
    and passes over pairs that its earlier links already join.
    """
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    label = ends.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("label"))
    sized = scratch.keep(label.join(sizes, "id"), "sized")
    parts = sized.groupBy("label").agg(F.ceil(F.sum("size") / F.lit(float(part_bytes))).cast("long").alias("parts")).where("parts > 1")
    split = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    place = scratch.keep(sized.join(parts, "label", "left").select("id", F.xxhash64("label", split).alias("part")), "places")
    dealt = pairs.join(place.select(F.col("id").alias("a"), F.col("part").alias("p")), "a").join(place.select(F.col("id").alias("b"), F.col("part").alias("q")), "b")
    dealt = scratch.keep(dealt.select(F.xxhash64(F.least("p", "q"), F.greatest("p", "q")).alias("base"), "a", "b"), "dealt")
    call = F.struct("base", F.lit(1).alias("blocks"), F.lit(0).alias("mode"), F.lit(0).cast("long").alias("comp"))
    calls = dealt.select(F.col("a").alias("id"), "base").union(dealt.select("b", "base")).groupBy("id").agg(F.collect_set(call).cast(CALL).alias("calls"))  # as many as neighbours
    held = _dealt_sets(texts, scratch.keep(calls, "calls"), how).select("cell", "kind", F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "s")

    def named(batches):  # as _dealt_sets() names the only cell of a base
        for batch in batches:
            cell = X.mix(batch.column(0).to_numpy().view(U))
            yield pa.RecordBatch.from_arrays([_signed(cell), pa.array(np.ones(len(cell), np.int32)), batch.column(1), batch.column(2), pa.nulls(len(cell), pa.binary())], names=["cell", "kind", "a", "b", "s"])

    rows = held.union(dealt.mapInArrow(named, "cell long, kind int, a long, b long, s binary"))

    def work(batches):
        cell, known, forest = None, {}, _Forest()
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("cell", "kind", "a", "b")]
            for i, (at, kind, a, b) in enumerate(zip(*columns, strict=True)):
                if at != cell:
                    cell, known, forest = at, {}, _Forest()
                if not kind:
                    known.setdefault(a, []).append(np.frombuffer(batch.column("s")[i].as_py(), U))
                    continue
                if (r := forest.root(a)) == (q := forest.root(b)):
                    continue
                for x, y in ((x, y) for x in known[a] for y in known[b]):
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    common = _common(x, y)
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        forest.up[r] = q
                        found.append((a, b))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell", "kind", "a", "b").mapInArrow(work, "a long, b long")


def _from_pivots(rows: DataFrame) -> DataFrame:
    """(comp, id, d): the Jaccard distance of each document at home in a cell from the pivot that visits it."""

    def work(batches):
        now, block = None, []
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("cell", "kind", "id", "comp")]
            for i, (at, kind, one, comp) in enumerate(zip(*columns, strict=True)):
                if at != now:
                    now, block = at, []
                s = np.frombuffer(batch.column("s")[i].as_py(), U)
                if kind < 2:
                    block.append((one, s))
                if kind:
                    for other, t in block:
                        common = _common(s, t)
                        found.append((comp, other, 1 - common / (len(s) + len(t) - common)))
            if found:
                comp, one, d = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(comp, pa.int64()), pa.array(one, pa.int64()), pa.array(d, pa.float64())], names=["comp", "id", "d"])

    return rows.repartition("cell").sortWithinPartitions("cell", "kind", "id").mapInArrow(work, "comp long, id long, d double")


def _banded(inside: DataFrame, guests: DataFrame, texts: DataFrame, how: Signature, percent: int, scratch: Scratch, block_bytes: int, width: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Calls (id, base, blocks, mode, comp) of documents at home and of visitors, for components that need more than one block.

    One document of a component is its pivot. As Jaccard distance is a metric, two linked documents' distances from the pivot
    differ by at most that of a link; so the component's documents are put into bands of that distance, and a visitor calls
    only on the bands in which a linked one can be.
    """
    both = inside.select(F.col("comp").alias("main"), "id", "size").union(guests.select("main", "id", "size")).distinct()
    blocks = both.groupBy("main").agg(F.ceil(F.sum("size") / F.lit(float(block_bytes))).cast("int").alias("blocks"))
    base = F.xxhash64(F.lit(3), "main")
    homes = both.join(blocks, "main").select("id", base.alias("base"), "blocks", F.lit(0).alias("mode"), F.col("main").alias("comp"))
    pivots = inside.groupBy(F.col("comp").alias("main")).agg(F.min("id").alias("id")).join(blocks, "main").select("id", base.alias("base"), "blocks", F.lit(2).alias("mode"), F.col("main").alias("comp"))
    asked = pivots.select("id", "base").withColumn("p", F.lit(True))
    homes = homes.join(asked, ["id", "base"], "left").withColumn("mode", F.when(F.col("p"), 1).otherwise(F.col("mode"))).drop("p")  # the pivot is at home once, and visits all blocks
    calls = homes.groupBy("id").agg(F.collect_list(F.struct("base", "blocks", "mode", "comp")).cast(CALL).alias("calls"))
    near = _from_pivots(_dealt_sets(texts, scratch.keep(calls, "pivot-calls"), how))
    near = scratch.keep(near.select("id", F.col("comp").alias("main"), "d"), "pivots")

    reach, w = 1 - percent / 100 + 1e-9, F.lit(width)
    band = F.floor(F.col("d") / w).cast("int")
    placed = inside.withColumnRenamed("comp", "main").join(near, ["id", "main"]).select("main", "id", "size", band.alias("band")).distinct()
    bands = placed.groupBy("main", "band").agg(F.ceil(F.sum("size") / F.lit(float(block_bytes))).cast("int").alias("blocks"))
    at = F.xxhash64(F.lit(1), "main", "band").alias("base")
    here = placed.join(bands, ["main", "band"]).select("id", at, "blocks", F.lit(0).alias("mode"), F.col("main").alias("comp"))
    seen = guests.join(near, ["id", "main"]).select("id", "main", "comp", F.explode(F.sequence(F.floor((F.col("d") - reach) / w).cast("int"), F.floor((F.col("d") + reach) / w).cast("int"))).alias("band"))
    calls = seen.distinct().join(bands, ["main", "band"]).select("id", at, "blocks", F.lit(2).alias("mode"), "comp")
    return here, calls


def _visits(crowd: DataFrame, member: DataFrame, sizes: DataFrame, texts: DataFrame, how: Signature, percent: int, scratch: Scratch, block_bytes: int) -> DataFrame:
    """(id, calls): the cells in which each document of `crowd` is at home or visits, so that all that meets under a key in different
    components, and may be linked, meets in a cell.

    Under a key, the documents outside its largest component visit the blocks of that component's documents, once for all keys
    that say so, and of a component of several blocks only those that the distance from its pivot does not rule out; and if they are of several components themselves, the blocks of each other, once for all keys with the same
    documents. A block holds about `block_bytes`.
    """
    own = crowd.groupBy("rep").agg(F.collect_list("key").alias("keys")).withColumnRenamed("rep", "id")  # at most one key a place of the signature
    own = scratch.keep(own.join(sizes, "id").join(member, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "own")
    rows = own.select(F.explode("keys").alias("key"), "id", "comp", "size")
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("main"), "comps")
    out = scratch.keep(rows.join(main, "key").where("comp <> main"), "outside")

    bound = F.lit(float(block_bytes))
    guests = out.select("id", "comp", "main", "size").distinct()
    inside = own.join(guests.select(F.col("main").alias("comp")).distinct(), "comp", "left_semi").select("id", "comp", "size")
    blocks = scratch.keep(inside.groupBy("comp").agg(F.ceil(F.sum("size") / bound).cast("int").alias("blocks")), "blocks")
    small, large = (blocks.where(c) for c in ("blocks = 1", "blocks > 1"))
    homes = inside.join(small, "comp").select("id", F.xxhash64(F.lit(1), "comp").alias("base"), "blocks", F.lit(0).alias("mode"), "comp")
    calls = guests.join(small.withColumnRenamed("comp", "main"), "main").select("id", F.xxhash64(F.lit(1), "main").alias("base"), "blocks", F.lit(2).alias("mode"), "comp").union(homes)
    if not large.isEmpty():
        for more in _banded(inside.join(large, "comp", "left_semi"), guests.join(large.select(F.col("comp").alias("main")), "main", "left_semi"), texts, how, percent, scratch, block_bytes):
            calls = calls.union(more)

    several = out.where("comps > 2").groupBy("key").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.ceil(F.sum("size") / bound).cast("int").alias("blocks"))
    several = several.groupBy("x", "y").agg(F.min("key").alias("key"), F.max("blocks").alias("blocks"))  # one key of those with the same documents
    mutual = out.join(several.select("key", "blocks"), "key").select("id", F.xxhash64(F.lit(2), "key").alias("base"), "blocks", F.lit(1).alias("mode"), "comp")
    calls = calls.union(mutual)
    return scratch.keep(calls.groupBy("id").agg(F.collect_list(F.struct("base", "blocks", "mode", "comp")).cast(CALL).alias("calls")), "visits")  # two a key, and some bands, at most


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Links between visitors and documents at home in their cells, enough of them to join what is linked in a cell."""

    class Cell:
        def __init__(self):
            self.block, self.also, self.index, self.forest = [], [], None, _Forest()

        def closed(self) -> list[tuple[int, int]]:
            """No more documents are at home here: the shingles in order, and whose each one is; then those visit that also do."""
            if self.index is not None or not self.block:
                return []
            sizes = np.array([len(s) for _, _, s in self.block])
            values, owner = np.concatenate([s for _, _, s in self.block]), np.repeat(np.arange(len(self.block)), sizes)
            order = np.argsort(values, kind="stable")
            self.index = values[order], owner[order], sizes
            return [link for k in self.also for link in self.visit(*self.block[k])]

        def visit(self, one: int, comp: int, s: np.ndarray) -> list[tuple[int, int]]:
            if self.index is None:
                return []
            (values, owner, sizes), links = self.index, []
            low, high = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            common = np.bincount(owner[at], minlength=len(sizes))
            for k in np.flatnonzero(100 * common >= percent * (len(s) + sizes - common)):
                other, of, _ = self.block[k]
                if (r := self.forest.root(comp)) != (q := self.forest.root(of)):
                    self.forest.up[r] = q
                    links.append((min(one, other), max(one, other)))
            return links

    def work(batches):
        now, cell = None, Cell()
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("cell", "kind", "id", "comp")]
            for i, (at, kind, one, comp) in enumerate(zip(*columns, strict=True)):
                if at != now:
                    found += cell.closed()
                    now, cell = at, Cell()
                s = np.frombuffer(batch.column("s")[i].as_py(), U)
                if kind == 2:
                    found += cell.closed()
                    found += cell.visit(one, comp, s)
                    continue
                if kind:
                    cell.also.append(len(cell.block))
                cell.block.append((one, comp, s))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])
        if found := cell.closed():
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell", "kind", "id").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, how: Signature | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct word shingles (A-Z
    lower-cased; fewer words than a shingle are one shingle). component_id is the smallest id reachable over links;
    kept tells whether it is the document's own. A null, empty or blank text has no shingles and no links. Repeated rows
    with one id count as one document that has every row's links, also if their texts differ; each row has its own n_shingles.
    Ties don't arise: the smallest id stays. A null id has a null component and is kept. An empty table gives an empty one. Texts
    of any length are read whole; a task holds the sets of a block of about `block_bytes`, or of one document. Any integer id and
    any other columns are allowed; the latter are not read.
    """
    how = how or Signature()
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    sigs = scratch.keep(signatures(docs, id_col, text_col, how), "signatures")
    named = sigs.where("n > 0 and id is not null")
    classes = named.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "sig")).alias("r")).select("f1", "f2", "n", F.col("r.id").alias("rep"), F.col("r.sig").alias("sig"))
    classes = scratch.keep(classes, "classes")
    rows = scratch.keep(sigs.select("id", "n", "f1", "f2").join(classes.drop("sig"), ["f1", "f2", "n"], "left").select("id", "n", "rep"), "rows")
    scratch.drop("signatures")

    met = scratch.keep(meetings(filed(classes, how), percent), "met")
    scratch.drop("classes")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = rows.where("n > 0").groupBy("id").agg((F.sum("n") * 8).alias("size"))
    pairs = scratch.keep(met.where("key is null").select("a", "b").distinct(), "pairs")
    links = scratch.keep(_confirmed(pairs, texts, sizes, how, percent, scratch, block_bytes), "links")
    for name in ("pairs", "sized", "places", "dealt", "calls"):
        scratch.drop(name)
    # Documents with one id and several texts are one document.
    several = rows.where("rep is not null and id is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    several = rows.join(several.where("a < b").select("id", "a"), "id").select("a", F.col("rep").alias("b"))
    member = connected_components(links.union(several), scratch, "first")

    crowd = met.where("key is not null").select("key", F.col("a").alias("rep"))
    visits = _visits(crowd, member, sizes, texts, how, percent, scratch, block_bytes)
    for name in ("met", "own", "outside", "blocks", "pivot-calls", "pivots"):
        scratch.drop(name)
    more = scratch.keep(_joined(_dealt_sets(texts, visits, how), percent), "more")
    if not more.isEmpty():
        joined = member.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)
        member = connected_components(joined, scratch, "all")
    out = rows.join(member.select(F.col("id").alias("rep"), "component"), "rep", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    out = scratch.keep(out, "result")
    scratch.drop_all_but("result")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

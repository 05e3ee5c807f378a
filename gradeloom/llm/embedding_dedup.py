"""Embedding near-dedup by NN-descent.

Equal vectors of one label are collapsed first. A neighbour graph starts from a few random-hyperplane tables, each compared in
small blocks, and is refined by local joins: the neighbours of a vector, and those that have it as a neighbour, are compared with
each other, and every list keeps its best. A list whose last place is still a link is saturated and gets twice the room. Edges
below cos(2 * angle(threshold)) are never kept, as no path of two links leads over them.

Links of the graph give components. An audit compares one vector each of a sample of groups with all rows, drawing until enough of
them have links; what was missed is added, and if recall by groups is too low, more tables are. If the last table is not enough
either, cells of all vectors are compared exactly. Links that full lists had no room for are settled exactly: the vectors with full
lists are put in cells, and all pairs of cells of different components that are near enough to hold a link are compared. The
measured recall and what followed from it are logged. What lists with `most` places cannot hold is
counted exactly: members within half the threshold's angle of their component's pivot are all linked with each other, which needs
no comparison; each other member is compared with all of its component, in pairs of bounded blocks, and only counts leave the
tasks. That is quadratic in the members outside of the half angle at most; the contract asks for counts, not for components alone.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, runs, small_batches
from .components import connected_components

EDGE = "u long, v long, s double"
log = logging.getLogger(__name__)


def _matrix(column) -> np.ndarray:
    """The doubles of a binary column without nulls, whose values have one length, without a copy of each."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<f8").reshape(n, -1)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label (text), size and x: the vector at unit length as doubles; x is null where the row can't have links."""

    def work(batches):
        for batch in batches:
            lists, n = batch.column(2), batch.num_rows
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes  # of flatten(), which leaves out null lists
            flat = lists.flatten()
            values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            out: list[bytes | None] = [None] * n
            labelled = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero((sizes == d) & labelled)
                v = values[starts[at][:, None] + np.arange(d)]
                fine = np.isfinite(v).all(1) & (v != 0).any(1)
                at, v = at[fine], v[fine]
                v = v / np.abs(v).max(1, keepdims=True)
                v = v / np.sqrt((v * v).sum(1, keepdims=True))
                for i, x in zip(at, v, strict=True):
                    out[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(out, pa.binary())], names=["id", "label", "size", "x"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(work, "id long, label string, size int, x binary")


def _edges(ids: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(s)], names=["u", "v", "s"])


def _table_edges(points: DataFrame, table: int, block: int, room: int, floor: float, seed: int) -> DataFrame:
    """Edges of one random-hyperplane table. Its codes have enough bits for about `block` / 4 vectors of a label each."""

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            bits = np.ceil(np.log2(np.maximum(batch.column("n").to_numpy() * 4 / block, 1))).astype(np.int64)
            codes, place = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = _matrix(batch.column("x").take(pa.array(at)))
                planes = np.random.default_rng([seed, table, int(d)]).standard_normal((d, 41))
                sign = (x @ planes[:, :40] > 0).astype(np.int64) << np.arange(40)
                codes[at] = (sign * (np.arange(40)[None, :] < bits[at, None])).sum(1)
                place[at] = x @ planes[:, 40]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "label", "size", "x")] + [pa.array(codes), pa.array(place)], names=["id", "label", "size", "x", "code", "place"])

    def compare(batches):
        for batch in _chunks(batches, block):
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("x"))
            if len(ids) < 2:
                continue
            s = x @ x.T
            np.fill_diagonal(s, -2)
            top = np.argpartition(-s, min(room, len(ids) - 1) - 1, axis=1)[:, :room] if len(ids) > room else np.tile(np.arange(len(ids)), (len(ids), 1))
            i = np.repeat(np.arange(len(ids)), top.shape[1])
            j = top.reshape(-1)
            good = s[i, j] >= floor
            yield _edges(ids, i[good], j[good], s[i, j][good])

    coded = points.mapInArrow(code, "id long, label string, size int, x binary, code long, place double")
    coded = coded.select(F.xxhash64("label", "size", "code").alias("g"), "place", "id", "x")
    return coded.repartition("g").sortWithinPartitions("g", "place", "id").mapInArrow(compare, EDGE)


def _chunks(batches, most: int):
    """Stretches of at most `most` rows with one g, of input sorted by g; nothing larger is held."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        held = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            while b - a >= most:
                yield batch.slice(a, most)
                a += most
            if b == len(g):
                held = batch.slice(a, b - a) if b > a else None
            elif b > a:
                yield batch.slice(a, b - a)
    if held is not None and held.num_rows:
        yield held


def _best(edges: DataFrame, room: int, most: int, threshold: float) -> DataFrame:
    """The best `room` edges of each vector; up to `most` while they are links. Each task's batches are cut first, so that the edges of
    a vector that is in many lists don't all travel."""

    def cut(batches):
        for batch in batches:
            u, v, s = (batch.column(c).to_numpy() for c in ("u", "v", "s"))
            order = np.lexsort((v, -s, u))
            u, v, s = u[order], v[order], s[order]
            new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
            order, u = order[new], u[new]
            first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
            place = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
            yield batch.take(pa.array(order[place < max(room, most)]))

    def work(batches):
        last, seen, count = None, set(), 0
        for batch in batches:
            u, v, s = (batch.column(c).to_numpy() for c in ("u", "v", "s"))
            keep = np.zeros(len(u), bool)
            for i in range(len(u)):
                if u[i] != last:
                    last, seen, count = u[i], set(), 0
                if (count < room or count < most and s[i] >= threshold) and v[i] not in seen:
                    seen.add(v[i])
                    count += 1
                    keep[i] = True
            yield batch.filter(pa.array(keep))

    return edges.mapInArrow(cut, EDGE).repartition("u").sortWithinPartitions("u", F.desc("s"), "v").mapInArrow(work, EDGE)


def _local_join(graph: DataFrame, points: DataFrame, room: int, floor: float) -> DataFrame:
    """Compare with each other the neighbours of each vector, and up to as many that have it as a neighbour."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")
    member = _best(graph, room, room, 2.0).union(_best(back, room, room, 2.0)).select("u", "v").distinct()

    def compare(batches):
        for batch in runs(batches, "u"):
            u, v, x = batch.column("u").to_numpy(), batch.column("v").to_numpy(), _matrix(batch.column("x"))
            cuts = [0, *(np.flatnonzero(np.diff(u)) + 1).tolist(), len(u)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    s = x[a:b] @ x[a:b].T
                    i, j = np.nonzero(np.triu(s >= floor, 1))
                    if len(i):
                        yield _edges(v[a:b], np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s[i, j]] * 2))

    rows = member.join(points.select(F.col("id").alias("v"), "x"), "v").select("u", "v", "x")
    return rows.repartition("u").sortWithinPartitions("u", "v").mapInArrow(compare, EDGE)


def audit(points: DataFrame, component: DataFrame, threshold: float, scratch: Scratch, name: str, enough: int = 256, first: int = 1024, most: int = 16384) -> tuple[float, DataFrame | None]:
    """Recall by groups, and links (a, b) that were missed.

    A group is a component or a vector alone; the vector with its smallest id stands for it, so that a large group weighs no more
    than a pair. Groups are drawn until `enough` of those compared with all rows have a link, or there are no more. Recall is the
    mean, over those with a link, of the share of their links whose ends share a component; 1 if no vector has a link.
    """
    rows = points.select("id", "label", "size", "x").join(component.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left")
    rows = scratch.keep(rows.withColumn("component", F.coalesce("component", "id")).drop("cid"), f"{name}-rows")
    groups = rows.where("id = component").withColumn("h", F.xxhash64("id")).select("h", "id", "label", "size", "x")
    shares, missed, last, draw, turn = [], None, None, first, 0
    while len(shares) < enough:
        left = groups if last is None else groups.where((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("id") > last[1])))
        asked = left.orderBy("h", "id").limit(draw).collect()
        if not asked:
            break
        last = (asked[-1].h, asked[-1].id)
        found = scratch.keep(_compared(rows, asked, threshold), f"{name}-{turn}")
        counts = found.groupBy("q").agg(F.sum("found").alias("f"), F.sum("missed").alias("m")).collect()
        shares += [r.f / (r.f + r.m) for r in counts]
        some = found.where("v is not null").select(F.col("q").alias("a"), F.col("v").alias("b"))
        missed = some if missed is None else missed.union(some)
        if len(asked) < draw:
            break
        draw, turn = min(draw * 4, most), turn + 1
    return (sum(shares) / len(shares) if shares else 1.0), missed


def _compared(rows: DataFrame, asked: list, threshold: float) -> DataFrame:
    """(q, found, missed, v): counts of an asked vector's links within and out of its component, and of the latter one for each other component met."""
    by_kind: dict[tuple, list] = {}
    for r in asked:
        by_kind.setdefault((r.label, r.size), []).append((r.id, bytes(r.x)))

    def work(batches):
        for batch in batches:
            kinds: dict[tuple, list[int]] = {}
            for i, kind in enumerate(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                if kind in by_kind:
                    kinds.setdefault(kind, []).append(i)
            ids, comps = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            for kind, at in kinds.items():
                own = np.array([o[0] for o in by_kind[kind]])
                x = _matrix(batch.column("x").take(pa.array(at)))
                q = np.frombuffer(b"".join(o[1] for o in by_kind[kind]), "<f8").reshape(len(own), -1)
                i, j = np.nonzero(q @ x.T >= threshold)
                i, j = own[i], np.array(at)[j]
                other = i != ids[j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                same = i == comps[j]
                asked_ids, back = np.unique(i, return_inverse=True)
                f, m = np.bincount(back, same), np.bincount(back, ~same)
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids), pa.array(f.astype(np.int64)), pa.array(m.astype(np.int64)), pa.nulls(len(asked_ids), pa.int64())], names=["q", "found", "missed", "v"])
                i, j = i[~same], j[~same]
                if len(i):
                    once = np.unique(np.stack([i, comps[j]]), axis=1, return_index=True)[1]
                    zero = pa.array(np.zeros(len(once), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(i[once]), zero, zero, pa.array(ids[j[once]])], names=["q", "found", "missed", "v"])

    return rows.mapInArrow(work, "q long, found long, missed long, v long")


def _grid(rows: DataFrame, kind: list[str], key: str, block: int) -> DataFrame:
    """`rows` dealt to pairs (part, other) of parts of about `block` rows, so that any two of one kind meet in one g."""
    parts = rows.groupBy(*kind).agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("parts"))
    rows = rows.join(parts, kind).withColumn("part", F.pmod(F.xxhash64(key), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("g", F.xxhash64(*kind, F.least("part", "other"), F.greatest("part", "other")))


def _full(graph: DataFrame, room: int, threshold: float) -> DataFrame:
    """Ids of vectors with at least `room` links in the graph: no other list can have lost a link for want of room."""
    return graph.where(F.col("s") >= threshold).groupBy("u").agg(F.count("*").alias("links")).where(F.col("links") >= room).select(F.col("u").alias("id"))


def _settle(rows: DataFrame, threshold: float, scratch: Scratch, name: str, block: int = 1024) -> DataFrame:
    """(a, b): for any two components with a link between vectors of `rows` (id, label, size, x, component), one such link at least.

    Members of a component lie in cells of about `block` rows. By the triangle inequality of angles two cells hold a link only if
    the angle of their centres is at most both radii and the threshold's angle; all such pairs of cells are compared in full.
    """
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    parts = rows.groupBy("component").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("parts"))
    placed = rows.join(parts, "component").select(F.xxhash64("label", "size", "component", F.pmod(F.xxhash64("id"), "parts")).alias("cell"), "id", "label", "size", "component", "x")
    placed = scratch.keep(placed, f"{name}-cells")

    def centre(batches):
        for batch in runs(batches, "cell"):
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            first, middles, radii = pa.array(cuts[:-1]), [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                x = _matrix(batch.column("x").slice(a, b - a))
                c = x.sum(0)
                c = c / np.sqrt(c @ c) if c @ c > 1e-12 else x[0]
                middles.append(c.tobytes())
                radii.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(first) for k in ("cell", "label", "size", "component")), pa.array(middles, pa.binary()), pa.array(radii)], names=["cell", "label", "size", "component", "c", "radius"])

    def meet(batches):
        for batch in runs(batches, "g"):
            g, part, other, cell, component, radius = (batch.column(k).to_numpy() for k in ("g", "part", "other", "cell", "component", "radius"))
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                c = _matrix(batch.column("c").slice(a, b - a))
                left = np.flatnonzero(part[a:b] == part[a:b].min())
                right = np.flatnonzero(part[a:b] != part[a:b].min()) if (part[a:b] != other[a:b]).any() else left
                near = np.arccos(np.clip(c[left] @ c[right].T, -1, 1)) <= radius[a:b][left, None] + radius[a:b][None, right] + reach
                i, j = np.nonzero(near & (component[a:b][left, None] != component[a:b][None, right]))
                u, v = cell[a:b][left[i]], cell[a:b][right[j]]
                once = u < v if right is left else np.ones(len(u), bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)[once]), pa.array(np.maximum(u, v)[once])], names=["one", "two"])

    def link(batches):
        for batch in runs(batches, "pair"):
            pair, side, ids, component = (batch.column(k).to_numpy() for k in ("pair", "side", "id", "component"))
            cuts = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                x, m = _matrix(batch.column("x").slice(a, b - a)), a + int((side[a:b] == 0).sum())
                i, j = np.nonzero((x[: m - a] @ x[m - a :].T >= threshold) & (component[a:m, None] != component[None, m:b]))
                if len(i):
                    _, at = np.unique(np.stack([component[a:m][i], component[m:b][j]]), axis=1, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:m][i[at]]), pa.array(ids[m:b][j[at]])], names=["a", "b"])

    cells = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(centre, "cell long, label string, size int, component long, c binary, radius double")
    cells = _grid(scratch.keep(cells, f"{name}-centres"), ["label", "size"], "cell", 2048)
    pairs = cells.select("g", "part", "other", "cell", "component", "c", "radius").repartition("g").sortWithinPartitions("g").mapInArrow(meet, "one long, two long")
    pairs = scratch.keep(pairs.select(F.xxhash64("one", "two").alias("pair"), "one", "two"), f"{name}-pairs")
    sides = pairs.select("pair", F.lit(0).alias("side"), F.col("one").alias("cell")).union(pairs.select("pair", F.lit(1).alias("side"), F.col("two").alias("cell")))
    sides = sides.join(placed, "cell").select("pair", "side", "id", "component", "x")
    return scratch.keep(sides.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(link, "a long, b long"), f"{name}-links")


def _exact_counts(points: DataFrame, component: DataFrame, threshold: float, block: int, scratch: Scratch) -> DataFrame:
    """(id, links): for each member of a component the vectors it is linked with, copies counted, itself not.

    Members within half the threshold's angle of the pivot, the vector with the component's id, are inner ones: linked with each
    other, as angles keep the triangle inequality. A pair of blocks is compared only if one of them has outer members.
    """
    root = component.select(F.col("component").alias("id"), "component").distinct()
    member = points.select("id", "times", "x").join(component.union(root), "id")
    pivots = points.select(F.col("id").alias("component"), F.col("x").alias("pivot")).join(root.select("component"), "component", "left_semi")
    half = float(np.cos(np.arccos(np.clip(threshold, -1, 1)) / 2 - 1e-6)) if threshold > 0 else 2.0

    def near(batches):
        for batch in batches:
            inner = np.zeros(batch.num_rows, bool)
            size = pc.binary_length(batch.column("x")).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x, p = (_matrix(batch.column(c).take(pa.array(at))) for c in ("x", "pivot"))
                inner[at] = (x * p).sum(1) >= half
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "times", "x", "component")), pa.array(inner)], names=["id", "times", "x", "component", "inner"])

    placed = member.join(pivots, "component").select("id", "times", "x", "component", "pivot").mapInArrow(near, "id long, times long, x binary, component long, inner boolean")
    placed = scratch.keep(placed, "members")
    sums = placed.groupBy("component").agg(
        F.coalesce(F.sum(F.when(F.col("inner"), F.col("times"))), F.lit(0)).alias("within"), *(F.greatest(F.ceil(F.count_if(c) / F.lit(float(block))), F.lit(1)).cast("int").alias(n) for n, c in (("inners", F.col("inner")), ("outers", ~F.col("inner")))),
        F.count_if(~F.col("inner")).alias("outside"),
    )
    rows = placed.join(sums, "component")
    sure = rows.where("inner").select("id", F.col("within").alias("links"))
    rows = rows.where("outside > 0")
    h = F.xxhash64("id")
    inner = rows.where("inner").withColumn("part", F.pmod(h, "inners").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)))
    inner = inner.select(F.xxhash64("component", F.lit(1), "other", "part").alias("g"), F.lit(1).alias("side"), F.lit(True).alias("mixed"), "id", "times", "x")
    outer = rows.where("not inner").withColumn("part", F.pmod(h, "outers").cast("int"))
    visits = outer.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("inners") - 1))).where("within > 0").select(F.xxhash64("component", F.lit(1), "part", "other").alias("g"), F.lit(0).alias("side"), F.lit(True).alias("mixed"), "id", "times", "x")
    each = outer.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)))
    each = each.select(F.xxhash64("component", F.lit(0), F.least("part", "other"), F.greatest("part", "other")).alias("g"), (F.col("part") > F.col("other")).cast("int").alias("side"), (F.col("part") != F.col("other")).alias("mixed"), "id", "times", "x")

    def work(batches):
        for batch in runs(batches, "g"):
            g, side, mixed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "side", "mixed"))
            ids, times = batch.column("id").to_numpy(), batch.column("times").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                x, i, t = _matrix(batch.column("x").slice(a, b - a)), ids[a:b], times[a:b]
                if not mixed[a]:
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array((x @ x.T >= threshold) @ t)], names=["id", "links"])
                    continue
                left = side[a:b] == 0
                linked = x[left] @ x[~left].T >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(i[left]), pa.array(linked @ t[~left])], names=["id", "links"])
                yield pa.RecordBatch.from_arrays([pa.array(i[~left]), pa.array(linked.T @ t[left])], names=["id", "links"])

    counted = inner.union(visits).union(each).repartition("g").sortWithinPartitions("g", "side", "id").mapInArrow(work, "id long, links long")
    return counted.union(sure).groupBy("id").agg((F.sum("links") - 1).alias("links"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.93, room: int = 16, most: int = 64, tables: int = 8, block: int = 512, rounds: int = 4, recall: float = 0.99, seed: int = 5) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Vectors are linked when labels are equal and not null and their cosine in double precision is at least `threshold`. A vector
    that is null, empty, zero, or holds nulls or non-finite numbers has no links; those of different length have none with each
    other. n_links counts other rows linked directly; component_id is the smallest id reachable, the row's own included. Rows
    with one id and one vector count as copies. A null id has a null component and is kept. An empty table gives an empty one;
    other columns are not read, whatever their names. Without label_col all rows are compared. Ties don't arise: the smallest id stays.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "embeddings")
    if label_col is None:
        vectors, label_col = vectors.withColumn("__label", F.lit("")), "__label"
    rows = scratch.keep(unit_vectors(vectors, id_col, vector_col, label_col), "rows")
    classes = rows.where("x is not null and id is not null").groupBy("label", "size", "x").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    points = scratch.keep(classes, "classes")
    sizes = points.groupBy("label", "size").agg(F.count("*").alias("n"))
    coded = scratch.keep(points.join(sizes, ["label", "size"]), "points")
    floor = max(2 * threshold**2 - 1, 0.0) if threshold > 0 else -1.0

    graph, extra, done, turn = None, None, 0, 0
    while True:
        new = None
        for table in range(done, done + tables):
            edges = _table_edges(coded, table, block, room, floor, seed)
            new = edges if new is None else new.union(edges)
        done += tables
        graph = scratch.keep(_best(new if graph is None else graph.union(new), room, most, threshold), f"graph-{turn}")
        links = graph.where(F.col("s") >= threshold).count()
        for _ in range(rounds):
            turn += 1
            graph = scratch.keep(_best(graph.union(_local_join(graph, points, room, floor)), room * 2 ** min(turn, 2), most, threshold), f"graph-{turn}")
            scratch.drop(f"graph-{turn - 1}")
            before, links = links, graph.where(F.col("s") >= threshold).count()
            if links <= before * 1.01:
                break
        turn += 1
        linked = graph.where(F.col("s") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        if extra is not None:
            linked = linked.union(extra)
        component = connected_components(linked, scratch, f"components-{done}")
        got, missed = audit(points, component, threshold, scratch, f"audit-{done}")
        if missed is not None:
            extra = missed if extra is None else extra.union(missed)
        whole = got < recall and done >= 8 * tables
        log.info("recall by groups %.4f after %d tables%s", got, done, "; all cells are compared exactly" if whole else "")
        if got >= recall or whole:
            break

    own = component.select(F.col("id").alias("a"), F.col("component").alias("b"))
    if missed is not None and not missed.isEmpty():
        component = connected_components(own.union(missed), scratch, "components-audited")
        own = component.select(F.col("id").alias("a"), F.col("component").alias("b"))
    full = points if whole else points.join(_full(graph, min(room, most), threshold), "id")
    full = full.join(component.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left")
    more = _settle(full.select("id", "label", "size", "x", F.coalesce("component", "id").alias("component")), threshold, scratch, "settle")
    if not more.isEmpty():
        component = connected_components(own.union(more), scratch, "components-settled")

    counts = _exact_counts(points, component, threshold, 2048, scratch)
    of = points.join(component, "id", "left").join(counts, "id", "left")
    of = of.select("label", "size", "x", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.col("times") - 1)).alias("n_links"))
    of = scratch.keep(of, "found")
    out = rows.join(of, ["label", "size", "x"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    out = scratch.keep(out, "result")
    scratch.drop_all_but("result")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

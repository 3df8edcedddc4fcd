"""Gradient histograms of tree nodes, and the best splits of a level from them, in one shuffle.

Tasks add up the rows that reach each node into arrays of whole numbers (gradients in fixed
point), a few rows of bytes for each node and chunk of features; those are added up by node and
chunk, the other child of a node is its parent less the child that was counted, and the same
task searches the splits.  Only best splits come to the driver, whatever the level's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniforms
from .binning import from_bytes
from .split import Chunk, Node, Regularisation, Search

#: Cells of a chunk of features; rows that are counted together; cells that a task holds for one pass.
CHUNK_CELLS, ROWS, TASK_CELLS = 4096, 1 << 17, 1 << 24
#: Bytes of a block of rows, and of the blocks that a task is sent at once.
BLOCK_BYTES, SENT_BYTES = 1 << 22, 1 << 23


def shifts(n: int, most: Sequence[float]) -> tuple[int, int]:
    """Binary places of the fixed-point sums of gradients and Hessians.

    n rows of values up to ``most`` then add up within 63 bits, and ROWS of them within the 53
    bits in which floating point is exact.
    """
    bits = min(52 - ROWS.bit_length(), 61 - max(n, 1).bit_length())
    return tuple(max(min(int(math.floor(bits - math.log2(x))), 200), -200) if x > 0 else 0 for x in most)


@dataclass
class Sample:
    """Which rows a tree is grown on: keyed draws below a share, or below each row's own chance."""

    seed: int = 0
    iteration: int = 0
    share: float | None = None

    def inside(self, slot: int, key: np.ndarray | None, chance: np.ndarray | None) -> np.ndarray | None:
        if self.share is None and chance is None:
            return None
        return uniforms(key, self.seed, self.iteration, slot) < (self.share if chance is None else chance)


@dataclass
class Task:
    """A tree's part in a level: how rows are routed, the nodes to count, and which outputs' gradients count."""

    slot: int
    router: object  # rows of codes -> nodes
    count: list[int]
    outputs: list[int]
    groups: dict[int, int]  # by node: the parent, by which partial sums are dealt
    others: dict[int, tuple[int, int]] = field(default_factory=dict)  # by parent: (child to count, child to derive)
    search: list[int] = field(default_factory=list)  # nodes whose split groups count


SUMS = "slot int, grp int, chunk int, node int, kind int, sums binary"
FOUND = "feature int, bin int, default_left boolean, categories array<int>, loss float, gl array<double>, hl array<double>, nl long, gr array<double>, hr array<double>, nr long, wl array<double>, wr array<double>, score double, tg array<double>, th array<double>, tn long"


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that have so many rows together at most, or one that has more."""
    waiting, n = [], 0
    for batch in batches:
        if n and n + batch.num_rows > rows:
            yield waiting
            waiting, n = [], 0
        waiting.append(batch)
        n += batch.num_rows
    if n:
        yield waiting


def _kind(column: str, code: type) -> type:
    """Type of a column's values in blocks."""
    return code if column == "codes" else np.float32 if column[1:].isdigit() else np.float64 if column == "chance" else np.int64


def _largest(column: str) -> str:
    return f"largest_{column}"


def in_blocks(rows: DataFrame, n_features: int, code: type) -> DataFrame:
    """Rows of codes, gradients and what sampling needs, up to ROWS of them in one row: bytes of each column, their number n.

    Every level reads them, and a row of its own costs many times its counting on the way to Python.
    Beside them is the largest absolute value of each column of gradients (``largest``).
    """
    names, values = rows.columns, [c for c in rows.columns if c[1:].isdigit()]
    width = sum(np.dtype(_kind(c, code)).itemsize * (n_features if c == "codes" else 1) for c in names)
    most = max(1, min(ROWS, BLOCK_BYTES // max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _pieces(_together(batches, most), names, n_features, code):
            x = {c: np.ascontiguousarray(column(c), _kind(c, code)) for c in names}
            tops = [float(np.abs(x[c].astype(np.float64)).max()) for c in values]
            yield pa.RecordBatch.from_arrays([pa.array([len(x["codes"])]), *(pa.array([v.tobytes()]) for v in x.values()), *(pa.array([v]) for v in tops)], names=["n", *names, *map(_largest, values)])

    return rows.mapInArrow(run, ", ".join(["n long", *(f"{c} binary" for c in names), *(f"{_largest(c)} double" for c in values)]))


def totals(blocks: DataFrame, outputs: int) -> tuple[int, list[float]]:
    """Number of rows, and the largest absolute gradient and Hessian."""
    row = blocks.agg(F.sum("n").alias("n"), *(F.greatest(*(F.max(_largest(f"{c}{k}")) for k in range(outputs)), F.lit(0.0)).alias(c) for c in "gh")).first()
    return row["n"] or 0, [row["g"] or 0.0, row["h"] or 0.0]


def _pieces(batches: Iterator[list[pa.RecordBatch]], names: Sequence[str], n_features: int, code: type) -> Iterator[Callable[[str], np.ndarray]]:
    """Of the rows of each of several batches, or of each block, a function from a column's name to its values."""
    at = {c: k for k, c in enumerate(names)}
    for several in batches:
        if "n" in at:
            for b in several:
                for k in range(b.num_rows):

                    def column(c: str, b=b, k=k) -> np.ndarray:
                        x = np.frombuffer(b.column(at[c])[k].as_buffer(), _kind(c, code))
                        return x.reshape(b.column(at["n"])[k].as_py(), n_features) if c == "codes" else x

                    yield column
        else:

            def column(c: str, several=several) -> np.ndarray:
                one = [from_bytes(b.column(at[c]), n_features, code) if c == "codes" else b.column(at[c]).to_numpy(zero_copy_only=False) for b in several]
                return np.concatenate(one)

            yield column


def partial_sums(rows: DataFrame, tasks: Sequence[Task], parts: Sequence[Chunk], n_features: int, code: type, shift: tuple[int, int], sample: Sample | None = None, first: int = 0) -> DataFrame:
    """Each partition's sums of the nodes to count: columns SUMS, kind 0.

    rows: codes, then g0, h0, g1, h1, ... by output, and if there is a sample its ``key`` and
    perhaps ``chance``; or blocks of them.  first: the number of the first of parts.
    """
    columns = rows.columns
    names = ["slot", "grp", "chunk", "node", "kind", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {t.slot: [np.zeros((len(t.count), 2 * len(t.outputs) + 1, c.cells), np.int64) for c in parts] for t in tasks}

        def add(column: Callable[[str], np.ndarray]) -> None:
            codes = column("codes")
            fixed = {c: np.floor(column(c).astype(np.float64) * 2.0 ** shift[c[0] == "h"] + 0.5) for t in tasks for k in t.outputs for c in (f"g{k}", f"h{k}")}
            key = column("key") if "key" in columns and sample else None
            chance = column("chance") if "chance" in columns and sample else None
            for t in tasks:
                node = t.router(codes)
                place = np.full(int(max(node.max(), *t.count)) + 1, -1, dtype=np.int64)
                place[t.count] = np.arange(len(t.count))
                place = place[node]
                inside = sample.inside(t.slot, key, chance) if sample else None
                own = np.flatnonzero(place >= 0 if inside is None else (place >= 0) & inside)
                if not len(own):
                    continue
                every = len(own) == len(place)
                place = place if every else place[own]
                weights = [w if every else w[own] for w in (*(fixed[f"g{k}"] for k in t.outputs), *(fixed[f"h{k}"] for k in t.outputs))]
                for c, sums in zip(parts, held[t.slot], strict=True):
                    for f, size, start in zip(c.features, c.sizes, c.starts, strict=False):
                        cell = place * (size + 1) + (codes[:, f] if every else codes[own, f])
                        whole = len(t.count) * (size + 1)
                        for j, w in enumerate(weights):
                            sums[:, j, start : start + size + 1] += np.bincount(cell, weights=w, minlength=whole).astype(np.int64).reshape(len(t.count), -1)
                        sums[:, -1, start : start + size + 1] += np.bincount(cell, minlength=whole).reshape(len(t.count), -1)

        for column in _pieces(_together(batches, ROWS), columns, n_features, code):
            add(column)
        for t in tasks:
            for i, node in enumerate(t.count):
                for c, sums in enumerate(held[t.slot]):
                    if sums[i, -1].any():
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (t.slot, t.groups[node], first + c, node, 0)), pa.array([sums[i].tobytes()])], names=names)

    return rows.mapInArrow(run, SUMS)


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where new values begin in sorted rows of keys."""
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)


def group_counts(rows: DataFrame, tasks: Sequence[Task], parts: Sequence[Chunk], n_features: int, code: type, sample: Sample | None = None) -> DataFrame:
    """How many split groups begin and end at each cell of the nodes to search: columns SUMS, kind 2.

    rows: as for ``partial_sums``, and ``grp``.  A node's group is put together from all its rows
    (least and largest bin of each feature, whether any value is missing): partitions emit one row
    for each group and node in ROWS of their rows, a shuffle by group merges them, sorted, so that a
    task holds a batch of them only.  The counts are those of
    groups by least bin and by largest bin, of all groups and of those without missing values, and
    in the cell of missing values the number of groups that have any.
    """
    columns = rows.columns
    kinds = "slot int, node int, grp long, low binary, high binary, gone binary"
    names = [x.split()[0] for x in kinds.split(", ")]

    def packed_rows(keys: np.ndarray, low: np.ndarray, high: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1].astype(np.int32)), pa.array(keys[:, 2].copy()), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (low, high, gone))], names=names)

    def merged_rows(keys, low, high, gone):
        order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
        keys, low, high, gone = keys[order], low[order], high[order], gone[order]
        first = _edges(keys)
        return keys[first], np.minimum.reduceat(low, first, axis=0), np.maximum.reduceat(high, first, axis=0), np.maximum.reduceat(gone, first, axis=0)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _pieces(_together(batches, ROWS), columns, n_features, code):
            codes = column("codes").astype(np.uint16)
            for t in tasks:
                node = t.router(codes)
                use = np.isin(node, t.search) & (sum(column(f"h{k}") for k in t.outputs) > 0)
                inside = sample.inside(t.slot, *(column(c) if c in columns else None for c in ("key", "chance"))) if sample else None
                own = np.flatnonzero(use if inside is None else use & inside)
                if len(own):
                    keys = np.stack([np.full(len(own), t.slot), node[own], column("grp")[own]], axis=1).astype(np.int64)
                    x = codes[own]
                    yield packed_rows(*merged_rows(keys, np.where(x == 0, np.uint16(65535), x), x, (x == 0).astype(np.uint8)))

    groups = {(t.slot, n): g for t in tasks for n, g in t.groups.items()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows stream by: held are one node's counts, and its last group, which the next batch may go on with."""
        of, sums, last = None, [], None

        def add(low: np.ndarray, high: np.ndarray, gone: np.ndarray) -> None:
            for out, chunk in zip(sums, parts, strict=True):
                for f, size, start in zip(chunk.features, chunk.sizes, chunk.starts, strict=False):
                    there, whole = high[:, f] > 0, gone[:, f] == 0
                    for row, x, use in ((0, low, there), (1, high, there), (2, low, there & whole), (3, high, there & whole)):
                        out[row, start : start + size + 1] += np.bincount(x[use, f], minlength=size + 1)
                    out[4, start] += (~whole).sum()

        def closed() -> Iterator[pa.RecordBatch]:
            add(*last[1:])
            for c, out in enumerate(sums):
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (of[0], groups[of], c, of[1], 2)), pa.array([out.tobytes()])], names=["slot", "grp", "chunk", "node", "kind", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            x = [np.frombuffer(b"".join(batch.column(j).to_pylist()), kind).reshape(batch.num_rows, n_features) for j, kind in ((3, np.uint16), (4, np.uint16), (5, np.uint8))]
            if last is not None:
                keys, x = np.concatenate([last[0], keys]), [np.concatenate(two) for two in zip(last[1:], x, strict=True)]
            keys, *x = merged_rows(keys, *x)
            edge = _edges(keys[:, :2])
            for a, b in zip(edge, np.append(edge[1:], len(keys)), strict=True):
                node = int(keys[a, 0]), int(keys[a, 1])
                if node != of:
                    if of is not None:
                        yield from closed()
                    of, sums = node, [np.zeros((5, c.cells), dtype=np.int64) for c in parts]
                add(*(v[a : b - 1] for v in x))
                last = (keys[b - 1 : b], *(v[b - 1 : b] for v in x))
        if of is not None:
            yield from closed()

    keys = ["slot", "node", "grp"]
    return rows.mapInArrow(local, kinds).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(counted, SUMS)


def _added(batches: Iterator[pa.RecordBatch], parts: Sequence[Chunk]) -> tuple[dict, dict, dict]:
    """Sums of nodes, and of parents, by (slot, group, chunk, node), and counts of split groups by (slot, chunk, node)."""
    own: dict[tuple, np.ndarray] = {}
    parents: dict[tuple, np.ndarray] = {}
    counts: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for slot, grp, chunk, node, kind, raw in zip(*(batch.column(c).to_pylist() for c in range(5)), batch.column(5), strict=True):
            sums = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, parts[chunk].cells)
            if kind == 2:
                counts[slot, chunk, node] = sums + counts.get((slot, chunk, node), 0)
            elif kind:
                parents[slot, grp, chunk, node] = sums
            elif (slot, grp, chunk, node) in own:
                own[slot, grp, chunk, node] += sums
            else:
                own[slot, grp, chunk, node] = sums.copy()
    return own, parents, counts


def searched(sums: DataFrame, tasks: Sequence[Task], parts: Sequence[Chunk], reg: Regularisation, shift: tuple[int, int], nodes: dict[tuple[int, int], Node], *, symmetric: bool = False, used=None, cuts=None) -> DataFrame:
    """Whole sums of every node and chunk, with its best split: slot, node, chunk, sums and FOUND.

    sums: partial sums (kind 0) and the parents' whole sums (kind 1).  For a symmetric level
    the splits are those of the one candidate that helps the level most, with its score.
    """
    scale = (2.0 ** -shift[0], 2.0 ** -shift[1])
    by = {t.slot: t for t in tasks}
    fields = [x.split()[0] for x in FOUND.split(", ")]
    names = ["slot", "node", "chunk", "sums", *fields]
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.float32(), *[pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()] * 2, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parents, counts = _added(batches, parts)
        for (slot, grp, chunk, parent), whole in parents.items():
            if parent in by[slot].others:
                one, other = by[slot].others[parent]
                mine = own.get((slot, grp, chunk, one))
                if mine is None:
                    own[slot, grp, chunk, one] = mine = np.zeros_like(whole)
                own[slot, grp, chunk, other] = whole - mine
        levels: dict[tuple, dict] = {}
        for (slot, _, chunk, node), hist in own.items():
            levels.setdefault((slot, chunk), {})[node] = hist
        for (slot, chunk), hists in levels.items():
            k = len(by[slot].outputs)
            search = Search(parts[chunk], reg, scale, k, used, cuts)
            search.groups = {n: counts[slot, chunk, n] for n in hists if (slot, chunk, n) in counts}
            score, rows = None, None
            if symmetric:
                score, rows = search.symmetric(hists, {n: nodes[slot, n] for n in hists}) or (None, {})
            for node, hist in hists.items():
                search.at = node
                found = rows.get(node) if symmetric else search.best(hist, nodes[slot, node])
                total = hist[:, : parts[chunk].starts[1]].sum(axis=1)
                row = {**(found or {}), "score": score if found else None, "tg": (total[:k] * scale[0]).tolist(), "th": (total[k : 2 * k] * scale[1]).tolist(), "tn": int(total[-1])}
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (slot, node, chunk)), pa.array([hist.tobytes()]), *(pa.array([row.get(f)], t) for f, t in zip(fields, kinds, strict=True))], names=names)

    keys = ["slot", "chunk"] if symmetric else ["slot", "grp", "chunk"]
    lanes = len(parts) * (len(tasks) if symmetric else sum(len(set(t.groups.values())) for t in tasks))
    width = max(1, min(lanes, int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return sums.repartition(width, *keys).mapInArrow(run, "slot int, node int, chunk int, sums binary, " + FOUND)


def cells(whole: DataFrame, parts: Sequence[Chunk], shift: tuple[int, int]) -> DataFrame:
    """(slot, node, feature, bin, g, h, n) of the occupied cells of whole sums of one output; bin -1 holds missing values."""
    names = ["slot", "node", "feature", "bin", "g", "h", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, node, chunk, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                c = parts[chunk]
                sums = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, c.cells)
                at = np.flatnonzero(sums[-1] > 0)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), x, np.int32)) for x in (slot, node)), pa.array(np.array(c.features, np.int32)[c.of[at]]), pa.array(c.bin[at].astype(np.int32)), pa.array(sums[0, at] * 2.0 ** -shift[0]), pa.array(sums[1, at] * 2.0 ** -shift[1]), pa.array(sums[-1, at])], names=names)

    return whole.select("slot", "node", "chunk", "sums").mapInArrow(run, "slot int, node int, feature int, bin int, g double, h double, n long")


def merged(found: list) -> dict[tuple[int, int], dict]:
    """Of each (slot, node) its totals and its best split over all chunks: the larger loss, then the lower feature."""
    out: dict[tuple[int, int], dict] = {}
    for r in sorted(found, key=lambda r: (r["slot"], r["node"], r["chunk"])):
        at = out.setdefault((r["slot"], r["node"]), {"g": r["tg"], "h": r["th"], "n": r["tn"], "split": None})
        if r["feature"] is not None and (at["split"] is None or (r["loss"], -r["feature"]) > (at["split"]["loss"], -at["split"]["feature"])):
            at["split"] = r
    return out


def merged_level(found: list) -> dict[tuple[int, int], dict]:
    """The same for symmetric levels: of each slot the chunk with the largest score, then the lowest feature."""
    best: dict[int, tuple] = {}
    for r in found:
        if r["feature"] is not None:
            rank = (r["score"], -r["feature"])
            best[r["slot"]] = max(best.get(r["slot"], rank), rank)
    keep = [r if r["feature"] is not None and (r["score"], -r["feature"]) == best[r["slot"]] else {**r.asDict(), "feature": None} for r in found]
    return merged(keep)


def parent_sums(whole: DataFrame, parents: dict[int, list[int]], *, symmetric: bool = False) -> DataFrame:
    """Whole sums of those nodes of a level before, as rows of kind 1."""
    wanted = F.lit(False)
    for slot, nodes in parents.items():
        wanted = wanted | ((F.col("slot") == slot) & F.col("node").isin(nodes))
    grp = F.lit(0) if symmetric else F.col("node")
    return whole.where(wanted).select("slot", grp.alias("grp"), "chunk", "node", F.lit(1).alias("kind"), "sums")


def leaf_sums(rows: DataFrame, routers: Sequence, outputs: Sequence[int], n_features: int, code: type, shift: tuple[int, int]) -> dict[tuple[int, int], tuple[float, float, int]]:
    """(gradient sum, Hessian sum, rows) by (number of the router, leaf), of all rows and one output for each router."""
    at = {c: k for k, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = from_bytes(batch.column(at["codes"]), n_features, code)
            for s, (router, k) in enumerate(zip(routers, outputs, strict=True)):
                node = router(codes)
                g, h = (np.floor(batch.column(at[f"{c}{k}"]).to_numpy(zero_copy_only=False).astype(np.float64) * 2.0 ** shift[c == "h"] + 0.5) for c in "gh")
                new = np.stack([*(np.bincount(node, weights=x) for x in (g, h)), np.bincount(node)]).astype(np.int64)
                old = held.get(s, np.zeros((3, 0), np.int64))
                wide = max(old.shape[1], new.shape[1])
                held[s] = sum(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (old, new))
        for s, x in held.items():
            n = np.flatnonzero(x[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), s, np.int32)), pa.array(n.astype(np.int32)), *(pa.array(x[j, n]) for j in range(3))], names=["slot", "node", "g", "h", "n"])

    got = rows.mapInArrow(run, "slot int, node int, g long, h long, n long").groupBy("slot", "node").agg(*(F.sum(c).alias(c) for c in "ghn")).collect()
    return {(r["slot"], r["node"]): (r["g"] * 2.0 ** -shift[0], r["h"] * 2.0 ** -shift[1], r["n"]) for r in got}

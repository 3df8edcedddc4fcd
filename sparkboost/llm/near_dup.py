"""Near-duplicate classes by DartMinHash signatures and exact verification.

A document is a multiset of word shingles.  Darts are thrown into the region of every
shingle (its weight times a range of ranks), those that land below the weight are hashed
to coordinates, and the earliest dart of each coordinate is the signature.  Two signatures
agree in a coordinate with the weighted Jaccard similarity of the multisets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .store import small_batches, written
from .text import U64, mix, shingles, slices

#: Coordinates of a signature and coordinates of a band: a pair of similarity 0.8 shares
#: none of the 32 bands with probability 5e-8.
COORDINATES, BAND = 128, 4
WORDS, SIMILARITY = 5, 0.8
#: A star's link is put to the exact test if this many of the 128 one-bit coordinates agree; a pair of
#: similarity 0.8 has 115 on average and fewer than 98 with probability 1e-6.
AGREE = 98
#: Rows of a run that are held together; rows and bytes of sets of a group in a run that is dealt out.
RUN_BLOCK, DEAL_ROWS, DEAL_BYTES = 1 << 16, 2048, 8 << 20
#: Words of a run's bit sets that are held together.
JOIN_WORDS = 1 << 20


def throw(row: np.ndarray, key: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest dart of each coordinate: (ids, found), both of shape (rows, k).

    limit: the rank up to which a row's darts are thrown.  A region is one element and one
    dyadic range of weight ([0,1), [1,2), [2,4), ...); its darts come in order of rank as a
    Poisson process that only the element and the range seed, so that equal regions of
    different rows have equal darts.
    """
    n = len(limit)
    levels = np.where(weight > 1, 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 1)
    of = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    wide = np.where(level > 0, low, 1.0)
    state = mix(key[of] + level.astype(U64) * U64(0x632BE59BD9B4E019))
    at, top, end = row[of], weight[of], limit[row[of]]
    rank = np.zeros(len(of))
    cells, ranks, ids = [], [], []
    j = 0
    while len(state):
        j += 1
        u = mix(state + U64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rank = rank - np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / wide
        live = np.flatnonzero(rank <= end)
        if len(live) < len(state):
            state, u, rank, at, top, end, low, wide = (x[live] for x in (state, u, rank, at, top, end, low, wide))
        v = mix(u ^ U64(0xC2B2AE3D27D4EB4F))
        hit = np.flatnonzero(low + wide * ((v >> U64(11)).astype(np.float64) * 2.0**-53) < top)
        cells.append(at[hit] * k + (((v[hit] & U64(0x7FF)) * U64(k)) >> U64(11)).astype(np.int64))
        ranks.append(rank[hit])
        ids.append(v[hit])
    cell, first, name = np.concatenate(cells or [np.zeros(0, np.int64)]), np.concatenate(ranks or [np.zeros(0)]), np.concatenate(ids or [np.zeros(0, U64)])
    best = np.full(n * k, np.inf)
    np.minimum.at(best, cell, first)
    won = first == best[cell]
    out = np.zeros(n * k, dtype=U64)
    out[cell[won]] = name[won]
    return out.reshape(n, k), np.isfinite(best).reshape(n, k)


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """(n, k) signatures of weighted sets given as (row, key, weight); rows without elements get zeros."""
    total = np.bincount(row, weights=weight, minlength=n)
    out = np.zeros((n, k), dtype=U64)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n)
    limit[todo] = (k * math.log(k) + 2 * k) / total[todo]
    place = np.zeros(n, np.int64)
    while len(todo):
        place[:] = -1
        place[todo] = np.arange(len(todo))
        own = np.flatnonzero(place[row] >= 0)
        ids, found = throw(place[row[own]], key[own], weight[own], limit[todo], k)
        full = found.all(axis=1)
        out[todo[full]] = ids[full]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def counted(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) in order of row and shingle; shingles have 48 bits."""
    row, h = shingles(data, off, width)
    both, n = np.unique((row.astype(U64) << U64(48)) | (h >> U64(16)), return_counts=True)
    return (both >> U64(48)).astype(np.int64), both & U64((1 << 48) - 1), n.astype(np.float64)


SKETCH = "row long, doc_id long, text_hash binary, s0 long, s1 long, bands array<long>"


def _sketch(width: int, k: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(k // band, dtype=U64) + U64(77))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for i, j, data, off in slices(text):
                row, key, count = counted(data, off, width)
                sig = signatures(row, key, count, j - i, k)
                bits = np.packbits(((sig >> U64(20)) & U64(1)).astype(np.uint8), axis=1)
                half = np.zeros((j - i, 16), np.uint8)
                half[:, : min(16, bits.shape[1])] = bits[:, :16]
                half = half.view(np.int64)
                h = np.zeros((j - i, k // band), dtype=U64)
                for b in range(band):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, b::band][:, : k // band])
                h = mix(h + salt)
                some = np.bincount(row, minlength=j - i) > 0
                at = np.concatenate([[0], np.cumsum(np.where(some, k // band, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(h[some].ravel().view(np.int64)))
                valid = text.slice(i, j - i).is_valid().to_pylist()
                hashes = [hashlib.md5(data[off[r] : off[r + 1]]).digest() if valid[r] else None for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number, number + j - i)), ids.slice(i, j - i), pa.array(hashes, pa.binary()), pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()), bands],
                    names=["row", "doc_id", "text_hash", "s0", "s1", "bands"],
                )
                number += j - i

    return run


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of runs of equal key (the first n_keys columns), whole runs together up to RUN_BLOCK rows.

    The flag says that the block's first run goes on from the block before.
    """
    held: list[np.ndarray] | None = None
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        n = len(cols[0])
        new = np.zeros(n, dtype=bool)
        for c in cols[:n_keys]:
            new[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        held = cols
        if not cut and n > RUN_BLOCK:
            cut = n
        if cut:
            yield [c[:cut] for c in cols], open_key == [c[0] for c in cols[:n_keys]]
            held = [c[cut:] for c in cols] if cut < n else None
            open_key = [c[-1] for c in cols[:n_keys]] if cut == n else None
    if held is not None:
        yield held, open_key == [c[0] for c in held[:n_keys]]


def _agree(a0, a1, b0, b1) -> np.ndarray:
    # of signed integers bitwise_count takes the magnitude
    return COORDINATES - np.bitwise_count((a0 ^ b0).view(U64)).astype(np.int64) - np.bitwise_count((a1 ^ b1).view(U64))


def _bits(s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack([s0, s1], axis=1).view(np.uint8), axis=1)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every run of a band key with two documents or more: each row with the run's pivot.

    The pivot is the member nearest to the bitwise majority of the run's sketches, which
    for copies of one original is the original; long runs are chained block by block.
    """
    chain = None
    for (key, doc, s0, s1), goes_on in _runs(batches, 1):
        border = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(border, len(key)))
        if goes_on and chain is not None:  # the pivot before joins this block's first run
            key, doc, s0, s1 = (np.concatenate([[c], x]).astype(np.int64) for c, x in zip(chain, (key, doc, s0, s1), strict=True))
            border = np.concatenate([[0], border[1:] + 1])
            size = np.diff(np.append(border, len(key)))
        keep = np.repeat(size > 1, size)
        last_only = size[-1] == 1
        chain = (key[-1], doc[-1], s0[-1], s1[-1]) if last_only else None
        key, doc, s0, s1 = (x[keep] for x in (key, doc, s0, s1))
        size = size[size > 1]
        if not len(size):
            continue
        run = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        major = np.packbits((np.add.reduceat(_bits(s0, s1).astype(np.int32), first, axis=0) * 2 >= size[:, None]).astype(np.uint8), axis=1).view(np.int64)
        near = _agree(s0, s1, major[run, 0], major[run, 1])
        order = np.lexsort((doc, -near, run))
        pivot = order[first]
        if not last_only:
            chain = tuple(x[pivot[-1]] for x in (key, doc, s0, s1))
        p = pivot[run]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (key, doc, s0, s1, doc[p], (_agree(s0, s1, s0[p], s1[p]) >= AGREE) & (doc != doc[p]))],
            names=["key", "row", "s0", "s1", "pivot", "close"],
        )


def _bridges(similarity: float):
    """Links of a run between components: all pairs of the run are tested, on whole sets.

    Only elements that two rows of the run have can be common to a pair; with one bit for each
    of them the common elements of a pair are counted exactly.  One link is given for
    components that nothing joined before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j, group, comp, sets), _ in _runs(batches, 3):
            border = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            a, b = [], []
            for lo, hi in zip(border, np.append(border[1:], len(key)), strict=True):
                if (comp[lo:hi] != comp[lo]).any():
                    for p, q in _joining(comp[lo:hi], group[lo:hi] if i[lo] != j[lo] else None, [np.frombuffer(x, dtype=U64) for x in sets[lo:hi]], similarity):
                        a.append(p)
                        b.append(q)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _joining(comp, group, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of components that a pair of rows links; the bits are held JOIN_WORDS words at a time."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    number, owner = place[number[shared[number]]], owner[shared[number]]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    common = np.zeros((n, n), np.int32)
    width = int(shared.sum()) // 64 + 1
    wide = max(1, JOIN_WORDS // n)
    for w in range(0, width, wide):
        lo, hi = np.searchsorted(number, [w * 64, (w + wide) * 64])
        bits = np.zeros((n, min(wide, width - w)), dtype=U64)
        np.bitwise_or.at(bits, (owner[lo:hi], (number[lo:hi] >> 6) - w), U64(1) << (number[lo:hi] & 63).astype(U64))
        step = max(1, 2 * JOIN_WORDS // bits.size)
        for x in range(0, n, step):
            common[x : x + step] += np.bitwise_count(bits[x : x + step, None] & bits[None]).sum(axis=2, dtype=np.int32)
    head: dict[int, int] = {}

    def find(c: int) -> int:
        while head.get(c, c) != c:
            c = head[c]
        return c

    step = max(1, JOIN_WORDS // n)
    for x in range(0, n, step):
        a = slice(x, x + step)
        ok = (common[a] >= similarity * (size[a, None] + size[None] - common[a]) - 1e-9) & (comp[a, None] < comp[None])
        if group is not None:
            ok &= group[a, None] != group[None]
        u, v = np.nonzero(ok)
        if len(u):
            for c, d in np.unique(np.stack([comp[u + x], comp[v]], axis=1), axis=0).tolist():
                p, q = find(c), find(d)
                if p != q:
                    head[max(p, q)] = min(p, q)
                    yield c, d


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                row, h = shingles(data, off, width)
                both = np.sort((row.astype(U64) << U64(48)) | (h >> U64(16)))
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
                nth = np.arange(len(both)) - np.repeat(first, np.diff(np.append(first, len(both))))
                element = mix((both & U64((1 << 48) - 1)) ^ mix(nth.astype(U64) + U64(0x9E3779B97F4A7C15)))
                row = (both >> U64(48)).astype(np.int64)
                element = element[np.lexsort((element, row))]
                at = (np.searchsorted(row, np.arange(j - i + 1)) * 8).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(element)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sets], names=["row", "elements"])

    return run


def _test(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(z.as_buffer(), dtype=U64) for z in (x, y))
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep[r] = common >= similarity * (len(both) - common) - 1e-9
            if keep.any():
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) that have that weighted Jaccard similarity, by their whole shingle sets."""
    left = sets.select(F.col("row").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("elements").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(_test(similarity), "a long, b long")


def _open_runs(multi: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """The runs that hold more than one component, with the rows' sets; large ones dealt out by pairs of groups."""
    there = multi.select("key", "row").join(comps.withColumnRenamed("vertex", "row"), "row", "left")
    there = written(there.withColumn("component", F.coalesce("component", "row")), "dedup-runs")
    size = F.octet_length("elements")
    keys = there.join(sets.select("row", size.alias("size")), "row").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    keys = keys.where("lo <> hi").select("key", F.greatest(F.ceil(F.col("n") / DEAL_ROWS), F.ceil(F.col("size") / DEAL_BYTES)).alias("g"))
    dealt = there.join(keys, "key").withColumn("grp", F.pmod(F.xxhash64("row"), F.col("g")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    dealt = dealt.join(sets, "row").select("key", F.least("grp", "other").alias("i"), F.greatest("grp", "other").alias("j"), "grp", "component", "elements")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _merged(comps: DataFrame, joined: DataFrame) -> DataFrame:
    """comps, and rows that were alone, after their components were joined: components of the components' names."""
    joined = joined.select(F.col("vertex").alias("component"), F.col("component").alias("into"))
    known = comps.join(joined, "component", "left").select("vertex", F.coalesce("into", "component").alias("component"))
    alone = joined.join(comps.select(F.col("vertex").alias("component")), "component", "left_anti")
    return known.unionByName(alone.select(F.col("component").alias("vertex"), F.col("into").alias("component")))


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def _by_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of texts (__id, __hash, ...) whose id and text are among wanted (doc_id, text_hash, ...), with its columns.

    Texts are shuffled once.  The hashed side of the join has some dozens of bytes for each
    text of the other, so that it is far smaller than the partitions that texts are cut to.
    """
    w = wanted.withColumnsRenamed({"doc_id": "__w_id", "text_hash": "__w_hash"}).hint("shuffle_hash")
    return texts.join(w, F.col("__id").eqNullSafe(F.col("__w_id")) & (F.col("__hash") == F.col("__w_hash"))).drop("__w_id", "__w_hash")


def _classes(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with text hashes, representatives of texts, their linked classes).

    Rows are told apart by a number of their own; of equal texts the row with the least doc_id
    stands for all of them.  Linked classes: rep, component, name (the least doc_id), keeper (its row).
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(docs.mapInArrow(_sketch(width, COORDINATES, BAND), SKETCH), "dedup-sketch")
    least = lambda doc, row: F.min(F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("id"), F.col(row).alias("row"))).alias("f")
    reps = sig.where("text_hash is not null").groupBy("text_hash").agg(least("doc_id", "row"))
    reps = written(reps.select("text_hash", F.col("f.row").alias("rep"), F.col("f.id").alias("first")), "dedup-copies")

    unique = sig.join(reps.select(F.col("rep").alias("row")), "row", "left_semi")
    rows = unique.select(F.explode("bands").alias("key"), "row", "s0", "s1")
    rows = rows.repartition("key").sortWithinPartitions("key")
    multi = written(rows.mapInArrow(_stars, "key long, row long, s0 long, s1 long, pivot long, close boolean"), "dedup-runs")
    wanted = multi.select("row").distinct().join(sig.select("row", "doc_id", "text_hash"), "row")
    texts = docs.where("text is not null").select(F.col("doc_id").alias("__id"), _hash(F.col("text")).alias("__hash"), "text")
    sets = _by_text(texts, wanted).select("row", "text").mapInArrow(_sets(width), "row long, elements binary")
    if _repeats(sig):
        sets = sets.dropDuplicates(["row"])
    sets = written(sets, "dedup-sets")
    stars = multi.where("close").select(F.col("row").alias("a"), F.col("pivot").alias("b")).distinct()
    links = written(_verified(stars, sets, similarity), "dedup-links")
    comps = written(connected_components(links), "dedup-components")
    bridges = written(_open_runs(multi, comps, sets).mapInArrow(_bridges(similarity), "a long, b long").distinct(), "dedup-links")
    if not bridges.isEmpty():
        comps = written(_merged(comps, connected_components(bridges)), "dedup-components")
    named = comps.join(reps.select(F.col("rep").alias("vertex"), "first"), "vertex").groupBy("component").agg(least("first", "vertex"))
    named = named.select("component", F.col("f.id").alias("name"), F.col("f.row").alias("keeper"))
    return sig, reps, comps.join(named, "component").withColumnRenamed("vertex", "rep")


def _repeats(sig: DataFrame) -> bool:
    """Whether rows repeat a doc_id together with its text."""
    return not sig.where("text_hash is not null").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, *, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row (doc_id, class_id) for each row of docs; a class is named by its least doc_id.

    Two documents are linked if their texts are equal or the weighted Jaccard similarity of
    their shingle counts reaches ``similarity``; classes are the connected components.  Copies
    of a text are folded into one before anything else.  Every band key's run is joined to a
    pivot (a star) and those links are verified on whole shingle sets; then all pairs of a run
    that are still in different components are tested too, likewise on whole sets, so that no
    link between different texts depends on the pivot or on a sketch.

    Cases: a text of one to four words has one shingle of all its words; empty texts are equal
    to each other; very long texts are read whole, one at a time; a null text is a class of its
    own, named by its doc_id; rows that share a doc_id are documents of their own, each in the
    class of its text; a row without a doc_id is in the class of its text too, which has no name if
    no row of it has a doc_id; ties in the name can't be; an empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    sig, reps, linked = _classes(docs, width, similarity)
    members = sig.select("doc_id", "text_hash").join(reps, "text_hash", "left")
    out = members.join(linked.select("rep", "name"), "rep", "left")
    return out.select("doc_id", F.coalesce("name", "first", "doc_id").alias("class_id"))


def deduplicated(docs: DataFrame, *, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, of which one document of each near-duplicate class stays.

    The document with the least doc_id stays, one without a doc_id only if no other of its class
    has any.  Of rows that repeat a doc_id with its text one stays; rows that share a doc_id but
    differ in text are different documents.  Rows without a text all stay.
    """
    sig, reps, linked = _classes(docs, width, similarity)
    kept = reps.join(linked.select("rep", "keeper"), "rep", "left").where("keeper is null or keeper = rep").select(F.col("first").alias("doc_id"), "text_hash")
    keyed = docs.where("text is not null").withColumns({"__id": F.col("doc_id").cast("long"), "__hash": _hash(F.col("text"))})
    one = _by_text(keyed, kept)
    if _repeats(sig):
        one = one.dropDuplicates(["__id", "__hash"])
    return one.select(*docs.columns).unionByName(docs.where("text is null"))

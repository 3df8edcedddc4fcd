"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that occurs in a text with at most k edits shares at least
``m - q + 1 - k * q`` of its q-grams with it, all on diagonals (text position minus item
position) no more than k apart.  Shared q-grams are counted in bands of 2(k+1) diagonals, one
every k+1, so that any k+1 neighbouring diagonals lie in one band; a band that reaches the
bound is verified by alignment within its diagonals.

q-grams that follow each other in all items that have them form a chain, and places of a text
that follow a chain are one run: a passage that many items share counts once for each item,
not once for each of its q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept_rows, small_batches
from .text import U64, mix, slices

#: Length of a q-gram in characters, and edits allowed for each character of an item.
Q, EDITS = 10, 0.08
#: Bytes of items that are sent to the executors at once; a larger benchmark is worked off in blocks.
BLOCK_BYTES = 4 << 20
#: Runs times items, and alignments, that are held together.
PAIRS, ALIGNED = 1 << 18, 1 << 11

_P = U64(0x9E3779B97F4A7C15)
_fold: np.ndarray | None = None


def folded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, offsets) of rows of UTF-8: in lower case, each white space as a blank, one for one."""
    global _fold
    if _fold is None:  # no letter has another case from 0x20000 on
        low = [chr(c).lower() for c in range(0x20000)]
        _fold = np.array([0x20 if chr(c).isspace() else ord(x) if len(x) == 1 else c for c, x in enumerate(low)], dtype=np.uint32)
    raw = data.tobytes()
    try:
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4")
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=total[1:])
        at = total[off]
    except UnicodeDecodeError:
        rows = [raw[a:b].decode(errors="replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        chars = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), dtype="<u4")
        at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    return np.where(chars < 0x20000, _fold[np.minimum(chars, 0x1FFFF)], chars), at


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters at each position."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    part, size, power = chars.astype(U64) + U64(1), 1, _P
    out, done = np.zeros(n, U64), 0
    while True:  # hashes of 1, 2, 4, ... characters, put together by the bits of q
        if q & size:
            out = out * power + part[done : done + n]
            done += size
        if done == q:
            return mix(out)
        part = part[: len(part) - size] * power + part[size:]
        size, power = 2 * size, U64(int(power) ** 2 & (1 << 64) - 1)


@dataclass
class Index:
    """q-grams of a block of items, in chains."""

    ids: list
    items: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    keys: np.ndarray  # sorted q-grams
    head: np.ndarray  # by q-gram: the first one of its chain
    depth: np.ndarray  # by q-gram: its place in the chain
    first: np.ndarray  # by q-gram: where its items begin in ``of`` and ``at``
    of: np.ndarray
    at: np.ndarray
    table: np.ndarray

    @classmethod
    def of_items(cls, rows: list[tuple[int, bytes]], q: int = Q, edits: float = EDITS) -> Index:
        items = [folded(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]))[0] for _, x in rows]
        size = np.array([len(x) for x in items], dtype=np.int64)
        budget = np.maximum(np.minimum((edits * size).astype(np.int64), (size - q) // q), 0)
        need = np.maximum(size - q + 1 - budget * q, 1)
        h = [grams(x, q) for x in items]
        of = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in h])
        at = np.concatenate([*(np.arange(len(x), dtype=np.int32) for x in h), np.zeros(0, np.int32)])
        keys, gram, count = np.unique(np.concatenate([*h, np.zeros(0, U64)]), return_inverse=True, return_counts=True)
        order = np.argsort(gram, kind="stable")
        first = np.concatenate([[0], np.cumsum(count)])
        head, depth = np.arange(len(keys)), np.zeros(len(keys), np.int64)
        if len(keys):
            after = np.where(np.append(of[1:] == of[:-1], False), np.append(gram[1:], -1), -1)[order]
            low, high = np.minimum.reduceat(after, first[:-1]), np.maximum.reduceat(after, first[:-1])
            linked = np.flatnonzero((low == high) & (low >= 0) & (count[low] == count))
            head[low[linked]], depth[low[linked]] = linked, 1
            while (depth[head] > 0).any():  # twice as far back each time
                depth, head = depth + depth[head], head[head]
        table = np.zeros(1 << 22, dtype=bool)
        table[(keys >> U64(42)).astype(np.int64)] = True
        return cls([i for i, _ in rows], items, budget, need, keys, head, depth, first, of[order], at[order], table)

    def runs(self, chars: np.ndarray, off: np.ndarray, q: int = Q) -> tuple[np.ndarray, ...]:
        """(row, position in the row, chain, place in the chain, length) of places that follow a chain."""
        h = grams(chars, q)
        may = np.flatnonzero(self.table[(h >> U64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[k] == h[may])
        pos, k = may[hit], k[hit]
        row = np.searchsorted(off, pos, side="right") - 1
        inside = pos + q <= off[row + 1]
        pos, k, row = pos[inside], k[inside], row[inside]
        chain, place = self.head[k], self.depth[k]
        new = np.ones(len(pos), dtype=bool)
        new[1:] = (pos[1:] != pos[:-1] + 1) | (row[1:] != row[:-1]) | (chain[1:] != chain[:-1]) | (place[1:] != place[:-1] + 1)
        start = np.flatnonzero(new)
        return row[start], pos[start] - off[row[start]], chain[start], place[start], np.diff(np.append(start, len(pos)))

    def bands(self, runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, least diagonal) of the bands in which an item's bound is met."""
        row, pos, chain, place, length = runs
        n = self.first[chain + 1] - self.first[chain]
        parts = -(-int(n.sum()) // PAIRS)  # items are dealt so that memory is bounded
        found = []
        for part in range(parts):
            first, of, at = self.first, self.of, self.at
            if parts > 1:
                own = of % parts == part
                first, of, at = np.concatenate([[0], np.cumsum(own)])[first], of[own], at[own]
                n = first[chain + 1] - first[chain]
            which = np.repeat(np.arange(len(row)), n)
            slot = np.repeat(first[chain] - (np.cumsum(n) - n), n) + np.arange(len(which))
            item = of[slot].astype(np.int64)
            start = at[slot] + place[which]
            diagonal = pos[which] - start
            band = diagonal // (self.budget[item] + 1)
            r, i, b = np.concatenate([row[which]] * 2), np.concatenate([item] * 2), np.concatenate([band, band - 1])
            start, stop = np.concatenate([start] * 2), np.concatenate([start + length[which]] * 2)
            order = np.lexsort((start, b, i, r))
            r, i, b, start, stop = r[order], i[order], b[order], start[order], stop[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])[: len(r)]
            if not len(r):
                continue
            # distinct places of the item: what lies beyond all intervals before it in the band
            wide = int(stop.max()) + 1
            lane = np.cumsum(new) * wide
            reach = np.concatenate([[0], np.maximum.accumulate(lane + stop)[:-1]]) - lane
            fresh = np.maximum(stop - np.maximum(start, reach), 0)
            group = np.flatnonzero(new)
            ok = group[np.add.reduceat(fresh, group) >= self.need[i[group]]]
            found.append((r[ok], i[ok], b[ok] * (self.budget[i[ok]] + 1)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def search(self, data: np.ndarray, off: np.ndarray, q: int = Q) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of every region that holds an item, in characters of the row.

        Of places that overlap, the one with the fewest edits is given, the first of equal ones.
        """
        if not len(self.keys) or len(data) < q:
            return []
        chars, off = folded(data, off)
        row, item, low = self.bands(self.runs(chars, off, q))
        order = np.argsort(np.array([len(x) for x in self.items])[item], kind="stable")
        places = []
        for k in range(0, len(order), ALIGNED):
            own = order[k : k + ALIGNED]
            edits, start, end = self.aligned(chars, off, row[own], item[own], low[own])
            hit = edits >= 0
            places += zip(row[own][hit].tolist(), item[own][hit].tolist(), start[hit].tolist(), end[hit].tolist(), edits[hit].tolist(), strict=True)
        out: list[tuple[int, int, int, int, int]] = []
        stop = -1
        for p in sorted(places):
            if out and out[-1][:2] == p[:2] and p[2] < stop:
                stop = max(stop, p[3])
                if (p[4], p[2]) < (out[-1][4], out[-1][2]):
                    out[-1] = p
            else:
                out.append(p)
                stop = p[3]
        return out

    def aligned(self, chars: np.ndarray, off: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, start, end) of the best alignment of each whole item within its band, edits -1 beyond the budget.

        All bands go forward together, an item's character at a time; those beyond their budget leave.
        """
        n, size = off[row + 1] - off[row], np.array([len(self.items[i]) for i in item])
        budget = self.budget[item]
        width, longest = int(2 * (budget.max() + 1) + 1), int(size.max())
        letters = np.full((len(item), longest), 0xFFFFFFFE, dtype=np.uint32)
        for c, i in enumerate(item):
            letters[c, : size[c]] = self.items[i]
        out = np.full((3, len(item)), -1, dtype=np.int64)
        ramp, big = np.arange(width), np.int64(1 << 24)
        diagonal = low[:, None] + ramp
        cost = np.where((diagonal >= 0) & (diagonal <= n[:, None]) & (ramp <= 2 * (budget[:, None] + 1)), 0, big)
        begin, live = np.repeat(ramp[None], len(item), axis=0), np.arange(len(item))
        for j in range(longest):  # after row j: item[: j + 1] ends at text position diagonal + j + 1
            at = diagonal[live] + j
            inside = (at >= 0) & (at < n[live, None])
            text = np.where(inside, chars[np.where(inside, at + off[row[live], None], 0)], 0xFFFFFFFF)
            take = cost + (text != letters[live, j, None])
            drop = np.concatenate([cost[:, 1:], np.full((len(live), 1), big)], axis=1) + 1  # a character that the text lacks
            from_drop = drop < take
            new = np.where(from_drop, drop, take)
            begin = np.where(from_drop, np.concatenate([begin[:, 1:], begin[:, :1]], axis=1), begin)
            new = np.where((at + 1 >= 0) & (at + 1 <= n[live, None]), new, big)
            # characters that the item lacks: the least of new[x] + (y - x) for x <= y
            reach = np.minimum.accumulate((new - ramp) * (width + 1) + ramp, axis=1)
            source = reach % (width + 1)
            cost = reach // (width + 1) + ramp
            begin = np.take_along_axis(begin, source, axis=1)
            least = cost.min(axis=1)
            done = size[live] == j + 1
            good = np.flatnonzero(done & (least <= budget[live]))
            if len(good):
                end = at[good] + 1
                fits = (cost[good] <= budget[live[good], None]) & (end >= 0) & (end <= n[live[good], None])
                rank = np.where(fits, (cost[good] * (width + 1) + begin[good]) * (width + 1) + ramp, np.iinfo(np.int64).max)
                x = rank.argmin(axis=1)
                ok = np.take_along_axis(fits, x[:, None], axis=1)[:, 0]
                g, x, c = good[ok], x[ok], live[good[ok]]
                out[:, c] = cost[g, x], low[c] + begin[g, x], low[c] + x + j + 1
            stay = ~done & (least <= budget[live])
            if not stay.all():
                live, cost, begin = live[stay], cost[stay], begin[stay]
            if not len(live):
                break
        return out[0], out[1], out[2]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size; an item with a null id or text takes no part."""
    rows: list[tuple[int, bytes]] = []
    size = 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        raw = r["text"].encode()
        if rows and size + len(raw) > block_bytes:
            yield rows
            rows, size = [], 0
        rows.append((int(r["item_id"]), raw))
        size += len(raw)
    yield rows


def contaminations(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, edits) of every region of a document that holds an item.

    Places and edits are in code points, of text in lower case with every white space
    character as a blank; a letter whose lower case is two characters stays as it is.  An item
    of m characters is found with up to ``edits * m`` edits, but no more than the lemma can
    tell from chance: (m - q) / q.

    The benchmark is a fixed query set: it is sent to the executors in blocks of at most
    ``block_bytes`` and every block is held against all documents.  No document is shuffled.

    Cases: items shorter than q characters can't be told from chance and never match; an item
    of fewer than 2q must match exactly; places of an item that overlap are one region, given by
    its best place, the first of equally good ones; null texts hold nothing; very long texts are
    searched whole, one at a time; a repeated document gives repeated rows, and items that differ
    in their id alone are each found; null doc_ids are passed on; an empty benchmark finds nothing
    and an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for rows in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Index.of_items(rows, q, edits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for i, j, data, off in slices(batch.column(1)):
                    got = index.search(data, off, q)
                    if got:
                        row = np.array([g[0] for g in got])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array([index.ids[g[1]] for g in got]), *(pa.array([g[x] for g in got]) for x in (2, 3, 4))],
                            names=["doc_id", "item_id", "start_char", "end_char", "edits"],
                        )

        part = thin.mapInArrow(run, "doc_id long, item_id long, start_char long, end_char long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark."""
    for rows in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Index.of_items(rows, q, edits))

        def clean(data: np.ndarray, off: np.ndarray, shared=shared) -> np.ndarray:
            keep = np.ones(len(off) - 1, dtype=bool)
            keep[[r for r, *_ in shared.value.search(data, off, q)]] = False
            return keep

        docs = kept_rows(docs, "text", clean)
    return docs

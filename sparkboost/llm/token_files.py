"""Token-id files compressed by Re-Pair grammars.

A block holds the ids of consecutive documents.  Frequent pairs of neighbouring ids are
replaced by new symbols (nonterminals), again and again; a block stores its rules, the
length of every rule's expansion and the shortened sequence.  A pair never crosses the
border of documents, so any document, and with the lengths any id of it, is decoded alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import new_path, small_batches
from .text import SLICE_BYTES, U64, mix, slices

#: Ids of one block at most (a longer document has a block of its own).
BLOCK_IDS = 1 << 19
#: A pair becomes a rule if it occurs so often in a block; rules and sequence are 16 bits wide
#: as long as all terminals fit, and then there are at most 65,536 symbols.
LEAST = 12
END = 2
MAGIC = b"RPG1"


@dataclass
class Grammar:
    """terminals: ids below are themselves; rule k replaces symbol terminals + k by (left, right)."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    sequence: np.ndarray

    def lengths(self) -> np.ndarray:
        """Ids that each rule expands to."""
        n = np.ones(self.terminals + len(self.left), dtype=np.int64)
        self._by_level(lambda k: n.__setitem__(self.terminals + k, n[self.left[k]] + n[self.right[k]]))
        return n[self.terminals :]

    def _by_level(self, f) -> None:
        """f on rules in groups whose parts all lie in earlier groups (a round's rules follow each other)."""
        k = 0
        highest = np.maximum(self.left, self.right).astype(np.int64)
        while k < len(self.left):
            ok = highest[k:] < self.terminals + k
            stop = k + (len(ok) if ok.all() else int(np.argmin(ok)))
            f(np.arange(k, stop))
            k = stop

    def expansions(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the full expansion of every rule, one behind the other."""
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.zeros(offsets[-1], dtype=np.uint32)

        def fill(k: np.ndarray) -> None:
            at = offsets[k]
            for side in (self.left[k].astype(np.int64), self.right[k].astype(np.int64)):
                n = np.ones(len(k), np.int64)
                inner = side >= self.terminals
                ids[at[~inner]] = side[~inner]
                rule = side[inner] - self.terminals
                n[inner] = lengths[rule]
                ids[_ranges(at[inner], n[inner])] = ids[_ranges(offsets[rule], n[inner])]
                at = at + n

        self._by_level(fill)
        return offsets, ids


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of start[i], start[i] + 1, ..., start[i] + n[i] - 1."""
    total = int(n.sum())
    out = np.repeat((start - (np.cumsum(n) - n)).astype(np.int32 if total < 1 << 30 else np.int64), n)
    out += np.arange(total, dtype=out.dtype)
    return out


def repair(ids: np.ndarray, last: np.ndarray, terminals: int, least: int = LEAST) -> tuple[Grammar, np.ndarray]:
    """The grammar of ids, and the lengths in symbols of the documents that end where ``last`` is true.

    In each round the pairs that occur ``least`` times or more are taken from the most frequent
    on, except for those that begin with the end or end with the beginning of one taken before:
    the taken ones then can't overlap and all are replaced at once.  It ends when no pair occurs
    so often or the symbols are used up.  A replacement makes other pairs rarer, so that a round
    counts only the places of pairs that were frequent in the one before and of new symbols.  The
    sequence is a linked list until the end: a round costs as much as the places that it looks at.
    """
    seq, last = ids.astype(np.uint32), last.copy()
    # a pair is one number, of 32 bits where all symbols have 16
    bits, kind, factor = (16, np.uint32, 0x9E3779B1) if terminals < 65536 else (32, U64, 0x9E3779B97F4A7C15)
    mask, drop = kind((1 << bits) - 1), kind(2 * bits - 20)
    lefts, rights = [], []
    symbols = terminals
    n = len(seq)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive, marked = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    may = np.flatnonzero(~last[:-1])
    while True:
        key = (seq[may].astype(kind) << kind(bits)) | seq[after[may]]
        small = ((key * kind(factor)) >> drop).astype(np.int32)
        coarse = small >> 3  # counts that stay near the processor
        stay = np.flatnonzero((np.bincount(coarse, minlength=1 << 17) >= least)[coarse])
        may, key, small = may[stay], key[stay], small[stay]
        if not len(may):
            break
        pairs = np.sort(key)
        border = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        count = np.diff(np.append(border, len(pairs)))
        room = 65536 - symbols if symbols < 65536 else 1 << 20
        good = np.flatnonzero(count >= least)
        good = good[np.lexsort((pairs[border[good]], -count[good]))]
        best = pairs[border[good]]
        place = ((best * kind(factor)) >> drop).astype(np.int64)
        begins, ends, slots = set(), set(), set()
        taken = []
        for g, (a, b, s) in enumerate(zip((best >> kind(bits)).tolist(), (best & mask).tolist(), place.tolist(), strict=True)):
            if len(taken) >= room:
                break
            if a not in ends and b not in begins and s not in slots and (a != b or a not in begins and b not in ends):
                begins.add(a)
                ends.add(b)
                slots.add(s)
                taken.append(g)
        if not taken:
            break
        names = best[taken]
        number = np.full(1 << 20, -1, dtype=np.int32)
        number[place[taken]] = np.arange(len(taken))
        name = number[small]
        hit = np.flatnonzero(name >= 0)
        hit = hit[names[name[hit]] == key[hit]]
        place, name = may[hit], name[hit].astype(np.int64)
        twins = names >> kind(bits) == names & mask
        if twins.any() and (twin := twins[name]).any():  # in a run of one id every second place
            p = place[twin]
            start = np.flatnonzero(np.concatenate([[True], after[p[:-1]] != p[1:]]))
            nth = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))
            odd = p[nth % 2 == 1]
            stay = ~np.isin(place, odd)
            place, name = place[stay], name[stay]
        gone = after[place]
        follow = after[gone]
        seq[place], last[place], after[place], alive[gone] = symbols + name, last[gone], follow, False
        inside = follow < n
        before[follow[inside]] = place[inside]
        marked[may] = True
        ahead = before[place]
        marked[ahead[ahead >= 0]] = True
        may = np.flatnonzero(marked)
        marked[may] = False
        may = may[alive[may] & ~last[may] & (after[may] < n)]
        lefts.append((names >> kind(bits)).astype(np.uint32))
        rights.append((names & mask).astype(np.uint32))
        symbols += len(names)
        if symbols == 65536:
            break
    none, seq, last = np.zeros(0, np.uint32), seq[alive], last[alive]
    ends_at = np.flatnonzero(last) + 1
    return Grammar(terminals, np.concatenate([none, *lefts]), np.concatenate([none, *rights]), seq), np.diff(np.concatenate([[0], ends_at]))


def pack(grammar: Grammar, lengths: np.ndarray) -> bytes:
    """Header, rules, expansion lengths and sequence as one block of bytes, with a checksum."""
    wide = "<u2" if grammar.terminals + len(grammar.left) <= 65536 else "<u4"
    body = b"".join(x.astype(t).tobytes() for x, t in ((grammar.left, wide), (grammar.right, wide), (lengths, "<u4"), (grammar.sequence, wide)))
    return MAGIC + struct.pack("<IIII", grammar.terminals, len(grammar.left), len(grammar.sequence), zlib.crc32(body)) + body


def unpack(raw: bytes) -> tuple[Grammar, np.ndarray]:
    if raw[:4] != MAGIC:
        raise ValueError("not a token block")
    terminals, rules, symbols, crc = struct.unpack_from("<IIII", raw, 4)
    body = raw[20:]
    if zlib.crc32(body) != crc:
        raise ValueError("a token block is damaged")
    wide = 2 if terminals + rules <= 65536 else 4
    t = f"<u{wide}"
    left = np.frombuffer(body, t, rules)
    right = np.frombuffer(body, t, rules, rules * wide)
    lengths = np.frombuffer(body, "<u4", rules, 2 * rules * wide).astype(np.int64)
    sequence = np.frombuffer(body, t, symbols, 2 * rules * wide + 4 * rules)
    return Grammar(terminals, left, right, sequence), lengths


class Block:
    """A block for reading; the expansions of all rules are made when a whole sequence is first asked for."""

    def __init__(self, raw: bytes, symbols: np.ndarray) -> None:
        self.grammar, self.lengths = unpack(raw)
        self.flat: np.ndarray | None = None
        self.ends = np.cumsum(symbols)

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        if self.flat is None:
            self.offsets, self.flat = self.grammar.expansions(self.lengths)
        sequence = sequence.astype(np.int64)
        rule = sequence - self.grammar.terminals
        inner = rule >= 0
        n = np.ones(len(sequence), np.int64)
        n[inner] = self.lengths[rule[inner]]
        at = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), dtype=np.uint32)
        out[at[~inner]] = sequence[~inner]
        out[_ranges(at[inner], n[inner])] = self.flat[_ranges(self.offsets[rule[inner]], n[inner])]
        return out

    def document(self, k: int) -> np.ndarray:
        """All ids of the block's k-th document."""
        return self.expand(self.grammar.sequence[self.ends[k - 1] if k else 0 : self.ends[k]])

    def span(self, k: int, first: int, stop: int) -> np.ndarray:
        """The ids first, ..., stop - 1 of the k-th document: expansion lengths lead to them, no other rule is expanded."""
        part = self.grammar.sequence[self.ends[k - 1] if k else 0 : self.ends[k]].astype(np.int64)
        rule = part - self.grammar.terminals
        n = np.where(rule >= 0, self.lengths[np.maximum(rule, 0)] if len(self.lengths) else 1, 1)
        end = np.cumsum(n)
        s = int(np.searchsorted(end, first, side="right"))
        skip, out = first - int(end[s] - n[s]) if s < len(end) else 0, []
        stack = part[s : int(np.searchsorted(end, stop, side="left")) + 1][::-1].tolist()
        while stack and len(out) < stop - first:
            symbol = stack.pop()
            inner = symbol - self.grammar.terminals
            size = int(self.lengths[inner]) if inner >= 0 else 1
            if skip >= size:
                skip -= size
            elif inner < 0:
                out.append(symbol)
            else:
                stack += [int(self.grammar.right[inner]), int(self.grammar.left[inner])]
        return np.array(out, dtype=np.uint32)

    def token(self, k: int, i: int) -> int:
        """The i-th id of the k-th document."""
        return int(self.span(k, i, i + 1)[0])


#: Slots for pieces, and ids of pieces, that a worker remembers.
SLOTS, REMEMBERED = 1 << 21, 1 << 23

# classes of bytes: blank, line end, other white space, ASCII letter or digit, mark, lead byte that white space may have
_BLANK, _LINE, _WHITE, _ALNUM, _MARK, _LEAD = 1, 2, 4, 8, 16, 32
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x20], _CLASS[0x0A] = _BLANK, _LINE
_CLASS[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = _WHITE
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = _ALNUM
_CLASS[[ord(c) for c in ".,;:!?"]] = _MARK
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def _wide_white(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which of the places ``lead`` begin white space outside ASCII."""
    b0 = data[lead]
    b1, b2 = (data[np.minimum(lead + k, len(data) - 1)] for k in (1, 2))
    two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    three = (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80) | (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80) | (b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)
    three |= (b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))
    return lead[two | three]


def _names(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(2, n) words that name each piece: of up to 16 bytes its length and all its bytes, else a 128-bit hash."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    out = np.empty((2, len(start)), dtype=U64)
    out[0] = mix((eight[start] & _LOW[np.minimum(size, 8)]) + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    out[1] = np.where(size > 8, eight[np.maximum(start + size - 8, 0)], U64(0))
    at = np.flatnonzero(size > 16)
    inner = 8
    while len(at):
        for k, c in enumerate((U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93))):
            out[k, at] = mix(out[k, at] * c + eight[start[at] + inner])
        inner += 8
        at = at[size[at] > inner + 8]
    return out


class Encoder:
    """Ids of texts by the tokenizers library, remembered by piece.

    A byte-level vocabulary's pre-tokens never reach across certain places: before a blank
    between characters that aren't white space, between an ASCII letter or digit and one of
    ``.,;:!?``, and around a single line end between characters that aren't white space.  Texts are cut there;
    pieces that aren't remembered are encoded by the library behind one another, once each, and
    told apart by the bytes that each id stands for.  A text with any other white space, or with
    the string of a special token, is encoded as it is.  A piece is recognised by its bytes, one of more than 16 bytes by a 128-bit
    hash; a new piece takes the slot of an old one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()  # a character of a byte-level token is a byte
        self.size = max(vocabulary.values()) + 1
        self.bytes_of = np.zeros(self.size, dtype=np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.table = np.zeros((SLOTS, 4), dtype=U64)  # the name of a piece, its first id's place, its number of ids
        self.ids, self.used = np.zeros(REMEMBERED, dtype=np.uint32), 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes], between: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces, encoded as one text with ``between`` behind each."""
        ids = self._library([b"".join(x + between for x in pieces).decode()])[0]
        at = np.cumsum(self.bytes_of[ids])
        size = np.array([len(x) for x in pieces])
        stop = np.cumsum(size + len(between)) - len(between)
        last = np.searchsorted(at, stop)
        begin = np.concatenate([[0], last[:-1] + 1 + len(between)])
        if (at[last] != stop).any() or (at[begin] - self.bytes_of[ids[begin]] != stop - size).any():
            raise ValueError("pieces don't end where ids end: not a byte-level vocabulary")
        return ids[_ranges(begin, last + 1 - begin)], last + 1 - begin

    def _specials(self, data: np.ndarray) -> np.ndarray:
        """Where strings of special tokens begin."""
        raw, found = data.tobytes(), []
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                found.append(at)
                at = raw.find(x, at + 1)
        return np.array(found, dtype=np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts by row) of the rows of a slice."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if self.used > REMEMBERED:
            self._forget()
        kind = _CLASS[data]
        at, after = kind[:-1], kind[1:]
        cut = np.empty(len(data), dtype=bool)
        cut[1:] = (after & (_BLANK | _LINE)) | (at & _LINE) | ((at << 1) & after & _MARK)
        cut[off[:-1][off[:-1] < len(data)]] = True
        white = kind & (_BLANK | _LINE | _WHITE)
        double = np.flatnonzero((white[:-1] != 0) & (white[1:] != 0)) + 1
        border = off[1:][off[1:] > off[:-1]] - 1
        rare = np.flatnonzero(kind & (_WHITE | _LEAD))
        is_lead = kind[rare] == _LEAD
        strange = np.concatenate([double[~np.isin(double, off)], border[white[border] != 0], rare[~is_lead], _wide_white(data, rare[is_lead]), self._specials(data)])
        whole = np.zeros(n, dtype=bool)
        whole[np.searchsorted(off, strange, side="right") - 1] = True
        start = np.flatnonzero(cut)
        row = np.searchsorted(off, start, side="right") - 1
        if whole.any():
            stay = ~whole[row] | (start == off[row])
            start, row = start[stay], row[stay]
        end = np.append(start[1:], len(data))
        key = _names(data, start, end - start)
        slot = (mix(key[0] ^ key[1] * U64(0xA24BAED4963EE407)) >> U64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
        there = np.take(self.table, slot, axis=0)
        hit = (there[:, 0] == key[0]) & (there[:, 1] == key[1]) & ~whole[row]
        first, count = there[:, 2].astype(np.int64), there[:, 3].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            single, entire = miss[~whole[row[miss]]], miss[whole[row[miss]]]
            _, pick, inverse = np.unique(mix(key[0, single]) + key[1, single], return_index=True, return_inverse=True)
            pick = single[pick]
            lead = data[start[pick]]
            raw = [data[s:e].tobytes() for s, e in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]
            begin, n_ids = np.zeros(len(pick), np.int64), np.zeros(len(pick), np.int64)
            for own, between in ((lead == 0x20, b""), ((lead != 0x20) & (lead != 0x0A), b"\n"), (lead == 0x0A, None)):
                own = np.flatnonzero(own)
                if not len(own):
                    continue
                if between is None:
                    parts = self._library([raw[i].decode() for i in own])
                    ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
                else:
                    ids, counts = self._joined([raw[i] for i in own], between)
                begin[own], n_ids[own] = self._put(ids) + np.cumsum(counts) - counts, counts
            first[single], count[single] = begin[inverse], n_ids[inverse]
            self.table[slot[pick]] = np.stack([*key[:, pick], begin.astype(U64), n_ids.astype(U64)], axis=1)
            kept = self.used
            for k, ids in zip(entire, self._library([data[start[k] : end[k]].tobytes().decode() for k in entire]), strict=True):
                first[k], count[k] = self._put(ids), len(ids)
        out = self.ids[_ranges(first, count)]
        if len(miss):
            self.used = kept  # texts that were encoded as they are aren't remembered
        return out, np.bincount(row, weights=count, minlength=n).astype(np.int64)

    def _put(self, ids: np.ndarray) -> int:
        """Where the ids have been put behind the remembered ones."""
        at = self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), REMEMBERED >> 2), np.uint32)])
        self.ids[at : at + len(ids)] = ids
        self.used = at + len(ids)
        return at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILE = "part long, block long, block_start long, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, symbols array<long>, grammar binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text of docs and writes the blocks below path, in ascending order of doc_id.

    Every row of the Parquet files at path is a block: number of its part (ranges of doc_id in
    ascending order), its number and first position in the part, the least and the largest
    doc_id, the documents with their counts of ids and of symbols, and the packed grammar.
    Blocks are built one at a time.  Parts are ranges of doc_id, then of the text's hash and of
    the place in the input, so that rows of one doc_id, or without any, are dealt over parts.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ties = {"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()}
    ranged = thin.withColumns(ties).repartitionByRange("doc_id", *ties).sortWithinPartitions("doc_id", *ties).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        docs_held: list[pa.Array] = []
        ids_held: list[np.ndarray] = []
        counts_held: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal number, start, held
            n, flat = np.concatenate(counts_held), np.concatenate(ids_held)
            last = np.zeros(len(flat), dtype=bool)
            last[np.cumsum(n) - 1] = True
            grammar, symbols = repair(flat, last, max(code.size, end + 1))
            ids = pa.concat_arrays(docs_held)
            known = ids.drop_null()
            ends = (known[0].as_py(), known[-1].as_py()) if len(known) else (None, None)
            row = [[part], [number], [start], *([x] for x in ends), [ids], [n], [symbols], [pack(grammar, grammar.lengths())]]
            number, start, held = number + 1, start + len(flat), 0
            for x in (docs_held, ids_held, counts_held):
                x.clear()
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            cols = [pa.ListArray.from_arrays(pa.array([0, len(x[0])], pa.int32()), x[0] if isinstance(x[0], pa.Array) else pa.array(x[0])) if pa.types.is_list(t) else pa.array(x, t) for x, t in zip(row, types, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=["part", "block", "block_start", "first_id", "last_id", "doc_ids", "n_tokens", "symbols", "grammar"])

        for batch in batches:
            for i, j, data, off in slices(batch.column(1), SLICE_BYTES // 2):
                ids, counts = code.encode(data, off)
                at = np.concatenate([[0], np.cumsum(counts)])
                full = np.insert(ids, at[1:], np.uint32(end))
                counts, at = counts + 1, at + np.arange(j - i + 1)
                done = 0
                while done < j - i:  # as many documents as the block has room for
                    room = block_ids - held
                    to = int(np.searchsorted(at, at[done] + room, side="right")) - 1
                    to = max(min(to, j - i), done if held else done + 1)
                    if to > done:
                        docs_held.append(batch.column(0).slice(i + done, to - done))
                        ids_held.append(full[at[done] : at[to]])
                        counts_held.append(counts[done:to])
                        held += int(at[to] - at[done])
                        done = to
                    if done < j - i:
                        yield block()
        if held:
            yield block()

    ranged.mapInArrow(run, FILE).write.parquet(path)


def read_tokens(spark, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files at path.

    start: ids of all documents before it in the whole set of files.
    """
    files = spark.read.schema(FILE).parquet(path)
    parts = files.select("part", (F.col("block_start") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("stop")).groupBy("part").agg(F.max("stop").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, doc, n, symbols, raw = (batch.column(c)[k] for c in range(6))
                n = n.values.to_numpy(zero_copy_only=False)
                symbols = symbols.values.to_numpy(zero_copy_only=False)
                block = Block(raw.as_buffer().to_pybytes(), symbols)
                ids = block.expand(block.grammar.sequence)
                at = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = np.array([zlib.crc32(raw[4 * at[d] : 4 * at[d + 1]]) for d in range(len(n))], dtype=np.int64)
                cols = [pa.array(np.full(len(n), part.as_py(), np.int64)), doc.values, pa.array(start.as_py() + at[:-1]), pa.array(n), pa.array(crc)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["part", "doc_id", "local", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = "part long, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    out = files.select("part", "block_start", "doc_ids", "n_tokens", "symbols", "grammar").mapInArrow(run, kinds)
    return out.join(parts, "part").select("doc_id", (F.col("local") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_document(spark, path: str, doc_id: int, first: int = 0, stop: int | None = None) -> DataFrame:
    """(doc_id, ids) of the documents of that id: all their ids, or those from ``first`` to before ``stop``.

    Only blocks whose range of ids holds doc_id are read (their borders are in the files' statistics),
    and of a block only the rules that the asked ids need are expanded.
    """
    files = spark.read.schema(FILE).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, n, symbols, raw in zip(*(batch.column(c) for c in range(4)), strict=True):
                at = np.flatnonzero(doc.values.fill_null(doc_id + 1).to_numpy() == doc_id)
                n, block = n.values.to_numpy(), Block(raw.as_buffer().to_pybytes(), symbols.values.to_numpy())
                for k in at.tolist():
                    end = int(n[k]) if stop is None else min(stop, int(n[k]))
                    ids = block.span(k, first, end) if first < end else np.zeros(0, np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.select("doc_ids", "n_tokens", "symbols", "grammar").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, *, end: int = END) -> DataFrame:
    """Writes the token files of docs to the shared folder and returns what is read back from them.

    Cases: null and empty texts are the end id alone; repeated rows are written as often as they
    come; rows that share a doc_id come in order of a hash of their texts; a null doc_id comes
    first; a document of more ids than a block holds has a block of its own; an empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end=end)
    return read_tokens(docs.sparkSession, path)

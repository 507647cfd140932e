"""Byte-level BPE by dynamic programming over prefixes.

A byte-pair encoding of a piece is the one sequence of tokens in which every two neighbours are compatible, that is,
in which the merges would not have joined or cut them in another way. So every prefix of the piece has exactly one last
token: a suffix automaton of the vocabulary (its tries and suffix links) lists the tokens that end at a position, and
the first of them that is compatible with the last token of the prefix before it is stored. Back-pointers from the end
give the ids. No merge is ever replayed.

Whole columns are encoded at once: the split pattern always cuts between a non-space and a white-space character, so
texts are taken apart into stretches there, each distinct stretch of a part of a column is split into pieces once, and
the automaton, the compatibility tests and the back-pointers run over all distinct pieces in step, one prefix length
after the other. Pieces over LONG bytes run by themselves. Answers of compatibility tests stay in a table of fixed size.

Defined results: null and empty texts have no ids; the vocabulary's special strings in a text become their ids, as the
tokenizers library does it; any text decodes to itself, since every byte is a token. Texts are encoded whole; a piece of
thousands of characters takes time in proportion to its length. Repeated rows are encoded each by itself, extra columns
are ignored (or kept, where a function says so), an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from . import textvec as tv
from .fingerprint import slices

#: The split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of the number of slots for answers of compatibility tests.
SLOTS = 20
#: Bytes of a part of a column.
PART = 8 << 20
#: Pieces of more bytes run by themselves, others in blocks of so many.
LONG, BLOCK = 40, 1 << 16


def _printable() -> dict[str, int]:
    """The byte that each printable stand-in character of the vocabulary file means."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Reads a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _printable()
        if model["type"] != "BPE" or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} isn't a byte-level BPE vocabulary")
        self.bytes: dict[int, bytes] = {i: bytes(byte[c] for c in s) for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        by = {s: i for s, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}  # by token, the rank of the merge that makes it; -1: a single byte
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = by[a], by[b], by[a + b]
            self.rank[left, right] = r
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (left, right), r
        self.automaton = ahocorasick.Automaton()
        for s, i in by.items():
            if i in self.parts or len(self.bytes[i]) == 1:
                raw = self.bytes[i]
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
                self.born.setdefault(i, -1)
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # A merge can't make these from their own bytes; they never stand at the start of a piece as a whole.
        self.odd = {i for i, (a, b) in self.parts.items() if not self._fits(a, b, self.born[i])}
        self._tables()

    def _fits(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether two tokens stay apart side by side: undo, from the latest, the merges that made the two tokens'
        facing ends; at no moment may the facing parts have a merge that would have come before the undone one.
        below: only merges of a lower rank count."""
        rank, parts, born = self.rank, self.parts, self.born
        while True:
            r = rank.get((left, right))
            if r is not None and r < below:
                return False
            bl, br = born[left], born[right]
            if bl < 0 and br < 0:
                return True
            # A left part's merge happens before a right one of equal rank, so that one is undone last.
            if bl > br:
                below = min(below, bl)
                left = parts[left][1]
            else:
                below = min(below, br + 1)
                right = parts[right][0]

    def _tables(self) -> None:
        """The same vocabulary as arrays: the automaton's states (prefixes of tokens, numbered by length), tokens' parts
        and merges, and the answers found so far."""
        top = max(self.bytes) + 1
        state, child, longest, parent = {b"": 0}, [], [-1], [-1]
        tokens = {self.bytes[i]: i for i in self.born}
        for raw in sorted({raw[:k] for raw in tokens for k in range(1, len(raw) + 1)}, key=len):
            state[raw] = len(longest)
            child.append(state[raw[:-1]] << 8 | raw[-1])
            longest.append(tokens.get(raw, -1))
            parent.append(state[raw[:-1]])
        self.child = _Lookup(np.array(child, np.int64), np.arange(1, len(longest)))
        self.suffix = np.zeros(len(longest), np.int32)  # the longest shorter state that ends a state's bytes
        keys, own = np.array(child, np.int64) & 255, np.array(parent[1:], np.int64)
        depth = np.zeros(len(longest), np.int64)
        for k in range(1, len(longest)):
            depth[k] = depth[parent[k]] + 1
        for d in range(2, int(depth.max(initial=0)) + 1):
            at = np.flatnonzero(depth == d)
            self.suffix[at] = self._step(self.suffix[own[at - 1]].astype(np.int64), keys[at - 1])
        # Of each state: the longest token that ends it; of each token: the longest shorter token that ends it.
        longest = np.array(longest, np.int32)
        shorter = np.full(top, -1, np.int32)
        for d in range(1, int(depth.max(initial=0)) + 1):
            at = np.flatnonzero(depth == d)
            below = longest[self.suffix[at]]
            is_token = longest[at] >= 0
            shorter[longest[at[is_token]]] = below[is_token]
            longest[at[~is_token]] = below[~is_token]
        self.longest, self.shorter = longest, shorter
        self.size, self.made = np.zeros(top, np.int32), np.full(top, -1, np.int64)
        self.left, self.right, self.unfit = np.zeros(top, np.int64), np.zeros(top, np.int64), np.zeros(top, bool)
        for i, raw in self.bytes.items():
            self.size[i] = len(raw)
        for i, r in self.born.items():
            self.made[i] = r
        for i, (a, b) in self.parts.items():
            self.left[i], self.right[i] = a, b
        self.unfit[list(self.odd)] = True
        self.merges = _Lookup(np.array([a << 32 | b for a, b in self.rank], np.int64), np.array(list(self.rank.values())))
        self.asked = np.full(1 << SLOTS, -1, np.int64)
        self.answer = np.zeros(1 << SLOTS, bool)
        raw = [self.bytes.get(i, b"") for i in range(top)]
        self.raw, self.spelled = pa.array(raw, pa.binary()), pa.array([b",%d" % i for i in range(top)], pa.binary())

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's next states."""
        out = self.child.get(state << 8 | byte)
        todo = np.flatnonzero((out < 0) & (state > 0))
        at = state[todo]
        while len(todo):
            at = self.suffix[at].astype(np.int64)
            found = self.child.get(at << 8 | byte[todo])
            out[todo] = found
            more = (found < 0) & (at > 0)
            todo, at = todo[more], at[more]
        return np.maximum(out, 0)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_fits of many pairs, by what is known and, for the rest, in step."""
        key = left.astype(np.int64) << 32 | right
        slot = _slots(key, SLOTS)
        out = self.answer[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            found = self._fit(keys)
            out[new] = found[back]
            where = _slots(keys, SLOTS)
            _, one = np.unique(where, return_index=True)  # a slot's key and answer come from one pair
            self.asked[where[one]], self.answer[where[one]] = keys[one], found[one]
        return out

    def _fit(self, key: np.ndarray) -> np.ndarray:
        left, right = key >> 32, key & 0xFFFFFFFF
        out = np.ones(len(key), bool)
        at, below = np.arange(len(key)), np.full(len(key), 1 << 60)
        while len(at):
            r = self.merges.get(left << 32 | right)
            bad = (r >= 0) & (r < below)
            out[at[bad]] = False
            bl, br = self.made[left], self.made[right]
            more = ~bad & ((bl >= 0) | (br >= 0))
            at, left, right, bl, br, below = at[more], left[more], right[more], bl[more], br[more], below[more]
            undo = bl > br
            below = np.minimum(below, np.where(undo, bl, br + 1))
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
        return out

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the split pattern."""
        n = len(piece)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        done = -1
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - length
            if token in self.odd if not start else last[start] < 0 or not self._fits(last[start], token):
                continue
            last[end + 1], size[end + 1], done = token, length, end
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def pieces(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces of data one after the other, and where each one's begin."""
        count = np.zeros(len(length) + 1, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, places from the end, ids
        for k in np.flatnonzero(length > LONG):
            ids = np.array(self.piece(data[begin[k] : begin[k] + length[k]].tobytes()), np.int32)
            done.append((np.full(len(ids), k), np.arange(len(ids))[::-1], ids))
            count[k + 1] = len(ids)
        order = np.argsort(-length, kind="stable")
        order = order[(length[order] <= LONG) & (length[order] > 0)]
        for a in range(0, len(order), BLOCK):
            self._block(data, begin, length, order[a : a + BLOCK], done, count)
        np.cumsum(count, out=count)
        ids = np.zeros(count[-1], np.int32)
        for k, back, token in done:
            ids[count[k + 1] - 1 - back] = token
        return ids, count

    def _block(self, data, begin, length, own, done, count) -> None:
        """Pieces by falling length, so those that have a prefix of a length stand first."""
        size = length[own]
        last = np.full((int(size[0]) + 1, len(own)), -1, np.int32)
        state = np.zeros(len(own), np.int64)
        for p in range(int(size[0])):
            n = int(np.searchsorted(-size, -p, "left"))
            state = self._step(state[:n], data[begin[own[:n]] + p].astype(np.int64))
            at, token = np.arange(n), self.longest[state]
            while len(at):
                start = p + 1 - self.size[token]
                before = last[start, at]
                ok = np.where(start > 0, before >= 0, ~self.unfit[token])
                ask = np.flatnonzero(ok & (start > 0))
                ok[ask] = self.compatible(before[ask], token[ask])
                last[p + 1, at[ok]] = token[ok]
                at, token = at[~ok], self.shorter[token[~ok]]
                at, token = at[token >= 0], token[token >= 0]
        k, at, back = np.arange(len(own)), size.copy(), 0
        while len(k):
            token = last[at, k]
            done.append((own[k], np.full(len(k), back), token))
            at -= self.size[token]
            count[own[k[at == 0]] + 1] = back + 1
            k, at, back = k[at > 0], at[at > 0], back + 1

    def column(self, col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Of a column of texts: each stretch's number among the distinct ones, where each text's begin, and the ids of
        the distinct stretches with where each one's begin."""
        data, offs = tv.raw(col)
        data = np.ascontiguousarray(data)
        cuts = _cuts(data, offs, self.special)
        first = np.searchsorted(cuts[:-1], offs, "left")
        first[-1] = len(cuts) - 1
        stretches = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        data, offs = tv.raw(stretches.dictionary)
        mixed = _mixed(data, offs, self.special)
        size, number, flat = np.ones(len(mixed), np.int64), {}, []
        special, most = self.specials, len(mixed)
        for k in np.flatnonzero(mixed).tolist():
            s = data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "surrogatepass")
            n = len(flat)
            for part in [s] if special is None or not special.search(s) else special.split(s):
                if part in self.special:
                    flat.append(-self.special[part] - 1)
                else:
                    flat += [number.setdefault(x, len(number)) for x in self.split.findall(part)]
            size[k] = len(flat) - n
        ids, at = self.pieces(data, offs[:-1], np.where(mixed, 0, np.diff(offs)))
        raw, o = tv.raw(pa.array([x.encode("utf-8", "surrogatepass") for x in number], pa.binary()))
        more, then = self.pieces(raw, o[:-1], np.diff(o))
        named = np.array(sorted(self.special.values()), np.int32)
        ids = np.concatenate((ids, more, named))
        at = np.concatenate((at, at[-1] + then[1:], at[-1] + then[-1] + 1 + np.arange(len(named))))
        flat = np.array(flat, np.int64)
        flat = np.where(flat >= 0, most + flat, most + len(number) + np.searchsorted(named, -flat - 1))
        own, odd = np.empty(size.sum(), np.int64), np.repeat(mixed, size)
        own[odd], own[~odd] = flat, np.flatnonzero(~mixed)
        each, where = gather(ids, at, own)
        return stretches.indices, first, each, where[np.concatenate(([0], np.cumsum(size)))]

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        codes, first, ids, at = self.column(col)
        out, where = gather(ids, at, codes.to_numpy())
        return out, where[first]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_column(pa.array([text or ""], pa.large_string()))[0].tolist()

    def decode(self, ids) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, ids)).decode("utf-8", "replace")


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.astype(tv.U) * tv.U(0x9E3779B97F4A7C15) >> tv.U(64 - bits)).astype(np.int64)


class _Lookup:
    """Numbers by distinct keys: a table of at least twice as many slots, with the next free slot for each key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        slot, todo = _slots(keys, self.bits), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]
            set_ = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[set_]] = values[set_]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) % size

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 where there is none."""
        slot = _slots(keys, self.bits)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            todo, slot = todo[more], slot[more]
        return out


def gather(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists which of those that begin at `at` in values, one after the other, and where each begins."""
    n = at[which + 1] - at[which]
    where = np.zeros(len(which) + 1, np.int64)
    np.cumsum(n, out=where[1:])
    return values[np.repeat(at[which] - where[:-1], n) + np.arange(where[-1])], where


#: Classes of bytes: letters, digits, other ASCII characters, ASCII spaces; 0 where more bytes are needed to tell.
_LETTER, _DIGIT, _OTHER, _SPACE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
#: Last bytes of the UTF-8 forms of spaces beyond ASCII.
_LAST = np.zeros(256, bool)
_LAST[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True


def _classes(data: np.ndarray) -> np.ndarray:
    """Of each byte. U+00C0 to U+023F are letters but for two signs."""
    out = _CLASS[data]
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    at = at[at + 1 < len(data)]
    at = at[(data[at] != 0xC3) | ((data[at + 1] != 0x97) & (data[at + 1] != 0xB7))]
    out[at] = out[at + 1] = _LETTER
    return out


def _found(data: np.ndarray, special) -> Iterator[tuple[int, int]]:
    raw = data.tobytes() if special else b""
    for s in special:
        s = s.encode()
        at = raw.find(s)
        while at >= 0:
            yield at, at + len(s)
            at = raw.find(s, at + 1)


def _cuts(data: np.ndarray, offs: np.ndarray, special) -> np.ndarray:
    """Where stretches begin, and the end: at the beginnings of texts, at ASCII spaces after a character that is none,
    and between letters, digits and others (not after an apostrophe, nor inside special strings). The split pattern cuts
    at all of these; where a character's class isn't known from its bytes, fewer cuts give the same ids."""
    c = _classes(data)
    cut = np.zeros(len(data) + 1, bool)
    before, own = c[:-1], c[1:]
    ink = (before > 0) & (before < _SPACE)
    cut[1:-1] = (own == _SPACE) & (ink | ((data[:-1] >= 0x80) & ~_LAST[data[:-1]])) | ink & (own > 0) & (own < _SPACE) & (own != before) & (data[:-1] != 0x27)
    for a, b in _found(data, special):
        cut[a + 1 : b] = False
    cut[offs] = True
    return np.flatnonzero(cut)


def _mixed(data: np.ndarray, offs: np.ndarray, special) -> np.ndarray:
    """Whether the split pattern must be asked: not where a stretch is a space at most and characters of one class."""
    if len(offs) < 2:
        return np.zeros(0, bool)
    c = _classes(data)
    begin, end = offs[:-1], offs[1:]
    spaced = (data[begin] == 0x20) & (end - begin > 1)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((c == 0) | (c == _SPACE) | (data == 0x27), out=total[1:])
    change = np.zeros(len(data) + 1, np.int64)
    np.cumsum(c[1:] != c[:-1], out=change[1:-1])  # before the byte
    change[-1] = change[-2]
    out = (total[end] > total[begin] + spaced) | (change[end - 1] > change[begin + spaced])
    for a, _ in _found(data, special):
        out[np.searchsorted(offs, a, "right") - 1] = True
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """All columns of docs, and ids array<int> (in place of a column of that name)."""
    prepare(docs.sparkSession)
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        out, at = encoder(path).encode_column(pa.array(texts, pa.large_string()))
        return pd.Series(np.split(out, at[1:-1]) if len(texts) else [], index=texts.index, dtype=object)

    return docs.withColumn("ids", ids(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def decode_ids(rows: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """All columns of rows, and decoded string. Null ids decode to the empty text."""
    prepare(rows.sparkSession)
    path = path or vocabulary()

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: encoder(path).decode([] if x is None else x))

    return rows.withColumn("decoded", text(F.col(column)))


def _joined(strings: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The strings of the ids of each list, joined."""
    all_ = strings.take(pa.array(ids))
    where = np.frombuffer(all_.buffers()[1], np.int32)[: len(ids) + 1][at]
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(where)), all_.buffers()[2] or pa.py_buffer(b"")])


def _bytes(strings: pa.Array, codes: pa.Array, first: np.ndarray) -> Iterator[bytes]:
    """Of each text: the strings of its stretches, joined."""
    all_ = strings.take(codes)
    data = memoryview(all_.buffers()[2] or b"")
    where = np.frombuffer(all_.buffers()[1], np.int32)[: len(codes) + 1][first].tolist()
    for a, b in zip(where, where[1:]):
        yield data[a:b]


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the decimal ids and of the text that they decode to."""
    prepare(docs.sparkSession)
    path = path or vocabulary()

    def run(batches):
        e = encoder(path)
        for b in batches:
            for lo, hi in slices(b.column(1), PART):
                codes, first, ids, at = e.column(b.column(1).slice(lo, hi - lo))
                n = np.concatenate(([0], np.cumsum(np.diff(at)[codes.to_numpy()])))
                spelled = [hashlib.sha256(x[1:]).hexdigest() for x in _bytes(_joined(e.spelled, ids, at), codes, first)]
                decoded = [hashlib.sha256(bytes(x).decode("utf-8", "replace").encode("utf-8", "surrogatepass")).hexdigest() for x in _bytes(_joined(e.raw, ids, at), codes, first)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(n[first])), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

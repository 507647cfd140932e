"""Vectorised tokenising and hashing of whole Arrow string columns.

Words are found on the UTF-8 bytes: each of the word patterns used here treats every byte of a non-ASCII character
alike, so byte classes and character classes agree. A text is never cut: chunks end between texts, or, within a text
longer than a chunk, between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(int(_BASE), -1, 2**64))
CHUNK = 1 << 20

#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
#: For bytes.translate: lower-case A-Z.
FOLD_BYTES = FOLD.tobytes()
_FOLDED = _BYTE[FOLD]

_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        n = max(n, CHUNK + 1)
        for k, b in (("p", _BASE), ("i", _INV)):
            a = np.full(n, b, U)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=U)
        _pow["n"] = n
    return _pow["p"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins (one more than rows). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _cuts(data: np.ndarray, offs: np.ndarray, isword: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about CHUNK, ending between texts or, in a longer text, after a separator."""
    at, end = 0, int(offs[-1])
    while at < end:
        k = int(np.searchsorted(offs, at + CHUNK, "right")) - 1
        to = int(offs[k])
        if to <= at:  # one text is longer than a chunk
            to, last = at + CHUNK, int(offs[k + 1])
            while to < last:
                seps = np.flatnonzero(~isword[data[to : min(last, to + CHUNK)]])
                if len(seps):
                    to += int(seps[0]) + 1
                    break
                to = min(last, to + CHUNK)
            to = min(to, last)
        yield at, to
        at = to


def spans(data: np.ndarray, offs: np.ndarray, isword: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all words and the bytes after them. No word goes on from one text to the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = isword[data]
    begins = m.copy()
    begins[1:] &= ~m[:-1]
    inner = offs[(offs < len(data))]
    begins[inner] = m[inner]
    ends = m.copy()
    ends[:-1] &= ~m[1:]
    last = offs[offs > 0] - 1
    ends[last] = m[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(col: pa.Array, isword: np.ndarray = SPACED, fold: bool = True, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words of a column, with the index of each row's first word (one more than rows), and the
    words' first and last-plus-one bytes in raw()'s data. prefix: also hashes of the words' first so many bytes."""
    data, offs = raw(col)
    table = _FOLDED if fold else _BYTE
    hashes, begins, ends, heads = [], [], [], []
    for a, b in _cuts(data, offs, isword):
        part = data[a:b]
        lo, hi = np.searchsorted(offs, a, "left"), np.searchsorted(offs, b, "right")
        own = np.unique(np.concatenate(([0], offs[lo:hi] - a, [b - a])))
        s, e = spans(part, own, isword)
        p, inv = _powers(b - a + 1)
        total = np.zeros(b - a + 1, U)
        np.cumsum(table[part] * p[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inv[s] + (e - s).astype(U)))
        if prefix:
            heads.append(mix((total[np.minimum(s + prefix, e)] - total[s]) * inv[s]))
        begins.append(s + a)
        ends.append(e + a)
    none = np.zeros(0, np.int64)
    s = np.concatenate([none, *begins])
    out = np.concatenate([none.astype(U), *hashes]), np.searchsorted(s, offs, "left"), s, np.concatenate([none, *ends])
    return (*out, np.concatenate([none.astype(U), *heads])) if prefix else out


def hash_bytes(words: list[bytes], fold: bool = True) -> np.ndarray:
    """The same hashes for single words."""
    out = np.zeros(len(words), U)
    for k, w in enumerate(words):
        b = np.frombuffer(w, np.uint8)
        p, _ = _powers(len(b) + 1)
        out[k] = ((_FOLDED if fold else _BYTE)[b] * p[: len(b)]).sum(dtype=U) + U(len(b))
    return mix(out)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words of one sequence of word hashes."""
    if len(h) < n:
        return np.zeros(0, U)
    p, inv = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inv[: len(h) - n + 1] + U(n))


def sizes(offs: np.ndarray) -> np.ndarray:
    return np.diff(offs)

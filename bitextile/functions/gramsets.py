"""Sets of trigrams, marks and digits of many texts at once, as numbers in numpy arrays, for kernels that compare them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from .text import PUNCTUATION, _plain

#: Characters from here on have no ASCII letter under them for functions.text.squeezed().
_TOP, _DROP = 0x3000, 255
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_NUMBER = {c: k for k, c in enumerate(_LETTERS, 1)}
_TAGS = {c: 1 << k for k, c in enumerate(sorted(set("|".join(PUNCTUATION.values()))))}


@lru_cache
def _tables() -> tuple[np.ndarray, ...]:
    """By character: its letter as a number (0: line end), whether plain.squeezed() has other letters, its tags, whether it may be a digit."""
    letter, tags = np.full(_TOP + 1, _DROP, np.uint8), np.zeros(_TOP + 1, np.int32)
    single = dict(zip(*_plain()))
    for k in range(_TOP):
        c = single.get(chr(k), chr(k))
        letter[k] = _NUMBER.get(c.lower(), _DROP) if c.isascii() else _DROP
    letter[10] = 0
    other = np.array([k >= 0x80 and chr(k) not in single and unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore") != b"" for k in range(_TOP)] + [True])
    for c, names in PUNCTUATION.items():
        tags[ord(c)] = sum(_TAGS[x] for x in set(names))
    digit = np.array([chr(k).isdigit() for k in range(_TOP)] + [True])
    return letter, other, tags, digit


def _characters(texts: list[str]) -> np.ndarray:
    """Characters of texts without line ends, one a line, none above _TOP."""
    return np.minimum(np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)


def _sets(characters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    v = _tables()[0][characters]
    v = v[v != _DROP].astype(np.int32 if n < 1 << 15 else np.int64)
    end = v == 0
    at, ends = np.cumsum(end, dtype=v.dtype), np.flatnonzero(end)
    inside = ~(end[:-2] | end[1:-1] | end[2:])
    keys = (at[:-2] << 16 | v[:-2] * 1369 + v[1:-1] * 37 + v[2:])[inside]
    begins = np.concatenate(([0], ends + 1))
    sizes = np.concatenate((ends, [len(v)])) - begins
    short = []
    for k in np.flatnonzero(sizes < 3):
        x = [int(c) for c in v[begins[k] : begins[k] + sizes[k]]]
        # A shorter text is one gram, with zeros at its end, which no other has; an empty one is "item".
        grams = [x + [0] * (3 - len(x))] if x else [[_NUMBER[c] for c in "ite"], [_NUMBER[c] for c in "tem"]]
        short += [int(k) << 16 | a * 1369 + b * 37 + c for a, b, c in grams]
    if short:
        keys = np.concatenate((keys, np.array(short, v.dtype)))
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys & 0xFFFF, np.searchsorted(keys >> 16, np.arange(n + 1))


def folded_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of functions.text.squeezed() as numbers below 2^16, one text after the other, and where each begins."""
    return _sets(_characters(texts), len(texts))


def described(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Trigrams of plain.squeezed() as in folded_grams() with their begins, lengths, marks as bits, and a number for digits, equal where these are."""
    texts = [t.replace("\n", " ") for t in texts] if any("\n" in t for t in texts) else texts
    _, other, tags, digit = _tables()
    characters = _characters(texts)
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    owner = lambda flags: np.unique(np.searchsorted(begins, np.flatnonzero(flags), "right") - 1)
    found = tags[characters]
    # The line end after each text keeps an empty one from reading the next.
    found = np.append(found, 0)
    marks = np.bitwise_or.reduceat(found, begins) | np.where(np.add.reduceat((found != 0).astype(np.int64), begins) > 1, _TAGS["|"], 0)
    numbers, ids = np.zeros(len(texts), np.int64), {"": 0}
    for k in owner(digit[characters]):
        numbers[k] = ids.setdefault("".join(filter(str.isdigit, texts[k])), len(ids))
    odd = owner(other[characters])
    if len(odd):
        texts = list(texts)
        for k in odd:
            texts[k] = unicodedata.normalize("NFKD", texts[k]).encode("ascii", "ignore").decode().replace("\n", " ")
        characters = _characters(texts)
    return *_sets(characters, len(texts)), lengths, marks, numbers


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """plain.share()."""
    return np.where((a > 0) & (b > 0), np.minimum(a, b) / np.maximum(np.maximum(a, b), 1), 0.0)

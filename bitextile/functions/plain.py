"""The text similarities of functions.text for grouped Python kernels, on plain strings."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .text import BOUNDARY, PUNCTUATION, SUFFIXES, _plain

_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]")


@lru_cache(100_000)
def squeezed(text: str) -> str:
    plain = (text if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()).lower()
    return re.sub("[^a-z0-9]+", "", plain) or "item"


@lru_cache(100_000)
def grams(text: str) -> frozenset[str]:
    s = squeezed(text)
    return frozenset(s[i : i + 3] for i in range(max(1, len(s) - 2)))


@lru_cache(100_000)
def marks(text: str) -> frozenset[str]:
    return frozenset("|".join(PUNCTUATION[c] for c in text if c in PUNCTUATION))


@lru_cache(100_000)
def digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def overlap(a: frozenset, b: frozenset, both_empty: float = 1.0) -> float:
    common = len(a & b)
    union = len(a) + len(b) - common
    return common / union if union else both_empty


def share(a: float, b: float) -> float:
    return min(a, b) / max(a, b) if a > 0 and b > 0 else 0.0


def signals(a: str, b: str) -> tuple[float, float, float, float]:
    """Length, trigrams, punctuation, digits."""
    return share(len(a), len(b)), overlap(grams(a), grams(b), 0.0), overlap(marks(a), marks(b)), float(digits(a) == digits(b))


@lru_cache(200_000)
def sentence_total(a: str, b: str) -> float:
    length, trigram, punctuation, digit = signals(a, b)
    return length * 0.35 + trigram * 0.40 + punctuation * 0.20 + digit * 0.05


@lru_cache(100_000)
def tokens(text: str) -> tuple[tuple[int, str, str], ...]:
    """(place from 1, token, kind)."""
    kind = lambda t: "number" if t.isdigit() else "word" if any(map(str.isalpha, t)) else "punct"
    return tuple((k, t, kind(t)) for k, t in enumerate(_TOKEN.findall(text), 1))


@lru_cache(100_000)
def lemma(word: str, language: str) -> str:
    s = squeezed(word)
    return next((s[: -len(x)] for x in SUFFIXES.get(language, ()) if s.endswith(x) and len(s) - len(x) >= 3), s)


@lru_cache(100_000)
def lemmas(text: str, language: str) -> frozenset[str]:
    return frozenset(lemma(t, language) for _, t, kind in tokens(text) if kind == "word")


def span_total(a: str, b: str, languages: tuple[str, str] = ("pl", "cs")) -> float:
    """For spans of sentences; without an analyser's tags the overlap of tags is that of two empty sets."""
    length, trigram, punctuation, digit = signals(a, b)
    return 0.28 * length + 0.28 * trigram + 0.14 * punctuation + 0.05 * digit + 0.15 * overlap(lemmas(a, languages[0]), lemmas(b, languages[1])) + 0.05 + 0.05


def token_texts(text: str) -> list[str]:
    """functions.text.tokens()."""
    return _TOKEN.findall(text)


def token_kind(token: str) -> str:
    """functions.text.token_kind() of one of token_texts()."""
    return "number" if token.isdecimal() else "word" if token.isalpha() or any(map(str.isalpha, token)) else "punct"


_FOLDED = {ord(c): plain for c, plain in zip(*_plain())}
_OTHER = bytes(k for k in range(256) if not (chr(k).isascii() and chr(k).isalnum()))


def folded(text: str) -> str:
    """functions.text.squeezed(): letters without a single ASCII letter under them go, where squeezed() here expands them."""
    plain = text.encode() if text.isascii() else text.translate(_FOLDED).encode("ascii", "ignore")
    return plain.lower().translate(None, _OTHER).decode() or "item"


_BOUNDARY = re.compile(BOUNDARY)


def split_sentences(text: str) -> list[str]:
    """functions.text.split_sentences() of a cleaned text."""
    return [x for x in _BOUNDARY.split(text) if x]


def ending_cut(form: str, language: str) -> str:
    """functions.text.lemma_of() of a word in its normalised form."""
    return next((form[: -len(x)] for x in SUFFIXES.get(language, ()) if form.endswith(x) and len(form) - len(x) >= 3), form)


_BITS: dict[str, int] = {}


def letter_bits(text: str) -> int:
    """The set of a text's characters as bits of a number, the same ones in one process."""
    out = 0
    for c in text:
        out |= _BITS.get(c) or _BITS.setdefault(c, 1 << len(_BITS))
    return out


def token_spans(text: str) -> list[tuple[int, int]]:
    """First and last-plus-one characters of tokens()."""
    return [m.span() for m in _TOKEN.finditer(text)]

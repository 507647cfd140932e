"""Scalar text functions as Catalyst column expressions.

All of them stay on the JVM. Null texts give null unless a function says otherwise.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A sentence ends at white space between these.
BOUNDARY = r"(?<=[.!?…])\s+(?=[\"'“”«»„A-Z0-9\-])"
BOUNDARY_UNICODE = r"(?<=[.!?…])\s+(?=[\"'“”«»„\p{Lu}0-9\-])"
#: Digits, letters, or one mark.
TOKEN = r"\p{Nd}+|[\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"
#: Tags of punctuation marks.
PUNCTUATION = {"„": "Q", "”": "Q", '"': "Q", "'": "Q", "—": "D", "-": "D", ",": "C", ".": "P", "!": "E", "?": "QMARK", ";": "S", ":": "COL", "(": "B", ")": "B"}
#: Frequent words, and endings in the order in which they are tried, by language.
STOPWORDS = {
    "pl": "a ale bo by do i jak jest na nie o od po się to w z że".split(),
    "cs": "a ale by do i jak je na ne o od po se si to v z že už".split(),
}
SUFFIXES = {
    "pl": "ami ach ego emu owie owi owa owe iem ych om em ie y a ę ą".split(),
    "cs": "ami ech ich ého emu ové ovi ova ove em ou ím ý á é y a u".split(),
}
#: Words that hint at German or Latin insertions.
GERMAN = (
    "ein zwei drei vier fuenf funf achtung jawohl bitte herr frau kamerad marsch bahnhof schwein los raus komm weiter halt nicht ja nein gut wurst bier gott mit uns der die das schla befehl fertig"
).split()
LATIN = "etc sic ergo nota bene corpus delicti in vino veritas".split()


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(c: Column) -> Column:
    """White space of any kind, runs of it too, becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def split_sentences(c: Column, unicode_caps: bool = False) -> Column:
    """Cleaned sentences in order. unicode_caps: capitals outside ASCII begin a sentence too."""
    parts = F.split(clean_text(c), BOUNDARY_UNICODE if unicode_caps else BOUNDARY)
    # Not transform(parts, F.trim): that hands over the place as the characters to trim, and digits go.
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Cleaned non-empty lines in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), clean_text), lambda s: s != "")


@lru_cache
def _plain() -> tuple[str, str]:
    """Letters outside ASCII that decompose to one ASCII character, and those characters."""
    found = {}
    for k in range(0x80, min(0x3000, sys.maxunicode)):
        ascii_ = unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore").decode()
        if len(ascii_) == 1:
            found[chr(k)] = ascii_
    return "".join(found), "".join(found.values())


def ascii_fold(c: Column) -> Column:
    """Accents off; what has no single ASCII letter under it goes. (slugify_exact() also expands ligatures.)"""
    folded = F.regexp_replace(F.translate(c, *_plain()), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(folded)  # ASCII has nothing to fold


def slugify(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single hyphens between; "item" if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.regexp_replace(slug, "^$", "item")


@F.pandas_udf(StringType())
def slugify_exact(s: pd.Series) -> pd.Series:
    """slugify() with full compatibility decomposition."""
    plain = s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii").str.lower()
    slug = plain.str.replace("[^a-z0-9]+", "-", regex=True).str.strip("-")
    return slug.mask(slug == "", "item")


def squeezed(c: Column) -> Column:
    """The slug without hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", ""), "^$", "item")


def grams(s: Column, n: int = 3) -> Column:
    """Distinct n-grams; a shorter text is one gram, an empty one has none."""

    def of(x):
        # One pass: substrings by place would each be sought from the text's beginning.
        every = F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
        return F.when(x == "", F.array().cast("array<string>")).when(F.length(x) < n, F.array(x)).otherwise(every)

    return let(s, of)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two arrays as sets; one empty: 0."""
    common = F.size(F.array_intersect(a, b))
    return let(F.struct(common.alias("c"), F.size(F.array_union(a, b)).alias("u")), lambda x: F.when(x["u"] == 0, F.lit(both_empty)).otherwise(x["c"] / x["u"]))


def distinct_jaccard(a: Column, b: Column) -> Column:
    """jaccard() of arrays without repeated values: their union is counted, not built."""
    return let(F.size(F.array_intersect(a, b)), lambda c: F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(c / (F.size(a) + F.size(b) - c)))


def set_overlap(a: Column, b: Column) -> Column:
    return jaccard(a, b, 1.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(grams(squeezed(a)), grams(squeezed(b)))


def ratio(a: Column, b: Column, both_zero: float = 0.0) -> Column:
    """Smaller over larger of two counts; 0 if one isn't positive."""
    value = F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))
    return F.when((a <= 0) & (b <= 0), F.lit(both_zero)).otherwise(value)


def length_similarity(a: Column, b: Column) -> Column:
    return ratio(F.length(a), F.length(b))


def position_similarity(i: Column, n: Column, j: Column, m: Column) -> Column:
    """Of places i of n and j of m, counted from 1."""
    one = F.lit(1)
    gap = F.abs((i - 1) / F.greatest(n - 1, one) - (j - 1) / F.greatest(m - 1, one))
    return F.when((n <= 1) & (m <= 1), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - gap))


def expected_index(i: Column, n: Column, m: Column) -> Column:
    """The place among m that corresponds to place i of n; halves round to even."""
    return F.when((n <= 1) | (m <= 1), F.lit(1)).otherwise(F.bround((i - 1) / F.greatest(n - 1, F.lit(1)) * (m - 1)).cast("int") + 1)


def punctuation_tags(c: Column) -> Column:
    marks = F.filter(F.split(c, ""), lambda x: x.isin(*PUNCTUATION))
    table = F.create_map(*[F.lit(x) for kv in PUNCTUATION.items() for x in kv])
    return F.array_join(F.transform(marks, lambda x: table[x]), "|")


def punctuation_similarity(a: Column, b: Column) -> Column:
    """Overlap of the characters of the two joined tag strings; none on both sides: 1."""
    letters = lambda c: F.filter(F.array_distinct(F.split(punctuation_tags(c), "")), lambda x: x != "")
    return set_overlap(letters(a), letters(b))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def digit_similarity(a: Column, b: Column) -> Column:
    return (digits(a) == digits(b)).cast("double")


def sentence_score(a: Column, b: Column) -> Column:
    """struct<length, char_trigram, punctuation, digit_pattern, total>."""
    parts = [length_similarity(a, b), trigram_similarity(a, b), punctuation_similarity(a, b), digit_similarity(a, b)]
    return scored(*parts)


def scored(length: Column, trigram: Column, punctuation: Column, digit: Column) -> Column:
    total = length * 0.35 + trigram * 0.40 + punctuation * 0.20 + digit * 0.05
    return F.struct(length.alias("length"), trigram.alias("char_trigram"), punctuation.alias("punctuation"), digit.alias("digit_pattern"), total.alias("total"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_kind(t: Column) -> Column:
    return F.when(t.rlike(r"^\p{Nd}+$"), "number").when(t.rlike(r"\p{L}"), "word").otherwise("punct")


def normalized(t: Column) -> Column:
    return F.when(token_kind(t) == "punct", t).otherwise(squeezed(t))


def lemma(t: Column, language: str) -> Column:
    """The normalised word without the first ending in the language's list that leaves three letters."""
    return let(F.struct(token_kind(t).alias("kind"), normalized(t).alias("n")), lambda x: lemma_of(x["kind"], x["n"], language))


def lemma_of(kind: Column, n: Column, language: str) -> Column:
    """lemma() of a token whose kind and normalised form are known."""
    out = F.when(kind != "word", n)
    for s in SUFFIXES.get(language, ()):
        if s.isascii():  # as normalised words are
            out = out.when(n.endswith(s) & (F.length(n) - len(s) >= 3), F.substring(n, F.lit(1), F.length(n) - len(s)))
    return out.otherwise(n)


def is_stopword(t: Column, language: str) -> Column:
    return let(F.struct(token_kind(t).alias("kind"), normalized(t).alias("n")), lambda x: stopword_of(x["kind"], x["n"], language))


def stopword_of(kind: Column, n: Column, language: str) -> Column:
    """is_stopword() of a token whose kind and normalised form are known."""
    return (kind == "word") & F.array_contains(_array(STOPWORDS.get(language, [])), n)


def foreign_ratio(c: Column) -> Column:
    """Share of words that the German and Latin hint lists have."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-zÀ-ž']+"), F.lit(0))
    hints = sorted({*GERMAN, *LATIN})
    return let(found, lambda x: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.filter(x, lambda w: w.isin(*hints))) / F.size(x)))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.65, "high").when(score >= 0.45, "medium").otherwise("low")


def rationale(signals: Column) -> Column:
    found = F.array_compact(
        F.array(
            F.when(signals["char_trigram"] >= 0.18, "strong character-overlap signal"), F.when(signals["length"] >= 0.85, "similar sentence length"),
            F.when(signals["punctuation"] >= 0.75, "matching punctuation shape"), F.when(signals["digit_pattern"] >= 1.0, "same digit pattern"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("weak lexical and structural evidence"))).otherwise(found)


def safe_depth(label: Column) -> Column:
    return F.when(label.isin("high", "medium"), "sentence").otherwise("paragraph")


def preview(c: Column, most: int = 220) -> Column:
    return let(clean_text(c), lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, F.lit(1), F.lit(most - 3))), F.lit("..."))))


def _roman(slug: Column) -> Column:
    """The first roman numeral up to fifteen among a slug's parts."""
    found = F.filter(F.split(slug, "-"), lambda w: w.rlike("^(i{1,3}|iv|v|vi{1,3}|ix|x|xi{1,3}|xiv|xv)$"))
    return F.try_element_at(found, F.lit(1))


def title_similarity(a: Column, b: Column) -> Column:
    def of(v):
        x, y = v["x"], v["y"]
        intro = x.isin("wstep", "uvod") & y.isin("wstep", "uvod")
        return F.when(intro, 1.0).when(_roman(x) == _roman(y), 0.8).when(x == y, 1.0).otherwise(jaccard(F.array_distinct(F.split(x, "-")), F.array_distinct(F.split(y, "-"))))

    return let(F.struct(slugify(a).alias("x"), slugify(b).alias("y")), of)


def chapter_score(i: Column, n: Column, j: Column, m: Column, count_a: Column, count_b: Column, title: Column) -> Column:
    return position_similarity(i, n, j, m) * 0.55 + ratio(count_a, count_b) * 0.35 + title * 0.10


def escape_latex(c: Column) -> Column:
    """The eight special characters; the braces of what a backslash becomes stay."""
    out = F.replace(c, F.lit("\\"), F.lit("\x01"))
    for ch in "&%$#_{}":
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return F.replace(out, F.lit("\x01"), F.lit("\\textbackslash{}"))


#: The Czech alphabet with the digraph ch after h.
CZECH = "a á b c č d ď e é ě f g h ch i í j k l m n ň o ó p q r ř s š t ť u ú ů v w x y ý z ž".split()


def czech_sort_key(c: Column) -> Column:
    """Array of letter places; unknown characters come last."""
    letters = F.regexp_extract_all(F.lower(c), F.lit("ch|(?s:.)"), F.lit(0))
    order = _array(CZECH)
    return F.transform(letters, lambda x: F.when(F.array_position(order, x) > 0, F.array_position(order, x)).otherwise(F.lit(len(CZECH) + 1)).cast("int"))


def dot(a: Column, b: Column) -> Column:
    """Of two vectors; the cosine of unit vectors. 0 for empty ones or unequal lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), F.lit(0.0)).otherwise(product)


def held(v: Column) -> Column:
    """The places, from 1, and values of a vector that aren't 0."""
    return F.filter(F.transform(v, lambda x, k: F.struct((k + 1).alias("at"), x.cast("double").alias("x"))), lambda e: ~e["x"].eqNullSafe(F.lit(0.0)))


def held_dot(a: Column, some: Column, b: Column) -> Column:
    """dot(a, b), where some is held(a); of finite vectors, in which what is 0 adds nothing."""
    product = F.aggregate(some, F.lit(0.0), lambda s, e: s + e["x"] * F.element_at(b, e["at"]).cast("double"))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), F.lit(0.0)).otherwise(product)


def hashed_trigrams(c: Column, buckets: int = 128) -> Column:
    """Unit vector of bucketed trigram counts, by a hash that is the same everywhere; a null text has zeros."""
    def of(s):
        every = F.when(F.length(s) < 3, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit("(?s)(?=(.{3}))."), F.lit(1)))
        at = F.transform(every, lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
        # With each bucket once more and sorted, a bucket's count is the gap between its last place and the last one before.
        ranked = F.sort_array(F.concat(F.coalesce(at, F.array().cast("array<int>")), F.sequence(F.lit(0), F.lit(buckets - 1))))
        last = let(ranked, lambda r: F.filter(F.transform(r, lambda x, k: F.when(~x.eqNullSafe(F.get(r, k + 1)), k)), lambda k: k.isNotNull()))
        return let(last, lambda e: F.transform(e, lambda x, b: (x - F.coalesce(F.get(e, b - 1), F.lit(-1)) - 1).cast("double")))

    def unit(v):
        return let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))

    return let(let(squeezed(c), of), unit)

"""Phrases whose words keep company, from count tries of shards.

Texts are lower-cased (A-Z), split into pieces and these into words. A shard (a few MB of texts in a task) counts, for
each word, the run of up to `depth` words from there to the end of its piece in a trie of that depth: the sorted
distinct runs, each stored as what it doesn't share with the one before, so the counts of all shorter phrases are sums
over branches. Tries are cut into ranges of prefixes; a task merges one range of all shards as sorted runs, walks the
merged trie, and gives each phrase of least occurrences with the counts of its ancestors, that is, of all its left parts. Its
right parts hang in other ranges: they are reached by suffix links, a join on the phrase without its first words.

A word, or a pair of neighbours, that occurs fewer than `least` times can't be in a phrase that occurs `least` times, so
runs end before such words and within such pairs. Which these may be is known from counts of hashed words, then of hashed
pairs, summed over the corpus: what falls into a slot of fewer than `least` is rare for certain. A frequent or colliding
one only lengthens runs; counts never depend on it.

Bounds of ranges are the shortest prefixes that part two neighbours in a bounded sample. A phrase that is a proper prefix
of a bound has its occurrences in more ranges than one: those partial counts, at most depth - 1 a bound, are added in an
aggregate. So no word or phrase, however common, has to be in one task as a whole, and within a shard it is one branch.

Scores are exact: floor(1000 a n / (l r)) in decimals of 38 digits. For each candidate the lowest-scoring cut counts.
A candidate is dropped if a longer one that contains it has `share` % of its occurrences or more; it suffices to look at
those with one word more, since one of these lies between.

Defined results: null and empty texts have no words; a null lang is `und`; repeated rows all count; extra columns are
ignored. An empty table gives no rows. Words may hold any character but space, tab and the marks that split. Ties in score go to the
smaller cut, in rank to the larger count and then the phrase in byte order. Texts are read whole; a task holds one slice
of texts, or one longer text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare
from . import textvec as tv
from .columns import COMMON
from .fingerprint import slices

LEAST, DEPTH, TOP, SHARE = 100, 5, 2000, 100
#: Bytes of text of a shard; of text for each range of prefixes; of the sample, for each range.
SHARD_BYTES, RANGE_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20, 16 << 10
#: Runs that a merge holds before it adds up equal ones.
PENDING = 4_000_000
#: Bytes of words that are compared at once.
COMPARED = 1 << 20
#: Bits of the number of slots for hashed words: at most, at least; words for each slot.
MOST_SLOTS, LEAST_SLOTS, SLOT_WORDS = 28, 16, 32

#: [.,;:!?\x0A-\x0D] ends a piece, \x20 and \x09 a word.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False

BLOB = "range int, vocab array<binary>, shape binary, ids binary, counts binary"
NODE = "lang string, phrase string, k int, a long, edge boolean, lefts array<long>"


class Words:
    """The words of a slice of texts: hashes (of language and word), whether each begins a piece, and their bytes."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.hash, offs, self.begin, self.end = tv.words(texts, _WORD)
        self.data, _ = tv.raw(texts)
        names, self.langs = pd.factorize(np.array([x.encode() for x in langs.to_pylist()], object))
        self.lang = np.repeat(names, np.diff(offs))
        salt = tv.hash_bytes(list(self.langs), fold=False)
        if len(self.hash):
            self.hash = tv.mix(self.hash ^ salt[self.lang])
        piece = np.cumsum(_ENDS[self.data], dtype=np.int64)[self.begin] if len(self.data) else np.zeros(0, np.int64)
        self.first = np.ones(len(self.hash), bool)
        self.first[1:] = piece[1:] != piece[:-1]
        self.first[offs[:-1][offs[:-1] < len(self.hash)]] = True

    def entry(self, k: int) -> bytes:
        """Language and word: no word has a line feed."""
        return self.langs[self.lang[k]] + b"\n" + self.data[self.begin[k] : self.end[k]].tobytes().translate(tv.FOLD_BYTES)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words at a and at b are equal: language and folded bytes."""
        size = self.end - self.begin
        out = (self.lang[a] == self.lang[b]) & (size[a] == size[b])
        at = np.flatnonzero(out & (a != b))
        a, b, total = a[at], b[at], np.cumsum(size[a[at]])
        lo = 0
        while lo < len(at):  # about COMPARED bytes at a time, one word at least
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + COMPARED, "right")))
            n = size[a[lo:hi]]
            starts = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(starts, n)
            x, y = (tv.FOLD[self.data[np.repeat(self.begin[k[lo:hi]], n) + step]] for k in (a, b))
            out[at[lo:hi]] = ~np.logical_or.reduceat(x != y, starts)
            lo = hi
        return out


def runs(words: Words, alive: np.ndarray, goes_on: np.ndarray, depth: int, bounds: list[tuple[bytes, ...]]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """Sorted entries (from 1; 0: the run has ended), columns of the sorted distinct runs, and their counts."""
    code = np.zeros(len(words.hash), np.int64)
    at = np.flatnonzero(alive)
    code[at], found = pd.factorize(words.hash[at])
    first = np.zeros(len(found), np.int64)
    first[code[at][::-1]] = at[::-1]
    # Equal hashes may be of different words (long ones can be made so): their bytes decide.
    other = at[~words.same(at, first[code[at]])]
    more: dict[bytes, int] = {}
    for k in other.tolist():
        code[k] = len(found) + more.setdefault(words.entry(k), len(more))
    own = [*(words.entry(k) for k in first.tolist()), *more]
    vocab = sorted({*own, *(w for b in bounds for w in b)})
    number = {w: k + 1 for k, w in enumerate(vocab)}
    ids = np.array([number[w] for w in own], np.int64)
    code[at] = ids[code[at]] if len(at) else 0
    n = len(code)
    cols, reach = [code[at]], np.ones(len(at), bool)
    for j in range(1, depth):
        nxt = np.minimum(at + j, max(n - 1, 0))
        reach = reach & (at + j < n) & goes_on[nxt]
        cols.append(np.where(reach, code[nxt], 0))
    return vocab, *_distinct(cols, np.ones(len(at), np.int64), len(vocab))


def _distinct(cols: list[np.ndarray], counts: np.ndarray, top: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of numbers up to top, sorted, equal ones added up."""
    if not len(counts):
        return cols, counts
    bits = max(1, int(top).bit_length())
    width, keys = 63 // bits, []
    for lo in range(0, len(cols), width):
        key = np.zeros(len(counts), np.int64)
        for c in cols[lo : lo + width]:
            key = key << bits | c
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return [c[order[starts]] for c in cols], np.add.reduceat(counts[order], starts)


def _shared(cols: list[np.ndarray]) -> np.ndarray:
    """How many leading columns each row has in common with the one before."""
    out = np.zeros(len(cols[0]), np.uint8)
    same = np.ones(max(len(out) - 1, 0), bool)
    for c in cols:
        same = same & (c[1:] == c[:-1])
        out[1:] += same
    return out


def span(cols: list[np.ndarray], prefix: list[int]) -> tuple[int, int]:
    """Rows that begin with these numbers; where they would stand, if none does."""
    lo, hi = 0, len(cols[0])
    for c, x in zip(cols, prefix):
        lo, hi = lo + int(np.searchsorted(c[lo:hi], x, "left")), lo + int(np.searchsorted(c[lo:hi], x, "right"))
        if lo == hi:
            break
    return lo, hi


def pack(vocab: list[bytes], cols: list[np.ndarray], counts: np.ndarray) -> tuple:
    """A trie as bytes: of each run how much it shares with the one before and its length, then the other words."""
    size = np.zeros(len(counts), np.uint8)
    for c in cols:
        size += c > 0
    shared = _shared(cols)
    rest = [c[(shared <= j) & (size > j)] for j, c in enumerate(cols)]
    used, ids = np.unique(np.concatenate(rest), return_inverse=True)
    return [vocab[k - 1] for k in used.tolist()], (shared << 4 | size).tobytes(), ids.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes(), counts.astype(np.uint32).tobytes()


def unpack(vocab: list[bytes], shape: bytes, ids: bytes, counts: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns (numbers in vocab from 1; 0: ended) and counts."""
    shape = np.frombuffer(shape, np.uint8)
    shared, size = shape >> 4, shape & 15
    ids = np.frombuffer(ids, np.uint16 if len(vocab) <= 1 << 16 else np.uint32).astype(np.int64) + 1
    rows, cols, at = np.arange(len(shape)), [], 0
    for j in range(depth):
        fresh, has = shared <= j, size > j
        own, new = np.zeros(len(shape), np.int64), fresh & has
        own[new] = ids[at : at + int(new.sum())]
        at += int(new.sum())
        cols.append(own[np.maximum.accumulate(np.where(fresh, rows, 0))])
    return cols, np.frombuffer(counts, np.uint32).astype(np.int64)


def _joined(tries: list[tuple]) -> tuple:
    """Several tries (vocab, cols, counts) as one."""
    vocab = sorted({w for t in tries for w in t[0]})
    number = {w: k + 1 for k, w in enumerate(vocab)}
    maps = [np.array([0, *(number[w] for w in t[0])], np.int64) for t in tries]
    cols = [np.concatenate([m[t[1][j]] for m, t in zip(maps, tries)]) for j in range(len(tries[0][1]))]
    return vocab, *_distinct(cols, np.concatenate([t[2] for t in tries]), len(vocab))


def walk(vocab: list[bytes], cols: list[np.ndarray], counts: np.ndarray, least: int, edges: set[tuple[bytes, ...]]) -> list[tuple]:
    """Rows NODE: phrases with at least `least` occurrences, each with its ancestors' counts (null: an edge), and the
    edges, phrases that other ranges have too."""
    number = {w: k + 1 for k, w in enumerate(vocab)}
    at_edge: list[set[int]] = [set() for _ in cols]  # by depth, the first rows of edges
    for e in edges:
        if all(w in number for w in e):
            lo, hi = span(cols, [number[w] for w in e])
            if lo < hi:
                at_edge[len(e) - 1].add(lo)
    shared, out, above = _shared(cols), [], []
    for j, col in enumerate(cols):
        new = shared <= j
        new[:1] = True
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        sums = np.add.reduceat(counts, starts)
        edge = np.isin(starts, np.fromiter(at_edge[j], np.int64, len(at_edge[j])))
        chosen = np.flatnonzero((col[starts] > 0) & ((sums >= least) | edge))
        lefts = [[None if e else f for f, e in zip(s[g[starts[chosen]]].tolist(), x[g[starts[chosen]]].tolist())] for s, g, x in above]
        for k, (i, s) in enumerate(zip(chosen.tolist(), starts[chosen].tolist())):
            parts = [vocab[cols[m][s] - 1].rpartition(b"\n") for m in range(j + 1)]
            out.append((parts[0][0].decode(), b" ".join(p[2] for p in parts).decode(), j + 1, int(sums[i]), bool(edge[i]), [x[k] for x in lefts]))
        above.append((sums, group, edge))
    return out


class Slots:
    """One bit for each slot of hashed words or pairs: whether `least` of them or more fell there."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    @staticmethod
    def of(hashes: np.ndarray, bits: int) -> np.ndarray:
        return (hashes >> tv.U(64 - bits)).astype(np.int64)

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        at = self.of(hashes, self.bits)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Of each word with the one before it; the first has none."""
    before = np.roll(hashes, 1)
    return tv.mix(before * tv.U(0x9E3779B97F4A7C15) + hashes)


def _reach(words: Words, slots: list[Slots]) -> tuple[np.ndarray, np.ndarray]:
    """Which words may be frequent, and which of them may go on a run of the word before."""
    alive = slots[0].frequent(words.hash) if slots else np.ones(len(words.hash), bool)
    goes_on = alive & ~words.first
    goes_on[1:] &= alive[:-1]
    goes_on[:1] = False
    if len(slots) > 1:
        at = np.flatnonzero(goes_on)
        goes_on[at] = slots[1].frequent(_pairs(words.hash)[at])
    return alive, goes_on


def _slots(docs: DataFrame, bits: int, parts: int, least: int, known: list[Slots]) -> tuple[Slots, DataFrame]:
    """Slots of words (none known) or of pairs of words, and, of words, how many each language has (lang, n): partial counts
    of slices meet in ranges of slots."""
    width = -(-(1 << bits) // parts // 8) * 8
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        for b in batches:
            for lo, hi in slices(b.column(1), SHARD_BYTES):
                part = b.slice(lo, hi - lo)
                words = Words(part.column(1), part.column(0))
                hashes = _pairs(words.hash)[_reach(words, shared.value)[1]] if shared.value else words.hash
                slots, counts = np.unique(Slots.of(hashes, bits), return_counts=True)
                cuts = np.searchsorted(slots, np.arange(0, parts + 1) * width)
                rows = [(k, (slots[x:y] - k * width).astype(np.uint32).tobytes(), np.minimum(counts[x:y], least).astype(np.uint32).tobytes(), None, None) for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if x < y]
                if not shared.value:
                    each = np.bincount(words.lang, minlength=len(words.langs)).tolist()
                    rows += [(int(words.hash[0] % tv.U(parts)), None, None, words.langs[k].decode(), int(n)) for k, n in enumerate(each) if n]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("part", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary()), ("lang", pa.string()), ("n", pa.int64())))})

    def add(batches):
        sums, last, langs = np.zeros(width, np.int64), None, {}

        def done():
            rows = [(last, np.packbits(sums >= least, bitorder="little").tobytes(), None, None), *((None, None, k, n) for k, n in langs.items())]
            return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("part", pa.int32()), ("bits", pa.binary()), ("lang", pa.string()), ("n", pa.int64())))})

        for b in batches:
            for k, slots, counts, lang, n in zip(*(b.column(c).to_pylist() for c in range(5))):
                if k != last:
                    if last is not None:
                        yield done()
                    sums, last, langs = np.zeros(width, np.int64), k, {}
                if slots is None:
                    langs[lang] = langs.get(lang, 0) + n
                else:
                    sums[np.frombuffer(slots, np.uint32)] += np.frombuffer(counts, np.uint32)
        if last is not None:
            yield done()

    each = docs.mapInArrow(count, "part int, slots binary, counts binary, lang string, n long").repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    merged = materialize(each.mapInArrow(add, "part int, bits binary, lang string, n long"))
    packed = np.zeros(width * parts // 8, np.uint8)
    for row in merged.where("part is not null").select("part", "bits").collect():  # one bit a slot
        packed[row["part"] * width // 8 : (row["part"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return Slots(bits, packed), merged.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))


def _bounds(docs: DataFrame, total: int, ranges: int, slots: list[Slots], depth: int) -> list[tuple[bytes, ...]]:
    """Prefixes at which ranges begin, from stretches of texts of ranges * SAMPLE_BYTES altogether, about."""
    stretch = 4_000
    place = (F.pmod(F.xxhash64("text", F.lit(6)), F.greatest(F.length("text") - stretch, F.lit(1)))).cast("int") + 1
    size = F.octet_length("text")
    want = ranges * SAMPLE_BYTES
    # A long text's stretch stands for all of it.
    drawn = docs.where(F.rand(3) * max(total, 1) < size * (want / stretch)).select("lang", F.substr("text", place, F.lit(stretch)).alias("text")).toArrow().combine_chunks()
    if not len(drawn):
        return []
    words = Words(drawn.column("text").combine_chunks(), drawn.column("lang").combine_chunks())
    vocab, cols, counts = runs(words, *_reach(words, slots), depth, [])
    shared, out = _shared(cols), set()
    for cut in (np.arange(1, ranges) * len(counts) // ranges).tolist() if len(counts) >= ranges else []:
        if cut:
            size = int(shared[cut]) + 1
            out.add(tuple(vocab[c[cut] - 1] for c in cols[:size] if c[cut]))
    return sorted(out)


def counted(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals): phrases of up to depth words with at least `least` occurrences a language (rows NODE; of an edge,
    or a phrase below one, some lefts are null), edges as partial counts, and the words of each language (lang, n)."""
    if not 1 <= depth <= 15:
        raise ValueError("depth must be from 1 to 15")
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES + 1)
    ranges = ranges or parts
    bits = min(MOST_SLOTS, max(LEAST_SLOTS, int(total // 6 // SLOT_WORDS).bit_length()))
    slots, totals = _slots(rows, bits, parts, least, [])
    slots = [slots, _slots(rows, bits, parts, least, [slots])[0]]
    bounds = _bounds(rows, total, ranges, slots, depth)
    shared = spark.sparkContext.broadcast((slots, bounds))

    def tries(batches):
        slots, bounds = shared.value
        for b in batches:
            for lo, hi in slices(b.column(1), SHARD_BYTES):
                part = b.slice(lo, hi - lo)
                words = Words(part.column(1), part.column(0))
                vocab, cols, counts = runs(words, *_reach(words, slots), depth, bounds)
                number = {w: k + 1 for k, w in enumerate(vocab)}
                cuts = [0, *(span(cols, [number[w] for w in p])[0] for p in bounds), len(counts)]
                out = [(k, *pack(vocab, [c[x:y] for c in cols], counts[x:y])) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if x < y]
                kinds = (("range", pa.int32()), ("vocab", pa.list_(pa.binary())), ("shape", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(kinds)})

    def merge(batches):
        bounds, held, last = shared.value[1], [], None

        def done():
            edges = {p[:k] for p in bounds[max(last - 1, 0) : last + 1] for k in range(1, len(p))}
            out = walk(*_joined(held), least, edges)
            kinds = (("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("a", pa.int64()), ("edge", pa.bool_()), ("lefts", pa.list_(pa.int64())))
            return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(kinds)})

        for b in batches:
            for k, *blob in zip(*(b.column(c).to_pylist() for c in range(5))):
                if k != last:
                    if last is not None:
                        yield done()
                    held, last = [], k
                held.append((blob[0], *unpack(*blob, depth)))
                # Equal runs are added up early, so what is held grows with distinct ones.
                if len(held) > 1 and sum(len(t[2]) for t in held) > max(PENDING, 2 * len(held[0][2])):
                    held = [_joined(held)]
        if last is not None:
            yield done()

    dealt = rows.mapInArrow(tries, BLOB).repartitionById(parts, F.pmod("range", F.lit(parts))).sortWithinPartitions("range")
    return materialize(dealt.mapInArrow(merge, NODE)), materialize(totals)


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int | None = TOP, share: int = SHARE, ranges: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut of the best `top` phrases a language (None: of all)."""
    nodes, totals = counted(docs, least, depth, ranges)
    edges = materialize(nodes.where("edge").groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    counts = nodes.where("not edge").drop("edge").unionByName(edges.withColumn("lefts", F.when(F.col("k") > 1, F.array_repeat(F.lit(None).cast("long"), F.col("k") - 1)).otherwise(F.array().cast("array<long>"))))
    # Ranges give the left parts, but for edges.
    cuts = counts.select("lang", "phrase", "k", "a", F.posexplode("lefts").alias("at", "own")).withColumn("cut", F.col("at") + 1)
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.substr("phrase", F.length("left") + 2))
    ends = edges.select("lang", F.col("phrase").alias("left"), F.col("a").alias("edge_a"))
    cuts = cuts.join(ends, ["lang", "left"], "left").withColumn("l", F.coalesce("own", "edge_a"))
    cuts = materialize(cuts.select("lang", "phrase", "k", "a", "cut", "l", "left", F.col("right")))
    # Suffix links: common right parts meet their counts by a bounded broadcast, the others in a join without hot keys.
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    wanted = materialize(cuts.groupBy("lang", "right").agg(F.count(F.lit(1)).alias("links")))
    found = materialize(wanted.join(rights, ["lang", "right"]))
    hot = found.where(F.col("links") * COMMON >= max(cuts.count(), 1)).drop("links")
    rest = cuts.join(F.broadcast(hot), ["lang", "right"], "left_anti")
    cuts = cuts.join(F.broadcast(hot), ["lang", "right"]).unionByName(rest.join(found.drop("links"), ["lang", "right"]))
    whole = "decimal(19,0)"
    score = F.expr(f"cast((cast(a as {whole}) * cast(n as {whole}) * 1000) div (cast(l as {whole}) * cast(r as {whole})) as long)")
    cuts = materialize(cuts.join(totals, "lang").withColumn("score", score))
    best = cuts.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "n", "best.*")
    # One word more at the front or at the end.
    longer = cuts.where("k >= 3")
    inside = longer.where((F.col("cut") == 1) & (100 * F.col("a") >= share * F.col("r"))).select("lang", F.col("right").alias("phrase"))
    inside = inside.unionByName(longer.where((F.col("cut") == F.col("k") - 1) & (100 * F.col("a") >= share * F.col("l"))).select("lang", F.col("left").alias("phrase")))
    kept = best.join(inside.distinct(), ["lang", "phrase"], "left_anti")
    return ranked(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))


def ranked(rows: DataFrame, top: int | None) -> DataFrame:
    """rank a language by score, a and phrase; the first `top` are first found in parts, so no language is one task."""
    from pyspark.sql import Window

    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top).drop("part", "rank")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long"))
    return rows if top is None else rows.where(F.col("rank") <= top)


ORACLE = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 100),
c as (select lang, k, phrase, a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from f where k >= 2),
s as (select c.*, x.a as l, y.a as r, n.n, cast((cast(1000 as hugeint) * c.a * n.n) // (cast(x.a as hugeint) * y.a) as bigint) as score from c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[cut + 1 : c.k], ' ') join n on n.lang = c.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
gone as (select distinct lang, array_to_string(w[i : i + j - 1], ' ') as phrase, a from (select lang, w, a, k, j, unnest(range(1, k - j + 2)) as i from (select distinct lang, w, a, k from c), (select unnest(range(2, 5)) as j) where j < k)),
k as (select b.* from b where not exists (select 1 from gone where gone.lang = b.lang and gone.phrase = b.phrase and 100 * gone.a >= 100 * b.a))
select lang, rank, phrase, a, l, r, n, score, cut from (select lang, phrase, a, l, r, n, score, cut, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k) where rank <= 2000
"""

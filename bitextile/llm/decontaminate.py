"""Benchmark decontamination with an FM-index for each shard of training text.

A worker cuts its partition into shards of whole texts. Words that no test phrase has end a run; runs shorter than the
shortest phrase can't hold one. The other runs are indexed: suffix array by prefix doubling, Burrows-Wheeler transform,
a wavelet matrix for rank, and every SAMPLE-th suffix position. All test phrases are searched backwards together, their
occurrences located by walking to a sampled position, and overlapping spans merged.

Test phrases are the windows of n consecutive words of each benchmark item (an item of fewer words, but not none, is
one window). The benchmark is sent to workers in blocks of at most BLOCK_BYTES of text, one step a block in the same
stage, so no rows are shuffled. After GROUP blocks rows and findings are written to a table and these blocks given up, so
what is broadcast is bounded however large the benchmark is.

Defined results: null and empty texts have no words; null, empty and repeated benchmark rows add nothing new; an item
without an id marks words but isn't listed. Repeated documents are judged each by itself. An empty table gives no rows,
an empty benchmark no hits. Extra columns are kept as they are; contamination()'s new names must be free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare
from . import textvec as tv
from .columns import fresh, whole_text
from .fingerprint import slices

SAMPLE = 8
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
#: Blocks that are broadcast at a time.
GROUP = 8


class WaveletMatrix:
    """Rank of a symbol in a prefix, for many symbols and prefixes at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for k in reversed(range(bits)):
            bit = (seq >> k) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(at)
        for k, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            one = ((symbol >> k) & 1).astype(bool)
            lo1, at1 = ones[lo], ones[at]
            lo = np.where(one, zeros + lo1, lo - lo1)
            at = np.where(one, zeros + at1, at - at1)
        return at - lo


class FMIndex:
    """Over runs of symbols from 1 on; 0 ends each run, also the last."""

    def __init__(self, seq: np.ndarray):
        n, end = len(seq), seq == 0
        runs = int(end.sum())
        rank = np.where(end, np.cumsum(end) - 1, seq + runs)  # each end is a symbol of its own
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        h = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[:-h] = rank[h:] + 1
            key = rank * (n + 2) + nxt
            order = np.argsort(key, kind="stable")
            step = np.empty(n, np.int64)
            step[0], step[1:] = 0, np.cumsum(key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = step
            if step[-1] == n - 1:
                break
            h = min(2 * h, n - 1)
        bwt = seq[order - 1]
        size = int(seq.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=size))))
        self.bwt, self.rows = bwt, n
        self.tree = WaveletMatrix(bwt, max(1, (size - 1).bit_length()))
        starts = np.ones(n, bool)
        starts[1:] = end[:-1]
        marked = ((order % SAMPLE) == 0) | starts[order]
        self.marked, self.place = marked, np.cumsum(marked) - 1
        self.sample = order[marked]

    def search(self, patterns: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First rows and rows after the last of the suffixes that begin with each pattern."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.rows, np.int64)
        live = np.flatnonzero((patterns < len(self.first) - 1).all(1))
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        hi[dead] = 0
        for k in reversed(range(length)):
            c = patterns[live, k]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.marked[at])
        while len(walk):
            c = self.bwt[at[walk]]
            at[walk] = self.first[c] + self.tree.rank(c, at[walk])
            steps[walk] += 1
            walk = walk[~self.marked[at[walk]]]
        return self.sample[self.place[at]] + steps


class Phrases:
    """Windows of a block of benchmark items as numbers of the block's words."""

    def __init__(self, items: list[tuple[int | None, str]], n: int):
        h, offs, _, _ = tv.words(pa.array([t for _, t in items], pa.large_string()), tv.ALNUM)
        self.words = np.unique(h)
        number = np.searchsorted(self.words, h) + 1
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.words >> tv.U(48)).astype(np.int64)] = True
        found: dict[tuple[int, ...], set] = {}
        for k, (item, _) in enumerate(items):
            own = number[offs[k] : offs[k + 1]].tolist()
            for a in range(max(1, len(own) - n + 1)) if own else ():
                found.setdefault(tuple(own[a : a + n]), set()).add(item)
        self.windows = {size: np.array([w for w in found if len(w) == size], np.int64) for size in sorted({len(w) for w in found})}
        self.items = {size: [tuple(x for x in found[tuple(w)] if x is not None) for w in block.tolist()] for size, block in self.windows.items()}

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.filter[(h >> tv.U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        out[maybe] = np.where(self.words[at] == h[maybe], at + 1, 0)
        return out

    def occurrences(self, h: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: first words of all places, and the windows that stand there."""
        if not self.windows or not len(h):
            return
        shortest = min(self.windows)
        number = self.numbers(h)
        known = number > 0
        begins, ends = known.copy(), known.copy()
        begins[1:] &= ~known[:-1]
        ends[:-1] &= ~known[1:]
        inner = offs[(offs > 0) & (offs < len(h))]
        begins[inner] = known[inner]
        ends[inner - 1] = known[inner - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = (e - b) >= shortest
        b, e = b[long], e[long]
        if not len(b):
            return
        size = e - b + 1
        to = np.cumsum(size)
        origin = np.repeat(b - (to - size), size) + np.arange(to[-1])  # of each place of the sequence, its word
        seq = number[np.minimum(origin, len(h) - 1)]
        seq[to - 1] = 0
        index = FMIndex(seq)
        for length, patterns in self.windows.items():
            lo, hi = index.search(patterns, length)
            count = hi - lo
            if count.sum():
                which = np.repeat(np.arange(len(patterns)), count)
                rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                yield length, origin[index.locate(rows)], which


def _merged(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are inside any span."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    return np.cumsum(change[:-1]) > 0


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _block(phrases, n: int, text: str, names: tuple[str, str, str, str], has: bool):
    """names: of the new columns; has: the rows carry what earlier blocks have found."""
    n_words, n_hit, found_spans, found_items = names

    def run(batches):
        known = Phrases(phrases.value, n)
        for b in batches:
            columns = b.schema.names
            text_at = columns.index(text)
            for lo, hi in slices(b.column(text_at), SHARD_BYTES):
                part = b.slice(lo, hi - lo)
                h, offs, _, _ = tv.words(part.column(text_at), tv.ALNUM)
                doc = np.repeat(np.arange(hi - lo), np.diff(offs))
                hit = np.zeros(len(h), bool)
                items = [set(x or ()) for x in part.column(columns.index(found_items)).to_pylist()] if has else [set() for _ in range(hi - lo)]
                for length, first, which in known.occurrences(h, offs):
                    hit |= _merged(first, np.full(len(first), length), len(h))
                    pair = np.unique(doc[first] * (len(known.items[length]) + 1) + which)
                    for d, w in zip((pair // (len(known.items[length]) + 1)).tolist(), (pair % (len(known.items[length]) + 1)).tolist()):
                        items[d].update(known.items[length][w])
                if has:
                    for d, found in enumerate(part.column(columns.index(found_spans)).to_pylist()):
                        for x in found:
                            hit[offs[d] + x["start"] : offs[d] + x["end"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    while s < e:  # a span that reaches into the next text is two
                        d = int(doc[s])
                        stop = min(e, int(offs[d + 1]))
                        spans[d].append({"start": s - int(offs[d]), "end": stop - int(offs[d])})
                        s = stop
                cover = np.concatenate(([0], np.cumsum(hit)))
                new = {
                    n_words: pa.array(np.diff(offs), pa.int64()), n_hit: pa.array(cover[offs[1:]] - cover[offs[:-1]], pa.int64()),
                    found_spans: pa.array(spans, SPANS), found_items: pa.array([sorted(x, key=str) for x in items], pa.list_(pa.int64())),
                }
                kept = [(k, part.column(k)) for k in columns if k not in new]
                yield pa.RecordBatch.from_pydict(dict(kept) | new)

    return run


NAMES = ("n_words", "n_hit", "spans", "items")
_KINDS = ("long", "long", "array<struct<start:int,end:int>>", "array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: list[str] | None = None, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """The columns keep (all) of docs, and four new ones, by default n_words, n_hit, spans (of hit words, from 0, end
    excluded), items (ids of the items that occur, sorted as strings)."""
    spark = prepare(docs.sparkSession)
    keep = list(docs.columns if keep is None else keep)
    if {c.lower() for c in keep} & {c.lower() for c in names}:
        raise ValueError(f"columns named {names} are in the table: give other names")
    text, rows = whole_text(docs, keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema = ", ".join([kept, *(f"`{c}` {k}" for c, k in zip(names, _KINDS))])
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // (BLOCK_BYTES // 2) + 1)
    shared: list = []
    for k in range(blocks):
        if len(shared) == GROUP:
            rows = materialize(rows)
            for x in shared:
                x.unpersist()
            shared.clear()
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        shared.append(spark.sparkContext.broadcast([tuple(r) for r in part.orderBy("item_id", "text").collect()]))
        rows = rows.mapInArrow(_block(shared[-1], n, text, names, k > 0), schema)
    return rows.select(*keep, *names)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark, keep=["doc_id"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with the hit words, and what stands between hit neighbours, cut out of text; other text stays as it is."""
    columns = docs.columns
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = tuple(fresh(c, columns) for c in NAMES)
    found = contamination(docs, benchmark, n, names=names).select(*columns, names[2])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(batches):
        for b in batches:
            own = b.schema.names
            texts, spans = b.column(own.index("text")).to_pylist(), b.column(own.index(names[2])).to_pylist()
            for d in [k for k, x in enumerate(spans) if x]:
                _, _, s, e = tv.words(pa.array([texts[d]], pa.large_string()), tv.ALNUM)
                data, out, at = texts[d].encode(), [], 0
                for x in spans[d]:
                    out.append(data[at : int(s[x["start"]])])
                    at = int(e[x["end"] - 1])
                texts[d] = b"".join([*out, data[at:]]).decode()
            yield pa.RecordBatch.from_pydict({c: pa.array(texts, pa.string()) if c == "text" else b.column(own.index(c)) for c in columns})

    return found.mapInArrow(cut, schema)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0)),
places as (select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as g
           from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from bw) where len(w) >= n)),
found as (select p.doc_id, p.p, p.n, bw.item_id from places p join bw on p.g = bw.g and p.n = bw.n),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(p, p + n)) as k from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

"""Removal of long word sequences that stand in an earlier document, by suffix automata of reference shards.

A window of WINDOW words is repeated if its words also stand in a document with a smaller doc_id. Copies of a whole
word sequence are settled by its hash. For the other texts, winnowing picks in every window one run of GRAM words, by
content alone, so two equal windows always pick the same run; a picked run that two texts share is an anchor, and the
smallest doc_id with it is its owner. Each text's words around its anchors go to the shard of their owner: every pair
of equal windows meets in the shard of an anchor within them. A shard reads its texts by ascending doc_id: the
matching statistics of each against the suffix automaton of the smaller ones give its maximal spans of WINDOW words or
more, then the windows that the automaton lacks are put into it, so it grows with what is new and not with copies. Two
bounds hold, each with an exact way for the rest: a shard that would read more than SHARD words (a very common passage)
isn't read by one task, and an automaton takes HELD words at most. The windows beyond are settled by their hashes: the
smallest doc_id of each, combined before the shuffle.

References can't be broadcast as such: all texts are references of all later ones, so an automaton of each part of the
corpus sent to all of it would cost the square of the corpus. Here a shard's automaton meets the texts that share an
anchor with it, and no others.

Defined results: null and empty texts have no words; rows without doc_id neither lose words nor count as references;
rows of the same doc_id don't count for each other, and repeated rows each lose the same words. An empty table gives no
rows. Extra columns are ignored, or kept as they are by deduplicated().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare
from . import textvec as tv
from .columns import fresh, join_counted
from .fingerprint import slices

WINDOW, GRAM = 50, 20
SHARD, HELD = 4_000_000, 200_000
_SPOT = 28


def anchors(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places of the picked runs of a slice of texts: of each window the run with the least hash, the first of equal."""
    width = WINDOW - GRAM + 1
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    g = tv.windows(h, GRAM)
    key = (g >> tv.U(_SPOT) << tv.U(_SPOT)) | np.arange(len(g), dtype=tv.U)
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = doc[: len(key)] == doc[WINDOW - 1 :][: len(key)]
    return np.unique(key[whole] & tv.U((1 << _SPOT) - 1)).astype(np.int64)


def _base(batches):
    for b in batches:
        for lo, hi in slices(b.column(1)):
            col = b.column(1).slice(lo, hi - lo)
            h, offs, _, _ = tv.words(col, tv.SPACED, fold=False)
            spots = anchors(h, offs)
            at = np.searchsorted(spots, offs)
            owner = np.repeat(np.arange(hi - lo), np.diff(at))
            g = tv.windows(h, GRAM)
            shas = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in col.cast(pa.binary()).to_pylist()]
            lists = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0).slice(lo, hi - lo), "words_sha": pa.array(shas), "n_words": pa.array(np.diff(offs), pa.int64()),
                    "anchors": pa.ListArray.from_arrays(lists, pa.array(g[spots].view(np.int64) if len(spots) else np.zeros(0, np.int64))),
                    "spots": pa.ListArray.from_arrays(lists, pa.array((spots - offs[owner]).astype(np.int32))),
                }
            )


def _unions(spots: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The words of all windows around these runs, as ranges."""
    out: list[tuple[int, int]] = []
    for s in np.sort(spots).tolist():
        a, e = max(0, s - (WINDOW - GRAM)), min(n, s + WINDOW)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return [(a, e) for a, e in out if e - a >= WINDOW]


def _regions(batches):
    """doc_id, words_sha, text, matched(owner, spot, hot) -> one row a range of words and owner."""
    for b in batches:
        for lo, hi in slices(b.column(2)):
            h, offs, _, _ = tv.words(b.column(2).slice(lo, hi - lo), tv.SPACED, fold=False)
            rows: list[tuple] = []
            for k, (doc, sha, matched) in enumerate(zip(*(b.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1, 3)))):
                by: dict[tuple, list[int]] = {}
                for m in matched:
                    by.setdefault((m["owner"], m["hot"]), []).append(m["spot"])
                own = h[offs[k] : offs[k + 1]]
                packed = own.view(np.uint8).reshape(-1, 8)[:, :6]
                for (owner, hot), spots in by.items():
                    for a, e in _unions(np.array(spots), len(own)):
                        if hot:
                            cut = own & tv.U((1 << 48) - 1)  # as shards have them
                            rows.append((owner, doc, sha, a, None, tv.windows(cut[a:e], WINDOW).view(np.int64)))
                        else:
                            rows.append((owner, doc, sha, a, packed[a:e].tobytes(), None))
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("owner", pa.int64()), ("doc_id", pa.int64()), ("words_sha", pa.string()), ("start", pa.int32()), ("words", pa.binary()), ("hashes", pa.list_(pa.int64()))))})


class SuffixAutomaton:
    """Of all sequences put in."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        p = last
        if c in nxt[p]:
            return self._split(p, c)
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            link[cur] = self._split(p, c)
        return cur

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest sequence followed by c."""
        nxt, link, size = self.next, self.link, self.size
        q = nxt[p][c]
        if size[q] == size[p] + 1:
            return q
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def matches(self, sequence: list[int], least: int) -> list[int]:
        """Places whose last `least` symbols stand in what was put in."""
        nxt, link, size = self.next, self.link, self.size
        v = n = 0
        out = []
        for i, c in enumerate(sequence):
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = size[v]
                to = nxt[v].get(c)
            if to is None:
                n = 0
            else:
                v = to
                n += 1
                if n >= least:
                    out.append(i)
        return out


def _ranges(ends: list[int]) -> list[tuple[int, int]]:
    """The words of the windows that end at these places."""
    out: list[tuple[int, int]] = []
    for e in ends:
        if out and e - WINDOW + 1 <= out[-1][1]:
            out[-1] = (out[-1][0], e + 1)
        else:
            out.append((e - WINDOW + 1, e + 1))
    return out


def _shards(batches):
    """Regions sorted by owner, doc_id -> repeated spans (no hash), and hashes of new windows that aren't held."""
    automaton, shard, doc, waiting, held = SuffixAutomaton(), None, None, [], 0

    def settle():
        nonlocal held
        for words, missing in waiting:
            for a, e in _ranges(missing):
                automaton.add(words[a:e])
                held += e - a
        waiting.clear()

    kinds = (("doc_id", pa.int64()), ("words_sha", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("window", pa.int64()))
    for b in batches:
        out: list[tuple] = []
        for owner, d, sha, start, packed in zip(*(b.column(c).to_pylist() for c in range(5))):
            if owner != shard:
                automaton, shard, doc, held = SuffixAutomaton(), owner, d, 0
                waiting.clear()
            elif d != doc:
                settle()
                doc = d
            wide = np.zeros((len(packed) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
            words = wide.view(np.int64).ravel()
            symbols = words.tolist()
            ends = automaton.matches(symbols, WINDOW) if len(automaton.next) > 1 else []
            out += [(d, sha, start + a, start + e, None) for a, e in _ranges(ends)]
            known = set(ends)
            missing = [e for e in range(WINDOW - 1, len(symbols)) if e not in known]
            if held < HELD:
                waiting.append((symbols, missing))
            elif missing:
                h = tv.windows(words.view(tv.U), WINDOW).view(np.int64)
                out += [(d, sha, start + e - WINDOW + 1, start + e + 1, int(h[e - WINDOW + 1])) for e in missing]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(kinds)})


SPAN = "doc_id long, words_sha string, start int, end int, window long"


class Repeats:
    """base: a row each of docs (doc_id, words_sha, n_words, copy: an earlier row has the same words and enough of
    them); spans: doc_id, words_sha and the repeated spans, of the others; texts: of all that have spans, and more."""

    def __init__(self, docs: DataFrame):
        prepare(docs.sparkSession)
        spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        base = materialize(rows.mapInArrow(_base, "doc_id long, words_sha string, n_words long, anchors array<long>, spots array<int>"))
        long = base.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
        # One row for each word sequence; anchors are the same in each copy.
        firsts = materialize(long.groupBy("words_sha").agg(F.min("doc_id").alias("first_id"), F.first(F.arrays_zip("anchors", "spots")).alias("runs")))
        owners = firsts.select("words_sha", "first_id")
        self.base = base.select("doc_id", "words_sha", "n_words").join(owners, "words_sha", "left").select(
            "doc_id", "words_sha", "n_words", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copy")
        )
        runs = firsts.select(F.col("first_id").alias("doc_id"), "words_sha", F.explode("runs").alias("run")).select("doc_id", "words_sha", F.col("run.anchors").alias("anchor"), F.col("run.spots").alias("spot"))
        shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("owner < most").drop("most")
        shared, n_runs = materialize(shared), firsts.agg(F.sum(F.size("runs"))).first()[0] or 0
        matched = materialize(join_counted(runs, shared, "anchor", "n", n_runs).select("doc_id", "words_sha", "owner", "spot"))
        # Each anchor brings about (WINDOW - GRAM + 1) / 2 new words, and WINDOW at the edges.
        sizes = matched.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).withColumn("hot", F.col("n") * ((WINDOW - GRAM) // 2) > SHARD)
        marked = join_counted(matched, materialize(sizes), "owner", "n", matched.count())
        listed = marked.groupBy("doc_id", "words_sha").agg(F.collect_list(F.struct("owner", "spot", "hot")).alias("matched"))
        # A doc_id may have several texts: the word sequence tells them apart.
        joined = rows.join(listed, "doc_id")
        self.texts = materialize(joined.mapInArrow(_own, "doc_id long, words_sha string, text string, matched array<struct<owner:long,spot:int,hot:boolean>>"))
        regions = self.texts.mapInArrow(_regions, "owner long, doc_id long, words_sha string, start int, words binary, hashes array<long>")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cold = regions.where("words is not null").select("owner", "doc_id", "words_sha", "start", "words").repartition(parts, "owner").sortWithinPartitions("owner", "doc_id", "start")
        found = materialize(cold.mapInArrow(_shards, SPAN))
        windows = regions.where("hashes is not null").select("doc_id", "words_sha", "start", F.posexplode("hashes").alias("k", "window"))
        windows = windows.select("doc_id", "words_sha", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + WINDOW).alias("end"), "window")
        windows = windows.unionAll(found.where("window is not null"))
        windows = materialize(windows)
        least = materialize(windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most"))
        common = join_counted(windows, least, "window", "n", windows.count()).where("least < doc_id").select("doc_id", "words_sha", "start", "end")
        found = found.where("window is null").drop("window")
        self.spans = found.unionAll(common).groupBy("doc_id", "words_sha").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _own(batches):
    """Keeps, of rows joined by doc_id, those whose words are the ones meant; each text once."""
    for b in batches:
        names = b.schema.names
        text, sha = (b.column(names.index(c)) for c in ("text", "words_sha"))
        own = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() == s for t, s in zip(text.cast(pa.binary()).to_pylist(), sha.to_pylist())]
        yield pa.RecordBatch.from_pydict({c: b.column(names.index(c)).filter(pa.array(own, pa.bool_())) for c in ("doc_id", "words_sha", "text", "matched")})


def _covered(spans, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    for x in spans:
        change[x["start"]] += 1
        change[x["end"]] -= 1
    return np.cumsum(change[:-1]) > 0


def _digest(batches):
    for b in batches:
        out: list[tuple] = []
        for doc, sha, text, spans in zip(*(b.column(c).to_pylist() for c in range(4))):
            words = text.encode().split()
            gone = _covered(spans, len(words)).tolist()
            kept = [w for w, g in zip(words, gone) if not g]
            out.append((doc, sha, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("doc_id", pa.int64()), ("words_sha", pa.string()), ("removed", pa.int64()), ("kept", pa.string())))})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words with one space between)."""
    r = Repeats(docs)
    texts = r.texts.select("doc_id", "words_sha", "text").join(r.spans, ["doc_id", "words_sha"])
    changed = texts.select("doc_id", "words_sha", "text", "spans").mapInArrow(_digest, "doc_id long, words_sha string, removed long, kept string").dropDuplicates(["doc_id", "words_sha"])
    return r.base.join(changed, ["doc_id", "words_sha"], "left").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "words_sha")).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the repeated words, and what stands between them, cut out of text; other text stays as it is."""
    r = Repeats(docs)
    copies = r.base.where("copy").select("doc_id", "words_sha", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("spans"))
    columns = docs.columns
    own, found = fresh("own_id", columns), fresh("cuts", columns)
    cuts = r.spans.unionAll(copies).dropDuplicates(["doc_id", "words_sha"]).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("words_sha", "spans")).alias(found))
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumn(own, F.col("doc_id").cast("long")).join(cuts, own, "left").select(*columns, found)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)

    def run(batches):
        for b in batches:
            names = b.schema.names
            texts, cuts = b.column(names.index("text")).to_pylist(), b.column(names.index(found)).to_pylist()
            for k in [k for k, c in enumerate(cuts) if c and texts[k]]:
                data = texts[k].encode()
                sha = hashlib.sha256(b" ".join(data.split())).hexdigest()
                spans = next((c["spans"] for c in cuts[k] if c["words_sha"] == sha), None)
                if spans is None:
                    continue
                _, _, s, e = tv.words(pa.array([texts[k]], pa.large_string()), tv.SPACED, fold=False)
                gone = np.flatnonzero(np.diff(np.concatenate(([False], _covered(spans, len(s)), [False])).astype(np.int8)))
                out, at = [], 0
                for a, z in zip(gone[::2].tolist(), gone[1::2].tolist()):
                    out.append(data[at : int(s[a])])
                    at = int(e[z - 1])
                texts[k] = b"".join([*out, data[at:]]).decode()
            yield pa.RecordBatch.from_pydict({c: pa.array(texts, pa.string()) if c == "text" else b.column(names.index(c)) for c in columns})

    return rows.mapInArrow(run, schema)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)),
least as (select h, min(doc_id) as m from win group by h having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, k from (select win.doc_id, unnest(range(win.p, win.p + 50)) as k from win join least on win.h = least.h and least.m < win.doc_id)),
each as (select doc_id, k, w[k] as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from d)),
kept as (select each.doc_id, string_agg(x, ' ' order by each.k) as t, count(*) as n from each anti join gone on each.doc_id = gone.doc_id and each.k = gone.k group by each.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""

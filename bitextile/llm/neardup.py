"""Near-duplicates by SetSketch registers.

A document is its set of distinct runs of `shingle` words. Each of REGISTERS registers holds the exponentially spaced,
truncated minimum of the set's exponential hashes: mergeable by maximum, equal in two sets with a probability that
grows with their similarity. BANDS keys of four registers each put documents into buckets; two sets of similarity 0.8
miss each other in all of them with a probability of 2e-8. Equal sets are settled first, by their hash.

No bucket is collected or paired off: each of its members is compared with its first one, and links merge components.
For the documents of buckets whose components are still apart, links across
components are found exactly: in buckets of SMALL members at most pair by pair, in others, however large, by a prefix
join on their full sets: elements in one order, rarest first; two similar sets share an element of their prefixes, early enough in both. A document's own edits come
first in its order, so one that is too far from its group meets none of it. A pair is first estimated from the
registers by maximum likelihood (pairs below ESTIMATE, more than six standard deviations under 0.8, go), then verified
on the full sets of the whole texts. Components are found by alternating large and small stars over Parquet tables.

Defined results: documents without words have size 0, are linked with nothing and are kept; with fewer words than a
run has, the whole sequence is the one element. Rows without doc_id are never linked. Repeated rows have equal sets
and so one component; all of them with its id are kept. An empty table gives no rows. Extra columns are ignored, or kept
as they are by deduplicated(). A doc_id with several texts counts as one node: what any of its texts links with is linked.
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

REGISTERS, BANDS, BASE, RATE, TOP = 128, 32, 1.05, 20.0, (1 << 15) - 1
ESTIMATE = 0.55
#: Links that a task of the components' rounds reads.
LINKS = 500_000
#: Members of a bucket that are compared pair by pair, across components; larger ones go to the prefix join.
SMALL = 8
_rng = np.random.Generator(np.random.PCG64(77))
_FACTOR = _rng.integers(0, 2**63, REGISTERS, dtype=np.int64).astype(tv.U) * tv.U(2) + tv.U(1)


def sets(col: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct runs of each text as hashes."""
    h, offs, _, _ = tv.words(col, tv.SPACED)
    runs = tv.windows(h, shingle) if shingle > 1 else h
    out = []
    for a, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if e - a >= shingle:
            out.append(np.unique(runs[a : e - shingle + 1]))
        else:  # fewer words than a run has: another hash, so that it equals no run
            out.append(tv.mix(tv.windows(h[a:e], e - a) + tv.U(0xA5A5A5A5)) if e > a else np.zeros(0, tv.U))
    return out


def registers(s: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, 2**64 - 1, tv.U)
    for k in range(0, len(s), 2048):
        least = np.minimum(least, (s[k : k + 2048, None] * _FACTOR).min(0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of register rows, given the sets' sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :]
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))
    return j[0][np.argmax(np.where(j <= most + 1e-9, fit, -np.inf), axis=1)]


def _base(shingle: int):
    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(1)):
                found = sets(b.column(1).slice(lo, hi - lo), shingle)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column(0).slice(lo, hi - lo), "n_shingles": pa.array([len(s) for s in found], pa.int64()),
                        "set_sha": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in found]),
                        "registers": pa.array([registers(s).tobytes() if len(s) else b"" for s in found], pa.binary()),
                    }
                )

    return run


def _keys(batches):
    """node, registers -> node and its bucket keys."""
    for b in batches:
        r = np.stack([np.frombuffer(x, "<u2") for x in b.column(1).to_pylist()]).astype(tv.U) if len(b) else np.zeros((0, REGISTERS), tv.U)
        r = r.reshape(len(b), BANDS, REGISTERS // BANDS)
        key = np.broadcast_to(tv.mix(np.arange(1, BANDS + 1, dtype=tv.U)), (len(b), BANDS))
        for k in range(r.shape[2]):
            key = tv.mix(key * tv.U(3) + r[:, :, k])
        yield pa.RecordBatch.from_pydict({"node": b.column(0), "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * BANDS, pa.int32()), pa.array(key.ravel().view(np.int64)))})


def _likely(batches):
    for b in batches:
        if not len(b):
            continue
        x, y = (np.stack([np.frombuffer(v, "<u2") for v in b.column(c).to_pylist()]).astype(np.int32) for c in (2, 3))
        na, nb = (np.array(b.column(c).to_pylist(), float) for c in (4, 5))
        keep = np.concatenate([estimate(x[k : k + 2000], y[k : k + 2000], na[k : k + 2000], nb[k : k + 2000]) for k in range(0, len(b), 2000)]) >= ESTIMATE
        keep &= np.minimum(na, nb) * 100 >= 80 * np.maximum(na, nb)
        keep = pa.array(keep)
        yield pa.RecordBatch.from_pydict({"a": b.column(0).filter(keep), "b": b.column(1).filter(keep)})


def _verify(shingle: int, percent: int):
    def run(batches):
        for b in batches:
            out: tuple[list, list] = ([], [])
            at = 0
            while at < len(b):  # few enough for memory: both texts of a pair count
                size = max(1, min(500, len(b) - at))
                part = b.slice(at, size)
                ids = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                for pair, x, y in zip(ids, sets(part.column(2), shingle), sets(part.column(3), shingle)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        out[0].append(pair[0])
                        out[1].append(pair[1])
                at += size
            yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _elements(shingle: int):
    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(1)):
                found = sets(b.column(1).slice(lo, hi - lo), shingle)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                every = np.concatenate([np.zeros(0, tv.U), *found]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"node": b.column(0).slice(lo, hi - lo), "component": b.column(2).slice(lo, hi - lo), "elements": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every))})

    return run


def _prefix_pairs(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, text, component -> all pairs (a, b) of different components that can reach the similarity.

    The order is by how many of these sets have an element; elements of one set only can't be shared and come first.
    The smaller set of a pair must have the common element in its first n - ceil(2t / (1 + t) n) + 1, the larger one in
    its first n - ceil(tn) + 1, and as many elements must be left in both as the overlap needs.
    """
    rows = texts.select("node", "text", "component").mapInArrow(_elements(shingle), "node long, component long, elements array<long>")
    every = materialize(rows)
    each = every.select("node", "component", F.explode("elements").alias("element"))
    total = every.agg(F.sum(F.size("elements"))).first()[0] or 0
    common = each.groupBy("element").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("c > 1")
    common = materialize(common.select("element", "c", F.col("c").alias("rows"), (F.col("low") < F.col("high")).alias("joins")))
    # An element of one component only takes its place in the order, and joins nothing.
    kept = join_counted(each.select("node", "element"), common, "element", "rows", total)
    ordered = kept.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "element", "joins"))).alias("shared")).join(every.select("node", "component", F.size("elements").alias("n")), "node")
    first = F.col("n") - F.size("shared")  # how many come before, in this set only
    prefix = ordered.select("node", "component", "n", first.alias("first"), F.posexplode(F.expr("slice(shared, 1, greatest(0, int(n - ceil(n * {p} / 100) + 1) - (n - size(shared))))".replace("{p}", str(percent)))).alias("k", "s"))
    prefix = prefix.where("s.joins").select(F.col("s.element").alias("element"), "node", "component", "n", (F.col("first") + F.col("k")).alias("at"), (F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1).alias("short"))
    prefix = materialize(prefix)
    # The largest component of each element meets the others only, so its members never meet each other.
    most = prefix.groupBy("element", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("element").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("rows")).where("kinds > 1")
    most = materialize(most.select("element", F.col("m.component").alias("largest"), "rows"))
    live = materialize(join_counted(prefix, most, "element", "rows", prefix.count()))
    left, right = (live.select("element", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "n", "at", "short", "largest")]) for s in "lr")
    small = (F.col("n_l") < F.col("n_r")) | ((F.col("n_l") == F.col("n_r")) & (F.col("node_l") < F.col("node_r")))
    near = (F.col("component_l") != F.col("component_r")) & (F.least("n_l", "n_r") * 100 >= F.greatest("n_l", "n_r") * percent)
    near &= F.when(small, F.col("at_l") < F.col("short_l")).otherwise(F.col("at_r") < F.col("short_r"))
    near &= F.least(F.col("n_l") - F.col("at_l"), F.col("n_r") - F.col("at_r")) * (100 + percent) >= (F.col("n_l") + F.col("n_r")) * percent
    met = left.where("component_l != largest_l").alias("l").join(right.alias("r"), (F.col("l.element") == F.col("r.element")) & near)
    return met.select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of links (a, b)."""
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = edges.count() // LINKS + 1
    edges = edges.coalesce(parts)
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct())
        edges = edges.coalesce(parts)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row each of docs: doc_id, n_shingles, set_sha, component_id, kept."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(rows.mapInArrow(_base(shingle), "doc_id long, n_shingles long, set_sha string, registers binary"))
    nodes = base.where("doc_id is not null and n_shingles > 0").groupBy("set_sha").agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n"))
    nodes = materialize(nodes)
    keyed = nodes.select("node", "registers").mapInArrow(_keys, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first")
    members = materialize(keyed.join(shared, "key").select("key", "node", "first"))
    wanted = members.select("node").distinct()
    texts = materialize(rows.join(wanted, rows["doc_id"] == wanted["node"]).select("node", "text"))
    sketches = materialize(nodes.join(wanted, "node").select("node", "registers", "n"))

    def verified(pairs: DataFrame) -> DataFrame:
        sides = []
        for side in ("a", "b"):
            sides.append((sketches.select(F.col("node").alias(side), F.col("registers").alias(f"r{side}"), F.col("n").alias(f"n{side}")), texts.select(F.col("node").alias(side), F.col("text").alias(f"t{side}"))))
        likely = pairs.distinct().join(sides[0][0], "a").join(sides[1][0], "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_likely, "a long, b long")
        full = likely.distinct().join(sides[0][1], "a").join(sides[1][1], "b").select("a", "b", "ta", "tb")
        return materialize(full.mapInArrow(_verify(shingle, percent), "a long, b long"))

    links = verified(members.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    found = materialize(components(links))
    placed = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("key", "size")
    live = materialize(placed.join(apart, "key"))
    few = live.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "component"))).alias("m"))  # SMALL at most
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & (y["component"] != x["component"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    links = links.unionAll(verified(few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")))
    open_ = materialize(live.where(F.col("size") > SMALL).select("node", "component").distinct())
    links = links.unionAll(verified(_prefix_pairs(texts.join(open_, "node"), shingle, percent)))
    found = materialize(components(links))
    by_set = nodes.select("set_sha", "node").join(found, "node", "left").select("set_sha", F.coalesce("component", "node").alias("component"))
    return base.drop("registers").join(by_set, "set_sha", "left").select(
        "doc_id", "n_shingles", "set_sha", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 2).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept: one doc_id of each group."""
    own = fresh("gone_id", docs.columns)
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.withColumn(own, F.col("doc_id").cast("long")).join(gone, own, "left_anti").select(*docs.columns)


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[p : p + 1], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
sym as (select a, b from link union all select b, a from link),
reach as (select doc_id as node, doc_id as root from d union select sym.b, reach.root from reach join sym on sym.a = reach.node where reach.root < sym.b)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.root as component_id, d.doc_id = r.root as kept
from d left join n using (doc_id) join (select node, min(root) as root from reach group by node) r on r.node = d.doc_id
"""

"""Exact duplicates through minimal perfect hashes over the digests of earlier texts.

Two texts are equal if they are identical without white space (space and U+0009 to U+000D); a text's digest is the
SHA-256 of what is left. An index holds the distinct digests of all earlier rows in shards of about SHARD_KEYS: in each,
a minimal perfect hash (levels of bits, a key stays at the first level where it is alone) gives every digest a slot of
its own, and slots hold the full digest and the locator of the row that stays (its doc_id and length) with the number
of equal rows. A later digest is looked up in its shard and is a member only if all its bytes equal the slot's; what
isn't a member is grouped by itself. Of equal texts the row with the most code points in its original text stays, then
the one with the smallest doc_id, whether it came earlier or later.

Rows are aggregated by digest before any shuffle, so copies never gather; only digests, lengths and ids are shuffled,
never texts. An index much smaller than what is looked up is dealt to several groups, so each group is bounded. Digests
that many rows have meet their winner by a bounded broadcast.

Defined results: null texts count as empty, and all empty texts are equal. A null doc_id comes after all others; a
group of such rows only has a null keep_id, and its longest rows stay. Rows that repeat one doc_id with equal texts of
the same length are one document: all stay, or none. An empty table gives no rows. Extra columns are ignored, or kept
as they are by deduplicated().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare
from . import textvec as tv
from .columns import fresh, join_counted

SHARD_KEYS = 1 << 16
#: Later digests that meet one copy of a shard, in shards' sizes.
LOAD = 4
#: The characters that don't count.
BLANK = " \t\n\x0b\x0c\r"

INDEX = "shard long, shards long, n int, sizes array<int>, bits binary, digests binary, keep_ids array<long>, n_chars array<long>, counts array<long>"
_FOUND = "digest binary, member boolean, n_chars long, keep_id long, n long"


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys of 32 bytes; any other key gets some number, or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        words, h = keys.view("<u8").reshape(-1, 4), np.zeros(len(keys), tv.U)
        for k in range(4):
            h = tv.mix(h + words[:, k] + tv.U((4 * level + k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        return (h % tv.U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left, level = [], [], keys, 0
        while len(left):
            size = len(left) * 3 // 2 + 1
            at = cls._at(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left, level = left[~alone[at]], level + 1
        return cls(sizes, np.concatenate([np.zeros(0, bool), *bits]))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out, open_, begin = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = begin + self._at(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, begin = open_[~hit], begin + size
        return out


def _keys(col: pa.Array) -> np.ndarray:
    data, _ = tv.raw(col)
    return np.ascontiguousarray(data).reshape(-1, 32)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANK, "")


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest (32 bytes): all that is needed of a text. Read more than once, it should be a table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


def _order(n_chars: Column, doc_id: Column) -> Column:
    """The larger one stays."""
    return F.struct(n_chars.alias("n_chars"), doc_id.isNotNull().alias("named"), F.bitwise_not(doc_id).alias("low"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row a digest: digest, n_chars and keep_id of the row that stays, n rows."""
    best = rows.groupBy("digest").agg(F.max(_order(F.col("n_chars"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("n"))
    return best.select("digest", F.col("best.n_chars").alias("n_chars"), F.bitwise_not("best.low").alias("keep_id"), "n")


def _shard(shards: int) -> Column:
    head = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    return F.shiftright(head * F.lit(shards), 32)


def index(groups: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """A row a shard of the distinct digests in groups (rows of grouped())."""
    spark = prepare(groups.sparkSession)
    groups = materialize(groups)
    shards = max(1, -(-groups.count() // shard_keys))

    def build(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        keys = _keys(part.column("digest").combine_chunks())
        found = PerfectHash.build(keys)
        slot = np.argsort(found.lookup(keys))
        row = {"shard": [part.column("shard")[0].as_py()], "shards": [shards], "n": [len(keys)], "sizes": [found.sizes], "bits": [np.packbits(found.bits).tobytes()], "digests": [keys[slot].tobytes()]}
        row |= {c: [part.column(a).take(pa.array(slot)).to_pylist()] for c, a in (("keep_ids", "keep_id"), ("n_chars", "n_chars"), ("counts", "n"))}
        return pa.Table.from_pydict(row, pa.schema([("shard", pa.int64()), ("shards", pa.int64()), ("n", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("digests", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("keep_ids", "n_chars", "counts"))]))

    if groups.isEmpty():
        return spark.createDataFrame([], INDEX)
    return materialize(groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, INDEX))


def _probe(later: pa.Table, shard: pa.Table) -> pa.Table:
    later = later.combine_chunks()
    n = len(later)
    member, n_chars, keep, counts = np.zeros(n, bool), [None] * n, [None] * n, [0] * n
    if len(shard) and n:
        s = {c: shard.column(c)[0].as_py() for c in shard.column_names}
        found = PerfectHash(s["sizes"], np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=sum(s["sizes"])).astype(bool))
        keys, held = _keys(later.column("digest").combine_chunks()), np.frombuffer(s["digests"], np.uint8).reshape(-1, 32)
        slot = found.lookup(keys)
        member = (slot >= 0) & (held[slot] == keys).all(1)
        for k in np.flatnonzero(member).tolist():
            n_chars[k], keep[k], counts[k] = s["n_chars"][slot[k]], s["keep_ids"][slot[k]], s["counts"][slot[k]]
    return pa.Table.from_arrays([later.column("digest").combine_chunks(), pa.array(member), pa.array(n_chars, pa.int64()), pa.array(keep, pa.int64()), pa.array(counts, pa.int64())], ["digest", "member", "n_chars", "keep_id", "n"])


def looked_up(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups (rows of grouped()) against an index: digest, member, and the slot's n_chars, keep_id, n (0: no member)."""
    first = found.select("shards").first()
    if first is None:
        return groups.select("digest", F.lit(False).alias("member"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("n"))
    shards, held = first[0], found.agg(F.sum("n")).first()[0]
    copies = max(1, -(-groups.count() // (LOAD * held)))
    own = groups.select("digest", _shard(shards).alias("shard"), F.pmod(F.xxhash64("digest"), F.lit(copies)).cast("long").alias("copy"))
    dealt = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"))
    return own.groupBy("shard", "copy").cogroup(dealt.groupBy("shard", "copy")).applyInArrow(_probe, _FOUND)


def winners(earlier: DataFrame, later: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The groups of both, rows of grouped() each: members update their slot's group, nonmembers are groups of their own."""
    earlier, later = materialize(earlier), materialize(later)
    seen = looked_up(later, index(earlier, shard_keys)).select("digest", "member", *(F.col(c).alias(f"old_{c}") for c in ("n_chars", "keep_id", "n")))
    both = later.join(seen, "digest")
    better = F.greatest(_order(F.col("n_chars"), F.col("keep_id")), F.when(F.col("member"), _order(F.col("old_n_chars"), F.col("old_keep_id"))))
    both = materialize(both.select("digest", better.alias("best"), (F.col("n") + F.col("old_n")).alias("n")).select("digest", F.col("best.n_chars").alias("n_chars"), F.bitwise_not("best.low").alias("keep_id"), "n"))
    return both.unionByName(earlier.join(both, "digest", "left_anti"))


def marked(rows: DataFrame, won: DataFrame) -> DataFrame:
    """rows (of digested(), or with more columns) with keep_id, group_size and kept. No digest is hot in a shuffle."""
    found = won.select("digest", F.col("n_chars").alias("best_chars"), "keep_id", F.col("n").alias("group_size"), "n")
    out = join_counted(rows, materialize(found), "digest", "n", rows.count())
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best_chars"))).drop("best_chars")


def split_history(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier and later rows: up to the middle of the range of ids, and all others (null ids too)."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit(None if low is None else low + (high - low) // 2).cast("long")
    earlier = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return rows.where(earlier), rows.where(~earlier)


def digests(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the lower half of the ids is the history."""
    prepare(docs.sparkSession)
    rows = materialize(digested(docs))
    earlier, later = split_history(rows)
    out = marked(rows, winners(grouped(earlier), grouped(later), shard_keys))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay, with their columns: without history, one of each group of equal texts in docs; with
    an index of history, those among them that are no member of it."""
    prepare(docs.sparkSession)
    digest, taken = fresh("digest", docs.columns), fresh("taken", docs.columns)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    length = F.length(text).cast("long")
    own = materialize(grouped(digested(docs)))
    if history is not None:
        own = own.join(looked_up(own, history).where("not member").select("digest"), "digest")
    best = materialize(own.select(F.col("digest").alias(digest), F.struct("n_chars", "keep_id").alias(taken), F.col("n").alias(fresh("n", docs.columns))))
    rows = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    total = best.agg(F.sum(fresh("n", docs.columns))).first()[0] or 0
    kept = join_counted(rows, best, digest, fresh("n", docs.columns), total)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{taken}.keep_id")) & (length == F.col(f"{taken}.n_chars"))
    return kept.where(same).select(*docs.columns)


ORACLE = r"""
with d as (select doc_id, length(coalesce(text, '')) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s from documents),
g as (select s, count(*) as group_size, first(doc_id order by n_chars desc, doc_id) as keep_id from d group by s)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id = g.keep_id as kept, d.s as text_sha256 from d join g on d.s = g.s
"""

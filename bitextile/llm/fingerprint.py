"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (the non-empty stretches between line feeds). Each paragraph is hashed to a
wide vector: LANES uniform numbers modulo 2^32, and BUCKETS small numbers modulo 2^16 that count, with signs, its
two-word runs (the first word with a start mark). A text's fingerprint is the sum of its paragraphs' vectors, so the
order of paragraphs is irrelevant, equal multisets have equal fingerprints, and a paragraph can be added or taken away
by adding or subtracting its vector. The uniform lanes decide equality; the counted lanes give the likeness, the cosine
of two sums.

Defined results: a null or empty text has the zero vector; two equal fingerprints have likeness 1, one zero vector and
another vector 0. Rows may repeat; tied ids are ordered by a hash of their text. Null ids come after all others. An empty
table gives no rows, a table of one row has that row as its own next one. Extra columns are ignored. A count that leaves 16 bits (a pair that occurs over 32,767 times) wraps, so that sums stay homomorphic.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from . import textvec as tv

LANES, BUCKETS = 16, 256
WIDTH = LANES * 4 + BUCKETS * 2
SLICE_BYTES = 4 << 20

_PARAGRAPH = np.ones(256, bool)
_PARAGRAPH[10] = False
_START = tv.U(0xD1B54A32D192ED03)
_GOLDEN = tv.U(0x9E3779B97F4A7C15)


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about limit bytes at most, one row at least."""
    _, offs = tv.raw(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to
        at = to


def vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The uniform lanes (uint32) and the counted lanes (int16) of each text."""
    n = len(col)
    p, po, _, _ = tv.words(col, _PARAGRAPH, fold=False)
    lanes = np.zeros((n, LANES), np.uint32)
    total = np.zeros(len(p) + 1, tv.U)
    for k in range(LANES):
        np.cumsum(tv.mix(p + tv.U((k + 1) * int(_GOLDEN) % 2**64)) >> tv.U(32), out=total[1:])
        lanes[:, k] = (total[po[1:]] - total[po[:-1]]).astype(np.uint32)
    h, o, s, _ = tv.words(col, tv.SPACED, fold=False)
    if not len(h):
        return lanes, np.zeros((n, BUCKETS), np.int16)
    data, _ = tv.raw(col)
    lines = np.cumsum(data == 10, dtype=np.int64)[s]
    before = np.empty_like(h)
    before[0], before[1:] = _START, h[:-1]
    first = np.zeros(len(h), bool)
    first[1:] = lines[1:] != lines[:-1]
    first[o[:-1][o[:-1] < len(h)]] = True
    before[first] = _START
    f = tv.mix(before * tv.U(0x100000001B3) + h)
    row = np.repeat(np.arange(n), np.diff(o))
    at = row * BUCKETS + (f >> tv.U(56)).astype(np.int64)
    sums = np.bincount(at, weights=(f & tv.U(1)).astype(np.float64) * 2 - 1, minlength=n * BUCKETS)
    return lanes, sums.astype(np.int64).astype(np.int16).reshape(n, BUCKETS)


def encode(lanes: np.ndarray, counted: np.ndarray) -> list[str]:
    both = np.concatenate([lanes.astype("<u4").view(np.uint8), counted.astype("<i2").view(np.uint8)], axis=1)
    return [base64.b64encode(x.tobytes()).decode() for x in both]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data, "<u4", LANES), np.frombuffer(data, "<i2", BUCKETS, LANES * 4)


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of the paragraphs of both, or, with sign -1, of a without those of b."""
    (la, ca), (lb, cb) = decode(a), decode(b)
    if sign < 0:
        return encode((la - lb)[None], (ca - cb)[None])[0]
    return encode((la + lb)[None], (ca + cb)[None])[0]


def likeness(la: np.ndarray, ca: np.ndarray, lb: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1."""
    x, y = ca.astype(np.float64), cb.astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    same = (la == lb).all(1) & (ca == cb).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every text, without a shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(encode(*vectors(part.column(1))), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, its own rows first, then the row that follows them in the next range."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held = None  # range, is a bridge, doc_id, text, lanes, counted: the row whose successor isn't known yet
    for batch in batches:
        for lo, hi in slices(batch.column(3)):
            part = batch.slice(lo, hi - lo)
            ranges, bridge, ids = (part.column(k).to_pylist() for k in range(3))
            texts = [t or "" for t in part.column(3).to_pylist()]
            lanes, counted = vectors(part.column(3))
            if held is not None:
                ranges, bridge, ids, texts = [held[0], *ranges], [held[1], *bridge], [held[2], *ids], [held[3], *texts]
                lanes, counted = np.vstack([held[4], lanes]), np.vstack([held[5], counted])
            n = len(ids) - 1
            held = (ranges[n], bridge[n], ids[n], texts[n], lanes[n : n + 1], counted[n : n + 1])
            own = [k for k in range(n) if not bridge[k]]
            if not own:
                continue
            edited = []
            for k in own:
                half = len(texts[k]) // 2
                edited.append(texts[k][: len(texts[k]) - half] + texts[k + 1][:half])
            el, ec = vectors(pa.array(edited, pa.large_string()))
            at = np.array(own)
            near = likeness(lanes[at], counted[at], el, ec)
            following = likeness(lanes[at], counted[at], lanes[at + 1], counted[at + 1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(encode(lanes[at], counted[at])),
                    pa.array(encode(el, ec)), pa.array(near), pa.array(following),
                ],
                schema=schema,
            )


_LAST = np.iinfo(np.int64).max


def _position(key: np.ndarray, tie: np.ndarray, keys: np.ndarray, ties: np.ndarray, side: str) -> np.ndarray:
    """Like searchsorted, in pairs (keys, ties) in order. Only pairs with equal keys are looked at one by one."""
    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    for k in np.flatnonzero(hi > lo):
        lo[k] += np.searchsorted(ties[lo[k] : hi[k]], tie[k], side)
    return lo


def edited_neighbours(docs: DataFrame, range_bytes: int = 64 << 20, samples: int = 500_000) -> DataFrame:
    """Fingerprints of each text and of its edit with the beginning of the next text, by descending doc_id.

    Texts are dealt to ranges of (doc_id, hash of text) and sorted there, so each text is shuffled once and nothing is
    ordered over the whole table. Ranges have about range_bytes of text: their bounds come from a sample of about
    `samples` keys at most, drawn in proportion to bytes, and workers look a row's range up by binary search. The first
    row of each range also goes to the range before it. The driver holds the sample and two keys a range.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce(F.bitwise_not("doc_id"), F.lit(_LAST)).alias("key"), F.xxhash64("text").alias("tie"))
    sized = rows.select("key", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("double").alias("size"))
    total = sized.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], PAIR)
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // range_bytes + 1))
    step = max(total / samples, total / (100 * parts))
    chance = F.pmod(F.xxhash64("key", "tie", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sized.where(chance * step < F.col("size")).groupBy("key", "tie").agg(F.max("size").alias("size")).toArrow()
    key, tie = (drawn.column(c).to_numpy() for c in ("key", "tie"))
    order = np.lexsort((tie, key))
    key, tie = key[order], tie[order]
    passed = np.cumsum(np.maximum(drawn.column("size").to_numpy()[order], step))
    # The first key after each share; a range begins with its bound.
    cut = np.unique(np.searchsorted(passed, passed[-1] * np.arange(1, parts) / parts, "right")) if len(passed) else np.zeros(0, np.int64)
    cut = cut[cut < len(key)]
    bounds = spark.sparkContext.broadcast((key[cut], tie[cut]))

    @F.pandas_udf("int")
    def range_of(k, t):
        import pandas as pd

        return pd.Series(_position(k.to_numpy(), t.to_numpy(), *bounds.value, "right").astype(np.int32))

    heads = sized.select(range_of("key", "tie").alias("range"), "key", "tie").groupBy("range").agg(F.min(F.struct("key", "tie")).alias("head")).select("range", "head.key", "head.tie").toArrow()  # one row a range
    ranges = heads.column("range").to_numpy()
    order = np.argsort(ranges)
    first = spark.sparkContext.broadcast((ranges[order], heads.column("key").to_numpy()[order], heads.column("tie").to_numpy()[order]))

    @F.pandas_udf("long")
    def dealt_to(k, t):
        """A row's range and, for a range's first row, the range before + 1 in the upper half."""
        import pandas as pd

        numbers, keys, ties = first.value
        k, t = k.to_numpy(), t.to_numpy()
        at = np.maximum(_position(k, t, keys, ties, "right") - 1, 0)
        head = (keys[at] == k) & (ties[at] == t)
        return pd.Series(numbers[at] + np.where(head, numbers[at - 1].astype(np.int64) + 1, 0) * (1 << 32))

    coded = rows.withColumn("code", dealt_to("key", "tie"))
    own, onto = F.col("code").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("code", 32) - 1
    places = F.when(onto >= 0, F.array(F.struct(own.alias("range"), F.lit(False).alias("bridge")), F.struct(onto.alias("range"), F.lit(True).alias("bridge")))).otherwise(F.array(F.struct(own.alias("range"), F.lit(False).alias("bridge"))))
    each = coded.select("doc_id", "text", "key", "tie", F.explode(places).alias("p")).select(F.col("p.range").cast("int").alias("range"), "p.bridge", "doc_id", "text", "key", "tie")
    dealt = each.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "bridge", "key", "tie").select("range", "bridge", "doc_id", "text")
    return dealt.mapInArrow(_neighbours, PAIR)

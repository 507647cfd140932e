"""Token-id output: best-fit-decreasing packing of texts into rows of a fixed length.

A worker encodes its texts, as llm.bpe does (special strings become their ids), and packs them block by block (BLOCK
tokens, or one longer text): texts longer than a row are cut into whole rows and a rest, nothing is lost; the pieces,
longest first, each go to the fullest row that still has room, found by a search down a segment tree over the remaining
capacities. A packed row has its ids (16-bit, or 32-bit where the vocabulary needs it, little-endian, padded to the row
length), the texts and offsets that its segments come from, the cumulative segment lengths from 0, and positions that
restart at 0 with each segment (16-bit, or 32-bit where the row length needs it, little-endian, padded with 0).
Packing needs no shuffle, and memory for one block; each block leaves one row at most that is less than half full,
besides rows that no pair fits. The rows of one input split are the same when they are made again.

Defined results: null and empty texts have no tokens and so no segment; every other token of every row is in exactly
one segment. Repeated texts are packed each; a null doc_id stays null. An empty table has no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from . import bpe
from .fingerprint import slices

LENGTH, BLOCK = 2048, 1 << 20


class BestFit:
    """Rows by what room they have left; the least room that is enough is found in a segment tree over capacities."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def put(self, row: int, room: int) -> None:
        self.rows.setdefault(room, []).append(row)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room of `least` or more, and its room; it is taken out."""
        count, k = self.count, least + self.size
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return self.rows[room].pop(), room


def pack(lengths: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of segments (text, first token, tokens), for texts of these lengths."""
    rows: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int, int]] = []
    for t, n in enumerate(lengths):
        for a in range(0, n - length + 1, length):
            rows.append([(t, a, length)])
        if n % length:
            rests.append((t, n - n % length, n % length))
    rests.sort(key=lambda x: (-x[2], x[0]))
    fit = BestFit(length)
    for piece in rests:
        found = fit.take(piece[2])
        if found is None:
            found = (len(rows), length)
            rows.append([])
        row, room = found
        rows[row].append(piece)
        if room > piece[2]:
            fit.put(row, room - piece[2])
    return rows


SCHEMA = "pack_id long, n_tokens int, n_segments int, doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, ids binary, positions binary"
_KINDS = {"pack_id": pa.int64(), "n_tokens": pa.int32(), "n_segments": pa.int32(), "doc_ids": pa.list_(pa.int64()), "doc_offsets": pa.list_(pa.int32()), "cu_seqlens": pa.list_(pa.int32()), "ids": pa.binary(), "positions": pa.binary()}


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, pad: int = 0) -> DataFrame:
    """Packed rows of all documents."""
    prepare(docs.sparkSession)
    path = path or bpe.vocabulary()

    def run(batches):
        e = bpe.encoder(path)
        kind, places = (np.dtype("<u2" if size <= 1 << 16 else "<u4") for size in (max(e.bytes) + 1, length))
        serial = TaskContext.get().partitionId() << 33
        texts: list[np.ndarray] = []
        owners: list[int | None] = []

        def block():
            nonlocal serial
            out: list[tuple] = []
            for segments in pack([len(t) for t in texts], length):
                matrix, at = np.full(length, pad, kind), np.zeros(length, places)
                ends = [0]
                for t, a, n in segments:
                    matrix[ends[-1] : ends[-1] + n] = texts[t][a : a + n]
                    at[ends[-1] : ends[-1] + n] = np.arange(n)
                    ends.append(ends[-1] + n)
                out.append((serial, ends[-1], len(segments), [owners[t] for t, _, _ in segments], [a for _, a, _ in segments], ends, matrix.tobytes(), at.tobytes()))
                serial += 1
            texts.clear()
            owners.clear()
            for k in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out[k : k + 1000]], t) for i, (c, t) in enumerate(_KINDS.items())})

        total = 0
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, at = e.encode_column(b.column(1).slice(lo, hi - lo))
                ids = ids.astype(kind)
                for d, a, z in zip(b.column(0).slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    if a == z:
                        continue
                    texts.append(ids[a:z])
                    owners.append(d)
                    total += z - a
                    if total >= BLOCK:
                        yield from block()
                        total = 0
        if texts:
            yield from block()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def unpacked(rows: DataFrame) -> DataFrame:
    """doc_id, doc_offset, n_tokens of every segment of packed rows."""
    n = F.transform(F.sequence(F.lit(1), F.size("doc_ids")), lambda k: F.element_at("cu_seqlens", k + 1) - F.element_at("cu_seqlens", k))
    each = rows.select(F.explode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("doc_offsets").alias("doc_offset"), n.alias("n_tokens"))).alias("s"))
    return each.select("s.*")


def write_packed(docs: DataFrame, target: str, length: int = LENGTH, path: str | None = None) -> None:
    """The packed id matrices with cumulative segment lengths and position resets, as a Parquet table."""
    packed(docs, length, path).write.parquet(target)

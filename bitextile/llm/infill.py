"""Fill-in-middle rearrangement of texts, cut at line ends that a seed picks.

Equal texts have equal line ends, so these are found once for each distinct text: documents are dealt and sorted by a
hash of their text, equal neighbours are confirmed byte by byte, the ends of the lines of the first of them become an
Elias-Fano list (low bits packed, high bits in unary), and each of the documents selects its two cuts from that list.
Texts travel with their hash, so each is shuffled once and the join of lists back to documents costs nothing more. A text
that many documents have is dealt to several tasks in turn (and listed once in each); which ones are broadcast, two
a task at most.

Of the 8-digit groups h1 to h4 of the SHA-256 of `seed:doc_id`, h1 and h2 pick two of the n + 1 line ends (the text's
beginning included): prefix, middle and suffix lie between. h3 decides by `rate` (in 100) whether a text is rearranged,
h4 by `spm_rate` whether the suffix comes first. A text that is empty or contains a marker stays plain.

Defined results: null texts count as empty, so they are plain with n = 0. A null doc_id is hashed as no digits. Repeated
rows come out each. An empty table gives no rows. infilled() keeps extra columns as they are; its own new columns (form,
n, prefix_chars, middle_chars, output) must be free. A text in one line (n = 1) is cut at its ends only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare
from .columns import fresh, whole_text

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = [("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output", "string")]

_P, _S, _M = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


class EliasFano:
    """Ascending numbers up to universe: low bits as they are, high bits as gaps in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, (universe // n).bit_length() - 1) if n else 0
        low = values & ((1 << self.low_bits) - 1)
        self.low = np.packbits(((low[:, None] >> np.arange(self.low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        high = np.zeros(((int(values[-1]) >> self.low_bits) + n) if n else 0, np.uint8)
        high[(values >> self.low_bits) + np.arange(n)] = 1
        self.high = np.packbits(high, bitorder="little")
        self.ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        byte = int(np.searchsorted(self.ones, k, "right"))
        rest, bits, at = k - (int(self.ones[byte - 1]) if byte else 0), int(self.high[byte]), 0
        while rest or not bits & 1:
            rest -= bits & 1
            bits >>= 1
            at += 1
        high = 8 * byte + at - k
        begin = k * self.low_bits
        own = int.from_bytes(self.low[begin >> 3 : (begin + self.low_bits + 7) >> 3].tobytes(), "little") >> (begin & 7)
        return high << self.low_bits | own & ((1 << self.low_bits) - 1)


def line_ends(text: bytes) -> np.ndarray:
    """The byte after each line."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if text and not text.endswith(b"\n") else ends


def _chars(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def arranged(text: bytes, ends: EliasFano, seeded: str, rate: int, spm_rate: int) -> tuple[str, int | None, int | None, bytes]:
    """form, code points of prefix and of middle, output."""
    h = [int(seeded[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or h[2] % 100 >= rate or _P in text or _S in text or _M in text:
        return "plain", None, None, text
    a, b = sorted(x % (ends.n + 1) for x in h[:2])
    a, b = (ends.select(k - 1) if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return "spm", _chars(prefix), _chars(middle), _S + suffix + _P + prefix + _M + middle
    return "psm", _chars(prefix), _chars(middle), _P + prefix + _S + suffix + _M + middle


def infilled(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """docs with n (lines), form, prefix_chars, middle_chars and output."""
    spark = prepare(docs.sparkSession)
    if clash := {c for c, _ in ADDED} & {c.lower() for c in docs.columns}:
        raise ValueError(f"give other names to the columns {sorted(clash)}")
    key, salt = (fresh(c, docs.columns) for c in ("key", "salt"))
    text, rows = whole_text(docs, docs.columns)  # a text is shuffled once
    rows = rows.withColumn(key, F.xxhash64(F.coalesce(text, F.lit(""))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(docs.select(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias(salt)))
    total = counts.agg(F.sum(salt)).first()[0] or 0
    # Texts of more than half a task's share: at most two for each task.
    hot = counts.where(F.col(salt) * 2 * parts > total).withColumn(salt, F.ceil(F.col(salt) * 2 * parts / max(total, 1)).cast("long"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(salt, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(salt)), F.lit(0).cast("long")))
    dealt = dealt.repartition(parts, key, salt).sortWithinPartitions(key)
    columns, added_columns = list(docs.columns), [c for c, _ in ADDED]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} {t}" for c, t in ADDED)])

    def run(batches):
        last, known = None, []  # texts with the key at hand: one, but for a collision of hashes
        for b in batches:
            cols = {c: b.column(b.schema.names.index(c)) for c in (key, "doc_id", text)}
            out: list[tuple] = []
            for k, doc, t in zip(cols[key].to_pylist(), cols["doc_id"].to_pylist(), cols[text].cast(pa.binary()).to_pylist()):
                t = t or b""
                h = hashlib.sha256(f"{seed}:{'' if doc is None else int(doc)}".encode()).hexdigest()
                if k != last:
                    last, known = k, []
                ends = next((e for own, e in known if own == t), None)
                if ends is None:
                    ends = EliasFano(line_ends(t), len(t))
                    known.append((t, ends))
                out.append((ends.n, *arranged(t, ends, h, rate, spm_rate)))
            own = [b.column(b.schema.names.index(c)) for c in columns]
            added = list(zip(*out)) or [()] * len(added_columns)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(added, kinds)), pa.array(added[4], pa.binary()).cast(pa.string())], [*columns, *added_columns])

    return dealt.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""

    def between(a: str, b: str) -> tuple[Column, Column, Column]:
        """What stands after the marker a, after b and after MIDDLE."""
        first = F.substring_index(F.substr(output, F.lit(len(a) + 1)), b, 1)
        rest = F.substr(output, F.length(first) + len(a) + len(b) + 1)
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substr(rest, F.length(second) + len(MIDDLE) + 1)

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    ahead, begin, inner = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(begin, inner, ahead)).otherwise(output)


def digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    rows = infilled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), seed, rate, spm_rate)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def plain(doc_id: int | None, text: str | None, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> tuple:
    """The same for one text, without lists of line ends: for tests."""
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text and not text.endswith("\n") else [])
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm_rate:
        return len(lines), "spm", len(prefix), len(middle), SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return len(lines), "psm", len(prefix), len(middle), PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || cast(doc_id as varchar)) as h from documents),
u as (select doc_id, t, case when t = '' then [] else regexp_extract_all(t, '[^\n]*\n|[^\n]+') end as w, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(array_to_string(w[1:a], ''), '') as x, coalesce(array_to_string(w[a + 1:b], ''), '') as y, coalesce(array_to_string(w[b + 1:n], ''), '') as z from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(x) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(y) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256, sha256(t) as restored_sha256 from p
"""

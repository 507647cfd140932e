"""Toxic passages by maximum-scoring segments, calibrated by extreme values.

A word's score is its log-odds between toxic and other labelled documents under Dirichlet priors: a word's counts are
centred on those of all words with its first PREFIX bytes, these on the labels' rates, so an unseen form of a toxic
stem scores too. Every word of the sample has its own score. DRIFT is taken off each token. A linear scan over each
whole text finds all maximal scoring segments. A segment's excess is -log of the number of segments of its score that
the extreme-value (Gumbel) distribution, fitted to the best segments of documents labelled 0 (by their median and upper
tenth, which wrong labels move little), expects in a plain text of its length; it is significant where the excess is
positive, that is, where less than one such segment is expected. A logistic fit on labelled documents that the counts
have not seen turns the best segment's excess and the sum of all significant ones into a score from 0 to 1.

Learning uses labels of rows only that the split leaves for training: LEARN of them at most for counts and CALIBRATE
at most for calibration, drawn by a hash of doc_id; these two bounds are the parameters of the sample. The driver holds
the distinct words of the sample. All documents are scored. Labels, lang, source and doc_id never enter a score.

Defined results: null and empty texts have no segment and the score that goes with that; without labels of both kinds
the score is their smoothed rate (0.25 without any). Several labels for one id: the largest counts; null labels don't. Repeated
documents are scored each by itself. An empty table gives no rows. Extra columns are ignored, or kept as they are where
a function keeps columns; the names that it adds must then be free (accepted() needs none).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare
from . import textvec as tv
from .columns import fresh, whole_text
from .fingerprint import slices

PREFIX, DRIFT, PREFIXES = 5, 1.0, 1 << 17
LEARN, CALIBRATE = 60_000, 20_000
SIGNIFICANT = 0.01


def fold(doc_id: int | None, modulus: int = 5) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def _count(batches):
    """doc_id, text, toxic -> counts of documents by word hash (kind 0, with the word's prefix bucket) and by prefix
    bucket (kind 1), by label."""
    for b in batches:
        label = np.array(b.column(2).to_pylist(), np.int64)
        for lo, hi in slices(b.column(1)):
            h, offs, _, _, head = tv.words(b.column(1).slice(lo, hi - lo), tv.ALNUM, prefix=PREFIX)
            doc = np.repeat(np.arange(lo, hi), np.diff(offs))
            bucket = (head % tv.U(PREFIXES)).astype(np.int64)
            for kind, key in ((0, h.view(np.int64)), (1, bucket)):
                order = np.lexsort((key, doc))
                new = np.ones(len(order), bool)
                new[1:] = (key[order[1:]] != key[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                own = order[new]
                values, first, at = np.unique(key[own], return_index=True, return_inverse=True)
                t = np.bincount(at, label[doc[own]], len(values)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(values), kind, np.int32)), "key": pa.array(values), "bucket": pa.array(bucket[own[first]].astype(np.int32)), "toxic": pa.array(t), "plain": pa.array(np.bincount(at, minlength=len(values)) - t)})


class Scores:
    """Log-odds of words (by hash) and of prefix buckets."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, prefixes: np.ndarray, toxic: int, plain: int):
        a, b = max(toxic, 1), max(plain, 1)
        rate = np.array([a, b]) / (a + b)
        near = prefixes + 2 * rate
        self.known = toxic > 0 and plain > 0
        self.prefix = (np.log(prefixes[:, 0] + 2 * rate[0]) - np.log(a) - np.log(prefixes[:, 1] + 2 * rate[1]) + np.log(b)).astype(np.float32)
        order = np.argsort(words["hash"])
        self.words, counts, bucket = words["hash"][order], counts[order], words["bucket"][order]
        prior = 2 * near[bucket] / near[bucket].sum(1, keepdims=True) if len(bucket) else np.zeros((0, 2))
        both = counts + prior
        self.word = (np.log(both[:, 0]) - np.log(a) - np.log(both[:, 1]) + np.log(b)).astype(np.float32)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.words >> tv.U(44)).astype(np.int64)] = True

    def tokens(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(h), -DRIFT)
        out = self.prefix[(head % tv.U(PREFIXES)).astype(np.int64)].astype(np.float64)
        maybe = np.flatnonzero(self.filter[(h >> tv.U(44)).astype(np.int64)])
        if len(maybe) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
            hit = self.words[at] == h[maybe]
            out[maybe[hit]] = self.word[at[hit]]
        return out - DRIFT


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after the last, score) of one sequence, in time linear in its length.

    A segment that may still grow to the left is a candidate with the sums before it and after it; each one points to
    the nearest candidate on its left that begins at a smaller sum, so the search for one to join with never walks over
    a candidate twice.
    """
    total = np.concatenate(([0.0], np.cumsum(score)))
    at = np.flatnonzero(score > 0)
    begin: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    smaller: list[int] = []
    for i, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        first, k = i, len(low) - 1
        while True:
            while k >= 0 and low[k] >= left:
                k = smaller[k]
            if k < 0 or high[k] >= right:
                break
            first, left, to = begin[k], low[k], smaller[k]
            del begin[k:], end[k:], low[k:], high[k:], smaller[k:]
            k = to
        begin.append(first)
        end.append(i + 1)
        low.append(left)
        high.append(right)
        smaller.append(k)
    return [(a, z, r - x) for a, z, x, r in zip(begin, end, low, high)]


class Extremes:
    """Gumbel parameters of the best segments of plain documents, by quantiles of best - log(length) / rate."""

    #: Of the standard Gumbel distribution: median and upper tenth.
    MEDIAN, TENTH = 0.36651292, 2.25036733

    def __init__(self, best: np.ndarray, n: np.ndarray):
        self.rate, self.offset = 1.0, 0.0
        if len(best) >= 10:
            y = np.log(n + 1.0)
            for _ in range(30):
                low, high = np.quantile(best - y / self.rate, [0.5, 0.9])
                self.rate = 0.5 * self.rate + 0.5 * min(20.0, (self.TENTH - self.MEDIAN) / max(float(high - low), 1e-3))
            self.offset = float(np.median(self.rate * best - y)) - self.MEDIAN

    def excess(self, score, n):
        """-log of the number of segments of this score expected in a plain text of this length."""
        return self.rate * score - np.log(n + 1.0) - self.offset


class Calibration:
    """The logistic fit on the best segment's excess and the sum of the significant ones."""

    def __init__(self, extremes: Extremes, excess: np.ndarray, total: np.ndarray, toxic: np.ndarray):
        self.extremes = extremes
        self.weights = np.zeros(3)
        ones = float(toxic.sum())
        rate = (ones + 0.5) / (len(toxic) + 2)
        self.bias = float(np.log(rate / (1 - rate)))
        self.mean, self.scale = np.zeros(3), np.ones(3)
        if 0 < ones < len(toxic):
            x = self.features(excess, total)
            self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
            z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)
            w = np.zeros(4)
            ridge = np.diag([1.0, 1.0, 1.0, 1e-6])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (toxic - p) - ridge @ w)
                w += step
                if np.abs(step).max() < 1e-8:
                    break
            self.weights, self.bias = w[:3], float(w[3])

    @staticmethod
    def features(excess, total) -> np.ndarray:
        e = np.clip(excess, -10, 30)
        return np.stack([e, np.maximum(e - 3, 0), np.log1p(total)], 1)

    def probability(self, excess, total) -> np.ndarray:
        x = (self.features(excess, total) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _found(scores: Scores, col: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """Of each text: its segments, the best score, the number of tokens."""
    h, offs, _, _, head = tv.words(col, tv.ALNUM, prefix=PREFIX)
    t = scores.tokens(h, head)
    found = [segments(t[offs[k] : offs[k + 1]]) for k in range(len(col))]
    return found, np.array([max((x[2] for x in f), default=0.0) for f in found]), np.diff(offs).astype(float)


def _sums(extremes: Extremes, found: list, n: np.ndarray) -> np.ndarray:
    """Of each text: the sum of its significant segments' excess."""
    out = np.zeros(len(found))
    for k, f in enumerate(found):
        if f:
            out[k] = np.maximum(extremes.excess(np.array([x[2] for x in f]), n[k]), 0).sum()
    return out


PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _samples(labels: DataFrame, modulus: int) -> DataFrame:
    """doc_id, toxic, fold of the labelled training rows, LEARN + CALIBRATE at most."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    number = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(modulus))
    rows = materialize(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("part", number).where("part != 0"))
    out = []
    for calibrate, most in ((False, LEARN), (True, CALIBRATE)):
        own = rows.where((F.col("part") == modulus - 1) == F.lit(calibrate))
        share = min(1.0, 0.95 * most / max(1, own.count()))
        out.append(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most).withColumn("calibrate", F.lit(calibrate)))
    return out[0].unionAll(out[1]).drop("part")


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> tuple[Scores, Calibration]:
    """From labelled rows whose crc32(doc_id as text) mod modulus isn't 0."""
    spark = prepare(docs.sparkSession)
    sample = materialize(_samples(labels, modulus).coalesce(1))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic", "calibrate"))
    base = rows.where("not calibrate")
    toxic, plain = (int(x or 0) for x in base.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    counts = base.select("doc_id", "text", "toxic").mapInArrow(_count, "kind int, key long, bucket int, toxic long, plain long").groupBy("kind", "key").agg(F.min("bucket").alias("bucket"), F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    counts = materialize(counts)
    prefixes = np.zeros((PREFIXES, 2))
    found = counts.where("kind = 1").select("key", "toxic", "plain").toArrow()  # PREFIXES rows at most
    prefixes[found["key"].to_numpy()] = np.stack([found["toxic"].to_numpy(), found["plain"].to_numpy()], 1)
    parts = [counts.where((F.col("kind") == 0) & (F.pmod("key", F.lit(4)) == k)).select("key", "bucket", F.col("toxic").cast("int"), F.col("plain").cast("int")).toArrow() for k in range(4)]  # so that the JVM never holds all
    key, bucket, t, p = (np.concatenate([x.column(c).to_numpy() for x in parts]) for c in range(4))
    del parts
    scores = Scores({"hash": key.view(tv.U), "bucket": bucket}, np.stack([t, p], 1), prefixes, toxic, plain)
    del key, bucket, t, p
    shared = spark.sparkContext.broadcast(scores)
    probe = rows.where("calibrate").select("text", "toxic")  # CALIBRATE rows at most

    def measure(extremes):
        def run(batches):
            for b in batches:
                for lo, hi in slices(b.column(0)):
                    found, best, n = _found(shared.value, b.column(0).slice(lo, hi - lo))
                    total = _sums(extremes, found, n) if extremes else np.zeros(hi - lo)
                    yield pa.RecordBatch.from_pydict({"best": pa.array(best), "n": pa.array(n), "total": pa.array(total), "toxic": b.column(1).slice(lo, hi - lo)})

        seen = probe.mapInArrow(run, "best double, n double, total double, toxic int").toPandas().sort_values(["best", "n", "total", "toxic"])
        return [seen[c].to_numpy(float) for c in ("best", "n", "total", "toxic")]

    best, n, _, toxic = measure(None)
    extremes = Extremes(best[toxic == 0], n[toxic == 0])
    best, n, total, toxic = measure(extremes)
    shared.unpersist()
    return scores, Calibration(extremes, extremes.excess(best, n), total, toxic)


def scored(docs: DataFrame, model: tuple[Scores, Calibration], keep: list[str] | None = None, names: tuple[str, str, str] = ("score", "predicted", "passages")) -> DataFrame:
    """The columns keep (all) of docs with three new ones, by default score, predicted and passages: first and
    last-plus-one words (from 0) and scores of the segments of which less than SIGNIFICANT are expected in a plain text
    of the length."""
    spark = prepare(docs.sparkSession)
    keep = list(docs.columns if keep is None else keep)
    if {c.lower() for c in keep} & {c.lower() for c in names}:
        raise ValueError(f"columns named {names} are in the table: give other names")
    shared = spark.sparkContext.broadcast(model)
    text, rows = whole_text(docs, keep)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    score, predicted, spans = names

    def run(batches):
        scores, calibration = shared.value
        e = calibration.extremes
        least = -np.log(SIGNIFICANT)
        for b in batches:
            col = b.column(b.schema.names.index(text))
            for lo, hi in slices(col):
                found, best, n = _found(scores, col.slice(lo, hi - lo))
                excess = e.excess(best, n)
                p = calibration.probability(excess, _sums(e, found, n))
                passages = [[{"start": s, "end": z, "score": x} for s, z, x in f if e.excess(x, m) > least] if f and top > least else [] for f, m, top in zip(found, n, excess)]
                part = {c: b.column(b.schema.names.index(c)).slice(lo, hi - lo) for c in keep}
                yield pa.RecordBatch.from_pydict(part | {score: pa.array(p), predicted: pa.array((p >= 0.5).astype(np.int32)), spans: pa.array(passages, PASSAGES)})

    return rows.mapInArrow(run, f"{kept}`{score}` double, `{predicted}` int, `{spans}` array<struct<start:int,end:int,score:double>>")


def accepted(docs: DataFrame, model: tuple[Scores, Calibration]) -> DataFrame:
    """The rows of docs, with all their columns as they are, that the model doesn't reject."""
    names = tuple(fresh(c, docs.columns) for c in ("score", "predicted", "passages"))
    return scored(docs, model, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs, learn(docs, labels), ["doc_id"])
    number = F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "UTF-8")), F.lit(5))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (number == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))

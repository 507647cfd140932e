"""Scoring of texts with a Brown class-based bigram model.

Learning covers every training text. Words are counted over the corpus; items are all words that hold at least one in
ITEMS of the training tokens, so there are ITEMS at most, however large the corpus is. The exchange algorithm assigns items to classes, by all item
bigrams of the corpus (kept sparse), so that the likelihood of the class bigrams grows with every move, until no move
is left. Each rarer training word then gets the class that its own neighbours in all its places make likeliest. Words
that training never has get the class of most once-seen words with their ending. Class transitions are counted over
all training tokens, with the classes of all words. A text's probability is the product over its tokens of
P(class | class before) * P(word | class), the first smoothed towards the class's frequency, the last discounted for
words that aren't items, so that a class's unseen words share what these give up. For each history these sum to one over
the training words and one unknown word of each class.

Items and common words (one in COMMON tokens at least) are broadcast; other tokens meet their counts and classes in a
join, in which no key can hold more than one in COMMON of all rows. The driver holds the distinct bigrams of items, whose
number is bounded with the number of items; counts of words, their neighbours and classes stay in the cluster.

Defined results: a null or empty text has one token, its end. Repeated rows count each time, and are scored each by
itself. A null doc_id counts as the text "". Without training tokens every probability is as smoothing leaves it.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare
from .fingerprint import slices
from .textvec import FOLD_BYTES

ITEMS, SIGNATURES, COMMON, CLASSES = 10_000, 512, 200_000, 48
FLUSH = 400_000
PAIRS = 4_000_000
#: No word has this byte.
END = b"\n"


def held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def signature(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SIGNATURES


def _texts(batch: pa.RecordBatch, lo: int, hi: int) -> list[bytes]:
    return [(t or b"").translate(FOLD_BYTES) for t in batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()]


def _count(split):
    def run(batches):
        every: dict[bytes, int] = {}
        train: dict[bytes, int] = {}

        def rows():
            words = list(every)
            out = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "sig": pa.array([signature(w) for w in words], pa.int32()), "n_all": pa.array(every.values(), pa.int64()), "n_train": pa.array([train.get(w, 0) for w in words], pa.int64())})
            every.clear()
            train.clear()
            return out

        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi in slices(b.column(1)):
                for k, t in enumerate(_texts(b, lo, hi), lo):
                    words = t.split()
                    words.append(END)
                    for into in (every,) if held_out(ids[k], *split) else (every, train):
                        get = into.get
                        for w in words:
                            into[w] = get(w, 0) + 1
                if len(every) >= FLUSH:
                    yield rows()
        if every:
            yield rows()

    return run


class Known:
    """What workers look up: items first, then other common words."""

    def __init__(self, words: list[bytes], n_items: int):
        self.index = {w: k for k, w in enumerate(words)}
        self.n_items, self.end = n_items, self.index.get(END, -1)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Index of each token's word (-1: not known), each text's end, all tokens."""
        words: list[bytes] = []
        ends = []
        for t in texts:
            words += t.split()
            words.append(END)
            ends.append(len(words))
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words)), np.asarray(ends), words


def _training(batches, split):
    for b in batches:
        ids = b.column(0).to_pylist()
        for lo, hi in slices(b.column(1)):
            texts = [t for t, d in zip(_texts(b, lo, hi), ids[lo:hi]) if not held_out(d, *split)]
            if texts:
                yield texts


def _pairs(known, split):
    """All bigrams of two items."""

    def run(batches):
        k = known.value
        held: list[np.ndarray] = []

        def rows():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for a in range(0, len(codes), 200_000):
                part = codes[a : a + 200_000]
                yield pa.RecordBatch.from_pydict({"code": pa.array(part), "n": pa.array(n[a : a + 200_000].astype(np.int64))})

        for texts in _training(batches, split):
            at, _, _ = k.read(texts)
            before = np.concatenate(([k.end], at[:-1]))
            both = (at >= 0) & (at < k.n_items) & (before >= 0) & (before < k.n_items)
            held.append(before[both] * k.n_items + at[both])
            if sum(map(len, held)) >= PAIRS:
                yield from rows()
        if held:
            yield from rows()

    return run


def _places(model, split):
    """Each training token that is no item, with the classes around it: before * 64 + after, 63 where not an item."""

    def run(batches):
        known, label = model.value
        for texts in _training(batches, split):
            at, _, words = known.read(texts)
            c = np.where((at >= 0) & (at < known.n_items), np.append(label, 63)[np.where((at >= 0) & (at < known.n_items), at, -1)], 63)
            rare = np.flatnonzero(c == 63)
            code = np.concatenate(([0], c[:-1])) * 64 + np.append(c[1:], 0)
            for a in range(0, len(rare), 200_000):
                part = rare[a : a + 200_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array([words[k] for k in part.tolist()], pa.binary()), "code": pa.array(code[part].astype(np.int16))})

    return run


def likeliest(transition: np.ndarray) -> np.ndarray:
    """By places (before * 64 + after, 63: not known), log probability of each class there; class 0 is the end's."""
    k = len(transition)
    out = np.zeros((64, 64, k))
    out[:k] += transition[:, None, :]
    out[:, :k] += transition.T[None, :, :]
    out[..., 0] = -np.inf
    return out.reshape(64 * 64, k)


def _classes(table):
    def run(batches):
        t = table.value
        for b in batches:
            codes = b.column(1)
            n = np.diff(codes.offsets.to_numpy())
            flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(n), 2000):
                m = n[a : a + 2000]
                first = n[:a].sum()
                part = t[flat[first : first + m.sum()]]
                best = np.add.reduceat(part, np.concatenate(([0], np.cumsum(m)[:-1]))).argmax(1)
                yield pa.RecordBatch.from_pydict({"word": b.column(0).slice(a, len(m)), "class": pa.array(best.astype(np.int32)), "n_train": pa.array(m.astype(np.int64))})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def class_pairs(label: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, k: int, step: int = 1_000_000) -> np.ndarray:
    """Class bigrams of item bigrams, a part at a time to save memory."""
    out = np.zeros(k * k)
    for a in range(0, len(i), step):
        out += np.bincount(label[i[a : a + step]] * k + label[j[a : a + step]], n[a : a + step], k * k)
    return out.reshape(k, k)


def exchange(pairs, fixed: int, classes: int = CLASSES, rounds: int | None = None) -> np.ndarray:
    """Classes from 1 on of all items; the item fixed is alone in class 0.

    pairs[i, j]: how often j follows i, as a table or as (number of items, i, j, times). Items move, the most frequent
    first, each to the class that gains most, until a round moves none (or for so many rounds at most).
    """
    if isinstance(pairs, tuple):
        n, i_, j_, x_ = pairs
    else:
        n, (i_, j_) = len(pairs), np.nonzero(pairs)
        x_ = pairs[i_, j_]
    k = classes + 1

    def grouped(by, to):
        o = np.argsort(by, kind="stable")
        return np.concatenate(([0], np.cumsum(np.bincount(by, minlength=n)))), to[o], x_[o]

    (after_at, after, after_n), (before_at, before, before_n) = grouped(i_, j_), grouped(j_, i_)
    same = i_ == j_
    count, own_n = np.bincount(j_, x_, n), np.bincount(i_[same], x_[same], n)
    order = [i for i in np.argsort(-count, kind="stable") if i != fixed and count[i]]
    label = np.ones(n, np.int64)
    if fixed >= 0:
        label[fixed] = 0
    for r, i in enumerate(order):
        label[i] = 1 + r % classes
    b = class_pairs(label, i_, j_, x_, k)
    # Of each item: what follows and what stands before, by class.
    right, left = np.zeros((n, k)), np.zeros((n, k))
    for i in range(n):
        s = slice(after_at[i], after_at[i + 1])
        right[i] = np.bincount(label[after[s]], after_n[s], k)
        s = slice(before_at[i], before_at[i + 1])
        left[i] = np.bincount(label[before[s]], before_n[s], k)
    done = 0
    while rounds is None or done < rounds:
        moved, done = 0, done + 1
        for i in order:
            a, own = label[i], own_n[i]
            r, le = right[i].copy(), left[i].copy()
            r[a] -= own
            le[a] -= own
            b[a] -= r
            b[:, a] -= le
            b[a, a] -= own
            rows, cols = b.sum(1) + le, b.sum(0) + r  # as they are in any class
            p, q = np.flatnonzero(r), np.flatnonzero(le)
            bp, bq = b[:, p], b[q]
            gain = (_xlogx(bp + r[p]) - _xlogx(bp)).sum(1) + (_xlogx(bq + le[q, None]) - _xlogx(bq)).sum(0)
            diag = np.diagonal(b)
            gain += _xlogx(diag + r + le + own) + _xlogx(diag) - _xlogx(diag + r) - _xlogx(diag + le)
            gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(cols + le.sum() + own) - _xlogx(cols)
            gain[0] = -np.inf
            to = int(np.argmax(gain))
            if gain[to] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):  # beyond rounding, so that no item moves to and fro
                to = int(a)
            b[to] += r
            b[:, to] += le
            b[to, to] += own
            if to != a:
                moved += 1
                label[i] = to
                s = slice(before_at[i], before_at[i + 1])
                right[before[s], a] -= before_n[s]
                right[before[s], to] += before_n[s]
                s = slice(after_at[i], after_at[i + 1])
                left[after[s], a] -= after_n[s]
                left[after[s], to] += after_n[s]
        if not moved:
            break
    return label


def smoothed(b: np.ndarray) -> np.ndarray:
    """P(class | class before) from counts of class bigrams."""
    own = (b.sum(0) + 1) / (b.sum() + len(b))
    return (b + len(b) * own) / (b.sum(1, keepdims=True) + len(b))


def transitions(pairs: np.ndarray, label: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | class before), and log10 P(item | class)."""
    k = classes + 1
    one = np.zeros((len(pairs), k))
    one[np.arange(len(pairs)), label] = 1
    b = one.T @ pairs @ one
    count = pairs.sum(0)
    item = (count + 1) / (np.bincount(label, count, k) + np.bincount(label, minlength=k))[label]
    return np.log10(smoothed(b)), np.log10(item)


def emissions(n_train: np.ndarray, label: np.ndarray, item: np.ndarray, total: np.ndarray, discount: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 P(word | class): items whole, others (0: the unknown word) less the discount that the unknown word has.

    total: training tokens by class; discount and kinds: of its words that aren't items.
    """
    n = np.asarray(n_train, np.float64)
    rest = discount * kinds + (np.arange(len(total)) > 0)
    whole = np.where(np.arange(len(total)) > 0, total + 1, np.maximum(total, 1))
    mass = np.where(item, np.maximum(n, 1), np.where(n > 0, n - discount[label], rest[label]))
    return np.log10(mass / whole[label])


def _read(model, split):
    """Each text's classes (63: not known yet) and the sums of what is known; its other words and their places."""

    def run(batches):
        m = model.value
        known = m["known"]
        serial = TaskContext.get().partitionId() << 40
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi in slices(b.column(1)):
                at, ends, words = known.read(_texts(b, lo, hi))
                n = hi - lo
                size = np.diff(ends, prepend=0)
                text = np.repeat(np.arange(n), size)
                rare = np.flatnonzero(at < 0)
                per = np.bincount(text[rare], minlength=n)
                starts = pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {
                        "serial": pa.array(serial + np.arange(n)), "doc_id": b.column(0).slice(lo, n), "held_out": pa.array([held_out(d, *split) for d in ids[lo:hi]]),
                        "n_known": pa.array(np.bincount(text, m["seen"][at], n).astype(np.int64)),
                        "base_score": pa.array(np.bincount(text, m["base"][at], n)), "score": pa.array(np.bincount(text, m["word"][at], n)),
                        "classes": pa.array([x.tobytes() for x in np.split(m["class"][at].astype(np.uint8), ends[:-1])], pa.binary()),
                        "words": pa.ListArray.from_arrays(starts, pa.array([words[k] for k in rare.tolist()], pa.binary())),
                    }
                )
                serial += n

    return run


def _fill(batches):
    """Puts the classes of other words (place among them * 64 + class) where they belong."""
    for b in batches:
        names = b.schema.names
        out = []
        for c, found in zip(b.column(names.index("classes")).to_pylist(), b.column(names.index("found"))):
            c = np.frombuffer(c, np.uint8).copy()
            if found.is_valid:
                c[c == 63] = np.sort(found.values.to_numpy()) % 64
            out.append(c.tobytes())
        keep = {x: b.column(x) for x in names if x not in ("classes", "found")}
        yield pa.RecordBatch.from_pydict(keep | {"classes": pa.array(out, pa.binary())})


def _codes(classes: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams of texts, the class before the first an end's, and the texts' lengths."""
    size = np.fromiter(map(len, classes), np.int64, len(classes))
    c = np.frombuffer(b"".join(classes), np.uint8).astype(np.int64)
    return np.concatenate(([0], c[:-1])) * k + c, size  # all texts end with class 0


def _class_pairs(k):
    def run(batches):
        table = np.zeros(k * k, np.int64)
        for b in batches:
            table += np.bincount(_codes(b.column(0).to_pylist(), k)[0], minlength=k * k)
        yield pa.RecordBatch.from_pydict({"code": pa.array(np.arange(k * k)), "n": pa.array(table)})

    return run


def _score(transition):
    def run(batches):
        t = transition.value
        for b in batches:
            code, size = _codes(b.column(5).to_pylist(), len(t))
            score = np.bincount(np.repeat(np.arange(len(size)), size), t.ravel()[code], len(size)) + b.column(4).to_numpy()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(1), "n_tokens": pa.array(size), "n_known": b.column(2), "base_score": b.column(3), "score": pa.array(score)})

    return run


def train_and_score(docs: DataFrame, modulus: int = 7, remainder: int = 2, least: int | None = None) -> DataFrame:
    """Learn from the documents whose crc32(doc_id as text) mod modulus isn't remainder; score all. least: training uses
    that make a word an item, by default one in ITEMS of the training tokens."""
    spark = prepare(docs.sparkSession)
    split, k = (modulus, remainder), CLASSES + 1
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_count(split), "word binary, sig int, n_all long, n_train long")
    counts = materialize(counted.groupBy("word", "sig").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train")))
    n_all, n, v = (x or 0 for x in counts.agg(F.sum("n_all"), F.sum("n_train"), F.sum((F.col("n_train") > 0).cast("long"))).first())
    least = max(1, -(-n // ITEMS)) if least is None else least
    is_item = (F.col("n_train") >= least) | (F.col("word") == F.lit(END))
    listed = counts.where(is_item | (F.col("n_all") * COMMON >= n_all)).select("word", "sig", "n_train", is_item.alias("item")).toPandas()
    listed["word"] = listed["word"].map(bytes)
    listed = listed.sort_values(["item", "word"], ascending=[False, True], ignore_index=True)
    item, n_items = listed["item"].to_numpy(bool), int(listed["item"].sum())
    known = Known(listed["word"].tolist(), n_items)

    found = materialize(rows.mapInArrow(_pairs(share(known), split), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    size = max(n_items, 1)
    # In parts, so that the JVM never holds all.
    parts = [found.where(F.pmod("code", F.lit(8)) == x).select((F.col("code") / size).cast("int").alias("i"), (F.col("code") % size).cast("int").alias("j"), F.col("n").cast("int")).toArrow() for x in range(8)]
    i_, j_, x_ = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in range(3))
    del parts
    label = exchange((n_items, i_, j_, x_), known.end)
    first = class_pairs(label, i_, j_, x_, k)
    del i_, j_, x_

    places = rows.mapInArrow(_places(share((known, label)), split), "word binary, code short")
    # Of words that training has less than `least` times each.
    own = materialize(places.groupBy("word").agg(F.collect_list("code").alias("codes")).mapInArrow(_classes(share(likeliest(np.log(smoothed(first))))), "word binary, class int, n_train long"))
    once, twice = (F.sum((F.col("n_train") == x).cast("long")) for x in (1, 2))
    total, kinds, discount = np.bincount(label, listed["n_train"].to_numpy()[:n_items], k), np.zeros(k), np.full(k, 0.5)
    for c, t, w, n1, n2 in own.groupBy("class").agg(F.sum("n_train"), F.count(F.lit(1)), once, twice).collect():
        total[c] += t
        kinds[c], discount[c] = w, min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.05))
    # A short word's ending is the word.
    ending = F.pmod(F.crc32(F.when(F.length("word") > 3, F.expr("substring(word, -3, 3)")).otherwise(F.col("word"))), F.lit(SIGNATURES)).cast("int")
    new = np.zeros((SIGNATURES, k))
    for s, c, w in own.where("n_train = 1").groupBy(ending, "class").count().collect():
        new[s, c] = w
    new += new.sum(0) / (new.sum() + 1)  # decides where an ending has none
    new[:, 0] = -1
    unseen = new.argmax(1)

    common = spark.createDataFrame([(bytearray(w),) for w in listed["word"][n_items:]], "word binary")
    of = {bytes(w): c for w, c in own.join(F.broadcast(common), "word").select("word", "class").toPandas().itertuples(index=False)}
    label = np.concatenate((label, [of.get(w, unseen[s]) for w, s in zip(listed["word"][n_items:], listed["sig"][n_items:])])).astype(np.int64)
    c = listed["n_train"].to_numpy(np.float64)
    lookups = {"class": np.append(label, 63), "seen": np.append(c > 0, 0.0), "word": np.append(emissions(c, label, item, total, discount, kinds), 0.0), "base": np.append(np.log10((c + 1) / (n + v + 1)), 0.0)}
    schema = "serial long, doc_id long, held_out boolean, n_known long, base_score double, score double, classes binary, words array<binary>"
    read = materialize(rows.mapInArrow(_read(share({"known": known} | lookups), split), schema))
    tokens = read.select("serial", F.posexplode("words").alias("place", "word"))
    # Of rare words only: the common ones never meet this join.
    rare = own.join(F.broadcast(common), "word", "left_anti")
    met = tokens.join(rare, "word", "left").withColumn("class", F.coalesce("class", F.element_at(F.array(*[F.lit(int(x)) for x in unseen]), ending + 1))).withColumn("n_train", F.coalesce("n_train", F.lit(0)))
    less = F.array(*[F.lit(float(x)) for x in discount])
    rest = F.array(*[F.lit(float(x)) for x in discount * kinds + 1])
    whole = F.array(*[F.lit(float(x)) for x in total + 1])
    at = F.col("class") + 1
    within = F.log10(F.when(F.col("n_train") > 0, F.col("n_train") - F.element_at(less, at)).otherwise(F.element_at(rest, at)) / F.element_at(whole, at))
    sums = met.groupBy("serial").agg(F.collect_list(F.col("place").cast("long") * 64 + F.col("class")).alias("found"), F.sum((F.col("n_train") > 0).cast("long")).alias("r_seen"), F.sum(F.log10((F.col("n_train") + 1) / F.lit(float(n + v + 1)))).alias("r_base"), F.sum(within).alias("r_within"))
    joined = read.drop("words").join(sums, "serial", "left").select(
        "doc_id", "held_out", (F.col("n_known") + F.coalesce("r_seen", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("r_within", F.lit(0.0))).alias("score"), "classes", "found",
    )
    filled = materialize(joined.mapInArrow(_fill, "doc_id long, held_out boolean, n_known long, base_score double, score double, classes binary"))
    pairs = np.zeros(k * k)
    for c, x in filled.where("not held_out").select("classes").mapInArrow(_class_pairs(k), "code long, n long").groupBy("code").agg(F.sum("n")).collect():
        pairs[c] = x
    transition = share(np.log10(smoothed(pairs.reshape(k, k))))
    scored = filled.mapInArrow(_score(transition), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

"""Near copies against brute force, and the sketch's own promises."""

import random

import numpy as np

from bitextile.llm import neardup


def brute(rows, shingle, percent=80):
    sets = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[d] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d), find(d) == d) for d in ids}


def rows():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghik") for _ in range(3))
    out = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two"), (5, "  ")]
    for group in range(6):
        base = [word() for _ in range(60)]
        for _ in range(40):
            copy = list(base)
            for _ in range(r.randrange(9)):
                copy[r.randrange(60)] = word()
            if r.random() < 0.3:
                base = copy  # copies of copies
            out.append((len(out), " ".join(copy)))
    return out + [(len(out), out[10][1]), (len(out) + 1, out[10][1].upper())]


def test_components(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = {tuple(x) for x in neardup.digests(docs).collect()}
    assert found == brute(data, 2)


def test_empty(spark):
    assert neardup.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.Generator(np.random.PCG64(1))
    x, y = (r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (3000, 2500))
    x = np.concatenate([x, y[:1500]])
    a, b = neardup.registers(x), neardup.registers(y)
    assert (neardup.registers(np.concatenate([x, y])) == neardup.merged(a, b)).all()
    j = neardup.estimate(a[None], b[None], np.array([4500.0]), np.array([2500.0]))[0]
    assert abs(j - 1500 / 5500) < 0.15

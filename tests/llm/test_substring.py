"""Repeated passages against brute force, with all bounds small too."""

import hashlib

import pytest

from bitextile.llm import substring


def brute(rows):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        if d is not None:
            for k in range(len(w) - 49):
                g = tuple(w[k : k + 50])
                first[g] = min(first.get(g, d), d)
    out = set()
    for d, w in texts:
        gone = set()
        for k in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[k : k + 50])] < d:
                gone.update(range(k, k + 50))
        out.add((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def rows():
    import random

    r = random.Random(4)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + r.choice("12345")
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(70), text(300)
    out = [(0, None), (1, ""), (2, "one"), (3, base), (4, base), (5, base + " end"), (None, base), (6, text(49)), (7, text(30) + " " + passage + "\n" + text(60))]
    for k in range(8, 40):
        words = base.split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = word()
        out.append((k, " ".join(words) if k % 2 else text(r.randrange(80)) + "  " + passage + " " + text(r.randrange(80))))
    out += [(40, "same " * 200), (41, "same " * 120), (42, base), (42, base)]
    return out


@pytest.mark.parametrize("bounds", [(4_000_000, 200_000), (100, 200_000), (4_000_000, 60)])
def test_repeats(spark, monkeypatch, bounds):
    monkeypatch.setattr(substring, "SHARD", bounds[0])
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    shard = substring.HELD
    try:
        substring.HELD = bounds[1]
        found = {tuple(x) for x in substring.digests(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    finally:
        substring.HELD = shard
    assert found == brute(data)


def test_empty_table(spark):
    assert substring.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton():
    a = substring.SuffixAutomaton()
    a.add([1, 2, 3, 1, 2, 4])
    a.add([3, 1, 2, 5])
    assert a.matches([9, 1, 2, 5, 1, 2, 3, 1, 2, 4, 4], 3) == [3, 6, 7, 8, 9]

"""Collocations, fill-in-middle and exact duplicates against plain versions, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from bitextile.llm import collocations, exactdedup, infill

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ODD = [(None, "a b", None), (1, None, "en"), (2, "", "en"), (3, "A a\x0bB", "de"), (3, "A a\x0bB", "de"), (4, LONG, "en"), (5, "x", None), (6, "Aa B", "fr"), (None, "ab", "fr"), (7, "tail\n\n", "x\ny")]
CLASHING = ["n", "k", "digest", "taken", "key", "salt", "seeded", "whole", "range", "part"]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_phrases(rows, least, depth, top, share=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(depth, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if a >= least and len(p) >= 2}
        gone = {q[i : i + j] for q, a in some.items() for j in range(2, len(q)) for i in range(len(q) - j + 1) if 100 * a >= share * some[q[i : i + j]]}
        best = []
        for p, a in some.items():
            if p not in gone:
                score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), cut, counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s, cut) for r, (s, a, p, cut, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def made(seed, texts=120):
    rng = random.Random(seed)
    words = ["the", "of", "a", "Zug", "zug", "é", "new", "york", "city", "10", "x-y", "ßt"] + [f"r{k}" for k in range(60)]
    weights = [30, 20, 12, 4, 6, 5, 8, 8, 6, 3, 2, 2] + [1] * 60
    rows = []
    for k in range(texts):
        w = rng.choices(words, weights, k=rng.randrange(60))
        if k % 3 == 0:
            w += ["in", "New", "York", "city"] * rng.randrange(4)
        rows.append((k, "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for x in w), rng.choice(["en", "en", None, "de"])))
    return rows + [(texts + k, "of the of the of the of the. A a a a a a a", "en") for k in range(40)]


@pytest.mark.parametrize("ranges,least,depth,share,top", [(1, 3, 5, 100, 2000), (40, 3, 5, 100, 2000), (300, 2, 3, 60, 25), (7, 5, 2, 100, None)])
def test_phrases_equal_plain_counts(spark, monkeypatch, ranges, least, depth, share, top):
    monkeypatch.setattr(collocations, "LEAST_SLOTS", 6)  # many words share a slot
    rows = made(ranges)
    got = collocations.collocations(frame(spark, rows).repartition(5), least, depth, top, share, ranges).collect()
    want = plain_phrases(rows, least, depth, top, share)
    assert sorted(tuple(x) for x in got) == want and len(want) > 20


def test_ranges_split_a_common_word(spark):
    bounds = [(b"en\nof",), (b"en\nof", b"en\nthe"), (b"en\nof", b"en\nthe", b"en\nof"), (b"en\nthe",)]
    words = collocations.Words(*(__import__("pyarrow").array(x) for x in (["of the of the. of a b of the of"], ["en"])))
    vocab, cols, counts = collocations.runs(words, *collocations._reach(words, []), 4, bounds)
    back = collocations.unpack(*collocations.pack(vocab, cols, counts), 4)
    used = collocations.pack(vocab, cols, counts)[0]
    assert [[used[x - 1] if x else b"" for x in c.tolist()] for c in back[0]] == [[vocab[x - 1] if x else b"" for x in c.tolist()] for c in cols] and back[1].tolist() == counts.tolist()
    number = {w: k + 1 for k, w in enumerate(vocab)}
    cuts = [0, *(collocations.span(cols, [number[w] for w in b])[0] for b in bounds), len(counts)]
    assert cuts == sorted(cuts)
    total, edges = Counter(), 0
    for r, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        if x < y:
            prefixes = {b[:k] for b in bounds[max(r - 1, 0) : r + 1] for k in range(1, len(b))}
            for _, phrase, _, a, edge, lefts in collocations.walk(vocab, [c[x:y] for c in cols], counts[x:y], 1, prefixes):
                total[phrase] += a
                edges += edge
                assert edge or len(lefts) == phrase.count(" ")
    assert edges and total == Counter({" ".join(p): a for p, a in Counter(tuple(w[i : i + k]) for w in (["of", "the", "of", "the"], ["of", "a", "b", "of", "the", "of"]) for i in range(len(w)) for k in range(1, min(4, len(w) - i) + 1)).items()})


def test_phrases_of_odd_rows(spark):
    for rows in (ODD, ODD[1:3], []):
        assert sorted(tuple(x) for x in collocations.collocations(frame(spark, rows), 2, 3).collect()) == plain_phrases(rows, 2, 3, 2000)


def test_words_of_equal_hashes_stay_apart(spark):
    """Thue-Morse words of 2,048 letters and their inverses have equal polynomial hashes modulo 2^64."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    words = collocations.Words(*(__import__("pyarrow").array(x) for x in ([f"{a} {b} x"], ["en"])))
    assert words.hash[0] == words.hash[1] and words.same(np.array([0, 0, 2]), np.array([0, 1, 2])).tolist() == [True, False, True]
    rows = [(k, f"{a} q {b} z {a} {b} {b}" if k % 2 else f"{b} q {a.upper()} z", "en") for k in range(12)]
    want = plain_phrases(rows, 5, 3, 2000)
    assert sorted(tuple(x) for x in collocations.collocations(frame(spark, rows).repartition(3), 5, 3).collect()) == want and want


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    x = spark.range(1).select(F.expr("cast((cast(9000000000001 as decimal(19,0)) * cast(16000000000003 as decimal(19,0)) * 1000) div (cast(9000000000007 as decimal(19,0)) * cast(9000000000009 as decimal(19,0))) as long) as s")).first()[0]
    assert x == 9000000000001 * 16000000000003 * 1000 // (9000000000007 * 9000000000009)


def test_elias_fano_selects_every_value():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 10**9), (5, 5), (100, 100), (1000, 10**7), (777, 3000)):
        values = np.sort(rng.choice(top, n, replace=False) + 1).astype(np.int64)
        found = infill.EliasFano(values, int(values[-1]))
        assert [found.select(k) for k in range(n)] == values.tolist()
    assert infill.EliasFano(infill.line_ends(b""), 0).n == 0


def test_infill_equals_plain_version(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "é", "\n", "\n\n", " ß", "<", "S>", "<P", ">", "\r\n"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [(k, texts[k % 150] if k < 260 else texts[0], "x") for k in range(900)] + ODD + [(9001, "a <M> b\nc", "x"), (None, None, None)]
    for rate, spm in ((100, 50), (40, 90)):
        got = infill.infilled(frame(spark, rows).repartition(6), 7, rate, spm).withColumn("back", infill.restored(infill.F.col("output"), infill.F.col("form"))).collect()
        assert Counter((x["doc_id"], x["text"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"], x["back"]) for x in got) == Counter((d, t, *infill.plain(d, t, 7, rate, spm), t or "") for d, t, _ in rows)
    digests = infill.digests(frame(spark, rows)).collect()
    assert Counter((x["doc_id"], x["output_sha256"]) for x in digests) == Counter((d, hashlib.sha256(infill.plain(d, t)[4].encode()).hexdigest()) for d, t, _ in rows)


def plain_groups(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[re.sub(r"[ \t-\r]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = Counter()
    for s, members in groups.items():
        best = min(members)
        out.update((d, best[3], len(members), (n, none) == best[:2] and d == best[3], hashlib.sha256(s.encode()).hexdigest()) for n, none, _, d in members)
    return out


def test_exact_duplicates_equal_plain_groups(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(8))) for _ in range(400)]
    rows = [(rng.randrange(2000) if k % 17 else None, texts[k] if k < 400 else rng.choice(texts), "x") for k in range(900)] + [(5000 + k, "copy of a page", "x") for k in range(500)]
    for these in (rows, ODD, ODD[:1], []):
        for keys in (16, 1 << 16):
            got = exactdedup.digests(frame(spark, these), keys).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
            assert Counter(map(tuple, got)) == plain_groups(these)


def test_perfect_hash_is_minimal_and_members_are_checked(spark):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), np.uint8).reshape(-1, 32)
    found = exactdedup.PerfectHash.build(keys[:4000])
    assert sorted(found.lookup(keys[:4000]).tolist()) == list(range(4000))
    rows = [(k, f"text {k % 50}", "x") for k in range(100)]
    known = exactdedup.index(exactdedup.grouped(exactdedup.digested(frame(spark, rows))), 8)
    assert known.count() > 3 and known.agg(exactdedup.F.sum("n")).first()[0] == 50
    later = frame(spark, [(k, f"te xt{k % 60}", "x") for k in range(1000, 4000)])
    seen = exactdedup.looked_up(exactdedup.grouped(exactdedup.digested(later)), known).collect()
    assert sum(x["member"] for x in seen) == 50 and len(seen) == 60 and all(x["n"] == 2 and x["keep_id"] < 50 for x in seen if x["member"])
    assert sorted(x["text"] for x in exactdedup.deduplicated(later, known).collect()) == sorted(f"te xt{k}" for k in range(50, 60))


def test_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(d, t, *[f"{c}{k}" for c in CLASHING]) for k, (d, t, _) in enumerate(ODD)], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASHING)]))
    kept = exactdedup.deduplicated(docs)
    assert kept.dtypes == docs.dtypes and sorted(x["n"] for x in kept.collect()) == sorted(f"n{k}" for k in _staying())
    with pytest.raises(ValueError, match="give other names"):
        infill.infilled(docs)
    out = infill.infilled(docs.drop("n"))
    assert out.columns[: len(docs.columns) - 1] == docs.drop("n").columns and out.count() == len(ODD)


def _staying():
    want = plain_groups(ODD)
    stay = {(d, s) for (d, _, _, kept, s) in want if kept}
    out = set()
    for k, (d, t, _) in enumerate(ODD):
        s = re.sub(r"[ \t-\r]", "", t or "")
        best = max(len(u or "") for _, u, _ in ODD if re.sub(r"[ \t-\r]", "", u or "") == s)
        if (d, hashlib.sha256(s.encode()).hexdigest()) in stay and len(t or "") == best:
            out.add(k)
    return out

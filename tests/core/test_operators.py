"""Aligners against brute force, running totals over blocks, planning, rendering, EPUB packages, the entry."""

import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitextile.operators import planning, sequence, timeline
from bitextile.sources import epub


def paths(n, m, spans):
    if not n and not m:
        yield []
    for di, dj in spans:
        if di <= n and dj <= m:
            for rest in paths(n - di, m - dj, spans):
                yield [(di, dj), *rest]


def test_span_links_are_best():
    from bitextile.functions import plain as P

    a, b = ["Ano ne.", "Jde 5 dní!", "Pes."], ["Ano, ne.", "Jde", "5 dní! Pes."]
    found = sequence.span_links(a, b)
    best = -1.0
    for path in paths(3, 3, [(1, 1), (1, 2), (2, 1)]):
        i = j = 0
        total = 0.0
        for di, dj in path:
            total += P.span_total(" ".join(a[i : i + di]), " ".join(b[j : j + dj])) * max(di, dj)
            i, j = i + di, j + dj
        best = max(best, total)
    assert sum(s * max(x1 - x0 + 1, y1 - y0 + 1) for x0, x1, y0, y1, s in found) == pytest.approx(best)
    assert sequence.span_links(["a"], ["a", "b", "c"]) == [] and sequence.span_links([], ["a"]) == []


def test_chapter_path_is_best():
    r = np.random.Generator(np.random.PCG64(2))
    for _ in range(20):
        s = r.random((4, 3))
        found = sequence.chapter_path(s)
        value = sum(s[i - 1, j - 1] for i, j in found) - 0.2 * (7 - 2 * len(found))
        best = -9.0
        for k in range(4):
            for rows in itertools.combinations(range(4), k):
                for cols in itertools.combinations(range(3), k):
                    if all(s[i, j] >= 0.72 for i, j in zip(rows, cols)):
                        best = max(best, sum(s[i, j] for i, j in zip(rows, cols)) - 0.2 * (7 - 2 * k))
        assert value == pytest.approx(best)


def test_greedy_links():
    same = ["Ano.", "Jde domů?", "Má 5 psů!"]
    assert [(i, j) for i, j, _ in sequence.greedy_links(same, same)] == [(1, 1), (2, 2), (3, 3)]
    assert sequence.greedy_links(same, same[:2]) == []
    assert [(i, j) for i, j, _ in sequence.greedy_links(same[:2], ["Xyz", *same[:2]])] == [(1, 2), (2, 3)]


def test_paragraph_blocks():
    side = lambda texts, vectors, counts: sequence.Paragraphs(texts, counts, np.array(vectors, float), [0.0] * len(texts))
    a, b = side(["x" * 10] * 2, [[1, 0], [1, 0]], [1, 1]), side(["y" * 20], [[1, 0]], [2])
    assert [x[:4] for x in sequence.paragraph_blocks(a, b, 2)] == [(1, 2, 1, 1)]
    assert sequence.paragraph_blocks(a, side([], np.zeros((0, 2)), [])) == []


def test_token_links_and_diff():
    links = sequence.token_links("Pes jde domů 5", "Ten pes jde domu")
    assert [(i, j, r) for i, j, r, _ in links] == [(1, 2, "exact"), (2, 3, "exact"), (3, 4, "exact")]
    assert sequence.diff_segments("a b c", "a x c") == [("equal", "a", "a"), ("replace", "b", "x"), ("equal", "c", "c")]


def test_running_totals(spark):
    r = random.Random(3)
    data = [("hot" if r.random() < 0.5 else f"k{r.randrange(5)}", r.randrange(5000)) for _ in range(3000)]
    rows = timeline.timeline(spark.createDataFrame(data, "family string, unit long")).collect()
    for x in rows:
        own = [u for f, u in data if f == x.family]
        assert (x.n, x.total, x.seen_before, x.remaining_after) == (own.count(x.unit), len(own), sum(u < x.unit for u in own), sum(u > x.unit for u in own))
        assert (x.first_unit, x.last_unit) == (min(own), max(own))
    series = spark.range(3000).select(F.col("id").alias("unit"), (F.col("id") * 7 % 11).alias("value"))
    got = {x.unit: x.average for x in timeline.moving_average(series).collect()}
    v = [k * 7 % 11 for k in range(3000)]
    assert all(got[k] == pytest.approx(np.mean(v[max(0, k - 25) : k + 26])) for k in range(0, 3000, 37))
    runs = timeline.islands(spark.createDataFrame([("a", k) for k in (1, 2, 3, 7, 8, 10)], "f string, k long"), ["f"], "k")
    assert sorted(tuple(x)[1:] for x in runs.collect()) == [(1, 3, 3), (7, 8, 2), (10, 10, 1)]


def test_word_links_equal_a_plain_search():
    from bitextile.functions import plain as P

    r = random.Random(8)
    for _ in range(200):
        a, b = (" ".join(r.choice(["abab", "ababab", "domu", "domů", "domem", "kot", "kota", "psa", "pies", ",", "7", "x"]) for _ in range(r.randrange(1, 14))) for _ in range(2))
        words = lambda t, lang: [(k, P.squeezed(w), P.lemma(w, lang)) for k, w, kind in P.tokens(t) if kind == "word"]
        want, first = [], 1
        for k, form, lem in words(a, "pl"):
            scored = []
            for j, other, other_lem in words(b, "cs"):
                score = 1.0 if form == other else 0.92 if lem == other_lem else P.overlap(P.grams(form), P.grams(other), 0.0)
                relation = "exact" if form == other else "lemma_like" if lem == other_lem else "cognate"
                if j >= first and score >= 0.45:
                    scored.append((-round(score, 6), j, relation))
            if scored:
                score, j, relation = min(scored)
                want.append((k, j, relation, -score))
                first = j + 1
        assert sequence.token_links(a, b) == want


def test_render():
    assert planning.render("Pes jde domů.", [(1, 1, "pies"), (1, 2, "pies idzie")]) == "pies idzie domů."
    assert planning.render("Ano ,  ten pes(y)!", [(4, 4, "kot"), (3, 3, "to"), (4, 5, "kot ("), (99, 99, "?")]) == "Ano ,  to kot (y)!"
    with pytest.raises(ValueError):
        planning.Gates(minimum_alignment_confidence=2)


def test_subtrees(spark):
    heads = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 1, 1)], "sentence_id long, token long, head long")
    found = {(x.sentence_id, x.root): x.tokens for x in planning.subtrees(heads).collect()}
    assert found == {(1, 1): [1, 2, 3, 4], (1, 2): [2, 3], (1, 3): [3], (1, 4): [4], (2, 1): [1]}


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "book.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package xmlns:dc="d"><metadata><dc:title>Kniha</dc:title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="t" href="title.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/></manifest><spine><itemref idref="t"/><itemref idref="c"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/a.xhtml", "<html><body><table><p>no</p></table><p>Ano &amp; ne.<br/>Dva. Tři!</p><p> </p><p>Konec</p></body></html>")
        z.writestr("OPS/title.xhtml", "<html/>")
    (tmp_path / "bad.epub").write_bytes(b"x")
    spine = epub.read(spark, str(tmp_path))
    rows = {x.href: x for x in spine.collect()}
    assert rows["a.xhtml"].book_title == "Kniha" and rows["a.xhtml"].language == "und" and rows[None].error
    found = epub.chapters(spine).orderBy("paragraph_index").collect()
    assert [(x.text, x.sentences) for x in found] == [("Ano & ne.", ["Ano & ne."]), ("Dva. Tři!", ["Dva.", "Tři!"]), ("Konec", ["Konec"])]


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "benchmark_report" in e.queries()


def test_hashed_vectors_of_all_paragraphs(spark, tmp_path):
    import hashlib
    import math
    from collections import Counter

    from bitextile.plans import queries

    texts = {1: "Abcd\n\nabab\nxyz", 2: "", 3: "\nlast one"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for d, t in texts.items():
        for p, x in enumerate([x for x in t.split("\n") if x], 1):
            z = x.lower().replace(" ", "")
            n = Counter(int(hashlib.md5(z[i : i + 3].encode()).hexdigest()[:8], 16) % 128 for i in range(len(z) - 2))
            want |= {(d, p, k, round(c / math.sqrt(sum(v * v for v in n.values())), 9)) for k, c in n.items()}
    rows = queries.hashed_vectors(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.paragraph_index, x.bucket, round(x.weight, 9)) for x in rows) == sorted(want)


def test_quality_judges_all_gates(spark):
    from bitextile.operators import reports

    links = [(1, 1, 1, 0.9, "a b c d 5 .", "a b x y"), (1, 1, 2, 0.5, "e f", "e f g h"), (1, 2, 1, 0.1, "q r s", "t"), (2, 1, 1, 0.2, "a", "b")]
    tokens = [(1, 1, 1, 1, 1, 1.0), (1, 1, 1, 2, 2, 1.0), (1, 1, 2, 1, 1, 1.0)]
    a = spark.createDataFrame(links, "pair_id long, source_paragraph int, source_start int, score double, source_text string, target_text string")
    b = spark.createDataFrame(tokens, "pair_id long, source_paragraph int, source_start int, source_token int, target_token int, token_score double")
    (x,) = reports.quality(a, b).collect()
    want = {"pairs": 2, "safe_ratio": 1 / 3, "blocked_ratio": 2 / 3, "source_token_match": 3 / 6 / 2, "target_token_match": 3 / 8 / 2, "phrase_row_rate": 1 / 2 / 2}
    assert {k: x[k] for k in want} == pytest.approx(want)
    assert (x.safe_pass, x.blocked_pass, x.source_token_match_pass, x.target_token_match_pass, x.phrase_row_pass) == (False, False, True, True, True)
    (y,) = reports.quality(a, b.limit(0)).collect()
    assert not (y.source_token_match_pass or y.target_token_match_pass or y.phrase_row_pass)


def test_deep_trees_keep_all_ancestors(spark):
    heads = spark.createDataFrame([(1, k, k - 1) for k in range(1, 121)], "sentence_id long, token long, head long")
    assert {x.root: x.size for x in planning.subtrees(heads).collect()} == {k: 121 - k for k in range(1, 121)}


def test_books_and_spans(spark):
    from bitextile.operators import books, spans

    spine = spark.createDataFrame(
        [
            (1, "Book", 1, "c0_x", "cover", [("h1", "Cover")], ["only one"]), (1, "Book", 2, "c1", "Book", [], ["alone"]), (1, "Book", 3, "c2", "t", [("div", "x"), ("div", "ROZDZIAŁ I"), ("h1", "later")], ["a b", "x", "c d"]),
            (1, "Book", 4, "c3", "", [("div", "plain words")], ["Čeština, Polski", "x y"]), (1, "Book", 5, "c4", " ", [], ["e f", "Tekst jest własnością publiczną."]), (1, "Book", 6, "c5", "t", None, []),
        ],
        "book_id long, book_title string, spine_ordinal int, href string, title string, headings array<struct<tag:string,text:string>>, paragraphs array<string>",
    )
    got = sorted((x.chapter_index, x.title, x.paragraph_index, x.text) for x in books.canonical(spine).collect())
    assert got == [(1, "ROZDZIAŁ I", 1, "a b"), (1, "ROZDZIAŁ I", 2, "c d"), (2, "Chapter 2", 1, "e f")]
    with pytest.raises(Exception, match="FAILFAST|Malformed|without id"):
        books.from_json(spark.createDataFrame([("{no",)], "json string")).collect()
    items = spark.createDataFrame([(1, 5), (1, 70), (1, 200)], "k int, at int")
    units = spark.createDataFrame([(1, 1, 1, 10), (1, 2, 60, 150)], "k int, unit int, low int, high int")
    assert sorted((x["at"], x.unit) for x in spans.unit_of(items, units, ["k"]).collect()) == [(5, 1), (70, 2), (200, None)]
    with pytest.raises(Exception, match="more than one unit"):
        spans.unit_of(items, units.unionAll(units.withColumn("unit", F.col("unit") + 5)), ["k"]).collect()
    tree = lambda text, words, upos: F.struct(F.lit(text).alias("text"), F.array(*map(F.lit, words)).alias("tokens"), F.array(*map(F.lit, words)).alias("lemmas"), F.array(*map(F.lit, upos)).alias("upos"), F.array(*map(F.lit, upos)).alias("deprel"))
    like = spark.range(1).select(spans.subtree_similarity(tree("ab", ["a", "b"], ["N", "V"]), tree("ac", ["a"], ["N"]), F.lit(0.5)).alias("x")).first().x
    assert abs(like - (0.24 * 0.5 + 0.18 * 0.5 + 0.18 * 0.5 + 0.15 * 0.5 + 0.10 / 3 + 0.15 * 0.5)) < 1e-9


def test_links_score_as_plain_totals():
    """Runs that are described once score as their joined texts do, and each run is described once."""
    rng = random.Random(7)
    some = ["Ahoj světe!", "", "...", "„Ano” – 12, 13?", "12 13", "Ściana mur.", "Ein Bier, bitte; corpus delicti (nein)", "item"]
    for _ in range(60):
        a, b = ([rng.choice(some) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        text = lambda x, i, e: " ".join(x[i - 1 : e])
        for i, to_i, j, to_j, score in sequence.span_links(a, b):
            assert score == sequence.P.span_total(text(a, i, to_i), text(b, j, to_j))
        for i, to_i, j, to_j, score in sequence.block_links(a, b):
            x, y = text(a, i, to_i), text(b, j, to_j)
            length, trigram, punctuation, digit = sequence.P.signals(x, y)
            assert score == 0.26 * length + 0.18 * trigram + 0.08 * punctuation + 0.03 * digit + 0.17 * sequence.P.overlap(sequence.P.lemmas(x, "pl"), sequence.P.lemmas(y, "cs")) + 0.07 + 0.07


def test_each_run_is_described_once(monkeypatch):
    seen = []
    monkeypatch.setattr(sequence.P, "grams", lambda t, f=sequence.P.grams: seen.append(t) or f(t))
    a, b = [f"zdanie {k} a." for k in range(12)], [f"věta {k} b." for k in range(12)]
    assert sequence.span_links(a, b) and sequence.block_links(a, b)
    assert len(seen) == 2 * 2 * (12 + 11)

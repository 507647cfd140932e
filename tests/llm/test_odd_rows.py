"""Empty tables, nulls, long texts, repeated rows and columns with the operators' own names; hand-marked pages;
scores of the language model and likeness of fingerprints against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from bitextile.llm import brown, bpe, decontaminate, fingerprint, htmltext, licenses, neardup, packing, substring, toxicity

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ROWS = [(None, "a b"), (1, None), (2, ""), (3, "A a\x0bB"), (3, "A a\x0bB"), (4, LONG), (5, "x"), (6, LONG + " end")]
CLASHING = ["score", "Predicted", "passages", "items", "spans", "n_words", "n_hit", "_doc", "_cuts", "_gone", "own_id", "cuts", "gone_id", "kept", "text_1"]


def frame(spark):
    return spark.createDataFrame([(d, t, *[f"{c}{k}" for c in CLASHING]) for k, (d, t) in enumerate(ROWS)], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASHING)]))


def model(spark):
    rows = [(k, f"{'vile rotten' if k % 3 == 0 else 'fine calm'} words number {k % 7} here") for k in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.learn(docs, spark.createDataFrame([(d, int(d % 3 == 1)) for d, _ in rows], "doc_id long, toxic int"))


def test_columns_of_the_same_name_stay(spark):
    docs = frame(spark)
    bench = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    want = {x["score"]: x for x in docs.collect()}
    for kept in (toxicity.accepted(docs, model(spark)), decontaminate.decontaminated(docs, bench), substring.deduplicated(docs), neardup.deduplicated(docs)):
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        for x in kept.collect():
            assert all(x[c] == want[x["score"]][c] for c in ["doc_id", *CLASHING])
    for refuse in (lambda: toxicity.scored(docs, model(spark)), lambda: decontaminate.contamination(docs, bench)):
        with pytest.raises(ValueError, match="give other names"):
            refuse()


def test_every_operator_takes_odd_rows_and_empty_tables(spark):
    docs, empty = frame(spark), frame(spark).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", LONG, 2), (1, "u", LONG, 2)], "page_id long, url string, html string, text int")
    for run in (brown.train_and_score, lambda d: toxicity.held_out_scores(d, labels), substring.digests, lambda d: neardup.near_duplicates(d, 2), licenses.digests, bpe.digests, lambda d: decontaminate.digests(d, bench), fingerprint.edited_neighbours):
        assert run(docs).count() == len(ROWS) and run(empty).count() == 0
    assert htmltext.main_text(pages).count() == 3 and htmltext.main_text(pages.limit(0)).count() == 0
    assert packing.packed(empty).count() == 0 and packing.unpacked(packing.packed(docs)).select("doc_id").distinct().count() == 5


def test_pipeline_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


PAGES = {
    "<html><body><ul class=topnav><li><a href=/>Start</a><li><a href=/n>News</a><li><a href=/k>Contact</a></ul>"
    "<main id=inhalt><h1>The river rose again</h1><p>After a week of rain, the river rose by two metres on Sunday night, and the lower streets were closed.</p>"
    "<p>People who live there said that they had seen worse, though not in the last twenty years &amp; not in May.</p>"
    "<blockquote>We carried the piano upstairs, said one of them, and then we waited.</blockquote></main>"
    "<aside class=teaser-box><h3>Most read</h3><a href=/1>One</a> <a href=/2>Two</a></aside><footer><p>Imprint | Privacy</p></footer></body></html>": [
        "The river rose again", "After a week of rain, the river rose by two metres on Sunday night, and the lower streets were closed.",
        "People who live there said that they had seen worse, though not in the last twenty years & not in May.", "We carried the piano upstairs, said one of them, and then we waited.",
    ],
    "<body><header><p>The Gazette</p><nav><a href=/a>Home</a><a href=/b>Sport</a></nav></header><div class=wrap><article><h2>Bread without yeast</h2><p>Flour, water, salt and <b>time</b> are all that it takes; "
    "the rest is done by what lives on the grain.</p><p>Keep the dough warm, feed it once a day, and bake it after five days in a hot oven.</p></article>"
    "<section class=comments><h3>2 comments</h3><div class=comment><p>Tried it, works.</p></div><div class=comment><p>Mine went mouldy!</p></div></section></div>"
    "<form action=/s><p>Subscribe to our letter</p><input name=m></form></body>": [
        "Bread without yeast", "Flour, water, salt and time are all that it takes; the rest is done by what lives on the grain.", "Keep the dough warm, feed it once a day, and bake it after five days in a hot oven.",
    ],
}


def test_hand_marked_pages(spark):
    rows = [(k, f"u{k}", source, None) for k, source in enumerate(PAGES)] + [(None, None, next(iter(PAGES)), "x")]
    got = {x.url: x for x in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, extra string")).collect()}
    for k, want in enumerate(PAGES.values()):
        assert got[f"u{k}"].text.split("\n") == want and got[f"u{k}"].n_chars == len("\n".join(want))
    assert got[None].page_id is None and got[None].text == got["u0"].text


def test_page_keeps_what_is_no_tag():
    blocks = lambda s: [x[1] for x in htmltext.Page(s).blocks]
    assert blocks("<p title=it's>two foo <b>it's</b> bar</p>") == ["two foo it's bar"]
    assert blocks("<p>a</p>< 5 and everything else after stays") == ["a", "< 5 and everything else after stays"]
    assert blocks("<p>1 < 2 and <b>3</b><br/>4 <p") == ["1 < 2 and 3 4 <p"]
    assert blocks('<p class="a>b" id=c/>x</p>') == ["x"]
    import time

    for part in ("<p ", '<p a="', "<p a='x>", "<", "<!", "<button>", "<b><p>"):
        t = time.process_time()
        htmltext.Page(part * 100_000)
        assert time.process_time() - t < 20


def test_exchange_ends_by_itself():
    for seed in range(5):
        r = np.random.Generator(np.random.PCG64(seed))
        pairs = r.poisson(0.7, (60, 60)).astype(float)
        label = brown.exchange(pairs, 0, 20)
        b = np.zeros((21, 21))
        np.add.at(b, (label[:, None], label[None, :]), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        like = lambda b: f(b) - f(b.sum(0)) - f(b.sum(1))
        best = like(b)
        for i in range(1, 60):
            other = label.copy()
            other[i] = 1 + label[i] % 20
            c = np.zeros((21, 21))
            np.add.at(c, (other[:, None], other[None, :]), pairs)
            assert like(c) <= best + 1e-6


def test_brown_scores(spark):
    """Every word is an item, so the score is that of the class bigrams and the words' shares in their classes."""
    r = np.random.Generator(np.random.PCG64(4))
    docs = [(k, " ".join("abcdefgh"[x] for x in r.integers(0, 8, 30))) for k in range(60)]
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = [[*t.split(), "\n"] for d, t in docs if not out(d)]
    vocabulary = ["\n", *"abcdefgh"]
    index = {w: k for k, w in enumerate(vocabulary)}
    pairs = np.zeros((9, 9))
    for w in words:
        for a, z in zip(["\n", *w], w):
            pairs[index[a], index[z]] += 1
    label = brown.exchange(pairs, 0)
    k = brown.CLASSES + 1
    classes = np.zeros((k, k))
    for i in range(9):
        for j in range(9):
            classes[label[i], label[j]] += pairs[i, j]
    share = (classes.sum(0) + 1) / (classes.sum() + k)
    follow = (classes + k * share) / (classes.sum(1, keepdims=True) + k)
    count = Counter(w for t in words for w in t)
    total = np.bincount(label, [count[w] for w in vocabulary], k)
    want = {d: sum(math.log10(follow[label[index[a]], label[index[z]]] * count[z] / (total[label[index[z]]] + (z != "\n"))) for a, z in zip(["\n", *t.split()], [*t.split(), "\n"])) for d, t in docs}
    got = {x.doc_id: x.score for x in brown.train_and_score(spark.createDataFrame(docs, "doc_id long, text string"), least=1).collect()}
    assert all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_likeness_is_the_cosine_of_word_pairs(spark):
    texts = ["the cat sat on the mat\nand slept", "the cat sat on the mat\nand woke", "quite other words", ""]
    rows = sorted(fingerprint.edited_neighbours(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda x: -x.doc_id)

    def pairs(t):
        return Counter(p for line in t.split("\n") for p in zip(["", *line.split()], line.split()))

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return 1.0 if a == b else sum(a[p] * b[p] for p in a) / norm if norm else 0.0

    for x, y in zip(rows, [*rows[1:], rows[0]]):
        t, u = texts[x.doc_id], texts[y.doc_id]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert abs(x.near_next - cosine(pairs(t), pairs(u))) < 0.2 and abs(x.near_edited - cosine(pairs(t), pairs(edited))) < 0.2
        assert fingerprint.decode(x.fingerprint)[0].tolist() == fingerprint.vectors(__import__("pyarrow").array([t]))[0][0].tolist()

"""Column functions against their plain versions, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from bitextile.functions import plain as P
from bitextile.functions import text as T

TEXTS = ["", "Ahoj světe! Jak se máš?", "Ściana – mur: 12, 13 a „14”.", "ABC abc", "...", "x", "Ein Bier, bitte; corpus delicti (nein)", "na konec věta. A teď"]


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(1)
    return spark.createDataFrame([(r.choice(TEXTS), r.choice(TEXTS)) for _ in range(60)], "a string, b string").cache()


def test_scores(pairs):
    rows = pairs.select("a", "b", T.sentence_score(F.col("a"), F.col("b")).alias("s"), T.squeezed(F.col("a")).alias("q"), T.slugify_exact("a").alias("x"), T.slugify(F.col("a")).alias("y")).collect()
    for r in rows:
        length, trigram, punctuation, digit = P.signals(r.a, r.b)
        assert r.s.length == pytest.approx(length) and r.s.char_trigram == pytest.approx(trigram) and r.s.punctuation == pytest.approx(punctuation) and r.s.digit_pattern == digit
        assert r.s.total == pytest.approx(P.sentence_total(r.a, r.b))
        assert r.q == P.squeezed(r.a) and r.x == r.y


def test_tokens_and_lemmas(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", T.tokens(F.col("t")).alias("w"), F.transform(T.tokens(F.col("t")), lambda w: T.token_kind(w)).alias("k"), F.transform(T.tokens(F.col("t")), lambda w: T.lemma(w, "cs")).alias("l")).collect():
        want = P.tokens(r.t)
        assert r.w == [t for _, t, _ in want] and r.k == [k for _, _, k in want]
        assert [x for x, k in zip(r.l, r.k) if k == "word"] == [P.lemma(t, "cs") for _, t, k in want if k == "word"]


def test_sentences(spark):
    df = spark.createDataFrame([("Ano. Ne!  Šel. Ale proč? 5 dní… „Tak“",)], "t string")
    assert df.select(T.split_sentences(F.col("t"))).first()[0] == ["Ano.", "Ne! Šel.", "Ale proč?", "5 dní…", "„Tak“"]
    assert df.select(T.split_sentences(F.col("t"), True)).first()[0][1:3] == ["Ne!", "Šel."]


def test_places_and_keys(spark):
    one = spark.range(1)
    at = lambda i, n, m: one.select(T.expected_index(F.lit(i), F.lit(n), F.lit(m))).first()[0]
    assert [at(2, 3, 4), at(2, 3, 6), at(1, 1, 5), at(3, 3, 9)] == [3, 3, 1, 9]  # halves to even
    words = spark.createDataFrame([(w,) for w in ("chata", "cena", "dar", "dár", "dara", "hora", "ihned", "čaj")], "w string")
    assert [r.w for r in words.orderBy(T.czech_sort_key(F.col("w"))).collect()] == ["cena", "čaj", "dar", "dara", "dár", "hora", "chata", "ihned"]
    assert one.select(T.escape_latex(F.lit("a_b\\{c}&5%"))).first()[0] == "a\\_b\\textbackslash{}\\{c\\}\\&5\\%"
    assert one.select(T.preview(F.lit("x " * 200))).first()[0].endswith("...")
    v = one.select(T.hashed_trigrams(F.lit("ahoj svete")).alias("v")).first().v
    assert len(v) == 128 and sum(x * x for x in v) == pytest.approx(1)
    titles = [("Úvod", "Wstęp", 1.0), ("Kapitola II", "rozdział ii", 0.8), ("Ten den", "den", 0.5)]
    for a, b, want in titles:
        assert one.select(T.title_similarity(F.lit(a), F.lit(b))).first()[0] == want
    assert one.select(T.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == 11.0


def test_digits_at_the_ends_of_sentences_stay(spark):
    """Each sentence begins and ends with the digit of its own place."""
    text = "0 at first 0. 1 comes then 1. 2. 13.2. 4 by 4. 5"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.split_sentences(F.col("t")).alias("s"), T.split_sentences(F.col("t"), True).alias("u")).first()
    assert got.s == got.u == ["0 at first 0.", "1 comes then 1.", "2.", "13.2.", "4 by 4.", "5"]


@pytest.mark.parametrize("query", ["split_sentences", "token_counts", "span_texts", "embedding_samples"])
def test_sentences_of_digits_equal_the_sql(spark, tmp_path, query):
    import duckdb

    import __spark_entry__ as entry

    rows = [(k, ". ".join(f"{j}" if (j + k) % 3 else f"{j} X {k} 1{j}" for j in range(12)) + "\n" + "1 A. 3. 3. 2. 2", "en") for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[query])
    names = [x[0] for x in want.description]
    got = entry.queries()[query](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str) and got


def test_equally_long_phrases_by_their_order(spark):
    from bitextile.operators import lookups

    df = spark.createDataFrame([("Of the man in der Stadt",), ("in der mit uns, of the",), ("de la x",), ("nothing",)], "text string")
    for phrases, first in ((["de la", "of the", "in der", "mit uns"], "of the"), (["in der", "of the", "mit uns", "de la"], "in der")):
        assert [r.phrase for r in lookups.longest_phrase(df, phrases).collect()] == [first, "mit uns", "de la", None]

"""The second refresh analyses nothing; rows get the tokens of their own text and language."""

from pyspark.sql import functions as F

from bitextile import session
from bitextile.operators import snapshots as S
from bitextile.operators.enrichment import analysed
from bitextile.plans import queries as Q
from bitextile.plans import planner_queries as _  # noqa: F401  registers snapshot_tokens


def test_each_text_is_analysed_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("pl", "Pan idzie."), ("pl", "Pan idzie."), ("cs", "Pan idzie."), ("cs", ""), ("cs", None), (None, "Ano."), ("xx", "No.")], "language string, text string")
    assert S.stored(spark, path) is None
    assert S.refresh(rows, path, analysed, ["pl", "cs", "und"]) == 3
    assert S.refresh(rows, path, analysed, ["pl", "cs", "und"]) == 0
    more = rows.unionByName(spark.createDataFrame([("pl", "Nowe."), ("pl", "Nowe.")], rows.schema))
    assert S.refresh(more, path, analysed, ["pl", "cs", "und"]) == 1 and S.stored(spark, path).count() == 4
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).limit(2).write.mode("append").parquet(path + "2")
    assert S.stored(spark, path + "2").count() == 4  # a key once


def test_rows_get_their_tokens(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(k, "pl" if k % 2 else "cs", ["Pan idzie.", "Ano, ano.", "", None][k % 4]) for k in range(200)], "id int, language string, text string").repartition(3)
    S.refresh(rows, path, analysed, ["pl", "cs"])
    got = S.with_tokens(rows, path, F.col("language"), "text", "tokens").collect()
    assert len(got) == 200
    want = {(x["language"], x["text"]): x["t"] for lang in ("pl", "cs") for x in rows.where(F.col("language") == lang).select("language", "text", analysed(F.col("text"), lang).alias("t")).distinct().collect()}
    for x in got:
        assert x["tokens"] == (want[x["language"], x["text"]] if x["text"] else None)
    assert S.with_tokens(rows.limit(0), path, F.col("language"), "text", "tokens").count() == 0


def test_rows_without_a_store_have_the_same_tokens(spark):
    texts = ["Pan idzie.", "Ano, ano", "12 ² ½ dom", "Žluťoučký Kůň a K2 že ﬁn ＡＢ Ⅷ ǅ ΟΔΟΣ Ёлка 漢字 é ß İ _x - , „ ” ?", "...", "ová Nová nová ١٢", "𝒜b 𐐀c Dům", "  ", "x" * 3000, "", None]
    rows = spark.createDataFrame(list(enumerate(texts * 3)), "k int, text string")
    for language in ("pl", "cs", "xx"):
        want = rows.select("k", F.when(F.col("text") != "", analysed(F.col("text"), language)).alias("tokens")).collect()
        got = S.analysed_rows(rows, language, "text", "tokens").select("k", "tokens").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_snapshot_tokens_write_no_table(spark, tmp_path):
    """Before, sentences, distinct sentences and a store of tokens were written, and the store dealt out."""
    spark.createDataFrame([(k, "Pan idzie. Ano!\n\n12 a x") for k in range(20)] + [(20, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    written = len(session._tables)
    got = Q.QUERIES["snapshot_tokens"](spark, str(tmp_path))
    assert got.count() == 60 and len(session._tables) == written and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()

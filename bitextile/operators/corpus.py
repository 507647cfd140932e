"""The canonical corpus as tables: chapters (documents), paragraphs, sentences and tokens with ids, and its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Chapters of a book, where documents stand in for chapters.
CHAPTERS = 20


def chapters(docs: DataFrame) -> DataFrame:
    """book_id, chapter_index (from 1), doc_id, title (the first paragraph), paragraphs (array). No shuffle."""
    found = T.paragraphs(F.col("text"))
    rows = docs.select("doc_id", found.alias("paragraphs"))
    return rows.select(
        F.floor(F.col("doc_id") / CHAPTERS).cast("long").alias("book_id"), (F.col("doc_id") % CHAPTERS + 1).cast("int").alias("chapter_index"), "doc_id",
        F.coalesce(F.try_element_at("paragraphs", F.lit(1)), F.lit("")).alias("title"), "paragraphs",
    )


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index (from 1), paragraph_id, text."""
    rows = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("k", "text"))
    return rows.select("doc_id", (F.col("k") + 1).alias("paragraph_index"), paragraph_id(F.col("doc_id"), F.col("k") + 1).alias("paragraph_id"), "text")


def sentence_rows(docs: DataFrame, unicode_caps: bool = False) -> DataFrame:
    rows = paragraph_rows(docs).select("doc_id", "paragraph_index", "paragraph_id", F.posexplode(T.split_sentences(F.col("text"), unicode_caps)).alias("k", "text"))
    return rows.select("doc_id", "paragraph_index", (F.col("k") + 1).alias("sentence_index"), F.format_string("%s-s-%04d", "paragraph_id", F.col("k") + 1).alias("sentence_id"), "text")


def token_rows(docs: DataFrame, language: str = "cs") -> DataFrame:
    rows = sentence_rows(docs).select("doc_id", "sentence_id", F.posexplode(T.tokens(F.col("text"))).alias("k", "token"))
    return rows.select("doc_id", "sentence_id", (F.col("k") + 1).alias("token_index"), "token", T.token_kind(F.col("token")).alias("kind"), T.normalized(F.col("token")).alias("normalized"), T.lemma(F.col("token"), language).alias("lemma"))


def paragraph_id(doc: Column, index: Column) -> Column:
    return F.format_string("doc-%d-p-%04d", doc, index)


def violations(docs: DataFrame) -> DataFrame:
    """doc_id and the rules of the canonical corpus that it breaks."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("doc_id").isNull() | (F.col("doc_id") < 0), "index is negative or missing"), F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "text is blank"),
            F.when(F.size(T.paragraphs(F.col("text"))) == 0, "chapter has no paragraph"), F.when(F.coalesce("lang", F.lit("")) == "", "language is empty"),
        )
    )
    return docs.select("doc_id", F.explode(rules).alias("rule"))


def doc_pairs(docs: DataFrame) -> DataFrame:
    """pair_id, a and b: the paragraphs of an even document and of the one after it."""
    rows = docs.select(F.floor(F.col("doc_id") / 2).cast("long").alias("pair_id"), (F.col("doc_id") % 2).alias("side"), T.paragraphs(F.col("text")).alias("paragraphs"))
    a = rows.where("side = 0").select("pair_id", F.col("paragraphs").alias("a"))
    b = rows.where("side = 1").select("pair_id", F.col("paragraphs").alias("b"))
    return a.join(b, "pair_id")


def to_json(docs: DataFrame) -> DataFrame:
    """One canonical JSON object a chapter; null fields are left out."""
    rows = chapters(docs)
    shape = F.struct(
        F.format_string("doc-%d", "doc_id").alias("id"), F.col("chapter_index").alias("index"), F.when(F.col("title") != "", F.col("title")).alias("title"),
        F.transform("paragraphs", lambda t, k: F.struct(F.format_string("doc-%d-p-%04d", F.col("doc_id"), k + 1).alias("id"), (k + 1).alias("index"), t.alias("text"), T.split_sentences(t).alias("sentences"))).alias("paragraphs"),
    )
    return rows.select("doc_id", F.to_json(shape, {"ignoreNullFields": "true"}).alias("json"))

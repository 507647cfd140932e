"""Candidate generation: windowed joins with scores and top-k, on pairs of documents and of books.

A window of places is a range predicate. Places are cut into bins as wide as a window, so a window meets one or two bins:
a source item goes to these, a target item to its own, and an equi-join on (pair, bin) brings them together. Each text
and its trigrams are made once and copied twice at most; top-k is an aggregate of a window's few candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import chapters, doc_pairs


def _top(candidates: Column, k: int) -> Column:
    """The k best, equal scores by place."""
    order = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["target"] < y["target"], -1).when(x["target"] > y["target"], 1).otherwise(0)
    return F.slice(F.array_sort(candidates, order), 1, k)


def places(expected: Column, radius: int, total: Column) -> Column:
    """Places of a window around the expected one, from 1 to total; none if it lies outside."""
    low, high = F.greatest(F.lit(1), expected - radius), F.least(total, expected + radius)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def windowed(docs: DataFrame, window: int = 3) -> DataFrame:
    """Each source paragraph of a document pair with each target paragraph in its window: pair_id, i, j, n, m, both texts,
    and the three measures."""
    width = 2 * window + 1
    rows = doc_pairs(docs).withColumns({"n": F.size("a"), "m": F.size("b")}).where("m > 0")
    grams = lambda c: F.transform(T.grams(T.squeezed(F.col(c))), lambda g: F.xxhash64(g))
    # Lengths and sets of trigrams are made before the join, so texts pass it only where they are wanted.
    left = rows.select("pair_id", "n", "m", F.posexplode("a").alias("k", "source_text")).select("pair_id", "n", "m", (F.col("k") + 1).alias("i"), "source_text", F.length("source_text").alias("source_length"), grams("source_text").alias("g"))
    expected = T.expected_index(F.col("i"), F.col("n"), F.col("m"))
    left = left.withColumns({"low": F.greatest(F.lit(1), expected - window), "high": F.least(F.col("m"), expected + window)}).where("low <= high")
    slot = lambda c: F.floor((F.col(c) - 1) / width).cast("int")
    left = left.withColumn("bin", F.explode(F.array_distinct(F.array(slot("low"), slot("high")))))
    right = rows.select("pair_id", F.posexplode("b").alias("k", "target_text")).select("pair_id", (F.col("k") + 1).alias("j"), "target_text", F.length("target_text").alias("target_length"), grams("target_text").alias("h"))
    met = left.join(right.withColumn("bin", slot("j")), ["pair_id", "bin"]).where("j between low and high")
    return met.select(
        "pair_id", "i", "j", "source_text", "target_text", T.position_similarity(F.col("i"), F.col("n"), F.col("j"), F.col("m")).alias("position"),
        T.ratio(F.col("source_length"), F.col("target_length")).alias("length"), T.distinct_jaccard(F.col("g"), F.col("h")).alias("char_trigram"),
    ).withColumn("score", F.col("position") * 0.50 + F.col("length") * 0.30 + F.col("char_trigram") * 0.20)


def paragraph_candidates(docs: DataFrame, window: int = 3, top_k: int = 3) -> DataFrame:
    """For each source paragraph of a document pair its best targets: half place, three tenths length, a fifth trigrams."""
    order = F.struct((-F.col("score")).alias("worse"), F.col("j").alias("target"), "score", "position", "length", "char_trigram")
    best = windowed(docs, window).groupBy("pair_id", "i").agg(F.slice(F.array_sort(F.collect_list(order)), 1, top_k).alias("top"))  # 2 * window + 1 each
    ranked = best.select("pair_id", "i", F.posexplode("top").alias("r", "c"))
    return ranked.select("pair_id", F.col("i").alias("source_index"), (F.col("r") + 1).alias("rank"), F.col("c.target").alias("target_index"), "c.score", "c.position", "c.length", "c.char_trigram")


def book_pairs(docs: DataFrame) -> DataFrame:
    """book pairs (even, odd) with their chapters: array<struct<chapter_index, n, title>>, in order."""
    rows = chapters(docs).select("book_id", F.struct("chapter_index", F.size("paragraphs").alias("n"), "title").alias("c"))
    books = rows.groupBy("book_id").agg(F.array_sort(F.collect_list("c")).alias("chapters"))  # CHAPTERS rows a book
    a = books.where("book_id % 2 = 0").select(F.floor(F.col("book_id") / 2).alias("pair_id"), F.col("chapters").alias("a"))
    b = books.where("book_id % 2 = 1").select(F.floor(F.col("book_id") / 2).alias("pair_id"), F.col("chapters").alias("b"))
    return a.join(b, "pair_id")


def chapter_candidates(docs: DataFrame, window: int = 1, top_k: int = 3) -> DataFrame:
    rows = book_pairs(docs).select("pair_id", "b", F.size("a").alias("n"), F.size("b").alias("m"), F.posexplode("a").alias("k", "s"))
    rows = rows.withColumn("i", F.col("k") + 1).withColumn("near", places(T.expected_index(F.col("i"), F.col("n"), F.col("m")), window, F.col("m")))

    def score(j):
        t = F.element_at("b", j)
        return F.struct(j.alias("target"), T.chapter_score(F.col("i"), F.col("n"), j, F.col("m"), F.col("s.n"), t["n"], T.title_similarity(F.col("s.title"), t["title"])).alias("score"))

    ranked = rows.select("pair_id", "i", F.posexplode(_top(F.transform("near", score), top_k)).alias("r", "c"))
    return ranked.select("pair_id", F.col("i").alias("source_index"), (F.col("r") + 1).alias("rank"), F.col("c.target").alias("target_index"), "c.score")


def unmatched(docs: DataFrame, least: float) -> DataFrame:
    """Source paragraphs whose best candidate stays below a score: an anti result."""
    best = paragraph_candidates(docs, 3, 1).where(F.col("score") >= least).select("pair_id", "source_index")
    every = doc_pairs(docs).where(F.size("b") > 0).select("pair_id", F.posexplode("a").alias("k", "t")).select("pair_id", (F.col("k") + 1).alias("source_index"))
    return every.join(best, ["pair_id", "source_index"], "left_anti")

"""Spans of tokens and of paragraphs: texts and weights, containment joins, support, coverage, local reports, and the
similarity of nodes and subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BIN = 64


def _bins(low: str, high: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))


def in_rectangles(items: DataFrame, blocks: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """items (keys, i, j) with the unit of each block (keys, unit, i_low, i_high, j_low, j_high) that holds both places:
    an equi-join on bins of i, then the ranges."""
    left = items.withColumn("_bin", F.floor(F.col("i") / width))
    right = blocks.select(*keys, "unit", "i_low", "i_high", "j_low", "j_high", _bins("i_low", "i_high", width).alias("_bin"))
    met = left.join(right, [*keys, "_bin"]).where("i between i_low and i_high and j between j_low and j_high")
    return met.select(*items.columns, "unit")


def unit_of(items: DataFrame, units: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """items (keys, at) with the unit (keys, unit, low, high) that holds them, null if none; two units for one item are an
    error."""
    left = items.withColumn("_bin", F.floor(F.col("at") / width)).alias("l")
    right = units.select(*keys, "unit", "low", "high", _bins("low", "high", width).alias("_bin")).alias("r")
    on = (F.col("l._bin") == F.col("r._bin")) & (F.col("l.at") >= F.col("r.low")) & (F.col("l.at") <= F.col("r.high"))
    for k in keys:
        on &= F.col(f"l.{k}") == F.col(f"r.{k}")
    met = left.join(right, on, "left").select(*[F.col(f"l.{c}") for c in items.columns], F.col("r.unit").alias("unit"))
    found = met.groupBy(*items.columns).agg(F.min("unit").alias("unit"), F.max("unit").alias("last"))
    return found.select(*items.columns, F.when(F.col("unit") != F.col("last"), F.raise_error(F.lit("more than one unit"))).otherwise(F.col("unit")).alias("unit"))


def span_words(tokens: Column, first: Column, last: Column) -> Column:
    """The words of a span of an array of tokens, with spaces."""
    return F.array_join(F.filter(F.slice(tokens, first, last - first + 1), lambda t: T.token_kind(t) == "word"), " ")


def span_text(tokens: Column, first: Column, last: Column) -> Column:
    """All tokens of a span; closing marks stand at the token before them, opening ones at the one after."""
    joined = F.array_join(F.slice(tokens, first, last - first + 1), " ")
    return F.regexp_replace(F.regexp_replace(joined, r" ([,.;:!?)\]”])", "$1"), r"([(\[„“]) ", "$1")


def span_weight(tokens: Column, upos: Column, first: Column, last: Column) -> Column:
    """The content weight of a span's words (by parts of speech, where they are known)."""
    from .planning import content_weight

    both = F.slice(F.arrays_zip(tokens.alias("t"), upos.alias("u")), first, last - first + 1)
    return F.aggregate(F.filter(both, lambda x: T.token_kind(x["t"]) == "word"), F.lit(0.0), lambda acc, x: acc + content_weight(x["u"]))


def span_support(pairs: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, span_id, source_first, source_last, target_first, target_last) with how many token pairs (keys,
    source_token, target_token) stand inside both sides, over the longer side's length. keys name one sentence pair."""
    listed = pairs.groupBy(*keys).agg(F.collect_list(F.struct("source_token", "target_token")).alias("links"))  # of one sentence
    rows = spans.join(listed, keys, "left")
    held = F.size(F.filter(F.coalesce("links", F.array()), lambda x: x["source_token"].between(F.col("source_first"), F.col("source_last")) & x["target_token"].between(F.col("target_first"), F.col("target_last"))))
    longer = F.greatest(F.col("source_last") - F.col("source_first"), F.col("target_last") - F.col("target_first")) + 1
    return rows.select(*keys, "span_id", (held / longer).alias("support"))


def token_coverage(spans: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """spans (key, first, last) and totals (key, tokens): of each key the share of its tokens inside any span."""
    covered = spans.select(key, F.explode(F.sequence("first", "last")).alias("token")).join(totals, key).where(F.col("token").between(F.lit(1), F.col("tokens"))).groupBy(key).agg(F.countDistinct("token").alias("covered"))
    return totals.join(covered, key, "left").select(key, "tokens", F.coalesce("covered", F.lit(0)).alias("covered"), F.when(F.col("tokens") > 0, F.coalesce("covered", F.lit(0)) / F.col("tokens")).otherwise(0.0).alias("coverage"))


def mean_of_pairs(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Global metrics as the unweighted mean of the pairs' metrics."""
    return rows.agg(F.count(F.lit(1)).alias("pairs"), *[F.round(F.avg(c), 6).alias(c) for c in measures])


def family_weights(rows: DataFrame) -> DataFrame:
    """rows: family, functional, ord -> 0 for families whose first row is functional, else 1."""
    return rows.groupBy("family").agg(F.min(F.struct("ord", "functional")).alias("first")).select("family", F.when(F.col("first.functional"), 0.0).otherwise(1.0).alias("weight"))


def share(mass: Column, words: Column) -> Column:
    """mass / words from 0 to 1; no words have none."""
    return F.when(words > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mass / words))).otherwise(0.0)


def local_report(units: DataFrame, masses: DataFrame) -> DataFrame:
    """units: chapter, unit, words, occurrences, before, after; masses: chapter, unit, granularity, mass -> a row each
    chapter and granularity: the chapter's averages (coverage weighted by occurrences, mass ratios by words) and the
    granularity's mass and share of the chapter's."""
    by_unit = masses.groupBy("chapter", "unit").agg(F.sum("mass").alias("mass"))
    rows = units.join(by_unit, ["chapter", "unit"], "left").withColumn("ratio", share(F.coalesce("mass", F.lit(0.0)), F.col("words")))
    average = lambda v, w: F.when(F.sum(w) > 0, F.sum(F.col(v) * F.col(w)) / F.sum(w)).otherwise(0.0)
    chapters = rows.groupBy("chapter").agg(F.count(F.lit(1)).alias("units"), average("before", "occurrences").alias("before"), average("after", "occurrences").alias("after"), average("ratio", "words").alias("visible"), F.sum(F.coalesce("mass", F.lit(0.0))).alias("all_mass"))
    kinds = masses.groupBy("chapter", "granularity").agg(F.sum("mass").alias("mass"))
    return chapters.join(kinds, "chapter", "left").select("chapter", "units", "before", "after", "visible", "granularity", F.coalesce("mass", F.lit(0.0)).alias("mass"), F.when(F.col("all_mass") > 0, F.coalesce("mass", F.lit(0.0)) / F.col("all_mass")).otherwise(0.0).alias("mass_share"))


def first_of_each(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their rank: a report's examples. Ranks are limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def candidate_sets(texts: Column, positive: Column, radius: int = 2) -> Column:
    """Of an array of texts: the positive place and those around it, left and right in turn, each text once."""
    around = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda d: F.array(positive - d, positive + d)))
    places = F.filter(F.concat(F.array(positive), around), lambda p: (p >= 1) & (p <= F.size(texts)))
    found = F.transform(places, lambda p: F.struct(p.alias("place"), F.element_at(texts, p).alias("text")))
    return F.filter(found, lambda x, k: ~F.exists(F.slice(found, 1, k), lambda y: y["text"] == x["text"]))


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) & (a != ""), F.lit(False)).cast("double")


def char_overlap(a: Column, b: Column) -> Column:
    """Of the sets of small letters and other characters of two texts; two empty ones are alike."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))
    return T.set_overlap(letters(a), letters(b))


def node_similarity(a: Column, b: Column) -> Column:
    """Of two nodes (lemma, normalized, upos, deprel): forms count by their characters where they differ."""
    lemma, upos, deprel = (_equal(a[c], b[c]) for c in ("lemma", "upos", "deprel"))
    form = F.when(_equal(a["normalized"], b["normalized"]) == 1, 1.0).otherwise(char_overlap(a["normalized"], b["normalized"]))
    return F.greatest(lemma, form) * 0.44 + upos * 0.26 + deprel * 0.20 + form * 0.10


def subtree_similarity(a: Column, b: Column, embedding: Column | None = None) -> Column:
    """Of two subtrees (text, tokens, lemmas, upos, deprel: arrays but for text); embedding: of their texts, where an
    encoder gives it."""
    alike = lambda c: T.set_overlap(F.array_distinct(a[c]), F.array_distinct(b[c]))
    total = alike("lemmas") * 0.24 + alike("upos") * 0.18 + alike("deprel") * 0.18 + T.ratio(F.size(a["tokens"]), F.size(b["tokens"])) * 0.15
    return total + char_overlap(a["text"], b["text"]) * 0.10 + (F.lit(0.0) if embedding is None else embedding) * 0.15

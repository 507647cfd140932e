"""Documents to token ids: toxic documents go, near copies go, repeated passages and benchmark passages are cut out of
the texts, and what is left is encoded. Each stage calls one operator of bitextile.llm and works on all rows that the
stage before it kept; its result is written as Parquet and read again as the next one's documents.

Defined results: all but the last stage return the columns of documents, extra ones too, whatever their names. An empty
table stays empty; without labels, or a benchmark, a stage removes nothing. Null and empty texts go through every stage
(no ids at the end). Rows without doc_id are never near copies, and neither lose words nor count as references. Repeated
rows with one doc_id stay together: all of them are kept, or none. n_chars follows a text that a stage changes; a null
text keeps its n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextile.llm import bpe, decontaminate, neardup, substring, toxicity
from bitextile.session import materialize, table


def _sized(rows: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars follows the new texts; the columns stand as before."""
    if "n_chars" in like.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(like.schema["n_chars"].dataType))
    return rows.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject, learned from the labels of the training rows."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word runs, similarity 0.8)."""
    return neardup.deduplicated(docs, 5, 80).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return _sized(substring.deduplicated(docs), docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items."""
    return _sized(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("decontamination", cut_benchmark), ("bpe", encode)]

#: Learned scores decide the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

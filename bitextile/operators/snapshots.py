"""A store of analysed sentences, kept by content: each text of a language is analysed once.

The store is a Parquet table of key (SHA-256 of language and text), language, text and tokens. A refresh reads the distinct
texts of the new rows, leaves out by an anti-join on the key what the store has, analyses the rest and appends it; a second
refresh with the same texts analyses nothing. Rows meet their tokens by a join on the key, in which common texts are
broadcast up to a fixed number, so that no key is hot.

analysed_rows() gives rows the built-in analyser's tokens without a store: where tokens are needed once, a stored copy and its
shuffle cost several times the texts on disk. There the distinct tokens of a batch are analysed once.

Defined results: null and empty texts have no tokens and are never stored; a null language is "und". The store may not
exist yet. A refresh that fails leaves whole files or none; repeated keys, from two refreshes at once, are read as one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plain as P
from ..functions import text as T
from ..session import materialize, prepare

#: Texts with at least one in COMMON rows are broadcast.
COMMON = 10_000


def key(language: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(language, F.lit("und")), F.lit("\n"), text), 256)


def stored(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame | None:
    """The store's rows, one a key; None if there is no store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path).dropDuplicates(["key"])


def refresh(rows: DataFrame, path: str, analyse: Callable[[Column, str], Column], languages: list[str]) -> int:
    """rows: language, text. Analyses what the store lacks, language by language; returns how many texts that were."""
    spark = prepare(rows.sparkSession)
    have = stored(spark, path)
    texts = rows.select(F.coalesce("language", F.lit("und")).alias("language"), F.col("text").cast("string").alias("text")).where((F.col("text") != "") & F.col("language").isin(languages))
    new = texts.withColumn("key", key(F.col("language"), F.col("text"))).groupBy("key").agg(F.first("language").alias("language"), F.first("text").alias("text"))
    new = materialize(new if have is None else new.join(have.select("key"), "key", "left_anti"))
    count = new.count()
    if count:
        tokens = F.coalesce(*[F.when(F.col("language") == x, analyse(F.col("text"), x)) for x in languages])
        new.select("key", "language", "text", tokens.alias("tokens")).write.mode("append").parquet(path)
    return count


def with_tokens(rows: DataFrame, path: str, language: Column, text: str, to: str) -> DataFrame:
    """rows with the tokens of a text column as a new column `to`; null where the store has none."""
    spark = rows.sparkSession
    have = stored(spark, path)
    if have is None:
        raise ValueError(f"{path} is no store of snapshots")
    keyed = rows.withColumn("_key", key(language, F.col(text)))
    found = have.select(F.col("key").alias("_key"), F.col("tokens").alias(to))
    counts = rows.select(key(language, F.col(text)).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    common = materialize(counts.where(F.col("_n") * COMMON >= max(total, 1)).select("_key").where("_key is not null"))
    hot = keyed.join(F.broadcast(common), "_key").join(F.broadcast(found.join(F.broadcast(common), "_key", "left_semi")), "_key", "left")
    rest = keyed.join(F.broadcast(common), "_key", "left_anti").join(found, "_key", "left")
    return hot.unionByName(rest).drop("_key")


TOKENS = "array<struct<index:int,text:string,kind:string,normalized:string,lemma:string,is_stopword:boolean,upos:string,head:int,deprel:string>>"


@lru_cache(1 << 16)
def _token(text: str, language: str) -> tuple:
    """kind, form, lemma, is_stopword, tag of the first token, tag of a later one."""
    kind = P.token_kind(text)
    if kind != "word":
        form = text if kind == "punct" else P.folded(text)
        tag = "NUM" if kind == "number" else "PUNCT"
        return kind, form, form, False, tag, tag
    form = P.folded(text)
    stop = form in T.STOPWORDS.get(language, ())
    tag = "PART" if stop else "NOUN"
    return kind, form, P.ending_cut(form, language), stop, tag, "PROPN" if not stop and unicodedata.category(text[0]) == "Lu" else tag


def _analysed(texts: list[str | None], language: str) -> pa.Array:
    every, ends = [], [0]
    for t in texts:
        every += P.token_texts(t or "")
        ends.append(len(every))
    n, begins, sizes = len(every), np.array(ends[:-1]), np.diff(ends)
    coded = pa.array(every, pa.string()).dictionary_encode()
    ids, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    kind, form, lemma, stop, first, later = zip(*[_token(t, language) for t in distinct]) if distinct else [()] * 6
    index = np.arange(n) - np.repeat(begins, sizes) + 1
    word = np.array([k == "word" for k in kind], bool)[ids]
    # The words of a sentence form a heap: the head of its k-th word is the word k/2.
    total = np.concatenate(([0], np.cumsum(word)))
    before, at = np.repeat(total[begins], sizes), np.flatnonzero(word)
    k = total[1:] - before
    head = np.zeros(n, np.int32)
    below = word & (k > 1)
    head[below] = index[at[before[below] + k[below] // 2 - 1]]
    relation = np.where(k == 1, 0, 1 + k % 2)
    take = lambda values, of, kind=pa.string(): pa.array(values, kind).take(pa.array(of))
    columns = {
        "index": pa.array(index, pa.int32()), "text": coded.dictionary.take(coded.indices), "kind": take(kind, ids), "normalized": take(form, ids), "lemma": take(lemma, ids), "is_stopword": take(stop, ids, pa.bool_()),
        "upos": take([*first, *later], np.where(index == 1, ids, ids + len(distinct))), "head": pa.array(head, pa.int32(), mask=~word), "deprel": pa.array(["root", "nsubj", "obl"]).take(pa.array(relation, pa.int32(), mask=~word)),
    }
    values = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([not t for t in texts], pa.bool_()))


def analysed_rows(rows: DataFrame, language: str, text: str, to: str) -> DataFrame:
    """rows with enrichment.analysed() of a text column as a new column `to`; null where with_tokens() has null."""
    prepare(rows.sparkSession)

    @F.arrow_udf(TOKENS)
    def run(x: pa.Array) -> pa.Array:
        return _analysed(x.to_pylist(), language)

    return rows.withColumn(to, run(text))

"""License scans by an exact set-similarity join, with DataFrame functions only.

Templates are short license statements as sets of words. A text block meets a template if it contains at least
CONTAINMENT of the template's words. Blocks are the lines and, for statements wrapped over lines, all runs of words of
the text, over line ends, that are no longer than the statement's words over CONTAINMENT. One scan of the whole table tokenises each text once, finds the base
phrases, and keeps which template words a text has; a text that as a whole lacks a template's least number of words
can't have a block with them, and goes no further. The template words' document frequencies over the whole table give
the global order, rarest first. Blocks meet templates in a join on the prefixes (a block that meets a template must
have one of its rarest words); the length filter (enough template words at all) and the positional filter (enough words
left from the first common one on, in both) come before the overlap is counted. Runs are counted over a text's
places of a template's words, where these are enough and one is of the prefix. The templates are a fixed list, so the
broadcast side is of fixed size.

Defined results: null and empty texts have no words, no places, empty labels and score 0. The score is 1 with a base
phrase, else the largest containment found, else 0. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare

CONTAINMENT = 0.8

# Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# License statements and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """A-Z in lower case; what else lower() changes stays outside ASCII, but for two letters that are hidden from it."""
    return F.lower(F.when(text.rlike("[Kİ]"), F.translate(text, "Kİ", "��")).otherwise(text))


def words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, _SPLIT), "")


def _least(size: int) -> int:
    """The fewest words of a template that reach the containment."""
    return -(-size * int(CONTAINMENT * 100) // 100)


def _longest(statement: str) -> int:
    """The most words of a run that may meet a statement."""
    return -(-len(statement.split()) * 100 // int(CONTAINMENT * 100))


def _starts(w: Column, phrase: str) -> Column:
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(w) - len(parts))

    def here(i):
        found = F.element_at(w, i + 1) == parts[0]
        for k, p in enumerate(parts[1:], 2):
            found &= F.element_at(w, i + k) == p
        return found

    return F.when((F.size(w) >= len(parts)) & F.array_contains(w, parts[-2]), F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all) of docs with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = prepare(docs.sparkSession)
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    sets = [(label, sorted(set(t.split()))) for label, t in TEMPLATES]
    vocabulary = sorted({w for _, t in sets for w in t})
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("_t", folded(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("_w", words(F.col("_t")))
    hit = F.col("_t").contains("license")
    places = [F.when(hit, _starts(F.col("_w"), p)) for p, _ in PHRASES]
    every = F.array_sort(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<int>")) for p in places])))
    has = F.array_intersect(F.col("_w"), F.array(*map(F.lit, vocabulary)))
    may = F.lit(False)
    for _, t in sets:
        may |= F.size(F.array_intersect(F.col("_has"), F.array(*map(F.lit, t)))) >= _least(len(t))
    named = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(F.coalesce(p, F.array().cast("array<int>"))) > 0, F.lit(label)) for p, (_, label) in zip(places, PHRASES)]), lambda x: x.isNotNull())))
    base = rows.select(*keep, F.size("_w").cast("long").alias("n_words"), F.when(hit, every).otherwise(F.array().cast("array<int>")).alias("_places"), F.when(hit, named).otherwise(F.array().cast("array<string>")).alias("_base"), has.alias("_has"), F.col("_t"))
    base = materialize(base.withColumn("_t", F.when(may, F.col("_t"))).withColumn("_key", F.when(F.col("_t").isNotNull(), F.sha2("_t", 256))))

    counted = dict(base.select(F.explode("_has").alias("w")).groupBy("w").count().collect())  # of the fixed vocabulary
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    prefixes = []
    for k, (label, t) in enumerate(sets):
        ranked = [w for w in order if w in t]
        least = _least(len(t))
        prefixes += [(w, k, label, i, len(t), least, ranked) for i, w in enumerate(ranked[: len(t) - least + 1])]
    table = spark.createDataFrame(prefixes, "w string, template int, label string, i int, size int, least int, ranked array<string>")

    texts = base.where("_t is not null").select("_key", "_t").dropDuplicates(["_key"])
    blocks = texts.select("_key", F.posexplode(F.split("_t", "\n")).alias("block", "line"))
    blocks = blocks.select("_key", "block", F.array_intersect(F.array(*map(F.lit, order)), words(F.col("line"))).alias("ranked_block")).where(F.size("ranked_block") > 0)
    ranked = blocks.select("_key", "block", "ranked_block", F.posexplode("ranked_block").alias("j", "w"))
    met = ranked.join(F.broadcast(table), "w")
    met = met.where((F.size("ranked_block") >= F.col("least")) & (F.least(F.col("size") - F.col("i"), F.size("ranked_block") - F.col("j")) >= F.col("least")))
    met = met.withColumn("common", F.size(F.array_intersect("ranked_block", "ranked"))).where("common >= least")
    met = met.select("_key", "label", (F.col("common") / F.col("size")).alias("part")).unionAll(_runs(texts, sets, prefixes))
    found = met.groupBy("_key").agg(F.collect_set("label").alias("_own"), F.max("part").alias("_best"))

    places_ = F.col("_places")
    rest = base.where("_key is null").select("*", F.lit(None).cast("array<string>").alias("_own"), F.lit(None).cast("double").alias("_best"))  # most texts: no join
    joined = base.where("_key is not null").join(found, "_key", "left").select(*base.columns, "_own", "_best").unionAll(rest)
    return joined.select(
        *keep, "n_words", F.size(places_).cast("long").alias("n_base"), F.when(F.size(places_) > 0, F.array_min(places_)).cast("long").alias("first_word"),
        F.when(F.size(places_) > 0, F.array_max(places_)).cast("long").alias("last_word"), F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("_base"), F.coalesce("_own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def _runs(texts: DataFrame, sets: list, prefixes: list) -> DataFrame:
    """_key, label and part of the templates that runs of words (over line ends) of texts (_key, _t) meet."""
    first = {(p[0], p[1]) for p in prefixes}
    of = [(w, k, label, len(t), _least(len(t)), _longest(TEMPLATES[k][1]), (w, k) in first) for k, (label, t) in enumerate(sets) for w in t]
    table = texts.sparkSession.createDataFrame(of, "w string, template int, label string, size int, least int, longest int, prefix boolean")
    places = texts.select("_key", F.posexplode(words(F.col("_t"))).alias("at", "w")).join(F.broadcast(table), "w")
    found = places.groupBy("_key", "template", "label", "size", "least", "longest").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("p"), F.max("prefix").alias("prefix"))
    found = found.where("prefix and size(p) >= least")
    run = lambda x, i: F.size(F.array_distinct(F.transform(F.filter(F.slice("p", i + 1, F.col("longest")), lambda y: y["at"] < x["at"] + F.col("longest")), lambda y: y["w"])))
    found = found.withColumn("common", F.array_max(F.transform("p", run))).where("common >= least")
    return found.select("_key", "label", (F.col("common") / F.col("size")).alias("part"))


def digests(docs: DataFrame) -> DataFrame:
    return scan(docs, ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _oracle() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = " union all ".join(f"select '{label}' as label, {p.split()} as p" for p, label in PHRASES)
    templates = " union all ".join(f"select {k} as k, '{label}' as label, {sorted(set(t.split()))} as t, {_least(len(set(t.split())))} as least" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
with d as (select doc_id, {lower} as x, regexp_extract_all({lower}, {pattern}) as w from documents),
phrases as ({phrases}), templates as ({templates}),
place as (select doc_id, label, i from (select doc_id, w, label, p, unnest(range(0, len(w) - len(p) + 1)) as i from d, phrases where contains(x, 'license') and len(w) >= len(p)) where w[i + 1 : i + len(p)] = p),
b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from place group by doc_id),
line as (select doc_id, list_distinct(regexp_extract_all(l, {pattern})) as w from (select doc_id, unnest(string_split(x, chr(10))) as l from d)),
met as (select doc_id, label, len(list_intersect(line.w, t)) / len(t) as c from line, templates where len(line.w) >= least and len(list_intersect(line.w, t)) >= least),
names as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from met union all select doc_id, label from place) group by doc_id),
best as (select doc_id, max(c) as c from met group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(case when n_base > 0 then 1.0 else coalesce(best.c, 0.0) end as double) as score
from d left join b using (doc_id) left join names using (doc_id) left join best using (doc_id)
"""


ORACLE = _oracle()

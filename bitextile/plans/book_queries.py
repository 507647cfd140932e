"""Queries of books and spans, with their SQL. Where a query needs what the driver's tables don't have (token pairs, spans,
parts of speech), order lines stand in: an order is a sentence pair, a line a token."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import books, corpus, matching, spans
from ..session import prepare, table
from .queries import CAND, PARA, SENT, SLUG, TOKEN, docs, query

_NOISE = f"(contains(lower(t), 'tekst jest własnością publiczną') or contains(lower(t), 'text je vlastnictvim') or len({SLUG.format('t')}) <= 1)"


@query(f"with {PARA} select doc_id, p as paragraph_index from para where {_NOISE}")
def noise_paragraphs(spark, sf):
    return corpus.paragraph_rows(docs(spark, sf)).where(books.is_noise(F.col("text"))).select("doc_id", "paragraph_index")


def _spine(spark, sf):
    """Documents are the spine; their source is the title, their lines may be headings."""
    d = docs(spark, sf).where("doc_id is not null")
    tag = F.when(F.col("doc_id") % 3 == 0, "h2").otherwise("div")
    paragraphs = T.paragraphs(F.coalesce("text", F.lit("")))
    return d.select(
        F.floor(F.col("doc_id") / 20).cast("long").alias("book_id"), F.lit("web").alias("book_title"), F.col("doc_id").alias("spine_ordinal"), F.concat(F.lit("c"), (F.col("doc_id") % 20).cast("string"), F.lit("_x")).alias("href"),
        F.col("source").alias("title"), F.transform(paragraphs, lambda t: F.struct(tag.alias("tag"), t.alias("text"))).alias("headings"), paragraphs.alias("paragraphs"),
    )


_FITS = "len(t) > 2 and (doc_id % 3 = 0 or (len(t) < 160 and ((t = upper(t) and t <> lower(t)) or regexp_matches(t, '^\\p{Nd}') or starts_with(t, 'Rozdział') or starts_with(t, 'Rozdzial'))))"


@query(rf"""with {PARA},
kept as (select * from para where not {_NOISE}),
per as (select d.doc_id, d.source, count(k.t) as n, arg_min(k.t, k.p) as first from documents d left join kept k using (doc_id) group by d.doc_id, d.source),
head as (select doc_id, arg_min(t, p) as h from para where {_FITS} group by doc_id),
good as (select *, doc_id // 20 as book_id from per where n > 0 and not (n <= 1 and (doc_id % 20 = 0 or {SLUG.format("source")} = 'web'))
         and not (contains(lower(first), 'беларуская') or contains(lower(first), 'polski') or contains(lower(first), 'čeština') or contains(lower(first), 'cestina'))),
numbered as (select good.*, row_number() over (partition by book_id order by doc_id) as chapter_index from good),
titled as (select numbered.*, coalesce(h, nullif(trim(source), ''), 'Chapter ' || chapter_index) as title from numbered left join head using (doc_id))
select book_id, chapter_index, title, 'book-' || book_id || '-c-' || lpad(cast(chapter_index as varchar), 3, '0') || '-' || {SLUG.format("title")} as chapter_id, row_number() over (partition by titled.doc_id order by kept.p) as paragraph_index, kept.t as text
from titled join kept using (doc_id)""")
def canonical_books(spark, sf):
    return books.canonical(_spine(spark, sf)).select("book_id", "chapter_index", "title", "chapter_id", "paragraph_index", "text")


@query(f"with {PARA} select 'doc-' || doc_id as chapter_id, cast(doc_id % 20 + 1 as integer) as chapter_index, 'doc-' || doc_id || '-p-' || lpad(cast(p as varchar), 4, '0') as paragraph_id, p as paragraph_index, t as text from para")
def corpus_json_read(spark, sf):
    """Corpus JSON, written and read again."""
    return books.from_json(corpus.to_json(docs(spark, sf))).select("chapter_id", "chapter_index", "paragraph_id", "paragraph_index", "text")


@query("""with size as (select o_custkey // 10 as book, count(*) as n from orders group by 1),
pairs as (select book, unnest(range(1, n + 1)) as source_index from size)
select p.book, p.source_index, p.source_index as target_index from pairs p join size using (book) where n < 29 or source_index < 27
union all select book, unnest([27, 28, 29]), unnest([27, 28, 29]) from size where n >= 29""")
def scoped_chapter_pairs(spark, sf):
    sizes = table(prepare(spark), sf, "orders").groupBy(F.floor(F.col("o_custkey") / 10).alias("book")).agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.select("book", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("source_index")).withColumn("target_index", F.col("source_index"))
    return books.scoped_pairs(pairs, sizes.select("book", F.col("n").alias("source_chapters"), F.col("n").alias("target_chapters")))


@query(f"with {PARA}, size as (select doc_id, count(*) as n from para group by doc_id) select doc_id, p as paragraph_index, (p - 1) / greatest(n - 1, 1) as place from para join size using (doc_id)")
def normalised_places(spark, sf):
    return books.normalised_places(docs(spark, sf))


@query(f"with {CAND}, best as (select pair_id, source_index as i, target_index as j from ranked qualify row_number() over (partition by pair_id, source_index order by score desc, target_index) = 1) select pair_id, i, j, cast((i - 1) // 5 as integer) as unit from best where (i - 1) // 5 = (j - 1) // 5")
def items_in_blocks(spark, sf):
    """Best paragraph links in the rectangles of five by five paragraphs."""
    items = matching.windowed(docs(spark, sf)).groupBy("pair_id", "i").agg(F.min(F.struct((-F.col("score")).alias("worse"), "j")).alias("c")).select("pair_id", "i", "c.j")
    sizes = corpus.doc_pairs(docs(spark, sf)).select("pair_id", F.greatest(F.size("a"), F.size("b")).alias("n")).where("n > 0")
    tiles = sizes.select("pair_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 5).cast("int"))).alias("unit"))
    low, high = F.col("unit") * 5 + 1, F.col("unit") * 5 + 5
    return spans.in_rectangles(items, tiles.select("pair_id", "unit", low.alias("i_low"), high.alias("i_high"), low.alias("j_low"), high.alias("j_high")), ["pair_id"])


@query(f"with {PARA} select doc_id, p as paragraph_index, case when p <= 6 then cast((p - 1) // 3 as integer) end as unit from para")
def paragraph_units(spark, sf):
    """The unit of each paragraph; units are the first six paragraphs, three each."""
    d = docs(spark, sf)
    units = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("unit")).distinct().select("doc_id", "unit", (F.col("unit") * 3 + 1).alias("low"), (F.col("unit") * 3 + 3).alias("high"))
    items = corpus.paragraph_rows(d).select("doc_id", F.col("paragraph_index").alias("at"))
    return spans.unit_of(items, units, ["doc_id"]).select("doc_id", F.col("at").alias("paragraph_index"), "unit")


_HEAD = f"(list_slice({TOKEN}, 2, 7))"


@query(rf"""with {SENT}, cut as (select doc_id, p, s, {_HEAD} as w from sent)
select doc_id, p as paragraph_index, s as sentence_index, array_to_string(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')), ' ') as words,
regexp_replace(regexp_replace(array_to_string(w, ' '), ' ([,.;:!?)\]”])', '\1', 'g'), '([(\[„“]) ', '\1', 'g') as span_text, 0.5 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) as weight from cut""")
def span_texts(spark, sf):
    """The second to the seventh token of each sentence as a span."""
    rows = corpus.sentence_rows(docs(spark, sf)).withColumn("tokens", T.tokens(F.col("text")))
    nothing = F.transform("tokens", lambda t: F.lit(None).cast("string"))
    two, seven = F.lit(2), F.lit(7)
    return rows.select("doc_id", "paragraph_index", "sentence_index", spans.span_words(F.col("tokens"), two, seven).alias("words"), spans.span_text(F.col("tokens"), two, seven).alias("span_text"), spans.span_weight(F.col("tokens"), nothing, two, seven).alias("weight"))


_PAIRS = "select l_orderkey as sentence_id, l_linenumber as source_token, cast(l_partkey % 7 + 1 as integer) as target_token from lineitem"


@query(f"with pairs as ({_PAIRS}), s as (select distinct sentence_id, unnest([1, 2]) as span_id from pairs) select sentence_id, span_id, count(*) filter (source_token between span_id and span_id + 2 and target_token between span_id and 2 * span_id + 2) / (span_id + 3) as support from s join pairs using (sentence_id) group by 1, 2")
def span_support(spark, sf):
    pairs = table(prepare(spark), sf, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), F.col("l_linenumber").alias("source_token"), (F.col("l_partkey") % 7 + 1).cast("int").alias("target_token"))
    k = F.col("span_id")
    two = pairs.select("sentence_id").distinct().select("sentence_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("span_id"))
    return spans.span_support(pairs, two.select("sentence_id", "span_id", k.alias("source_first"), (k + 2).alias("source_last"), k.alias("target_first"), (2 * k + 2).alias("target_last")), ["sentence_id"])


_COVER = """with s as (select l_orderkey as pair_id, l_linenumber as first, l_linenumber + cast(l_quantity as integer) % 3 as last from lineitem),
t as (select pair_id, max(last) + 1 as tokens from s group by pair_id),
c as (select pair_id, count(distinct k) as covered from (select pair_id, unnest(range(first, last + 1)) as k from s) group by pair_id),
cov as (select pair_id, tokens, covered, covered / tokens as coverage from t join c using (pair_id))"""


def _cover(spark, sf):
    rows = table(prepare(spark), sf, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("last"))
    return spans.token_coverage(rows, rows.groupBy("pair_id").agg((F.max("last") + 1).alias("tokens")), "pair_id")


@query(f"{_COVER} select * from cov")
def token_coverage(spark, sf):
    return _cover(spark, sf)


@query(f"{_COVER} select count(*) as pairs, round(avg(covered), 6) as covered, round(avg(coverage), 6) as coverage from cov")
def hierarchical_metrics(spark, sf):
    return spans.mean_of_pairs(_cover(spark, sf), ["covered", "coverage"])


@query("select l_partkey as family, case when arg_min(l_returnflag, (l_orderkey, l_linenumber)) = 'R' then 0.0 else 1.0 end as weight from lineitem group by 1")
def family_weights(spark, sf):
    rows = table(prepare(spark), sf, "lineitem")
    return spans.family_weights(rows.select(F.col("l_partkey").alias("family"), (F.col("l_returnflag") == "R").alias("functional"), F.struct("l_orderkey", "l_linenumber").alias("ord")))


@query("""with u as (select l_orderkey as chapter, l_linenumber as unit, 64 as words, l_suppkey % 5 as occurrences, round(l_discount * 100) as before, round(l_discount * 100) + round(l_tax * 100) as after, l_returnflag as g, round(l_quantity * l_discount * 100) as mass from lineitem),
c as (select chapter, count(*) as units, case when sum(occurrences) > 0 then sum(before * occurrences) / sum(occurrences) else 0 end as before, case when sum(occurrences) > 0 then sum(after * occurrences) / sum(occurrences) else 0 end as after,
      sum(least(1, all_mass / words) * words) / sum(words) as visible, sum(all_mass) as everything from u join (select chapter, unit, sum(mass) as all_mass from u group by all) using (chapter, unit) group by chapter),
k as (select chapter, g as granularity, sum(mass) as mass from u group by all)
select chapter, units, before, after, visible, granularity, mass, case when everything > 0 then mass / everything else 0 end as mass_share from c join k using (chapter)""")
def local_report(spark, sf):
    """Orders are chapters, lines are units with one selected mass of the granularity l_returnflag."""
    hundredths = lambda c: F.round(F.col(c) * 100)  # noqa: E731  whole numbers add up alike in any order
    rows = table(prepare(spark), sf, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("unit"), F.lit(64).alias("words"), (F.col("l_suppkey") % 5).alias("occurrences"), hundredths("l_discount").alias("before"), (hundredths("l_discount") + hundredths("l_tax")).alias("after"), F.col("l_returnflag").alias("granularity"), F.round(F.col("l_quantity") * F.col("l_discount") * 100).alias("mass"))
    return spans.local_report(rows.drop("granularity", "mass"), rows.select("chapter", "unit", "granularity", "mass"))


@query("select event_type, event_id, value, cast(row_number() over (partition by event_type order by value desc, event_id) as integer) as rank from events qualify rank <= 20")
def report_examples(spark, sf):
    rows = table(prepare(spark), sf, "events").select("event_type", "event_id", "value")
    return spans.first_of_each(rows, ["event_type"], 20, F.col("value").desc(), F.col("event_id"))


@query(f"""with {SENT}, size as (select doc_id, p, max(s) as n from sent group by all),
place as (select doc_id, p, s, unnest([s, s - 1, s + 1, s - 2, s + 2]) as c, unnest([1, 2, 3, 4, 5]) as k from sent),
found as (select place.doc_id, place.p, place.s, place.k, c, o.t from place join sent o on o.doc_id = place.doc_id and o.p = place.p and o.s = place.c),
own as (select doc_id, p, s, t, min(k) as k, arg_min(c, k) as c from found group by all)
select doc_id, p as paragraph_index, s as sentence_index, string_agg(cast(c as varchar), ',' order by k) as places from own group by doc_id, p, s""")
def embedding_samples(spark, sf):
    """Each sentence with its distractors from its paragraph."""
    rows = corpus.paragraph_rows(docs(spark, sf)).select("doc_id", "paragraph_index", T.split_sentences(F.col("text")).alias("texts"))
    each = rows.select("doc_id", "paragraph_index", "texts", F.posexplode("texts").alias("k", "text")).withColumn("sentence_index", F.col("k") + 1)
    found = spans.candidate_sets(F.col("texts"), F.col("sentence_index"))
    return each.select("doc_id", "paragraph_index", "sentence_index", F.array_join(F.transform(found, lambda x: x["place"].cast("string")), ",").alias("places"))


@query("""with n as (select l_orderkey, l_linenumber, cast(l_partkey % 50 as varchar) as lemma, cast(l_suppkey as varchar) as form, l_returnflag as upos, l_linestatus as deprel from lineitem),
p as (select a.l_orderkey, a.l_linenumber, case when a.lemma = b.lemma then 1.0 else 0.0 end as lemma,
      case when a.form = b.form then 1.0 else len(list_intersect(list_distinct(string_split(a.form, '')), list_distinct(string_split(b.form, '')))) / len(list_distinct(list_concat(string_split(a.form, ''), string_split(b.form, '')))) end as form,
      case when a.upos = b.upos then 1.0 else 0.0 end as upos, case when a.deprel = b.deprel then 1.0 else 0.0 end as deprel
      from n a join n b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)
select l_orderkey, l_linenumber, greatest(lemma, form) * 0.44 + upos * 0.26 + deprel * 0.20 + form * 0.10 as similarity from p""")
def node_similarities(spark, sf):
    """Each order line, as a tree's node, with the next one."""
    node = F.struct((F.col("l_partkey") % 50).cast("string").alias("lemma"), F.col("l_suppkey").cast("string").alias("normalized"), F.col("l_returnflag").alias("upos"), F.col("l_linestatus").alias("deprel"))
    rows = table(prepare(spark), sf, "lineitem").select("l_orderkey", "l_linenumber", node.alias("a"))
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("a").alias("b"))
    return rows.join(after, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", spans.node_similarity(F.col("a"), F.col("b")).alias("similarity"))

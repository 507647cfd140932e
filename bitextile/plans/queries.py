"""Queries over the driver's tables, one for each operator, with the SQL that checks them.

Documents stand in for chapters, their lines for paragraphs; an even document and the next one are a pair, twenty
documents a book. Each query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, matching, reports, sequence, timeline
from ..session import materialize, prepare, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark, sf):
    return table(prepare(spark), sf, "documents")


def _linked(d):
    """Word links, and the sentence links' texts that they come from; the links are made once."""
    links = materialize(sequence.sentence_links(d).where(F.col("score") >= 0.45))
    return sequence.word_links(links), links.select("pair_id", "source_paragraph", "source_start", "source_text", "target_text")


# SQL pieces for the oracle.
CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_FOLD = r"regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g')"
SQUEEZED = "coalesce(nullif(regexp_replace(lower(" + _FOLD + "), '[^a-z0-9]+', '', 'g'), ''), 'item')"
SLUG = "coalesce(nullif(trim(regexp_replace(lower(" + _FOLD + "), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"
GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - 2, 1) + 1), lambda i: substr({0}, i, 3)))"
JACCARD = "(case when len({0}) + len({1}) = 0 then {2} else len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) end)"
PARA = f"""lines as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k from documents),
cleaned as (select doc_id, k, {CLEAN.format('l')} as t from lines),
para as (select doc_id, cast(row_number() over (partition by doc_id order by k) as integer) as p, t from cleaned where t <> '')"""
_CUT = r"""list_filter(list_transform(string_split(regexp_replace(t, '([.!?…])\s+(["''“”«»„A-Z0-9-])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""
SENT = f"{PARA},\nsent as (select doc_id, p, unnest({_CUT}) as t, cast(unnest(range(1, len({_CUT}) + 1)) as integer) as s from para)"
TOKEN = r"regexp_extract_all(t, '\p{Nd}+|[\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{N}_\s]')"
_TAGS = "array_to_string(list_transform(list_filter(string_split(t, ''), lambda c: contains('„”\"''—-,.!?;:()', c)), lambda c: case when c in ('„','”','\"','''') then 'Q' when c in ('—','-') then 'D' when c = ',' then 'C' when c = '.' then 'P' when c = '!' then 'E' when c = '?' then 'QMARK' when c = ';' then 'S' when c = ':' then 'COL' else 'B' end), '|')"
SIDES = f"""{PARA},
size as (select doc_id, max(p) as n from para group by doc_id),
grammed as (select doc_id, p, t, {GRAMS.format('z')} as g from (select *, {SQUEEZED.format('t')} as z from para)),
pairs as (select a.doc_id as a, b.doc_id as b, cast(a.doc_id // 2 as bigint) as pair_id, a.n, b.n as m from size a join size b on b.doc_id = a.doc_id + 1 where a.doc_id % 2 = 0)"""
_POS = "(case when n <= 1 and m <= 1 then 1.0 else greatest(0.0, 1.0 - abs(({0} - 1) / greatest(n - 1, 1) - ({1} - 1) / greatest(m - 1, 1))) end)"
CAND = f"""{SIDES},
wide as (select pair_id, n, m, s.p as i, t.p as j, s.t as st, t.t as tt, s.g as sg, t.g as tg,
         case when n <= 1 or m <= 1 then 1 else cast(round_even((s.p - 1) / greatest(n - 1, 1) * (m - 1), 0) as integer) + 1 end as e
         from pairs join grammed s on s.doc_id = a join grammed t on t.doc_id = b),
scored as (select pair_id, i as source_index, j as target_index, {_POS.format('i', 'j')} as position, least(len(st), len(tt)) / greatest(len(st), len(tt)) as length,
           {JACCARD.format('sg', 'tg', '0.0')} as char_trigram from wide where j between e - 3 and e + 3),
ranked as (select *, position * 0.50 + length * 0.30 + char_trigram * 0.20 as score from scored)"""


@query(f"with {PARA} select doc_id, p as paragraph_index, t as text from para")
def clean_paragraphs(spark, sf):
    return corpus.paragraph_rows(docs(spark, sf)).select("doc_id", "paragraph_index", "text")


@query(f"with {SENT} select doc_id, p as paragraph_index, s as sentence_index, t as text from sent")
def split_sentences(spark, sf):
    return corpus.sentence_rows(docs(spark, sf)).select("doc_id", "paragraph_index", "sentence_index", "text")


@query(f"with {PARA} select doc_id, p as paragraph_index, {SLUG.format('t')} as slug from para")
def slugs(spark, sf):
    return corpus.paragraph_rows(docs(spark, sf)).select("doc_id", "paragraph_index", T.slugify(F.col("text")).alias("slug"))


@query(rf"with {SENT}, tok as (select doc_id, unnest({TOKEN}) as w from sent) select doc_id, count(*) as tokens, count(*) filter (regexp_matches(w, '\p{{L}}')) as words, count(*) filter (regexp_full_match(w, '\p{{Nd}}+')) as numbers from tok group by doc_id")
def token_counts(spark, sf):
    rows = corpus.sentence_rows(docs(spark, sf)).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w"))
    kind = T.token_kind(F.col("w"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum((kind == "word").cast("long")).alias("words"), F.sum((kind == "number").cast("long")).alias("numbers"))


_LEMMA = " ".join(f"when ends_with(z, '{s}') and len(z) - {len(s)} >= 3 then substr(z, 1, len(z) - {len(s)})" for s in T.SUFFIXES["cs"])


@query(rf"with {SENT}, tok as (select unnest({TOKEN}) as w from sent), word as (select {SQUEEZED.format('w')} as z from tok where regexp_matches(w, '\p{{L}}')) select case {_LEMMA} else z end as lemma, count(*) as n from word group by 1")
def lemma_counts(spark, sf):
    rows = corpus.sentence_rows(docs(spark, sf)).select(F.explode(T.tokens(F.col("text"))).alias("w")).where(T.token_kind(F.col("w")) == "word")
    return rows.groupBy("w").count().groupBy(T.lemma(F.col("w"), "cs").alias("lemma")).agg(F.sum("count").alias("n"))


@query(f"with {PARA} select doc_id, p as paragraph_index, regexp_replace(t, '[^0-9]', '', 'g') as digits, {_TAGS} as tags from para")
def shapes(spark, sf):
    return corpus.paragraph_rows(docs(spark, sf)).select("doc_id", "paragraph_index", T.digits(F.col("text")).alias("digits"), T.punctuation_tags(F.col("text")).alias("tags"))


@query(f"with {CAND} select pair_id, source_index, cast(row_number() over (partition by pair_id, source_index order by score desc, target_index) as integer) as rank, target_index, score, position, length, char_trigram from ranked qualify rank <= 3")
def paragraph_candidates(spark, sf):
    return matching.paragraph_candidates(docs(spark, sf))


@query(f"with {CAND}, good as (select distinct pair_id, source_index from ranked where score >= 0.75) select pairs.pair_id, s.p as source_index from pairs join para s on s.doc_id = a anti join good on good.pair_id = pairs.pair_id and good.source_index = s.p")
def unmatched_paragraphs(spark, sf):
    return matching.unmatched(docs(spark, sf), 0.75)


@query()
def chapter_candidates(spark, sf):
    return matching.chapter_candidates(docs(spark, sf))


@query()
def chapter_matches(spark, sf):
    return sequence.chapter_matches(docs(spark, sf))


@query()
def paragraph_blocks(spark, sf):
    return sequence.paragraph_alignment(docs(spark, sf)).where("source_start is not null")


@query()
def paragraph_coverage(spark, sf):
    return reports.block_coverage(sequence.paragraph_alignment(docs(spark, sf)))


@query()
def sentence_links(spark, sf):
    return sequence.sentence_links(docs(spark, sf))


@query()
def sentence_spans(spark, sf):
    return sequence.sentence_links(docs(spark, sf), "span")


@query()
def sentence_blocks(spark, sf):
    return sequence.sentence_links(docs(spark, sf), "block")


@query()
def benchmark_report(spark, sf):
    return reports.score_summary(sequence.sentence_links(docs(spark, sf)))


@query()
def review_bundle(spark, sf):
    return reports.review_bundle(sequence.sentence_links(docs(spark, sf)))


@query()
def quality_report(spark, sf):
    links = materialize(sequence.sentence_links(docs(spark, sf)))
    return reports.quality(links, materialize(sequence.word_links(links.where(F.round("score", 6) >= 0.45))))


@query()
def span_coverage(spark, sf):
    d = docs(spark, sf)
    totals = corpus.doc_pairs(d).where(F.size("b") > 0).select("pair_id", F.aggregate(F.transform("a", lambda t: F.size(T.split_sentences(t))), F.lit(0), lambda s, x: s + x).cast("long").alias("sentences"))
    return reports.span_coverage(sequence.span_places(d), totals)


@query()
def safety_histogram(spark, sf):
    return reports.safety_histogram(sequence.sentence_links(docs(spark, sf)))


@query()
def token_links(spark, sf):
    return sequence.token_alignment(docs(spark, sf))


@query()
def action_inventory(spark, sf):
    from ..operators import planning

    return reports.action_inventory(planning.with_families(*_linked(docs(spark, sf))))


@query()
def consecutive_phrases(spark, sf):
    return reports.consecutive_phrases(sequence.token_alignment(docs(spark, sf)))


@query()
def best_token_links(spark, sf):
    return reports.best_links(sequence.token_alignment(docs(spark, sf)))


@query()
def text_diff(spark, sf):
    return sequence.text_diff(docs(spark, sf))


@query("select cast(doc_id as bigint) as doc_id, unnest(list_filter([case when doc_id < 0 then 'index is negative or missing' end, case when trim(coalesce(text, '')) = '' then 'text is blank' end, case when trim(coalesce(text, '')) = '' then 'chapter has no paragraph' end, case when coalesce(lang, '') = '' then 'language is empty' end], lambda x: x is not null)) as rule from documents")
def corpus_violations(spark, sf):
    return corpus.violations(docs(spark, sf))


@query()
def corpus_json(spark, sf):
    return corpus.to_json(docs(spark, sf))


def _occurrences(spark, sf):
    """Families are users, units are days since the first of 1970."""
    e = table(prepare(spark), sf, "events")
    return e.select(F.col("user_id").alias("family"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("unit"))


_OCC = "occ as (select user_id as family, cast(date_diff('day', date '1970-01-01', cast(ts as date)) as bigint) as unit from events), per as (select family, unit, count(*) as n from occ group by all)"
_LINE = f"{_OCC}, line as (select family, unit, n, sum(n) over (partition by family) as total, sum(n) over (partition by family order by unit) as run, min(unit) over (partition by family) as first_unit, max(unit) over (partition by family) as last_unit from per)"


@query(f"with {_LINE} select family, unit, n, cast(total as bigint) as total, cast(run - n as bigint) as seen_before, cast(total - run as bigint) as remaining_after, 1 / (1 + total - run) as urgency, (total - run + n) / total as gain, first_unit, last_unit from line")
def lemma_timeline(spark, sf):
    return timeline.timeline(_occurrences(spark, sf))


@query(f"with {_LINE}, x as (select family, unit, total, run - n + unnest(range(1, n + 1)) as k from line) select family, unit, cast(k as bigint) as occurrence_index, cast(total - k as bigint) as remaining_after, 1 / (1 + total - k) as urgency from x")
def occurrence_timeline(spark, sf):
    return timeline.occurrence_rows(timeline.timeline(_occurrences(spark, sf)))


@query(f"with {_LINE} select family, unit, cast(total - run as bigint) as remaining_after, 1 / (1 + total - run) as urgency, least(1.0, total / 12) * (total - run) / total as deferrability from line")
def family_deferrability(spark, sf):
    return timeline.deferrability(timeline.timeline(_occurrences(spark, sf)))


@query(f"with {_OCC}, f as (select family, min(unit) as u from per group by family) select unit, cast(sum(n) as bigint) as occurrences, cast(sum(case when u < unit then n else 0 end) as bigint) as known, count(*) filter (u = unit) as new_families, sum(case when u < unit then n else 0 end) / sum(n) as coverage from per join f using (family) group by unit")
def introduced_coverage(spark, sf):
    return timeline.introduced(_occurrences(spark, sf))


@query(f"with {_OCC}, u as (select unit, count(*) as n from occ group by unit), r as (select unit, n, sum(n) over (order by unit) as c, sum(n) over () as t from u) select unit, n, cast(c as bigint) as cumulative, c / t as progress, pow(c / t, 1.4) as target from r")
def cumulative_progress(spark, sf):
    return timeline.progress(_occurrences(spark, sf))


@query(f"with {_OCC}, u as (select unit, count(*) as n from occ group by unit), l as (select u as unit, count(*) as k from (select family, max(unit) as u from occ group by family) group by u) select unit, cast(sum(n) over () - sum(n) over (order by unit) as bigint) as remaining, cast(coalesce(k, 0) as bigint) as ending_families from u left join l using (unit)")
def remaining_after(spark, sf):
    return timeline.remaining_after(_occurrences(spark, sf))


@query("select doc_id as unit, n_chars as value, avg(n_chars) over (order by doc_id rows between 25 preceding and 25 following) as average from documents")
def moving_average(spark, sf):
    return timeline.moving_average(docs(spark, sf).select(F.col("doc_id").alias("unit"), F.col("n_chars").alias("value")))


@query(f"with {_OCC}, r as (select family, unit, unit - row_number() over (partition by family order by unit) as g from per) select family, min(unit) as run_start, max(unit) as run_end, count(*) as run_length from r group by family, g")
def consecutive_runs(spark, sf):
    return timeline.islands(_occurrences(spark, sf).distinct(), ["family"], "unit")


@query(f"with {_OCC}, u as (select unit, count(*) as n from occ group by unit), r as (select row_number() over (order by unit) as k, count(*) over () as last, sum(n) over (order by unit) / sum(n) over () as actual from u), c as (select k, last, actual, pow(k / last, 1.4) as target, 1 + (1 - (k - 1) / greatest(last - 1, 1)) as w from r) select sum(w * abs(target - actual)) as weighted_error, sum(case when k <= ceil(last * 0.2) then w * abs(target - actual) else 0 end) as early_error, max(actual - target) as overshoot, max(target - actual) as undershoot from c")
def prefix_error(spark, sf):
    from pyspark.sql import Window

    p = timeline.progress(_occurrences(spark, sf))  # one row a day
    n = p.agg(F.count(F.lit(1)).alias("last"))
    k = F.row_number().over(Window.orderBy("unit")).alias("unit")
    curve = p.select(k, F.col("progress").alias("actual")).join(F.broadcast(n), F.lit(True)).select("unit", "actual", F.pow(F.col("unit") / F.col("last"), F.lit(1.4)).alias("target"))
    return timeline.prefix_error(curve)


@query("with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e, label from embeddings), s as (select a.vec_id as q, b.vec_id as c, a.label = b.label as positive, round(list_dot_product(a.e, b.e), 6) as score from v a join v b on b.vec_id <> a.vec_id where a.vec_id % 100 = 0), r as (select *, row_number() over (partition by q order by score desc, c) as k from s), f as (select q, min(k) as k from r where positive group by q) select count(*) as samples, avg(case when k = 1 then 1.0 else 0.0 end) as top1, avg(1 / k) as mrr from f")
def encoder_mrr(spark, sf):
    """Vectors with an id divisible by 100 against all vectors."""
    return reports.encoder_ranks(table(prepare(spark), sf, "embeddings"))


@query(f"with {PARA} select doc_id, p as paragraph_index, case when len(w) = 0 then 0.0 else len(list_filter(w, lambda x: list_contains({sorted({*T.GERMAN, *T.LATIN})}, x))) / len(w) end as foreign_ratio from (select doc_id, p, regexp_extract_all(lower(t), '[A-Za-zÀ-ž'']+') as w from para)")
def foreign_ratio(spark, sf):
    return corpus.paragraph_rows(docs(spark, sf)).select("doc_id", "paragraph_index", T.foreign_ratio(F.col("text")).alias("foreign_ratio"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) = 1")
def best_per_key(spark, sf):
    rows = table(prepare(spark), sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return timeline.first_by(rows, ["l_orderkey"], -F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"))


@query(f"with {PARA}, s as (select doc_id, p, lower(t) as k from para) select k as entry, min_by(doc_id, doc_id * 1000000 + p) as doc_id, count(*) as uses from s group by k")
def first_seen_entries(spark, sf):
    rows = corpus.paragraph_rows(docs(spark, sf)).select(F.lower("text").alias("entry"), "doc_id")
    return rows.groupBy("entry").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("uses"))


@query("with s as (select l_orderkey as k, l_linenumber as id, cast(l_quantity as bigint) as a, cast(l_quantity + 5 as bigint) as e from lineitem) select x.k as l_orderkey, x.id as left_id, y.id as right_id from s x join s y on x.k = y.k and x.id < y.id and x.a <= y.e and y.a <= x.e")
def span_conflicts(spark, sf):
    rows = table(prepare(spark), sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity") + 5).cast("long").alias("end"))
    return reports.overlaps(rows, ["l_orderkey"]).select("l_orderkey", "left_id", "right_id")


@query("select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', chr(1)), '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_'), '{', '\\{'), '}', '\\}'), chr(1), '\\textbackslash{}') as latex from documents".replace("\\\\", "\\"))
def latex_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.escape_latex(F.col("text")).alias("latex"))


@query()
def czech_order(spark, sf):
    """Distinct words with their place keys in the Czech alphabet."""
    words = docs(spark, sf).select(F.explode(T.tokens(F.col("text"))).alias("w")).where(T.token_kind(F.col("w")) == "word").select(F.lower("w").alias("w")).distinct()
    return words.select("w", T.czech_sort_key(F.col("w")).alias("sort_key"))


@query()
def policy_gates(spark, sf):
    """Gates of all word links, with parts of speech by the analyser."""
    from ..operators import planning
    from .planner_queries import alignment

    rows = alignment(spark, sf).where("status = 'sentence_safe'")
    keys = ["pair_id", "source_paragraph", "source_start"]
    words = rows.select(*keys, F.explode("links").alias("l")).select(*keys, F.col("l.source").alias("source_token"), F.col("l.target").alias("target_token"), "l.relation", F.col("l.score").alias("token_score"), "l.source_upos", "l.target_upos")
    return planning.gated(words, rows.select(*keys, "score"), planning.Gates(require_low_false_friend_risk=True, require_low_inflection_risk=True))


@query()
def family_schedule(spark, sf):
    """All families as one book, with a late-fill phase: options stay distributed."""
    from ..operators import schedule

    options = schedule.options_of(timeline.timeline(_occurrences(spark, sf)))
    return schedule.scheduled(options, late_steps=50, late=1.0)


@query()
def family_schedule_report(spark, sf):
    from ..operators import schedule

    options = materialize(schedule.options_of(timeline.timeline(_occurrences(spark, sf))))
    return schedule.report(schedule.scheduled(options), options)


@query()
def hybrid_sentences(spark, sf):
    from ..operators import planning

    return planning.hybrid_sentences(*_linked(docs(spark, sf)))


@query()
def hybrid_diff(spark, sf):
    from ..operators import planning

    return planning.hybrid_diff(planning.hybrid_sentences(*_linked(docs(spark, sf))))


@query()
def dictionary(spark, sf):
    from ..operators import planning

    return planning.dictionary(*_linked(docs(spark, sf)))


@query("with recursive t as (select l_orderkey as s, cast(l_linenumber as bigint) as k from lineitem group by all), up as (select s, k, k as root from t union select up.s, up.k, up.root // 2 from up where up.root // 2 > 0 and exists (select 1 from t where t.s = up.s and t.k = up.root // 2)) select s as sentence_id, root, count(*) as size from up group by s, root")
def tree_closure(spark, sf):
    """Tokens are the line numbers of an order; a token's head is half its number."""
    from ..operators import planning

    t = table(prepare(spark), sf, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), F.col("l_linenumber").cast("long").alias("token")).distinct()
    heads = t.select("sentence_id", "token", F.floor(F.col("token") / 2).cast("long").alias("head"))
    kept = heads.join(t.select("sentence_id", F.col("token").alias("head"), F.lit(True).alias("there")), ["sentence_id", "head"], "left")
    return planning.subtrees(kept.select("sentence_id", "token", F.when(F.col("there"), F.col("head")).otherwise(F.lit(0).cast("long")).alias("head"))).select("sentence_id", "root", "size")


@query(f"with {PARA}, g as (select doc_id, p, {SQUEEZED.format('t')} as z from para), b as (select doc_id, p, unnest(list_transform(range(1, greatest(len(z) - 2, 1) + 1), lambda i: ('0x' || substr(md5(substr(z, i, 3)), 1, 8))::bigint % 128)) as k from g), c as (select doc_id, p, k, count(*) as n from b group by all) select doc_id, p as paragraph_index, cast(k as integer) as bucket, n / sqrt(sum(n * n) over (partition by doc_id, p)) as weight from c")
def hashed_vectors(spark, sf):
    """Non-zero places of the vectors of all paragraphs."""
    rows = corpus.paragraph_rows(docs(spark, sf))
    return rows.select("doc_id", "paragraph_index", F.posexplode(T.hashed_trigrams(F.col("text"))).alias("bucket", "weight")).where("weight > 0")


@query(f"with {PARA}, r as (select doc_id // 2 as pair_id, doc_id % 2 as side, t, p, row_number() over (partition by doc_id, t order by p) as k from para) select cast(a.pair_id as bigint) as pair_id, a.t as text, a.p as a_paragraph_index, b.p as b_paragraph_index from r a join r b on a.pair_id = b.pair_id and a.t = b.t and a.k = b.k and a.side = 0 and b.side = 1")
def repeated_lines(spark, sf):
    from ..operators import lookups

    return lookups.repeated_lines(docs(spark, sf))


@query("select distinct l_orderkey, cast(l_linenumber as bigint) as at from lineitem t where exists (select 1 from lineitem s where s.l_orderkey = t.l_orderkey and t.l_linenumber between cast(s.l_quantity as bigint) and cast(s.l_quantity as bigint) + 3)")
def tokens_in_spans(spark, sf):
    from ..operators import lookups

    li = table(prepare(spark), sf, "lineitem")
    tokens = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("at")).distinct()
    spans = li.select("l_orderkey", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + 3).alias("end"))
    return lookups.inside(tokens, spans, ["l_orderkey"])


@query(f"with {PARA} select doc_id, min(p) as paragraph_index from para where contains(lower(t), 'the') group by doc_id")
def anchor_search(spark, sf):
    from ..operators import lookups

    return lookups.anchors(docs(spark, sf), "The")


@query(f"with {SIDES}, x as (select pair_id, n, m, p as source_index, case when n <= 1 or m <= 1 then 1 else cast(round_even((p - 1) / greatest(n - 1, 1) * (m - 1), 0) as integer) + 1 end as expected from pairs join para on doc_id = a) select pair_id, source_index, expected, cast(greatest(0, least(m, expected + 3) - greatest(1, expected - 3) + 1) as integer) as window, {_POS.format('source_index', 'expected')} as position from x".replace(" as window,", ' as "window",'))
def expected_places(spark, sf):
    from ..operators import lookups

    return lookups.expected_places(docs(spark, sf))


@query(rf"with {PARA}, c as (select d.doc_id, cast(coalesce(sum(len(list_filter({TOKEN}, lambda w: regexp_matches(w, '\p{{L}}')))), 0) as integer) as words from documents d left join para using (doc_id) group by d.doc_id) select cast(doc_id // 20 as bigint) as book_id, cast(doc_id % 20 + 1 as integer) as chapter_index, words, cast(coalesce(sum(words) over (partition by doc_id // 20 order by doc_id rows between unbounded preceding and 1 preceding), 0) + 1 as bigint) as first_word from c")
def word_offsets(spark, sf):
    from ..operators import lookups

    return lookups.word_offsets(docs(spark, sf))


@query(f"with {SENT}, c as (select doc_id, count(*) as p from para group by doc_id), s as (select doc_id, count(*) as s from sent group by doc_id) select cast(d.doc_id // 20 as bigint) as book_id, count(*) as chapters, cast(sum(coalesce(c.p, 0)) as bigint) as paragraphs, cast(sum(coalesce(s.s, 0)) as bigint) as sentences from documents d left join c using (doc_id) left join s using (doc_id) group by 1")
def book_summary(spark, sf):
    from ..operators import lookups

    return lookups.book_summary(docs(spark, sf))


@query("with x as (select *, case when lag(role) over (partition by conv_id order by turn) = role then 0 else 1 end as n from conversations), y as (select *, sum(n) over (partition by conv_id order by turn) as r from x) select conv_id, min(turn) as first_turn, max(turn) as last_turn, min(role) as role, count(*) as turns from y group by conv_id, r")
def merged_turns(spark, sf):
    from ..operators import lookups

    return lookups.merged_turns(table(prepare(spark), sf, "conversations"))


@query("select user_id as family, count(*) as n, least(1.0, count(*) / 4) * 0.45 + avg(cast(event_id % 7 as double) / 7) * 0.30 + avg(cast(event_id % 5 as double) / 5) * 0.25 as trust from events group by user_id")
def family_trust(spark, sf):
    from ..operators import lookups

    e = table(prepare(spark), sf, "events")
    return lookups.family_trust(e.select(F.col("user_id").alias("family"), ((F.col("event_id") % 7).cast("double") / 7).alias("score"), ((F.col("event_id") % 5).cast("double") / 5).alias("similarity")))


@query("select lang, cast(sum(n_chars) as bigint) as weight, sum((doc_id % 10) * n_chars) / sum(n_chars) as average from documents group by lang")
def weighted_averages(spark, sf):
    from ..operators import lookups

    return lookups.weighted_average(docs(spark, sf).select("lang", (F.col("doc_id") % 10).alias("v"), "n_chars"), ["lang"], "v", "n_chars")


@query(f"with {PARA} select doc_id, p as paragraph_index, case when contains(x, ' mit uns ') then 'mit uns' when contains(x, ' of the ') then 'of the' when contains(x, ' in der ') then 'in der' when contains(x, ' de la ') then 'de la' end as phrase from (select doc_id, p, ' ' || replace({SLUG.format('t')}, '-', ' ') || ' ' as x from para)")
def foreign_phrases(spark, sf):
    from ..operators import lookups

    return lookups.longest_phrase(corpus.paragraph_rows(docs(spark, sf)), ["de la", "of the", "in der", "mit uns"]).select("doc_id", "paragraph_index", "phrase")


@query()
def link_rationales(spark, sf):
    """Signals, label, depth and reasons of each sentence link."""
    links = sequence.sentence_links(docs(spark, sf)).withColumn("signals", T.sentence_score(F.col("source_text"), F.col("target_text")))
    label = T.confidence(F.round("score", 6))
    return links.select("pair_id", "source_paragraph", "source_start", "target_start", F.round("score", 6).alias("score"), label.alias("label"), T.safe_depth(label).alias("depth"), T.rationale(F.col("signals")).alias("rationale"))


@query()
def progression_steps(spark, sf):
    from ..operators import progression

    return progression.progressions(*progression.token_options(*_linked(docs(spark, sf))))


from . import book_queries, planner_queries, policy_queries  # noqa: E402, F401  add their queries

"""Queries of policy selection, with the SQL of its reports. In the reports order lines stand in for decisions: an order
is a pair, a part a family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning, policy, reports, sequence
from ..session import materialize, prepare, table
from .queries import docs, query


def _sources(spark, sf):
    links = materialize(sequence.sentence_links(docs(spark, sf)).where(F.col("score") >= 0.45))
    texts = links.select("pair_id", "source_paragraph", "source_start", "source_text", "target_text")
    return links, texts, materialize(planning.with_families(sequence.word_links(links), texts))


@query()
def policy_words(spark, sf):
    """A decision on every word link of every pair."""
    links, texts, tokens = _sources(spark, sf)
    return policy.select_words(planning.gated(tokens, links), texts)


@query()
def policy_phrases(spark, sf):
    """A decision on every phrase of every pair."""
    _, texts, tokens = _sources(spark, sf)
    return policy.select_structures(reports.consecutive_phrases(tokens), texts)


_LINES = """d as (select l_orderkey as pair_id, l_linenumber as k, l_partkey % 5 as family, case when l_suppkey % 3 = 0 then 'phrase' else 'subtree' end as depth, case when l_suppkey % 2 = 0 then 'A' else 'B' end as unit_class, 0.5 as weight, l_returnflag <> 'N' as selected,
case when l_returnflag <> 'N' then 'best_positive_candidate' when l_partkey % 4 = 0 then 'content_weight_below_0.45' else 'alignment_confidence_below_threshold' end as reason from lineitem),
t as (select o_orderkey as pair_id, cast(o_custkey % 8 as double) as content from orders)"""
_REVIEW = f"""{_LINES},
f as (select pair_id, sum(weight) filter (selected) as used, count(*) filter (selected) as selected, count(distinct family) filter (selected) as families, count(*) filter (not selected) as blocked,
      count(*) filter (reason = 'alignment_confidence_below_threshold') as unsure, count(*) filter (reason = 'content_weight_below_0.45') as light, count(*) filter (selected and depth = 'subtree') as deep from d group by pair_id),
a as (select t.pair_id, case when content > 0 then coalesce(used, 0) / content else 0 end as actual, coalesce(selected, 0) as selected, coalesce(families, 0) as families, coalesce(blocked, 0) as blocked, coalesce(unsure, 0) as unsure, coalesce(light, 0) as light, coalesce(deep, 0) as deep from t left join f using (pair_id)),
review as (select pair_id, round(actual, 6) as actual, 0.3::double as target, round(greatest(0.3::double - actual, 0), 6) as gap, selected, families, blocked,
      coalesce(nullif(concat_ws('; ', case when actual < 0.15 then '{policy.LOW}' end, case when unsure > blocked * 0.6 then '{policy.UNSURE}' end, case when light > 0 then '{policy.LIGHT}' end, case when selected > 0 and deep = selected then '{policy.DEEP}' end), ''), '{policy.FINE}') as recommendations from a)"""


def _decisions(spark, sf):
    chosen, confident = F.col("l_returnflag") != "N", F.when(F.col("l_partkey") % 4 == 0, "content_weight_below_0.45").otherwise("alignment_confidence_below_threshold")
    return table(prepare(spark), sf, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 5).alias("family"), F.when(F.col("l_suppkey") % 3 == 0, "phrase").otherwise("subtree").alias("depth"),
        F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B").alias("unit_class"), F.lit(0.5).alias("weight"), chosen.alias("selected"), F.when(chosen, "best_positive_candidate").otherwise(confident).alias("reason"),
    )


def _reviews(spark, sf):
    totals = table(prepare(spark), sf, "orders").select(F.col("o_orderkey").alias("pair_id"), (F.col("o_custkey") % 8).cast("double").alias("content"))
    return policy.review(_decisions(spark, sf), totals, 0.3)


@query(f"with {_REVIEW} select * from review")
def policy_review(spark, sf):
    return _reviews(spark, sf)


@query(f"with {_REVIEW} select count(*) as pairs, round(avg(actual), 6) as mean_actual, round(avg(target), 6) as mean_target, cast(sum(selected) as bigint) as selected, cast(sum(families) as bigint) as families, cast(sum(blocked) as bigint) as blocked, count(*) filter (actual < target * 0.5) as under_target from review")
def policy_benchmark(spark, sf):
    return policy.benchmark(_reviews(spark, sf))


@query(f"with {_LINES}, k as (select pair_id, selected, 'reason' as kind, reason as value from d union all select pair_id, selected, 'depth', depth from d where selected union all select pair_id, selected, 'unit_class', unit_class from d where selected) select pair_id, selected, kind, value, count(*) as n from k group by all")
def policy_breakdown(spark, sf):
    return policy.breakdown(_decisions(spark, sf))


@query(f"with {_LINES}, c as (select pair_id, family, count(*) as n, min(k) as seen from d where selected group by all) select pair_id, cast(row_number() over (partition by pair_id order by n desc, seen, family) as integer) as rank, family, n from c qualify rank <= 12")
def policy_top_families(spark, sf):
    return policy.top_families(_decisions(spark, sf), ["k"])

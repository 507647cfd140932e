"""Policy selection: which word links, phrases or subtrees of a pair of texts are used at a policy level, and its reports.

Gates, classes and all parts of a score that don't hang on other choices are column expressions. Only the walk over one
pair's options, where each choice moves the share of content reached so far, is a kernel; pairs run side by side, and a
pair is no longer than its two chapters.

Defined results: a pair without options has no decisions; one without content words selects words by the other parts of
the score and phrases not at all. Equal scores keep reading order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import prepare
from .planning import Gates, ambiguity_risk, content_weight, inflection_risk, unnaturalness

#: What support of a depth adds; least totals to be used (words: more than; known families, structures).
COHESION = {"token": 0.0, "phrase": 0.15, "subtree": 0.3}
LEAST_KNOWN, LEAST_STRUCTURE, WORST_FIT, KNOWN_BONUS = -0.1, 0.2, -0.05, 0.1
#: By granularity the lowest scores of the classes in order, what cohesion adds, and both penalties.
STRUCTURES = {"phrase": ([("A", 0.84), ("B", 0.68)], 0.25, 0.08, 0.1), "subtree": ([("B", 0.82), ("C", 0.6)], 0.35, 0.04, 0.15)}
#: The sentences of the review.
LOW = "planner is materially below target surface; review gates before generation"
UNSURE = "alignment confidence is the main limiter; calibrate thresholds or widen accepted high-confidence rows"
LIGHT = "low-content function words are being filtered from L1 as intended"
DEEP = "all accepted L1 substitutions currently rely on subtree support, which is conservative but stable"
FINE = "current policy plan is balanced enough to move into text materialization experiments"


@dataclass(frozen=True)
class Weights:
    target_fit: float = 1.0
    didactic_value: float = 0.5
    cohesion_bonus: float = 0.5
    unnaturalness_penalty: float = 0.5
    inflection_risk_penalty: float = 0.5
    ambiguity_risk_penalty: float = 0.5


@dataclass(frozen=True)
class Level:
    """target: share of the content that is to be replaced; classes that may be; content_least: lightest word."""

    target: float = 0.3
    classes: tuple[str, ...] = ("A", "B")
    content_least: float = 0.0
    gates: Gates = field(default_factory=Gates)
    weights: Weights = field(default_factory=Weights)

    def __post_init__(self):
        if not 0 <= self.target <= 1:
            raise ValueError("target must be from 0 to 1")
        if set(self.classes) - set("ABCD"):
            raise ValueError("classes are A, B, C and D")


def word_class(relation: Column, score: Column, related: Column | None = None) -> Column:
    """A to D of a word link; related: both words have a place in a tree."""
    sure = relation.isin("exact", "lemma_like") | (score >= 0.82)
    likely = relation.isin("upos_cognate", "cognate") & (score >= 0.7)
    return F.when(sure, "A").when(likely, "B").when(F.lit(False) if related is None else related, "C").otherwise("D")


def structure_class(granularity: str, score: Column) -> Column:
    out = F.lit("D")
    for name, least in reversed(STRUCTURES[granularity][0]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def content(texts: DataFrame) -> DataFrame:
    """Sentences (pair_id, source_text) -> pair_id, content: the weight of all their words, parts of speech unknown."""
    words = F.size(F.filter(T.tokens(F.col("source_text")), lambda t: T.token_kind(t) == "word"))
    return texts.groupBy("pair_id").agg((F.sum(words) * content_weight(F.lit(None).cast("string"))).alias("content"))


def choose_words(weight, share, base, usable, family, total: float, target: float, fit: float, value: float, known=()) -> tuple[list, list]:
    """Arrays of a pair's options in reading order -> (total score, or None where not usable; way of selection, or None).

    Every option moves reading on by its weight, so the goal at each is known beforehand; only the share reached and the
    families taken so far change. A family taken before is worth more and is passed on down to a slightly negative score.
    """
    scale = 1 / total if total else 0.0
    goals, steps = target * np.cumsum(weight) * scale, np.asarray(weight) * scale
    known, reached, scores, ways = set(known), 0.0, [None] * len(base), [None] * len(base)
    for k in np.flatnonzero(usable):
        again = family[k] in known
        nearer = abs(goals[k] - reached) - abs(goals[k] - reached - steps[k])
        worth = min(share[k] + KNOWN_BONUS, 1.0) if again else share[k]
        scores[k] = float(base[k] + fit * max(nearer, WORST_FIT) + value * worth)
        if scores[k] > (LEAST_KNOWN if again else 0.0):
            ways[k] = "family_propagation" if again else "best_positive_candidate"
            reached += steps[k]
            known.add(family[k])
    return scores, ways


def select_words(options: DataFrame, texts: DataFrame, level: Level = Level()) -> DataFrame:
    """planning.gated() rows with their family, and the sentences that they come from -> a decision on each word link:
    unit_class, weight, total_score, selected and reason (of its selection, or why it is blocked)."""
    prepare(options.sparkSession)
    keys = ["pair_id", "source_paragraph", "source_start", "source_token"]
    w, relation, score = level.weights, F.col("relation"), F.col("token_score")
    depths = F.create_map(*[F.lit(x) for kv in COHESION.items() for x in kv])
    rows = options.withColumns({"unit_class": word_class(relation, score), "weight": content_weight(F.lit(None).cast("string"))})
    light = F.when(F.col("weight") < level.content_least, f"content_weight_below_{level.content_least:.2f}")
    other = F.when(~F.col("unit_class").isin(*level.classes), F.concat(F.lit("unit_class_"), "unit_class", F.lit("_not_allowed")))
    base = w.cohesion_bonus * F.element_at(depths, F.col("depth")) - w.unnaturalness_penalty * unnaturalness(relation)
    base = base - w.inflection_risk_penalty * inflection_risk(relation) - w.ambiguity_risk_penalty * ambiguity_risk(score)
    of = lambda *c: F.count(F.lit(1)).over(Window.partitionBy(*c))
    rows = rows.withColumns({"blocked": F.coalesce("reason", light, other), "base": base, "share": of("pair_id", "family") / of("pair_id")})
    rows = rows.join(content(texts), "pair_id").select(*keys, "family", "depth", "unit_class", "weight", "blocked", "base", "share", "content")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, ignore_index=True)
        usable = pdf["blocked"].isna().to_numpy()
        scores, ways = choose_words(pdf["weight"].to_numpy(), pdf["share"].to_numpy(), pdf["base"].to_numpy(), usable, pdf["family"].tolist(), pdf["content"].iloc[0], level.target, w.target_fit, w.didactic_value)
        pdf["total_score"], pdf["selected"] = pd.Series(scores, dtype="float64"), [x is not None for x in ways]
        pdf["reason"] = [x or (b if b is not None and b == b else "non_positive_total_score") for x, b in zip(ways, pdf["blocked"])]
        return pdf[[*keys, "family", "depth", "unit_class", "weight", "total_score", "selected", "reason"]]

    return rows.groupBy("pair_id").applyInPandas(run, "pair_id long, source_paragraph int, source_start int, source_token int, family string, depth string, unit_class string, weight double, total_score double, selected boolean, reason string")


def choose_structures(place, first, last, weight, base, blocked, total: float, target: float, fit: float) -> tuple[list, list, list]:
    """Arrays of a pair's structures, in order of sentences and falling score -> (total score or None, selected, reason).

    Tokens of a sentence are used once; a structure is judged by the share that it would make, against the target's part
    of it."""
    scale = 1 / total if total else 0.0
    taken: dict[object, list[tuple[int, int]]] = {}
    reached, scores, used, why = 0.0, [None] * len(base), [False] * len(base), list(blocked)
    for k in range(len(base)):
        spans = taken.setdefault(place[k], [])
        if any(a <= last[k] and first[k] <= b for a, b in spans):
            why[k] = "span_overlap_with_selected_action"
        elif why[k] is None:
            after = reached + weight[k] * scale
            nearer = abs(target * after - reached) - abs(target * after - after)
            scores[k] = float(base[k] + fit * max(nearer, WORST_FIT))
            used[k] = scores[k] > LEAST_STRUCTURE
            why[k] = "structural_action" if used[k] else "non_positive_total_score"
            if used[k]:
                spans.append((first[k], last[k]))
                reached = after
    return scores, used, why


def select_structures(spans: DataFrame, texts: DataFrame, granularity: str = "phrase", level: Level = Level(classes=("A", "B", "C"))) -> DataFrame:
    """Phrases or subtrees (pair_id, source_paragraph, source_start, source_first, source_last, score) and their
    sentences -> a decision on each, with the columns of select_words()."""
    from .spans import span_weight

    prepare(spans.sparkSession)
    sentence = ["pair_id", "source_paragraph", "source_start"]
    _, cohesion, unnatural, inflected = STRUCTURES[granularity]
    w, score = level.weights, F.col("score")
    rows = spans.join(texts.select(*sentence, T.tokens(F.col("source_text")).alias("tokens")), sentence)
    nothing = F.transform("tokens", lambda t: F.lit(None).cast("string"))
    rows = rows.withColumns({"weight": span_weight(F.col("tokens"), nothing, F.col("source_first"), F.col("source_last")), "unit_class": structure_class(granularity, score)})
    width = F.greatest(F.col("source_last") - F.col("source_first") + 1, F.lit(1))
    value = F.least(F.greatest(F.col("weight") / 2, width / 4), F.lit(1.0))
    doubt = F.when(score >= 0.9, 0.0).when(score >= 0.8, 0.08).otherwise(0.2)
    fixed = w.cohesion_bonus * cohesion - w.unnaturalness_penalty * unnatural - w.inflection_risk_penalty * inflected
    base = score * 0.6 + value * w.didactic_value - doubt * w.ambiguity_risk_penalty + fixed
    blocked = F.coalesce(
        F.when(F.col("weight") <= 0, "empty_structural_span"),
        F.when(~F.col("unit_class").isin(*level.classes), F.concat(F.lit("unit_class_"), "unit_class", F.lit("_not_allowed"))),
        F.when(score < level.gates.minimum_alignment_confidence, "alignment_confidence_below_threshold"),
    )
    rows = rows.withColumns({"base": base, "blocked": blocked}).join(content(texts), "pair_id").select(*sentence, "source_first", "source_last", "score", "unit_class", "weight", "base", "blocked", "content")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = [*sentence, "score", "source_first", "source_last"]
        pdf = pdf.sort_values(order, ascending=[True, True, True, False, True, True], ignore_index=True)
        places = list(zip(pdf["source_paragraph"], pdf["source_start"]))
        blocked = [None if b is None or b != b else b for b in pdf["blocked"]]
        scores, used, why = choose_structures(places, pdf["source_first"].tolist(), pdf["source_last"].tolist(), pdf["weight"].tolist(), pdf["base"].tolist(), blocked, pdf["content"].iloc[0], level.target, w.target_fit)
        pdf["total_score"], pdf["selected"], pdf["reason"] = pd.Series(scores, dtype="float64"), used, why
        return pdf[[*sentence, "source_first", "source_last", "unit_class", "weight", "total_score", "selected", "reason"]]

    return rows.groupBy("pair_id").applyInPandas(run, "pair_id long, source_paragraph int, source_start int, source_first int, source_last int, unit_class string, weight double, total_score double, selected boolean, reason string")


def review(decisions: DataFrame, totals: DataFrame, target: float) -> DataFrame:
    """Decisions (pair_id, family, depth, weight, selected, reason) and totals (pair_id, content) -> a row each pair: the
    share reached, the gap, counts, and recommendations."""
    chosen = lambda c: F.when(F.col("selected"), c)
    blocked = lambda reason: F.count(F.when(~F.col("selected") & F.col("reason").startswith(reason), 1))
    found = decisions.groupBy("pair_id").agg(
        F.sum(chosen(F.col("weight"))).alias("used"), F.count(chosen(F.lit(1))).alias("selected"), F.countDistinct(chosen(F.col("family"))).alias("families"), F.count(F.when(~F.col("selected"), 1)).alias("blocked"),
        blocked("alignment_confidence_below_threshold").alias("unsure"), blocked("content_weight_below_").alias("light"), F.count(F.when(F.col("selected") & (F.col("depth") == "subtree"), 1)).alias("deep"),
    )
    rows = totals.join(found, "pair_id", "left").na.fill(0)
    share = F.when(F.col("content") > 0, F.col("used") / F.col("content")).otherwise(0.0)
    rows = rows.withColumn("actual", share)
    said = F.array_compact(
        F.array(
            F.when(F.col("actual") < target * 0.5, LOW), F.when(F.col("unsure") > F.col("blocked") * 0.6, UNSURE),
            F.when(F.col("light") > 0, LIGHT), F.when((F.col("selected") > 0) & (F.col("deep") == F.col("selected")), DEEP),
        )
    )
    rows = rows.withColumn("said", said)
    return rows.select("pair_id", F.round("actual", 6).alias("actual"), F.lit(target).alias("target"), F.round(F.greatest(F.lit(target) - F.col("actual"), F.lit(0.0)), 6).alias("gap"), "selected", "families", "blocked", F.when(F.size("said") > 0, F.array_join("said", "; ")).otherwise(FINE).alias("recommendations"))


def breakdown(decisions: DataFrame) -> DataFrame:
    """How often each reason, depth and class stands among a pair's decisions: pair_id, selected, kind, value, n."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("reason", "depth", "unit_class")])).alias("k")
    return decisions.select("pair_id", "selected", kinds).select("pair_id", "selected", "k.*").where(F.col("selected") | (F.col("kind") == "reason")).groupBy("pair_id", "selected", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def top_families(decisions: DataFrame, order: list[str], n: int = 12) -> DataFrame:
    """The n families that a pair's selections have most often, of equal ones the first seen in order, then the smallest."""
    from .spans import first_of_each

    counted = decisions.where("selected").groupBy("pair_id", "family").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("seen"))
    return first_of_each(counted, ["pair_id"], n, F.col("n").desc(), F.col("seen"), F.col("family")).select("pair_id", "rank", "family", "n")


def benchmark(reviews: DataFrame) -> DataFrame:
    """review() rows -> one row over all pairs: means, sums, and pairs under half their target."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    under = F.count(F.when(F.col("actual") < F.col("target") * 0.5, 1))
    return reviews.agg(F.count(F.lit(1)).alias("pairs"), mean("actual").alias("mean_actual"), mean("target").alias("mean_target"), *[total(c).alias(c) for c in ("selected", "families", "blocked")], under.alias("under_target"))

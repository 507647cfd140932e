"""Enrichment of safe sentence links: parallel tree walk, word links, embedding fallback, promoted spans, summary.

A sentence pair is one row; its tokens are arrays of structs made by an analyser (a column factory), and everything else
is a column expression over these arrays, so no row leaves the JVM and nothing is joined or exploded. Trees are walked
as a fold over the source's words from the roots down: the state holds the nodes matched so far, and a word finds its
candidates among the children of the target node that its own head was matched with. The work of a sentence grows with
the square of its words.

Defined results: null texts have no tokens. A word whose head is null, missing or no word hangs nowhere and is never
reached; circles of heads end where they close. Of equal scores the earlier target is taken. Without roots the first
word is one. A link that isn't sentence-safe keeps its tokens and has no links or candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: How alike two nodes must be to be matched as roots or as children, to be a word link, to be a phrase by themselves.
ROOT, CHILD, WORD, PHRASE = 0.40, 0.43, 0.46, 0.70
#: Fixed value: what a sentence link must score, rounded to six places, to be sentence-safe.
SAFE = 0.45
#: A fallback link's least and greatest score, its bonuses for part of speech, relation, and trigrams.
FALLBACK, MOST, BONUS = 0.72, 0.99, (0.08, 0.04, 0.08)
#: Relations of links that no analysis stands behind, the strongest first.
WEAK = ["embedding_assisted", "dictionary", "manual_forced"]

_LINK = "array<struct<source:int,target:int,source_text:string,target_text:string,source_lemma:string,target_lemma:string,relation:string,score:double,source_upos:string,target_upos:string,source_deprel:string,target_deprel:string,norm:double>>"
_SPAN = "array<struct<source_start:int,source_end:int,target_start:int,target_end:int,words:int,score:double,relation:string,source_root:int,target_root:int,children:int,source_text:string,target_text:string,lemma:double,upos:double,deprel:double,embedding:double>>"

Analyser = Callable[[Column, str], Column]
Encoder = Callable[[Column], Column]


def analysed(text: Column, language: str) -> Column:
    """The built-in analyser: tokens with index, text, kind, normalized, lemma, is_stopword, upos, head, deprel.

    Forms and lemmas are by rule. Without a model, tags stand in for real ones: numbers are NUM, stopwords PART, words
    with a capital inside a sentence PROPN, all others NOUN; the words of a sentence form a heap, so the head of the k-th
    word is the word k/2, and its relation nsubj or obl. A real analyser is any function to the same array.
    """

    def tagged(t, k):
        plain = t.rlike("^[a-z]+$")  # most tokens: words in their normalised form

        def of(kind, n, stop, known):
            return F.struct(
                (k + 1).cast("int").alias("index"), t.alias("text"), kind.alias("kind"), n.alias("normalized"), T.lemma_of(kind, n, language).alias("lemma"), stop.alias("is_stopword"),
                F.when(kind == "number", "NUM").when(stop, "PART").when((kind == "word") & (k > 0) & ~known & t.rlike(r"^\p{Lu}"), "PROPN").when(kind == "word", "NOUN").otherwise("PUNCT").alias("upos"),
            )

        # Kind, form and stopword are made once a token.
        form = lambda kind, known: F.when(known | (kind == "punct"), t).otherwise(T.squeezed(t))
        return T.let(plain, lambda known: T.let(F.when(known, "word").otherwise(T.token_kind(t)), lambda kind: T.let(form(kind, known), lambda n: T.let(T.stopword_of(kind, n, language), lambda stop: of(kind, n, stop, known)))))

    def hung(ts):
        def heads(places):
            def head(x, k):
                at = F.when(x["kind"] != "word", F.lit(None)).when(k == 1, 0).otherwise(F.element_at(places, F.floor(k / 2).cast("int")))
                return F.struct(*[x[c].alias(c) for c in ("index", "text", "kind", "normalized", "lemma", "is_stopword", "upos")], at.cast("int").alias("head"), F.when(x["kind"] != "word", F.lit(None)).when(k == 1, "root").when(k % 2 == 0, "nsubj").otherwise("obl").alias("deprel"))

            return F.transform(ts, lambda x: T.let(F.array_position(places, x["index"]).cast("int"), lambda k: head(x, k)))

        return T.let(F.transform(F.filter(ts, lambda x: x["kind"] == "word"), lambda x: x["index"]), heads)

    return T.let(T.let(F.transform(T.tokens(F.coalesce(text, F.lit(""))), tagged), lambda ts: ts), hung)


def _words(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x["kind"] == "word")


def nodes(tokens: Column, encoder: Encoder | None = None) -> Column:
    """The words of a tree as nodes, from the roots down: what a token has, its parent (0: a root), depth, and the first and
    last place, size, text and sets of all words below it."""
    words = _words(tokens)

    def with_paths(ws):
        at = F.transform(ws, lambda x: x["index"])
        rooted = F.exists(ws, lambda x: F.coalesce(x["head"] == 0, F.lit(False)))

        def hung(y):
            parent = lambda x: F.when(x["head"] == 0, 0).when(~y["rooted"] & (x["index"] == y["at"][0]), 0).otherwise(x["head"])
            # Places of parents among the words, so that a step up is a look at one place.
            places = F.transform(ws, lambda x: F.coalesce(F.array_position(y["at"], parent(x)), F.lit(0)).cast("int"))

            def paths(above):
                def path(k):
                    def step(p, _):
                        up = F.element_at(above, F.element_at(p, -1))
                        return F.when((up == 0) | F.array_contains(p, up), p).otherwise(F.concat(p, F.array(up)))

                    return F.aggregate(above, F.array(k), step)

                return F.transform(ws, lambda x, k: F.struct(x.alias("own"), parent(x).cast("int").alias("parent"), (k + 1).cast("int").alias("place"), path((k + 1).cast("int")).alias("path")))

            return T.let(places, paths)

        return T.let(F.struct(at.alias("at"), rooted.alias("rooted")), hung)

    def featured(ps):
        def node(p):
            def of(below, text, vector=None):
                some = lambda c: F.array_distinct(F.filter(F.transform(below, lambda x: x[c]), lambda v: v.isNotNull() & (v != "")))
                parts = [F.size(p["path"]).alias("depth"), p["own"]["index"].alias("index"), p["parent"].alias("parent"), p["own"].alias("own"), below[0]["index"].alias("first"), F.element_at(below, -1)["index"].alias("last")]
                parts += [F.size(below).alias("size"), text.alias("text"), some("lemma").alias("lemmas"), some("upos").alias("upos"), some("deprel").alias("deprels"), _letters(text).alias("letters"), _letters(p["own"]["normalized"]).alias("own_letters")]
                return F.struct(*parts, *([vector.alias("vector"), T.held(vector).alias("held")] if encoder else []))

            def joined(below):
                text = F.array_join(F.transform(below, lambda x: x["text"]), " ")
                return T.let(text, lambda t: T.let(encoder(t), lambda v: of(below, t, v)) if encoder else of(below, t))

            return T.let(F.transform(F.filter(ps, lambda q: F.array_contains(q["path"], p["place"])), lambda q: q["own"]), joined)

        return F.array_sort(F.transform(ps, node), lambda x, y: F.when(x["depth"] != y["depth"], x["depth"] - y["depth"]).otherwise(x["index"] - y["index"]).cast("int"))

    return T.let(T.let(words, with_paths), featured)


def _letters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != ""))


def _overlap(a: Column, b: Column) -> Column:
    """Of two sets: both empty 1, one empty 0."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(T.let(F.size(F.array_intersect(a, b)), lambda common: common / (both - common)))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False)) & (F.coalesce(F.length(a), F.lit(0)) > 0)


def _norm(s: Column, t: Column) -> Column:
    return F.when(_same(s["own"]["normalized"], t["own"]["normalized"]), 1.0).otherwise(_overlap(s["own_letters"], t["own_letters"]))


def node_score(s: Column, t: Column) -> Column:
    lexical = lambda norm: F.when(_same(s["own"]["lemma"], t["own"]["lemma"]), 1.0).otherwise(norm)
    return T.let(_norm(s, t), lambda norm: 0.44 * lexical(norm) + 0.26 * _same(s["own"]["upos"], t["own"]["upos"]).cast("double") + 0.20 * _same(s["own"]["deprel"], t["own"]["deprel"]).cast("double") + 0.10 * norm)


def tree_score(s: Column, t: Column, vectors: bool = False) -> Column:
    """Of what hangs below two nodes."""
    sets = 0.24 * _overlap(s["lemmas"], t["lemmas"]) + 0.18 * _overlap(s["upos"], t["upos"]) + 0.18 * _overlap(s["deprels"], t["deprels"]) + 0.15 * (F.least(s["size"], t["size"]) / F.greatest(s["size"], t["size"])) + 0.10 * _overlap(s["letters"], t["letters"])
    return sets + 0.15 * T.held_dot(s["vector"], s["held"], t["vector"]) if vectors else sets


def walk(source: Column, target: Column, vectors: bool = False) -> Column:
    """nodes() of both sides -> array<struct<s, t, p, score, node>>: matched nodes, from the roots down (p: the source's parent).

    Children are taken in their order: each has the best later child of its head's match, if that is alike enough."""

    def taken(f, at, s, best):
        add = lambda name, v: F.concat(f[name], F.array(v)).alias(name)
        t = (-best["back"]).cast("int")
        last = F.concat(F.slice(f["last"], F.lit(1), at - 1), F.array(t), F.slice(f["last"], at + 1, F.size(f["last"])), F.array(F.lit(0))).alias("last")
        return F.struct(add("s", s["index"].cast("int")), add("t", t), add("p", s["parent"].cast("int")), last, add("score", best["score"]), add("node", best["node"]))

    def walked(parents):
        def step(f, s):
            def below(at):
                q, last = F.element_at(f["t"], at), F.element_at(f["last"], at)
                there = F.array_compact(F.transform(parents, lambda v, k: F.when(v == q, (k + 1).cast("int"))))
                scored = lambda t: T.let(node_score(s, t), lambda n: F.struct((0.55 * tree_score(s, t, vectors) + 0.45 * n).alias("score"), (-t["index"]).alias("back"), n.alias("node")))
                best = F.array_max(F.transform(there, lambda k: T.let(F.element_at(target, k), lambda t: F.when(t["index"] > last, scored(t)))))
                least = F.when(s["parent"] == 0, ROOT).otherwise(CHILD)
                return T.let(best, lambda x: F.when(x["score"] >= least, taken(f, at, s, x)).otherwise(f))

            at = F.array_position(f["s"], s["parent"].cast("int")).cast("int")
            return F.when(at > 0, T.let(at, below)).otherwise(f)

        # The state is flat arrays, one place a match: source, target, the source's parent, the last target below it, scores.
        start = F.struct(*[F.array(F.lit(v)).alias(c) for c, v in (("s", 0), ("t", 0), ("p", -1), ("last", 0), ("score", 1.0), ("node", 1.0))])
        rows = lambda f: F.transform(F.slice(F.sequence(F.lit(1), F.size(f["s"])), F.lit(2), F.size(f["s"])), lambda k: F.struct(*[F.element_at(f[c], k).alias(c) for c in ("s", "t", "p", "score", "node")]))
        return F.aggregate(source, start, step, rows)

    return T.let(F.transform(target, lambda t: t["parent"]), walked)


def _node(of: Column, index: Column) -> Column:
    return F.element_at(F.filter(of, lambda n: n["index"] == index), 1)


def _link(s: Column, t: Column, relation: Column, score: Column, norm: Column | None = None) -> Column:
    return F.struct(
        s["index"].alias("source"), t["index"].alias("target"), s["text"].alias("source_text"), t["text"].alias("target_text"), s["lemma"].alias("source_lemma"), t["lemma"].alias("target_lemma"),
        relation.alias("relation"), F.round(score, 6).alias("score"), s["upos"].alias("source_upos"), t["upos"].alias("target_upos"), s["deprel"].alias("source_deprel"), t["deprel"].alias("target_deprel"),
        F.round(F.lit(0.0) if norm is None else norm, 6).alias("norm"),
    )


def _span(s: Column, t: Column, score: Column, relation: str, children: Column, vectors: bool) -> Column:
    signals = [F.round(_overlap(s[a], t[a]), 6).alias(b) for a, b in (("lemmas", "lemma"), ("upos", "upos"), ("deprels", "deprel"))] if relation != "tree_walk" else [F.lit(None).cast("double").alias(b) for b in ("lemma", "upos", "deprel")]
    near = F.lit(None).cast("double") if relation == "tree_walk" else F.round(T.held_dot(s["vector"], s["held"], t["vector"]), 6) if vectors else F.lit(0.0)
    return F.struct(
        s["first"].alias("source_start"), s["last"].alias("source_end"), t["first"].alias("target_start"), t["last"].alias("target_end"), F.least(s["size"], t["size"]).alias("words"), F.round(score, 6).alias("score"), F.lit(relation).alias("relation"),
        s["index"].alias("source_root"), t["index"].alias("target_root"), children.cast("int").alias("children"), s["text"].alias("source_text"), t["text"].alias("target_text"), *signals, near.alias("embedding"),
    )


def _tree_results(source: Column, target: Column, found: Column, vectors: bool) -> Column:
    """struct<links, phrases, dependencies, subtrees> of a walk."""
    rows = F.transform(found, lambda m: F.struct(m.alias("m"), _node(source, m["s"]).alias("s"), _node(target, m["t"]).alias("t"), F.size(F.filter(found, lambda x: x["p"] == m["s"])).alias("children")))

    def of(rs):
        relation = lambda s, t: F.when(_same(s["normalized"], t["normalized"]), "exact").when(_same(s["lemma"], t["lemma"]), "lemma_like").when(_same(s["upos"], t["upos"]), "upos_cognate").otherwise("cognate")
        links = F.transform(F.filter(rs, lambda r: r["m"]["node"] >= WORD), lambda r: _link(r["s"]["own"], r["t"]["own"], relation(r["s"]["own"], r["t"]["own"]), r["m"]["node"], _norm(r["s"], r["t"])))
        phrase = lambda r: (r["children"] > 0) | ((r["m"]["node"] >= PHRASE) & (r["s"]["size"] > 1) & (r["t"]["size"] > 1))
        spans = lambda keep, name: F.transform(F.filter(rs, keep), lambda r: _span(r["s"], r["t"], r["m"]["score"], name, r["children"], vectors)).cast(_SPAN)
        return F.struct(
            F.array_sort(links, lambda x, y: (x["source"] - y["source"]).cast("int")).cast(_LINK).alias("links"), spans(phrase, "tree_phrase").alias("phrases"),
            spans(lambda r: r["m"]["node"] >= WORD, "tree_dependency").alias("dependencies"), spans(lambda r: r["m"]["p"] == 0, "tree_walk").alias("subtrees"),
        )

    return T.let(rows, of)


def _in_order(sources: Column, targets: Column, measure: Callable[[Column, Column], Column], least: float) -> Column:
    """Each source word with the best target word behind the one before it, if that measures `least` or more.
    measure gives struct<score, relation>."""

    def step(links, s):
        last = F.coalesce(F.array_max(F.transform(links, lambda x: x["target"])), F.lit(0))

        def scored(t):
            return T.let(measure(s, t), lambda m: F.struct(F.round(m["score"], 12).alias("score"), (-t["index"]).alias("back"), m["relation"].alias("relation"), t.alias("t")))

        def taken(b):
            new = F.array(_link(s, b["t"], b["relation"], F.least(b["score"], F.lit(1.0)))).cast(_LINK)
            return F.when(b["score"] >= least, F.concat(links, new)).otherwise(links)

        return T.let(last, lambda e: T.let(F.array_max(F.transform(F.filter(targets, lambda t: t["index"] > e), scored)), taken))

    return F.aggregate(sources, F.array().cast(_LINK), lambda links, s: step(links, s).cast(_LINK))


def _grams(word: Column) -> Column:
    return T.grams(F.coalesce(word, F.lit("")))


def _jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(T.let(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(a) + F.size(b) - common)))


def plain_links(source: Column, target: Column) -> Column:
    """Word links without trees: equal forms, equal lemmas, like forms with or without the same part of speech."""

    def measure(s, t):
        like = _jaccard(_grams(s["normalized"]), _grams(t["normalized"]))

        def of(x):
            score = F.when(_same(s["normalized"], t["normalized"]), 1.0).when(_same(s["lemma"], t["lemma"]), 0.92).when(_same(s["upos"], t["upos"]) & (x >= 0.28), F.least(x + 0.08, F.lit(0.9))).otherwise(x)
            relation = F.when(_same(s["normalized"], t["normalized"]), "exact").when(_same(s["lemma"], t["lemma"]), "lemma_like").when(_same(s["upos"], t["upos"]) & (x >= 0.28), "upos_cognate").when(x >= 0.35, "cognate").otherwise("weak")
            return F.struct(score.alias("score"), relation.alias("relation"))

        return T.let(like, of)

    return _in_order(_words(source), _words(target), measure, 0.45)


def completed(source: Column, target: Column, links: Column, encoder: Encoder | None) -> Column:
    """links, and links of words that have none yet: in order, by the cosine of their vectors and small bonuses."""
    if encoder is None:
        return links
    ends = lambda side: F.transform(links, lambda x: x[side])
    left = lambda tokens, side: T.let(ends(side), lambda there: F.filter(_words(tokens), lambda x: ~F.array_contains(there, x["index"])))
    free = lambda tokens, side: F.transform(left(tokens, side), lambda x: T.let(encoder(x["text"]), lambda v: x.withField("vector", v).withField("held", T.held(v)).withField("grams", _grams(x["normalized"]))))

    def measure(s, t):
        upos, deprel, chars = BONUS
        score = T.held_dot(s["vector"], s["held"], t["vector"]) + upos * _same(s["upos"], t["upos"]).cast("double") + deprel * _same(s["deprel"], t["deprel"]).cast("double") + chars * _jaccard(s["grams"], t["grams"])
        return F.struct(score.alias("score"), F.lit(WEAK[0]).alias("relation"))

    more = T.let(F.struct(free(source, "source").alias("a"), free(target, "target").alias("b")), lambda x: _in_order(x["a"], x["b"], measure, FALLBACK))
    capped = F.transform(more, lambda x: x.withField("score", F.least(x["score"], F.lit(MOST))))
    return F.array_sort(F.concat(links, capped), lambda x, y: F.when(x["source"] != y["source"], x["source"] - y["source"]).otherwise(x["target"] - y["target"]).cast("int"))


def runs(links: Column) -> Column:
    """Links in order of their source, cut where source or target don't go up by one."""
    kind = f"array<{_LINK}>"

    def step(found, x):
        cur = F.element_at(found, -1)
        end = F.element_at(cur, -1)
        follows = F.coalesce((x["source"] == end["source"] + 1) & (x["target"] == end["target"] + 1), F.lit(False))
        grown = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.concat(cur, F.array(x))))
        return F.when(F.size(found) == 0, F.array(F.array(x))).when(follows, grown).otherwise(F.concat(found, F.array(F.array(x)))).cast(kind)

    start = F.slice(F.transform(links, lambda x: F.array(x)), 1, 1).cast(kind)
    rest = F.slice(links, 2, F.greatest(F.size(links) - 1, F.lit(0)))
    return F.aggregate(rest, start, step)


def _run_spans(found: Column, weak: bool) -> Column:
    """Runs of two links or more as spans; weak: those with fallback links, by the strongest of their relations."""

    def span(run):
        a, e = run[0], F.element_at(run, -1)
        relations = F.transform(run, lambda x: x["relation"])
        relation = F.when(F.array_contains(relations, WEAK[0]), WEAK[0]).when(F.array_contains(relations, WEAK[1]), WEAK[1]).otherwise(WEAK[2]) if weak else F.lit("parallel_span")
        score = F.round(F.aggregate(run, F.lit(0.0), lambda s, x: s + x["score"]) / F.size(run), 6)
        text = lambda c: F.array_join(F.transform(run, lambda x: x[c]), " ")
        return F.struct(
            a["source"].alias("source_start"), e["source"].alias("source_end"), a["target"].alias("target_start"), e["target"].alias("target_end"), F.size(run).alias("words"), score.alias("score"), relation.alias("relation"),
            a["source"].alias("source_root"), a["target"].alias("target_root"), F.lit(0).alias("children"), text("source_text").alias("source_text"), text("target_text").alias("target_text"),
            *[F.lit(None).cast("double").alias(c) for c in ("lemma", "upos", "deprel", "embedding")],
        )

    kept = F.filter(found, lambda r: (F.size(r) >= 2) & (F.exists(r, lambda x: x["relation"].isin(*WEAK)) if weak else F.lit(True)))
    return F.transform(kept, span).cast(_SPAN)


def best_spans(spans: Column) -> Column:
    """One of each (spans, relation), the best, the first of equal ones; in order of their places, then relation."""
    same = lambda x, y: (x["source_start"] == y["source_start"]) & (x["source_end"] == y["source_end"]) & (x["target_start"] == y["target_start"]) & (x["target_end"] == y["target_end"]) & (x["relation"] == y["relation"])
    # Of two equal spans the better one, or the earlier, stays.
    kept = lambda every: F.filter(every, lambda x, k: ~F.exists(F.transform(every, lambda y, j: F.when(same(x, y), (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (j < k))).otherwise(False)), lambda b: b))
    order = lambda x, y: F.when(x["source_start"] != y["source_start"], x["source_start"] - y["source_start"]).when(x["target_start"] != y["target_start"], x["target_start"] - y["target_start"]).when(x["relation"] < y["relation"], -1).when(x["relation"] > y["relation"], 1).otherwise(0).cast("int")
    # The spans are made once, not once a span.
    return T.let(spans, lambda every: F.array_sort(kept(every), order))


def enriched(links: DataFrame, analyse: Analyser = analysed, encoder: Encoder | None = None, languages: tuple[str, str] = ("pl", "cs"), least: float = SAFE) -> DataFrame:
    """Sentence links (source_text, target_text, score, and keys) with status, source_tokens, target_tokens, links, phrases,
    dependencies, subtrees, unmatched_source and unmatched_target (places of words without a link)."""
    safe = F.round("score", 6) >= least
    rows = links.withColumns({"status": F.when(safe, "sentence_safe").otherwise("blocked_by_safe_depth"), "source_tokens": analyse(F.col("source_text"), languages[0]), "target_tokens": analyse(F.col("target_text"), languages[1])})
    a, b = F.col("source_tokens"), F.col("target_tokens")
    trees = F.exists(_words(a), lambda x: x["head"].isNotNull()) & F.exists(_words(b), lambda x: x["head"].isNotNull())
    rows = rows.withColumns({"_s": F.when(safe & trees, nodes(a, encoder)), "_t": F.when(safe & trees, nodes(b, encoder))})
    rows = rows.withColumn("_tree", F.when(F.col("_s").isNotNull(), _tree_results(F.col("_s"), F.col("_t"), walk(F.col("_s"), F.col("_t"), encoder is not None), encoder is not None)))
    none, no_span = F.array().cast(_LINK), F.array().cast(_SPAN)
    first = F.when(safe, F.coalesce(F.col("_tree.links"), plain_links(a, b))).otherwise(none)
    rows = rows.withColumn("_first", first).withColumn("links", F.when(safe, completed(a, b, F.col("_first"), encoder)).otherwise(none)).withColumn("_runs", runs(F.col("links")))
    own = F.when(F.size(F.coalesce(F.col("_tree.phrases"), no_span)) > 0, F.col("_tree.phrases")).otherwise(_run_spans(F.col("_runs"), False))
    promoted = _run_spans(F.col("_runs"), True)
    rows = rows.withColumns({
        "phrases": best_spans(F.concat(own, promoted)), "dependencies": best_spans(F.coalesce(F.col("_tree.dependencies"), no_span)), "subtrees": best_spans(F.concat(F.coalesce(F.col("_tree.subtrees"), no_span), promoted)),
        "unmatched_source": _unmatched(a, "source", safe), "unmatched_target": _unmatched(b, "target", safe),
    })
    return rows.drop("_s", "_t", "_tree", "_first", "_runs")


def _unmatched(tokens: Column, side: str, safe: Column) -> Column:
    there = T.let(F.transform(F.col("links"), lambda y: y[side]), lambda ends: F.transform(F.filter(_words(tokens), lambda x: ~F.array_contains(ends, x["index"])), lambda x: x["index"]))
    return F.when(safe, there).otherwise(F.array().cast("array<int>"))


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """enriched() by keys and over all (null keys): total, safe and blocked links."""
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias("total_items"), count("sentence_safe").alias("sentence_safe_items"), count("blocked_by_safe_depth").alias("blocked_items"))


def tree_links(rows: DataFrame, keys: list[str], encoder: Encoder | None = None) -> DataFrame:
    """source_tokens and target_tokens (arrays as of an analyser) -> keys, source, target, parent, score, node_score: a row
    a pair of matched nodes."""
    found = rows.select(*keys, nodes(F.col("source_tokens"), encoder).alias("_s"), nodes(F.col("target_tokens"), encoder).alias("_t"))
    out = found.select(*keys, F.explode(walk(F.col("_s"), F.col("_t"), encoder is not None)).alias("m"))
    return out.select(*keys, F.col("m.s").alias("source"), F.col("m.t").alias("target"), F.col("m.p").alias("parent"), F.round("m.score", 6).alias("score"), F.round("m.node", 6).alias("node_score"))

"""Tree walk, fallback, promotion and summary against slow plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bitextile.functions import text as T
from bitextile.operators import enrichment as E

TOKEN = "struct<index:int,text:string,kind:string,normalized:string,lemma:string,is_stopword:boolean,upos:string,head:int,deprel:string>"


def made(rng, n, heads=True):
    words = ["pan", "pani", "siedzi", "sedi", "dom", "domy", "a", "the", "rok"]
    out, places = [], []
    for k in range(1, n + 1):
        kind = "punct" if rng.random() < 0.15 else "word"
        w = rng.choice(words) if kind == "word" else ","
        out.append({"index": k, "text": w.title() if rng.random() < 0.2 else w, "kind": kind, "normalized": w, "lemma": w[:3], "is_stopword": False, "upos": rng.choice(["NOUN", "VERB", None]), "head": None, "deprel": rng.choice(["nsubj", "obj", None])})
        if kind == "word":
            places.append(k)
    if heads and places:
        order = places[:]
        rng.shuffle(order)
        for i, k in enumerate(order):
            out[k - 1]["head"] = 0 if i == 0 or rng.random() < 0.1 else rng.choice(order[:i])
        if rng.random() < 0.2:
            out[order[0] - 1]["head"] = None  # no root, or fewer
    return out


def overlap(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)


def plain_walk(a, b, vector=None):
    """Recursion over children, as one reads it."""
    def tree(tokens):
        words = {t["index"]: t for t in tokens if t["kind"] == "word"}
        roots = [k for k in sorted(words) if words[k]["head"] == 0] or sorted(words)[:1]
        children = defaultdict(list)
        for k in sorted(words):
            if k not in roots and words[k]["head"]:
                children[words[k]["head"]].append(k)

        def below(k):
            return sorted({k}.union(*(below(c) for c in children[k])))

        return words, roots, children, below

    (wa, ra, ca, da), (wb, rb, cb, db) = tree(a), tree(b)
    out = []

    def measure(s, t):
        x, y, p, q = wa[s], wb[t], [wa[k] for k in da(s)], [wb[k] for k in db(t)]
        same = lambda c: bool(x[c]) and x[c] == y[c]
        norm = 1.0 if same("normalized") else overlap(x["normalized"].lower(), y["normalized"].lower())
        node = 0.44 * (1.0 if same("lemma") else norm) + 0.26 * same("upos") + 0.20 * same("deprel") + 0.10 * norm
        get = lambda z, c: [t[c] for t in z if t[c]]
        text = lambda z: " ".join(t["text"] for t in z)
        total = 0.24 * overlap(get(p, "lemma"), get(q, "lemma")) + 0.18 * overlap(get(p, "upos"), get(q, "upos")) + 0.18 * overlap(get(p, "deprel"), get(q, "deprel")) + 0.15 * min(len(p), len(q)) / max(len(p), len(q)) + 0.10 * overlap(text(p).lower(), text(q).lower())
        if vector:
            total += 0.15 * sum(i * j for i, j in zip(vector(text(p)), vector(text(q))))
        return 0.55 * total + 0.45 * node, node

    def match(parent, left, right, least):
        start = 0
        for s in left:
            found = [(measure(s, t), j, t) for j, t in enumerate(right) if j >= start]
            found = [((score, node), j, t) for (score, node), j, t in found if score >= least]
            if found:
                (score, node), j, t = max(found, key=lambda f: (f[0][0], -f[1]))
                out.append((s, t, parent, round(score, 6), round(node, 6)))
                start = j + 1
                match(s, ca[s], cb[t], E.CHILD)

    match(0, ra, rb, E.ROOT)
    return sorted(out)


def vector(text):
    return [len(text) % 3 / 3, len(text) % 5 / 5]


def as_column(text):
    return F.array(F.length(text) % 3 / 3, F.length(text) % 5 / 5)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    out = []
    for k in range(160):
        a = made(rng, rng.randrange(14), k % 9 != 0)
        b = made(rng, rng.randrange(14), k % 7 != 0) if k % 4 == 0 else [dict(t) for t in a]
        if k % 4:  # the same tree with other words and tags
            other = made(rng, len(a), False)
            for t, o in zip(b, other):
                if rng.random() < 0.4:
                    t.update({c: o[c] for c in ("text", "normalized", "lemma")} if t["kind"] == "word" and o["kind"] == "word" else {"upos": o["upos"]})
        out.append((k, a, b))
    return out


@pytest.mark.parametrize("with_vectors", [False, True])
def test_tree_links_equal_a_recursion(spark, pairs, with_vectors):
    rows = spark.createDataFrame(pairs, f"k int, source_tokens array<{TOKEN}>, target_tokens array<{TOKEN}>")
    got = defaultdict(list)
    for x in E.tree_links(rows, ["k"], as_column if with_vectors else None).collect():
        got[x["k"]].append((x["source"], x["target"], x["parent"], x["score"], x["node_score"]))
    assert sum(map(len, got.values())) > 200 and any(p for v in got.values() for _, _, p, _, _ in v)
    for k, a, b in pairs:
        want = plain_walk(a, b, vector if with_vectors else None)
        assert [x[:3] for x in sorted(got[k])] == [x[:3] for x in want]
        assert all(abs(x[3] - y[3]) < 2e-6 and abs(x[4] - y[4]) < 2e-6 for x, y in zip(sorted(got[k]), want))


def plain_items(a, b):
    """Links by trees or forms, completed by vectors, with phrases and subtrees as (spans, relation)."""
    words = lambda ts: [t for t in ts if t["kind"] == "word"]
    found, spans, tops = [], [], []
    if any(t["head"] is not None for t in words(a)) and any(t["head"] is not None for t in words(b)):
        walked = plain_walk(a, b)
        by_a, by_b = {t["index"]: t for t in a}, {t["index"]: t for t in b}
        for s, t, _, _, node in walked:
            x, y = by_a[s], by_b[t]
            if node >= E.WORD:
                relation = "exact" if x["normalized"] == y["normalized"] else "lemma_like" if x["lemma"] == y["lemma"] else "upos_cognate" if x["upos"] and x["upos"] == y["upos"] else "cognate"
                found.append((s, t, relation, node))
    else:
        last = 0
        grams = lambda w: {w[i : i + 3] for i in range(max(1, len(w) - 2))} if w else set()
        for x in words(a):
            best = None
            for y in words(b):
                if y["index"] > last:
                    g, h = grams(x["normalized"]), grams(y["normalized"])
                    like, tags = len(g & h) / len(g | h), bool(x["upos"]) and x["upos"] == y["upos"]
                    score, relation = (1.0, "exact") if x["normalized"] == y["normalized"] else (0.92, "lemma_like") if x["lemma"] == y["lemma"] else (min(like + 0.08, 0.9), "upos_cognate") if tags and like >= 0.28 else (like, "cognate" if like >= 0.35 else "weak")
                    if score >= 0.45 and (best is None or score > best[3] + 1e-9):
                        best = (x["index"], y["index"], relation, score)
            if best:
                found.append(best)
                last = best[1]
    return found


def plain_completed(a, b, found):
    grams = lambda w: {w[i : i + 3] for i in range(max(1, len(w) - 2))}
    left = [t for t in a if t["kind"] == "word" and t["index"] not in {f[0] for f in found}]
    right = [t for t in b if t["kind"] == "word" and t["index"] not in {f[1] for f in found}]
    out, last = list(found), 0
    for x in left:
        best = None
        for y in right:
            if y["index"] > last:
                g, h = grams(x["normalized"]), grams(y["normalized"])
                score = sum(i * j for i, j in zip(vector(x["text"]), vector(y["text"]))) + 0.08 * (bool(x["upos"]) and x["upos"] == y["upos"]) + 0.04 * (bool(x["deprel"]) and x["deprel"] == y["deprel"]) + 0.08 * len(g & h) / len(g | h)
                if best is None or score > best[3] + 1e-9:
                    best = (x["index"], y["index"], "embedding_assisted", score)
        if best and best[3] >= E.FALLBACK:
            out.append((*best[:3], min(best[3], E.MOST)))
            last = best[1]
    return sorted(out)


def test_enriched_links_equal_plain_ones(spark, pairs):
    rows = spark.createDataFrame([(k, str(k), str(k), 0.7 if k % 5 else 0.2, a, b) for k, a, b in pairs], f"k int, source_text string, target_text string, score double, a array<{TOKEN}>, b array<{TOKEN}>")
    pick = iter((F.col("a"), F.col("b")))
    out = E.enriched(rows, lambda text, language: next(pick), as_column).collect()
    weak = 0
    for x in out:
        _, a, b = pairs[x["k"]]
        if x["k"] % 5 == 0:
            assert x["status"] == "blocked_by_safe_depth" and not x["links"] and not x["unmatched_source"]
            continue
        links = [(y["source"], y["target"], y["relation"]) for y in x["links"]]
        trees = any(t["head"] is not None for t in a if t["kind"] == "word") and any(t["head"] is not None for t in b if t["kind"] == "word")
        if not trees:
            want = plain_completed(a, b, plain_items(a, b))
            assert links == [w[:3] for w in want] and all(abs(y["score"] - w[3]) < 2e-6 for y, w in zip(x["links"], want))
            assert not x["dependencies"]
        weak += sum(r == "embedding_assisted" for _, _, r in links)
        assert x["unmatched_source"] == [t["index"] for t in a if t["kind"] == "word" and t["index"] not in {s for s, _, _ in links}]
        cut, group = [], []
        for y in x["links"]:
            if group and (y["source"], y["target"]) != (group[-1]["source"] + 1, group[-1]["target"] + 1):
                cut.append(group)
                group = []
            group.append(y)
        cut += [group] if group else []
        promoted = {(g[0]["source"], g[-1]["source"], g[0]["target"], g[-1]["target"]) for g in cut if len(g) >= 2 and any(y["relation"] in E.WEAK for y in g)}
        for kind in ("phrases", "subtrees"):
            spans = [(y["source_start"], y["source_end"], y["target_start"], y["target_end"], y["relation"]) for y in x[kind]]
            assert {s[:4] for s in spans if s[4] in E.WEAK} == promoted and len(set(spans)) == len(spans)
            assert spans == sorted(spans, key=lambda s: (s[0], s[2], s[4]))
        if not trees:
            runs = {(g[0]["source"], g[-1]["source"], g[0]["target"], g[-1]["target"]) for g in cut if len(g) >= 2}
            assert {tuple(y[c] for c in ("source_start", "source_end", "target_start", "target_end")) for y in x["phrases"]} == runs
    assert weak > 20


def test_built_in_analyser_and_summary(spark):
    links = spark.createDataFrame([(1, "Pan Ferdynand siedzi spokojnie.", "Pan Ferdinand sedí pokojně.", 0.7), (1, "Tak.", "Ne, ne.", 0.2), (2, None, "x", 0.9), (2, "", "", 0.9)], "pair_id int, source_text string, target_text string, score double")
    rows = {(x["pair_id"], x["source_text"]): x for x in E.enriched(links).collect()}
    first = rows[1, "Pan Ferdynand siedzi spokojnie."]
    assert [t["head"] for t in first["source_tokens"]] == [0, 1, 1, 2, None]
    assert first["subtrees"] and first["links"] and first["phrases"]
    assert all(any(s["source_start"] <= y["source"] <= s["source_end"] and s["target_start"] <= y["target"] <= s["target_end"] for s in first["subtrees"]) for y in first["links"])
    got = {x["pair_id"]: (x["total_items"], x["sentence_safe_items"], x["blocked_items"]) for x in E.summary(E.enriched(links), ["pair_id"]).collect()}
    assert got == {1: (2, 1, 1), 2: (2, 2, 0), None: (4, 3, 1)}
    assert E.enriched(links.limit(0)).count() == 0
    assert T.tokens is not None

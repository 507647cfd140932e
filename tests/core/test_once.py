"""What enrichment and vectors make of a sentence is made once, and is what plain versions give."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from bitextile.functions import plain as P
from bitextile.functions import text as T
from bitextile.operators import enrichment as E


def test_trigram_vectors_without_a_pass_a_bucket(spark):
    rng = random.Random(4)
    texts = ["", "a", "ab", "Žluťoučký kůň", None, *("".join(rng.choice("abcde fžň1") for _ in range(rng.randrange(1, 90))) for _ in range(40))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = {r.k: r.v for r in rows.select("k", T.hashed_trigrams(F.col("t")).alias("v")).collect()}
    for k, t in enumerate(texts):
        want = [0] * 128
        s = P.squeezed(t) if t is not None else ""
        for i in range(max(1, len(s) - 2) if s else 0):
            want[int(hashlib.md5(s[i : i + 3].encode()).hexdigest()[:8], 16) % 128] += 1
        norm = math.sqrt(sum(x * x for x in want))
        assert found[k] == [x / norm if norm else 0.0 for x in want], t
    # One pass over the sorted buckets: before, all trigrams were counted anew for each of 128 buckets.
    plan = rows.select(T.hashed_trigrams(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "sort_array" in plan


def test_held_dot_is_dot(spark):
    rng = random.Random(5)
    vector = lambda n: [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(n)]
    rows = [(vector(n), vector(m)) for n, m in [(9, 9)] * 30 + [(0, 0), (3, 4), (4, 0)]]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for r in df.select(T.dot(F.col("a"), F.col("b")).alias("x"), T.held_dot(F.col("a"), T.held(F.col("a")), F.col("b")).alias("y")).collect():
        assert r.x == r.y


def test_expressions_are_evaluated_once(spark):
    token = "struct<index:int,normalized:string,lemma:string,upos:string,deprel:string>"
    node = spark.createDataFrame([], f"s struct<own:{token},own_letters:array<string>>, t struct<own:{token},own_letters:array<string>>, spans {E._SPAN}")
    text = lambda c: node.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().split("\n")[0]
    # Before: four intersections a pair of nodes, and the spans made anew for each span.
    assert text(E.node_score(F.col("s"), F.col("t"))).count("array_intersect") == 1
    assert text(E.best_spans(F.reverse("spans"))).count("reverse(") == 1

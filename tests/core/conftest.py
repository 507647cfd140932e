"""A small chain of links, candidates and units that several tests read."""

import random

import pytest
from pyspark.sql import functions as F

from bitextile.operators import candidates as C
from bitextile.operators import enrichment as E
from bitextile.operators import planner as P
from bitextile.session import materialize

GROUP, UNIT, ORDER = ["book"], ["pair_id", "p"], ["k"]


@pytest.fixture(scope="session")
def chain(spark):
    rng = random.Random(8)
    words = "dom domy pan pana nowy nowa kawa kava i se w na mleko mleka piwo pivo stary idzie ide 12 34 Praga Praha".split()
    rows = []
    for book in range(3):
        for pair in range(4):
            for p in range(1, rng.randrange(2, 6)):
                for k in range(1, rng.randrange(2, 5)):
                    a = [rng.choice(words) for _ in range(rng.randrange(1, 8))]
                    b = [w if rng.random() < 0.6 else rng.choice(words) for w in a]
                    rows.append((book, 10 * book + pair, p, k, " ".join(a) + ".", " ".join(b) + rng.choice([".", ", jo."]), rng.choice([0.3, 0.5, 0.63, 0.8])))
    links = spark.createDataFrame(rows, "book long, pair_id long, p int, k int, source_text string, target_text string, score double")

    def analyse(text, language):
        """Tags by letters, so that all kinds of words are there."""
        tag = lambda x: F.when(x["kind"] == "number", "NUM").when(x["normalized"].isin("i", "se", "w", "na"), "ADP").when(x["normalized"].startswith("now"), "ADJ").when(x["normalized"].startswith("id"), "VERB").when(x["kind"] == "word", "NOUN").otherwise("PUNCT")
        return F.transform(E.analysed(text, language), lambda x: x.withField("upos", tag(x)))

    rich = materialize(E.enriched(links, analyse, lambda text: F.array(F.length(text) % 3 / 3.0, F.length(text) % 2 / 1.0)))
    found = materialize(C.items(rich, GROUP, UNIT, ORDER))
    units = materialize(C.unit_counts(found, GROUP, UNIT))
    rows = materialize(C.unit_candidates(found, GROUP, UNIT))
    ready = materialize(P.book_units(C.described(rows, units, GROUP), units, GROUP, "pair_id"))
    return found, units, rows, ready

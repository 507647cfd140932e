"""Policy selection against slow walks that sum everything anew, structures by tokens, reports against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from bitextile.operators import policy
from bitextile.operators.planning import Gates

SF = "/root/testdata/sf0.001"


def slow_words(options, total, target, fit, value):
    """options: (weight, share, base, usable, family); all sums from the start for every option."""
    ways = []
    for k, (weight, share, base, usable, family) in enumerate(options):
        taken = [options[i] for i in range(k) if ways[i]]
        at = lambda x: x / total if total else 0.0
        goal, now, then = target * at(sum(o[0] for o in options[: k + 1])), at(sum(o[0] for o in taken)), at(sum(o[0] for o in taken) + weight)
        again = family in {o[4] for o in taken}
        score = base + fit * max(abs(goal - now) - abs(goal - then), -0.05) + value * (min(share + 0.1, 1) if again else share)
        ways.append((("family_propagation" if again else "best_positive_candidate") if score > (-0.1 if again else 0) else None) if usable else None)
    return ways


def test_words_are_chosen_as_by_a_slow_walk():
    r = random.Random(5)
    for n in [0, 1, 2, 30, 60] * 8:
        rows = [(r.choice([0.25, 0.5, 1.0]), r.choice([0.1, 0.5, 1.0]), r.uniform(-0.9, 0.2), r.random() < 0.8, r.choice("abcd")) for _ in range(n)]
        total = r.choice([0.0, sum(x[0] for x in rows) + 3])
        columns = [list(c) for c in zip(*rows)] or [[], [], [], [], []]
        scores, ways = policy.choose_words(*columns, total, 0.4, 1.0, 0.5)
        assert ways == slow_words(rows, total, 0.4, 1.0, 0.5)
        assert all((s is not None) == x[3] for s, x in zip(scores, rows))


def test_structures_use_each_token_once():
    r = random.Random(6)
    for _ in range(40):
        rows = sorted(((r.randrange(4), f := r.randrange(1, 12), f + r.randrange(4), r.uniform(0.5, 2), r.uniform(0, 0.9), r.choice([None, None, "unit_class_D_not_allowed"])) for _ in range(30)), key=lambda x: x[0])
        scores, used, why = policy.choose_structures(*[list(c) for c in zip(*rows)], 60.0, 0.4, 1.0)
        taken, mass = set(), 0.0
        for (place, first, last, weight, base, blocked), s, u, y in zip(rows, scores, used, why):
            tokens = {(place, t) for t in range(first, last + 1)}
            if tokens & taken:
                assert (u, y) == (False, "span_overlap_with_selected_action")
            elif blocked:
                assert (u, y) == (False, blocked)
            else:
                now, then = mass / 60, (mass + weight) / 60
                assert s == pytest.approx(base + max(abs(0.4 * then - now) - abs(0.4 * then - then), -0.05))
                assert u == (s > 0.2)
            if u:
                taken |= tokens
                mass += weight


def test_classes_and_levels(spark):
    rows = spark.createDataFrame([("exact", 0.1), ("cognate", 0.7), ("cognate", 0.69), ("other", 0.82), ("other", 0.81)], "r string, s double")
    assert [x[0] for x in rows.select(policy.word_class(F.col("r"), F.col("s"))).collect()] == ["A", "B", "D", "A", "D"]
    assert [x[0] for x in rows.select(policy.structure_class("phrase", F.col("s"))).collect()] == ["D", "B", "B", "B", "B"]
    assert [x[0] for x in rows.select(policy.structure_class("subtree", F.col("s"))).collect()] == ["D", "C", "C", "B", "C"]
    with pytest.raises(ValueError):
        policy.Level(target=2)
    with pytest.raises(ValueError):
        policy.Level(classes=("E",))


def test_selection_through_spark(spark):
    texts = spark.createDataFrame([(1, 1, 1, "pes jde dom", "pes jde dum"), (2, 1, 1, "5 , 7", "5")], "pair_id long, source_paragraph int, source_start int, source_text string, target_text string")
    schema = "pair_id long, source_paragraph int, source_start int, source_token int, relation string, token_score double, family string, depth string, reason string"
    options = spark.createDataFrame([(1, 1, 1, 1, "exact", 0.99, "pes::pes", "phrase", None), (1, 1, 1, 2, "exact", 0.99, "jde::jde", "phrase", "inflection_risk_too_high"), (1, 1, 1, 3, "other", 0.5, "dom::dum", "token", None)], schema)
    found = {x["source_token"]: x for x in policy.select_words(options, texts).collect()}
    assert found[1]["selected"] and found[1]["reason"] == "best_positive_candidate"
    assert found[2]["reason"] == "inflection_risk_too_high" and found[2]["total_score"] is None and not found[2]["selected"]
    assert found[3]["reason"] == "unit_class_D_not_allowed"
    assert policy.select_words(options.limit(0), texts).count() == 0
    spans = spark.createDataFrame([(1, 1, 1, 1, 2, 0.95), (1, 1, 1, 2, 3, 0.9), (2, 1, 1, 1, 2, 0.95)], "pair_id long, source_paragraph int, source_start int, source_first int, source_last int, score double")
    out = {(x["pair_id"], x["source_first"]): x["reason"] for x in policy.select_structures(spans, texts, level=policy.Level(gates=Gates(minimum_alignment_confidence=0.5))).collect()}
    assert out == {(1, 1): "structural_action", (1, 2): "span_overlap_with_selected_action", (2, 1): "empty_structural_span"}


@pytest.mark.parametrize("name", ["policy_review", "policy_benchmark", "policy_breakdown", "policy_top_families"])
def test_reports_equal_sql(spark, name):
    from bitextile.plans import queries as q

    with duckdb.connect() as db:
        for t in ("lineitem", "orders"):
            db.execute(f"create view {t} as from '{SF}/{t}.parquet'")
        want = db.execute(q.ORACLE[name])
        columns = [c[0] for c in want.description]
        want = want.fetchall()
    got = q.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))

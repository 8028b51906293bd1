"""The pooled AUC from block counts against the ranks of all pairs."""

import random

import pytest

from candela.operators import crossfit, inference, ranking, scoring
from candela.plans import catalog

SCHEMA = "case_id string, person_id string, view string, h int, f array<double>"


def cases(n, first, seed, tag):
    rng = random.Random(seed)
    return [(f"{tag}{i}", f"p{i}", "sag", 4, [float(rng.randint(0, 3)), float(rng.randint(0, 2))]) for i in range(first, n)]


@pytest.mark.parametrize("digits", [None, 9])
@pytest.mark.parametrize("first", [0, 3, 20])  # all, some and no queries have a genuine reference
def test_equals_ranks_of_pairs(spark, monkeypatch, digits, first):
    monkeypatch.setattr(crossfit._dealt, "__defaults__", (7,))
    q, g = spark.createDataFrame(cases(12, 0, 1, "q"), SCHEMA), spark.createDataFrame(cases(40, first, 2, "d"), SCHEMA)
    want = inference.auc(ranking.pair_scores(scoring.view_scores(q, g, digits=digits))).first()
    got = crossfit.pooled_auc(q, g, "sag", digits).first()
    assert (got.n_genuine, got.n_impostor) == (want.n_genuine, want.n_impostor) and got.auc == (None if want.auc is None else pytest.approx(want.auc))


def test_no_score_is_shuffled(spark):
    plan = catalog.pooled_auc(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "score#" not in plan

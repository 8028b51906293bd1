"""Blocks that score only what single precision leaves open, folds whose scaler stays, and queries
that rank the configurations they need."""

import random

import numpy as np
import pandas as pd
import pytest

from candela.operators import crossfit, scoring
from candela.plans import catalog

MODES = ((0, "cor", 1, ("cor",)), (1, "sag", 1, ("sag",)), (2, "cor_sag", 2, ("cor", "sag")))
SF = "/root/testdata/sf0.001"


def block(rng, n_asked, n_held, values):
    held = pd.DataFrame({"db_case": [f"r{i}" for i in range(n_held)], "db_person": [f"p{i}" for i in range(n_held)], "h": 4})
    asked = pd.DataFrame({"query_case": [f"q{i}" for i in range(n_asked)], "query_person": [f"p{i}" for i in range(n_asked)], "known": [i % 5 > 0 for i in range(n_asked)], "h": 4})
    asked["fold"] = [f"p{i + 1}" for i in range(n_asked)]
    for v in ("cor", "sag"):
        held[f"r_{v}"], asked[f"q_{v}"] = list(values(rng, n_held)), list(values(rng, n_asked))
        asked[f"w_{v}"] = [np.array([1.0, 0.5, 2.0]) * (1 + (i % 7 == 0)) for i in range(n_asked)]
        asked[f"g_{v}"] = list(held[f"r_{v}"][:n_asked])
    return asked, held


def plainly(plan, asked, held, leave_out):
    better, equal = np.zeros((2, len(asked), len(plan.modes)), int)
    gone = np.array([[leave_out and p == d for d in held["db_person"]] for p in asked["fold"]])
    for here, m, s, g in plan.blocks(asked, held):
        s = np.where(gone[here], -1.0, s)
        better[here, m], equal[here, m] = (s > g[:, None]).sum(1), (s == g[:, None]).sum(1)
    known = asked["known"].to_numpy()[:, None]
    return better * known, equal * known


@pytest.mark.parametrize("digits", [9, None])
@pytest.mark.parametrize("values", [lambda r, n: r.integers(0, 3, (n, 3)).astype(float), lambda r, n: r.gamma(2, size=(n, 3)), lambda r, n: r.normal(size=(n, 3)) * 1e200, lambda r, n: 1e9 + r.normal(size=(n, 3)) * 1e-5, lambda r, n: r.normal(size=(n, 3)) * 1e-12])
def test_screened_counts(values, digits, monkeypatch):
    asked, held = block(np.random.default_rng(3), 30, 203, values)
    plan = crossfit._Plan(MODES, digits)
    for pairs in (1, 1000, 1 << 18):
        monkeypatch.setattr(crossfit, "PAIRS", pairs)
        for leave_out in (None, "fold"):
            with np.errstate(all="ignore"):
                got = crossfit._count(plan, ["query_case"], leave_out)(asked, held)
                want = plainly(plan, asked, held, leave_out)
            assert (np.stack(got["better"]) == want[0]).all() and (np.stack(got["equal"]) == want[1]).all()


def test_few_pairs_are_scored_in_full(monkeypatch):
    asked, held = block(np.random.default_rng(4), 40, 3000, lambda r, n: r.gamma(2, size=(n, 3)))
    scored, exact = [], crossfit._Plan.similarity

    def similarity(self, q, r, w):
        out = exact(self, q, r, w)
        scored.append(out.size)
        return out

    monkeypatch.setattr(crossfit._Plan, "similarity", similarity)
    crossfit._count(crossfit._Plan(MODES, 9), ["query_case"], None)(asked, held)
    assert sum(scored) < 0.02 * 40 * 3000


def test_folds_that_leave_the_scaler_are_not_ranked_anew(spark, monkeypatch):
    rng = random.Random(5)
    schema = "case_id string, person_id string, view string, h int, f array<double>"
    # many share the extremes 0 and 3; under h 4 p2 alone has the greatest value
    value = lambda i, h: 9.0 if (i, h) == (2, 4) else float(rng.randint(0, 3))
    rows = lambda tag: spark.createDataFrame([(f"{tag}{i}", f"p{i}", v, h, [value(i, h)]) for i in range(40) for v in ("cor", "sag") for h in (2, 4)], schema)
    q, g, modes = rows("q").where("person_id < 'p15'"), rows("r"), scoring.modes_table(spark, ("cor", "sag", "cor_sag"))
    ranked, anew = [], crossfit.fold_training_ranks

    def training(queries, gallery, modes, digits=None, folds=None):
        ranked.extend(tuple(r) for r in folds.collect())
        return anew(queries, gallery, modes, digits, folds)

    monkeypatch.setattr(crossfit, "fold_training_ranks", training)
    got = crossfit.fold_audit(q, g, modes, 9, 9)
    rows_of = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows_of(got) == rows_of(crossfit.selection_audit(anew(q, g, modes, 9), 9))
    assert set(ranked) <= {("p2", 4)}


@pytest.mark.parametrize("name, modes", [("mcnemar_table", {"sag", "cor_sag_axial"}), ("configured_ranks", {"cor_sag"})])
def test_only_the_configurations_asked_for_are_ranked(spark, monkeypatch, name, modes):
    seen, fixed = [], crossfit.fixed_configurations

    def spy(queries, gallery, table, digits=None):
        seen.append(({r["mode"] for r in table.collect()}, {r["h"] for r in queries.select("h").distinct().collect()}))
        return fixed(queries, gallery, table, digits)

    monkeypatch.setattr(crossfit, "fixed_configurations", spy)
    catalog.queries()[name](spark, SF).collect()
    assert seen == [(modes, {4})]


def test_deviating_folds_rank_once(spark, monkeypatch):
    calls, fixed = [], crossfit.fixed_configurations
    monkeypatch.setattr(crossfit, "fixed_configurations", lambda *a: calls.append(1) or fixed(*a))
    catalog.deviating_folds(spark, SF)
    assert len(calls) == 1

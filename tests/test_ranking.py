"""Scaling, scores and ranks against hand-computed values and plain joins."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from candela.operators import crossfit, ranking, scoring


def long_scores(spark, rows):
    return spark.createDataFrame(rows, "query_case string, query_person string, db_case string, db_person string, score double")


def test_midranks_of_ties_and_missing(spark):
    s = long_scores(spark, [("q", "A", "d1", "A", 0.8), ("q", "A", "d2", "B", 0.8), ("q", "A", "d3", "C", 0.2), ("r", "Z", "d1", "A", 0.1), ("r", "Z", "d2", "B", 0.3)])
    got = {r["query_case"]: r for r in ranking.true_midranks(s).collect()}
    assert (got["q"]["true_rank"], got["q"]["n_ties"], got["r"]["true_rank"]) == (1.5, 1, None)
    table = {r["query_case"]: r for r in ranking.true_rank_table(s).collect()}
    assert not table["r"]["has_match_in_database"] and table["r"]["matched_case"] == ""
    top = [(r["display_order"], r["db_case"], r["midrank"], r["n_ties"], r["correct"]) for r in ranking.top_k(s, 3).where("query_case = 'q'").orderBy("display_order").collect()]
    assert top == [(1, "d1", 1.5, 1, True), (2, "d2", 1.5, 1, False), (3, "d3", 3.0, 0, False)]


def test_several_genuine_references_fail(spark):
    s = long_scores(spark, [("q", "A", "d1", "A", 0.8), ("q", "A", "d2", "A", 0.7)])
    with pytest.raises(Exception, match="several genuine"):
        ranking.true_midranks(s).collect()


def test_midranks_sum(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(g, float(rng.randint(0, 5))) for g in "ab" for _ in range(40)], "g string, v double")
    sums = ranking.midranks_within(df, "v", ["g"]).groupBy("g").agg(F.sum("midrank").alias("s")).collect()
    assert all(r["s"] == 40 * 41 / 2 for r in sums)


def test_midranks_without_groups_are_sorted_by_range(spark):
    rng = random.Random(4)
    values = [float(rng.randint(0, 300)) for _ in range(500)] + [7.0] * 200 + [float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    out = ranking.midranks_within(df, "v")
    key = lambda v: (v != v, v)  # noqa: E731, NaN is greatest
    got = sorted(((r["v"], r["midrank"]) for r in out.collect()), key=lambda x: key(x[0]))
    order = sorted(values, key=key)
    less = {repr(v): sum(key(w) < key(v) for w in order[:-1]) for v in set(order)}
    # the null row counts below all values, as it did with one window
    want = [1 + less[repr(v)] + 0.5 * (max(1, order.count(v)) + 1) for v in order]
    assert [m for _, m in got] == want
    specs = re.findall(r"windowspecdefinition\(([^()]*)v#", out._jdf.queryExecution().analyzed().toString())
    assert specs and all("_range#" in x for x in specs)
    assert out.select("midrank").agg(F.max("midrank")).first()[0] == len(values) + 1


def arrays(spark, rows):
    return spark.createDataFrame([(f"{p}_{i}", p, "cor", 5, [float(x) for x in v]) for i, (p, v) in enumerate(rows)], "case_id string, person_id string, view string, h int, f array<double>")


def test_one_person_is_left_out_of_the_scale(spark):
    s = scoring.view_scores(arrays(spark, [("A", [5])]), arrays(spark, [("A", [100]), ("B", [0]), ("C", [10])]))
    got = {r["db_person"]: (r["distance"], r["score"]) for r in s.collect()}
    assert got["A"][0] == pytest.approx(9.5) and got["B"][0] == pytest.approx(0.5) and got["C"][0] == pytest.approx(0.5)
    assert got["A"][1] == pytest.approx(1 / 10.5)


def test_scaler_equals_the_plain_join(spark):
    rng = random.Random(4)
    people = list("ABCDEF")
    gallery = arrays(spark, [(rng.choice(people), [rng.randint(0, 4), rng.randint(0, 9)]) for _ in range(30)])
    asked = spark.createDataFrame([(p,) for p in [*people, "new"]], "person_id string")
    got = {(r["person_id"], i): (lo, hi) for r in scoring.scaler(asked, gallery).collect() for i, (lo, hi) in enumerate(zip(r["lo"], r["hi"]))}
    rows = gallery.collect()
    for p, i in itertools.product([*people, "new"], range(2)):
        x = [r["f"][i] for r in rows if r["person_id"] != p]
        assert got[p, i] == (min(x), max(x))


def test_fusion_of_three_views(spark):
    rows = [(n, n[-1], v, 1, [x]) for n, x in (("rA", 0.0), ("rB", 5.0), ("rC", 10.0)) for v in scoring.VIEWS]
    asked = [(n, n[-1], v, 1, [x]) for n, x in (("qA", 0.1), ("qB", 4.9)) for v in scoring.VIEWS]
    schema = "case_id string, person_id string, view string, h int, f array<double>"
    fused = scoring.fused_scores(scoring.view_scores(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema)), scoring.modes_table(spark)).where("mode = 'cor_sag_axial'")
    assert {(r["n_features"], r["distance_kind"]) for r in fused.collect()} == {(3, "equivalent_distance")}
    assert [r["true_rank"] for r in ranking.true_midranks(fused).collect()] == [1.0, 1.0]


def test_crossfit_selects_the_smallest_of_equals(spark):
    schema = "case_id string, person_id string, view string, h int, f array<double>"
    grid = [(v, h) for v in scoring.VIEWS for h in (5, 10)]
    q = spark.createDataFrame([(f"q{p}", p, v, h, [x]) for p, x in zip("ABC", (0.1, 10.1, 20.1)) for v, h in grid], schema)
    g = spark.createDataFrame([(f"r{p}", p, v, h, [x]) for p, x in zip("ABCD", (0.0, 10.0, 20.0, 100.0)) for v, h in grid], schema)
    modes = scoring.modes_table(spark)
    audit = crossfit.selection_audit(crossfit.fold_training_ranks(q, g, modes)).persist()
    crossfit.require_complete_audit(audit)
    assert {(r["mode"], r["h"]) for r in audit.where("selected").collect()} == {("cor", 5)} and audit.count() == 3 * 14
    assert [r["true_rank"] for r in crossfit.held_out_ranks(q, g, modes, audit).collect()] == [1.0, 1.0, 1.0]
    assert {(r["stage"], r["agrees"]) for r in crossfit.tie_stages(audit).collect()} == {("mode_order", True)}


def test_counters_equal_the_fused_scores(spark):
    rng = random.Random(9)
    schema = "case_id string, person_id string, view string, h int, f array<double>"
    rows = lambda tag, people: spark.createDataFrame([(f"{tag}{p}", p, v, h, [float(rng.randint(0, 3)), float(rng.randint(0, 3))]) for p in people for v in scoring.VIEWS for h in (2, 4)], schema)
    q, g, modes = rows("q", "ABCDZ"), rows("r", "ABCDEFGH"), scoring.modes_table(spark)
    by = ["query_case", "query_person", *crossfit.CONFIG]
    want = ranking.true_midranks(scoring.fused_scores(scoring.view_scores(q, g, digits=9), modes, digits=9), tuple(by))
    got = crossfit.fixed_configurations(q, g, modes, 9)
    pick = lambda df: sorted((tuple(r[c] for c in by), r["true_rank"], r["n_ties"], r["n_gallery"]) for r in df.collect())
    assert pick(got) == pick(want) and any(r["true_rank"] is None for r in got.collect())

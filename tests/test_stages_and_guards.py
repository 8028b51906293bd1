"""What must fail fails, and the stage operators on small tables."""

import math

import pytest
from pyspark.errors import PySparkException

from candela.operators import contracts, crossfit, inference, ranking, scoring, stages


def long(spark, rows):
    """rows: (case, person, [features])."""
    return spark.createDataFrame([(c, p, v, 2, f) for c, p, f in rows for v in scoring.VIEWS], "case_id string, person_id string, view string, h int, f array<double>")


GOOD = [("a0", "A", [0.0, 1.0]), ("b0", "B", [5.0, 2.0]), ("c0", "C", [10.0, 4.0])]


def test_sound_scores(spark):
    q = long(spark, [("a1", "A", [0.1, 1.0])])
    rows = scoring.view_scores(q, long(spark, GOOD)).where("view = 'cor'").collect()
    want = {"a0": (5.0, 2.0), "b0": (5.0, 2.0), "c0": (5.0, 2.0)}
    for r in rows:
        f = dict((c, x) for c, _, x in GOOD)[r["db_case"]]
        w = want[r["db_case"]]
        assert r["distance"] == pytest.approx(math.hypot((0.1 - f[0]) / w[0], (1.0 - f[1]) / w[1]))


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
@pytest.mark.parametrize("side", ["query", "gallery"])
def test_features_that_are_not_finite_fail(spark, bad, side):
    q = [("a1", "A", [0.1, bad if side == "query" else 1.0])]
    g = [*GOOD[:2], ("c0", "C", [10.0, bad if side == "gallery" else 4.0])]
    for run in (lambda: scoring.view_scores(long(spark, q), long(spark, g)).collect(), lambda: crossfit.fixed_configurations(long(spark, q), long(spark, g), scoring.modes_table(spark)).collect()):
        with pytest.raises(PySparkException, match="finite"):
            run()


def test_fit_sets_that_cannot_scale_fail(spark):
    q = long(spark, [("a1", "A", [0.1, 1.0])])
    with pytest.raises(PySparkException, match="no reference but"):
        scoring.view_scores(q, long(spark, GOOD[:1])).collect()
    with pytest.raises(PySparkException, match="constant"):
        scoring.view_scores(q, long(spark, GOOD[:2])).collect()
    with pytest.raises(PySparkException, match="constant"):
        scoring.view_scores(q, long(spark, [GOOD[0], ("b0", "B", [1.0, 1.0]), ("c0", "C", [1.0, 1.0])])).collect()
    assert scoring.view_scores(q, long(spark, GOOD[:2]), spread=False).count() == 6


@pytest.mark.parametrize("status", [None, "skipped", "OK", "failed"])
def test_only_success_is_attached(spark, status):
    cohort = spark.createDataFrame([("a0", "A", 0)], "case_id string, person_id string, pre_0_post_1 int")
    table = lambda s: spark.createDataFrame([("a0", "A", 0, s, "p", 1.5, 2.0)], "case_id string, person_id string, pre_0_post_1 int, status string, path string, processing_time_seconds double, x double")
    with pytest.raises(contracts.ContractError, match="failed"):
        contracts.attach_features(cohort, table(status))
    assert contracts.attach_features(cohort, table(" Success ")).columns == ["case_id", "person_id", "pre_0_post_1", "x"]


def test_attach_refuses_repeats_and_strangers(spark):
    cohort = spark.createDataFrame([("a0", "A", 0)], "case_id string, person_id string, pre_0_post_1 int")
    for rows, what in (([("a0", "A", 0), ("a0", "A", 0)], "repeated"), ([("a0", "B", 0)], "other_person"), ([("a0", "A", 1)], "other_flag"), ([("x", "A", 0)], "missing")):
        with pytest.raises(contracts.ContractError, match=what):
            contracts.attach_features(cohort, spark.createDataFrame(rows, "case_id string, person_id string, pre_0_post_1 int"))


def test_fold_audit_equals_ranking_every_fold(spark):
    """The sums of corrections against folds that are ranked one by one; ties among them."""
    import random

    rng = random.Random(4)
    people = [f"P{i}" for i in range(14)]
    near = lambda x: [round(v + rng.choice([0.0, 1.0, 2.0]), 1) for v in x]
    base = {p: [rng.choice([1.0, 3.0, 4.0, 6.0]), rng.choice([2.0, 5.0])] for p in people}
    gallery = [(f"{p}g", p, base[p]) for p in people] + [(f"D{i}g", f"D{i}", [rng.choice([0.0, 2.0, 9.0]), rng.choice([1.0, 7.0])]) for i in range(6)]
    queries = [(f"{p}q", p, near(base[p])) for p in people[:-1]] + [("Zq", "Z", [1.0, 1.0])]  # Z has no reference
    q, g, m = long(spark, queries), long(spark, gallery), scoring.modes_table(spark)
    key = lambda df: {(r["fold"], r["mode"], r["h"]): (r["training_n"], round(r["rank1_rate"], 9), round(r["rank5_rate"], 9), round(r["rank10_rate"], 9), r["mean_log_rank"], r["selected"]) for r in df.collect()}
    assert key(crossfit.fold_audit(q, g, m, 9, 9)) == key(crossfit.selection_audit(crossfit.fold_training_ranks(q, g, m, 9), 9))


def test_auc_of_ranks_and_full_order(spark):
    rows = [("q", "A", "a", "A", 0.8), ("q", "A", "b", "B", 0.8), ("q", "A", "c", "C", 0.2), ("r", "Z", "a", "A", 0.5)]
    scores = spark.createDataFrame(rows, "query_case string, query_person string, db_case string, db_person string, score double")
    auc = ranking.auc_of_ranks(ranking.true_midranks(scores)).collect()
    assert [(r["query_person"], r["auc"]) for r in auc] == [("A", 0.75)]
    order = {(r["query_case"], r["display_order"]): r["db_case"] for r in ranking.candidate_order(scores).collect()}
    assert order == {("q", 1): "a", ("q", 2): "b", ("q", 3): "c", ("r", 1): "a"}
    top = {(r["query_case"], r["display_order"]): (r["midrank"], r["n_ties"]) for r in ranking.top_k(scores, 1).collect()}
    assert top == {("q", 1): (1.5, 1), ("r", 1): (1.0, 0)}


def test_candidate_choice(spark):
    rows = [
        ("one", "x", 4, 5, 1.0), ("big", "x", 3, 5, 9.0), ("big", "y", 3, 7, 1.0), ("volume", "x", 3, 7, 1.0), ("volume", "y", 3, 7, 2.0),
        ("even", "x", 3, 7, 2.0), ("even", "x_Eq_1", 3, 7, 2.0), ("torn", "x", 3, 7, 2.0), ("torn", "y", 3, 7, 2.0005), ("flat", "x", 4, 7, 2.0), ("flat", "y", None, 7, 2.0),
    ]
    got = {r["case_id"]: (r["name"], r["policy"], r["error"]) for r in stages.choose_candidate(spark.createDataFrame(rows, "case_id string, name string, ndim int, voxel_count long, volume double")).collect()}
    assert got == {
        "one": ("x", "single_output", ""), "big": ("y", "largest_3d", ""), "volume": ("y", "largest_3d", ""), "even": ("x_Eq_1", "largest_3d", ""),
        "torn": (None, "largest_3d", "ambiguous"), "flat": (None, "largest_3d", "not_3d"),
    }


def test_results_keep_the_order_of_cases(spark):
    sha = "a" * 64
    cases = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal long, case_id string")
    schema = "ordinal long, case_id string, status string, image_sha256 string, mask_sha256 string, config_sha256 string"
    good = [(0, "a", "OK", sha, sha, sha), (1, "b", "ERROR", "", "", "")]
    assert stages.require_complete_results(spark.createDataFrame(good, schema), cases).count() == 2
    for rows, what in (([(1, "a", "OK", sha, sha, sha), (0, "b", "ERROR", "", "", "")], "misplaced 2"), (good[:1], "missing 1"), ([good[0], (1, "b", "ERROR", sha, "", "")], "failed_with_hash 1"), ([good[0], (1, "b", "OK", sha, sha, None)], "done_without_hash 1"), ([good[0], (1, "b", None, "", "", "")], "unknown_status 1")):
        with pytest.raises(contracts.ContractError, match=what):
            stages.require_complete_results(spark.createDataFrame(rows, schema), cases)


def test_input_order_lookup_and_first_rows(spark):
    cases = stages.with_input_order(spark.createDataFrame([(f"c{i:02d}",) for i in range(50)], "case_id string").repartition(5), "case_id")
    assert sorted(tuple(r) for r in cases.select("ordinal", "case_id").collect()) == [(i, f"c{i:02d}") for i in range(50)]
    assert [r["case_id"] for r in stages.first_rows(cases, 3).collect()] == ["c00", "c01", "c02"] and stages.first_rows(cases, None).count() == 50
    with pytest.raises(contracts.ContractError):
        stages.first_rows(cases, 0)
    row = lambda c, s, f: (c, s, f)
    asked = spark.createDataFrame([(0, "b"), (1, "a")], "ordinal long, case_id string")
    table = lambda rows: spark.createDataFrame(rows, "case_id string, status string, pre_0_post_1 int")
    good = [row("a", "OK", 1), row("b", "SKIPPED", 1)]
    assert [r["case_id"] for r in stages.lookup_in_order(asked, table(good)).orderBy("ordinal").collect()] == ["b", "a"]
    for rows, what in ((good[:1], "absent"), ([*good, good[0]], "repeated"), ([good[0], row("b", "ERROR", 1)], "not done"), ([good[0], row("b", "OK", 0)], "POST")):
        with pytest.raises(PySparkException, match=what):
            stages.lookup_in_order(asked, table(rows)).collect()


def test_loaded_ranks(spark):
    schema = "query_case string, query_person string, selected_mode string, selected_harmonic string, true_rank string"
    good = [(" a1 ", " A", "cor", "5", "1.5")]
    assert [tuple(r) for r in stages.load_ranks(spark.createDataFrame(good, schema), configured=True).collect()] == [("a1", "A", "cor", 5, 1.5)]
    assert [tuple(r) for r in stages.load_ranks(spark.createDataFrame(good, schema)).collect()] == [("A", 1.5)]
    for bad, what in ((("a", "", "cor", "5", "1"), "blank=1"), (("a", "A", "cor", "5.5", "1"), "bad_harmonic=1"), (("a", "A", "cor", "5", "0"), "bad_rank=1"), (("a", "A", "cor", "5", "x"), "bad_rank=1")):
        with pytest.raises(contracts.ContractError, match=what.split("=")[0]):
            stages.load_ranks(spark.createDataFrame([bad], schema), configured=True)


def test_bootstrap_of_a_mean(spark):
    df = spark.createDataFrame([(f"P{i}", float(i % 2)) for i in range(200)] + [("N", None)], "query_person string, auc double")
    r = inference.percentile_interval(inference.poisson_means(df, replicates=200).selectExpr("*", "0 as k"), by=("k",), value="mean").first()
    assert 0.4 < r["lo"] < 0.5 < r["hi"] < 0.6

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.functions import special
from candela.functions.parsing import NARROW_DIALECT, parse_bool, safe_identifier
from candela.operators import contracts, inference, quality, summaries


def test_special_functions():
    assert special.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert special.chi2_quantile(0.99, 14) == pytest.approx(29.141237740672796)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037)
    assert special.mcnemar_exact(0, 0) == 1.0 and special.mcnemar_exact(1, 9) == pytest.approx(22 / 1024)


def test_bool_dialects(spark):
    df = spark.createDataFrame([(" Yes ",), ("0",)], "x string")
    assert [r[0] for r in df.select(parse_bool(F.col("x"))).collect()] == [True, False]
    with pytest.raises(Exception, match="no boolean"):
        df.select(parse_bool(F.col("x"), NARROW_DIALECT)).collect()
    ids = spark.createDataFrame([("a-1",), (".",), ("..",), ("con",), ("x.",), ("a b",), (None,)], "x string")
    assert [r[0] for r in ids.select(safe_identifier(F.col("x"))).collect()] == [True] + [False] * 6


def test_case_contract(spark):
    good = spark.createDataFrame([(" c1 ", "p", "0"), ("c2", "p", "1.0")], "case_id string, person_id string, pre_0_post_1 string")
    assert [tuple(r) for r in contracts.validate_cases(good).collect()] == [("c1", "p", 0), ("c2", "p", 1)]
    for bad in ([("c", "p", "2")], [("", "p", "0")], [("c", "p", "0"), ("c ", "q", "1")], [("c", None, "0")]):
        with pytest.raises(contracts.ContractError):
            contracts.validate_cases(spark.createDataFrame(bad, good.schema))


def test_attach_rejects_what_does_not_fit(spark):
    cohort = spark.createDataFrame([("a", "p", 0), ("b", "q", 0)], "case_id string, person_id string, pre_0_post_1 int")
    rows = [("a", "p", 0, "Success", 1.0), ("b", "q", 0, "success", 2.0)]  # no other status counts as done
    schema = "case_id string, person_id string, pre_0_post_1 int, status string, x double"
    assert sorted(r["x"] for r in contracts.attach_features(cohort, spark.createDataFrame(rows, schema)).collect()) == [1.0, 2.0]
    for bad in (rows[:1], [rows[0], ("b", "z", 0, "success", 2.0)], [rows[0], ("b", "q", 1, "success", 2.0)], [rows[0], ("b", "q", 0, "failed", 2.0)], [rows[0], ("b", "q", 0, "ok", 2.0)]):
        with pytest.raises(contracts.ContractError):
            contracts.attach_features(cohort, spark.createDataFrame(bad, schema))


def test_hard_failures(spark):
    df = spark.createDataFrame([("success", "success", 1.0, 1.0), ("success", "failed", 1.0, 1.0), ("x", "success", None, float("inf")), ("ok", "success", float("inf"), 1.0)], "status string, efa_status string, s double, e double")
    assert [r["hard_qc_reason"] for r in quality.hard_failures(df, ["s"], ["e"]).collect()] == ["", "efa_failure", "radiomics_failure;missing_shape_feature;non_finite_efa_feature", "non_finite_shape_feature"]


def test_mahalanobis_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    df = spark.createDataFrame([("d", float(a), float(b), 1.0, False) for a, b in x], "dataset string, a double, b double, c double, hard_qc_failure boolean")
    got = np.array(sorted(r["mahalanobis_distance_squared"] for r in quality.mahalanobis(df, ["a", "b", "c"]).collect()))
    c = x - x.mean(0)
    want = np.sort(np.einsum("ij,jk,ik->i", c, np.linalg.inv(np.cov(x, rowvar=False)), c))
    assert np.allclose(got, want)


def test_mahalanobis_fits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2)) @ np.array([[3.0, 1.0], [0.0, 0.5]])
    rows = [("d", float(a), float(b), 1.0, False) for a, b in x] + [("e", float(i), 2.0 * i, 1.0, False) for i in range(9)] + [("d", 1e9, 0.0, 5.0, True)]
    df = spark.createDataFrame(rows, "dataset string, a double, b double, c double, hard_qc_failure boolean")
    d, e = sorted(quality.mahalanobis_fits(df, ["a", "b", "c"], confidence=0.95).collect())
    scaled = (x - x.min(0)) / np.ptp(x, axis=0)
    assert (d["n_fit"], d["n_features"], d["covariance_rank"]) == (30, 2, 2)
    assert d["condition_number"] == pytest.approx(np.linalg.cond(np.cov(scaled, rowvar=False)))
    assert d["threshold"] == pytest.approx(-2 * math.log(0.05))
    assert (e["n_fit"], e["n_features"], e["covariance_rank"]) == (9, 2, 1) and e["condition_number"] > 1e12
    assert e["threshold"] == pytest.approx(special.chi2_quantile(0.95, 1))


def test_review_overview(spark):
    df = spark.createDataFrame([("r1", "major", "ok"), ("r1", "major", "major"), ("r2", None, "major"), (None, None, None), ("r2", "ok", "ok")], "who string, pre string, post string")
    both = {"n_major": {"pre": "major", "post": "major"}, "n_partial": {"pre": "partial"}}
    assert tuple(summaries.review_overview(df, "who", both).first()) == (5, 2, 3, 0)
    assert tuple(summaries.review_overview(df.limit(0), "who", both).first()) == (0, 0, 0, 0)


def test_cohort_policies(spark):
    rows = [("a0", "a", 0, "institutional", False, False), ("a1", "a", 1, "institutional", False, False), ("b0", "b", 0, "institutional", False, True), ("b1", "b", 1, "institutional", False, False), ("z0", "z", 0, "other", False, False), ("z1", "z", 0, "other", False, False)]
    df = quality.include_flags(spark.createDataFrame(rows, "case_id string, person_id string, pre_0_post_1 int, dataset string, hard_qc_failure boolean, mahalanobis_outlier boolean"))
    want = {"primary": (1, 2), "technical_only_sensitivity": (2, 2), "one_per_person": (1, 1)}
    for policy, counts in want.items():
        r = quality.cohort_summary(quality.cohort_roles(df, policy)).first()
        assert (r["n_query"], r["n_distractor"]) == counts


def test_statistics(spark):
    ranks = spark.createDataFrame([("a", 1.0, 4), ("b", 1.5, 4), ("c", 4.0, 4), ("d", None, 4)], "query_person string, true_rank double, n_gallery int")
    assert {r["k"]: r["n_correct"] for r in inference.rank_rates(ranks).collect()} == {1: 1, 5: 3, 10: 3}
    pairs = spark.createDataFrame([("q", 1, 0.5), ("q", 0, 0.5)], "query_person string, label int, score double")
    assert inference.auc(pairs).first()["auc"] == 0.5
    zero = spark.createDataFrame([(0.0,), (0.0,)], "difference double")
    assert inference.sign_flip_p(zero) == 1.0
    one = spark.createDataFrame([(1.0,)] * 8, "difference double")
    assert inference.sign_flip_p(one, permutations=20_000) == pytest.approx(2 / 256, abs=0.003)
    boot = inference.percentile_interval(inference.bootstrap_rates(ranks, replicates=2000)).where("k = 1").first()
    assert boot["lo"] == 0.0 and 0.5 <= boot["hi"] <= 0.75
    rho = inference.spearman(spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)], "x int, y int"), "x", "y").first()
    assert rho["rho"] == pytest.approx(0.8) and rho["p"] == pytest.approx(0.10408803866182788)
    holm = inference.holm(spark.createDataFrame([(1, 0.01), (5, 0.04), (10, 0.03)], "k int, p double"))
    assert {r["k"]: r["p_holm"] for r in holm.collect()} == pytest.approx({1: 0.03, 5: 0.06, 10: 0.06})


def test_resampling_has_no_row_cap(spark):
    n = 120_000  # more people than were once allowed
    ranks = spark.range(n).select(F.col("id").cast("string").alias("query_person"), F.when(F.col("id") % 4 == 0, 1.0).when(F.col("id") % 4 == 1, 7.0).alias("a"), F.when(F.col("id") % 4 == 0, 1.0).when(F.col("id") % 4 == 2, 2.0).alias("b"))
    boot = inference.bootstrap_rates(ranks, replicates=2000, methods=("a", "b"))
    got = {(r["method"], r["k"]): (r["m"], r["s"]) for r in boot.groupBy("method", "k").agg(F.avg("rate").alias("m"), F.stddev_pop("rate").alias("s")).collect()}
    want = {("a", 1): 0.25, ("a", 5): 0.25, ("a", 10): 0.5, ("b", 1): 0.25, ("b", 5): 0.5, ("b", 10): 0.5}
    assert got.keys() == want.keys()
    for key, p in want.items():
        assert got[key][0] == pytest.approx(p, abs=2e-4) and got[key][1] == pytest.approx(math.sqrt(p * (1 - p) / n), rel=0.1)
    # paired draws: both methods hit the same people at 1
    assert inference.paired_differences(boot, "a", "b").where("k = 1").agg(F.max(F.abs("rate"))).first()[0] == 0
    even = spark.range(n).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("difference"))
    assert inference.sign_flip_p(even, permutations=2000) == 1.0
    shifted = spark.range(n).select(F.when(F.col("id") < 60_346, 1.0).otherwise(-1.0).alias("difference"))  # two deviations from 0
    assert inference.sign_flip_p(shifted, permutations=5000) == pytest.approx(0.0455, abs=0.012)


def test_sign_flips_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame([(0.1 * i,) for i in (3, -1, 4, 1, -5, 9, 2, 6)], "difference double")
    signs = np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T
    x = np.array([3, -1, 4, 1, -5, 9, 2, 6])
    got = {inference.sign_flip_p(d.repartition(k), permutations=20_000) for k in (1, 3)}
    assert len(got) == 1 and got.pop() == pytest.approx((np.abs(signs @ x) >= abs(x.sum())).mean(), abs=0.01)


def test_summaries(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    r = summaries.quartiles(df, "v").first()  # values that are no numbers fail: test_blocks_and_draws
    assert (r["n"], r["q1"], r["median"], r["q3"]) == (4, 1.75, 2.5, 3.25)
    tab = summaries.crosstab(spark.createDataFrame([(False, True)], "g boolean, f boolean"), "g", ("in", "out"), ["f"])
    assert {(r["group"], r["n_group"], r["n"], r["percent"]) for r in tab.collect()} == {("in", 0, 0, None), ("out", 1, 1, 100.0)}


def test_exact_quantiles_hold_no_group_in_one_task(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"wide": rng.standard_normal(4000), "ties": rng.integers(0, 3, 4000).astype(float), "one": np.array([2.5]), None: rng.exponential(size=900)}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = (0.0, 0.025, 0.25, 0.5, 0.975, 1.0)
    # a coarse sketch, so that values lie on all sides of its bounds
    got = {r["g"]: r for r in summaries.exact_quantiles(df, "x", probs, ["g"], accuracy=200).collect()}
    assert set(got) == {*values, "none"} and got["none"]["n"] == 0 and got["none"]["q"] == [None] * 6
    for g, xs in values.items():
        assert got[g]["n"] == len(xs)
        np.testing.assert_allclose(got[g]["q"], np.quantile(xs, probs), rtol=1e-12, atol=1e-15)
    every = summaries.exact_quantiles(df, "x", probs, accuracy=200).collect()
    np.testing.assert_allclose(every[0]["q"], np.quantile(np.concatenate(list(values.values())), probs), rtol=1e-12, atol=1e-15)
    assert [tuple(r) for r in summaries.exact_quantiles(df.where("false"), "x", (0.5,)).collect()] == [(0, [None])]

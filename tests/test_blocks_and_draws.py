"""Ranks from block counters against scores, guards on views, timings and cohorts, seeded draws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.operators import crossfit, inference, quality, ranking, scoring, summaries

FEATURES = "case_id string, person_id string, view string, h int, f array<double>"


def cases(n, seed, flag, views=("cor", "sag")):
    rng = random.Random(seed)
    return [(f"{flag}{i}", f"p{i}", v, 4, [float(rng.randint(0, 2)) for _ in range(2)]) for i in range(n) for v in views]


@pytest.fixture(scope="module")
def both(spark):
    # few values, so that many scores tie, also at the end of the list
    return spark.createDataFrame(cases(9, 1, "q"), FEATURES), spark.createDataFrame(cases(40, 2, "d")[2:], FEATURES)


def tuples(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("digits", [None, 6])
def test_blocks_rank_as_scores(both, digits, monkeypatch):
    monkeypatch.setattr(crossfit._dealt, "__defaults__", (7,))  # many cells
    queries, gallery = (df.where("view = 'sag'") for df in both)
    scores = scoring.view_scores(queries, gallery, digits=digits)
    got = tuples(crossfit.true_rank_table(queries, gallery, "sag", digits))
    assert got == tuples(ranking.true_rank_table(scores)) and any(r[0] is False for r in got)  # one query has no match
    for k in (1, 3, 10, 100):
        assert tuples(crossfit.top_k(queries, gallery, "sag", k, digits)) == tuples(ranking.top_k(scores, k))


def test_missing_views_fail_by_name(spark, both):
    queries, gallery = both
    modes = scoring.modes_table(spark, ("cor", "sag", "cor_sag"))
    lost = gallery.where("not (case_id = 'd3' and view = 'sag')")
    again = gallery.unionByName(gallery.where("case_id = 'd3' and view = 'sag'"))
    assert scoring.fused_scores(scoring.view_scores(queries, gallery), modes).count() == 9 * 39 * 3
    for broken, said in ((lost, "view sag is missing: .*d3"), (again, "view sag is repeated: .*d3")):
        with pytest.raises(Exception, match=said):
            scoring.fused_scores(scoring.view_scores(queries, broken), modes).collect()
        with pytest.raises(Exception, match=said):
            crossfit.fixed_configurations(queries, broken, modes).collect()
    audit = scoring.views_audit(lost.unionByName(gallery.where("case_id = 'd5' and view = 'cor'")), ("cor", "sag")).first().asDict()
    assert audit == {"n": 39, "n_without_cor": 0, "n_without_sag": 1, "n_repeated_cor": 1, "n_repeated_sag": 0}


def test_timings_fail_where_they_are_none(spark):
    df = spark.createDataFrame([("a", 1.0, "success"), ("a", 2.0, " Success"), ("a", 3.0, "success"), ("a", 4.0, "success")], "g string, t double, status string")
    r = summaries.quartiles(df, "t", ("g",), status="status").first()
    assert (r.n, r.q1, r.median, r.q3) == (4, 1.75, 2.5, 3.25)
    for bad in (None, float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="no numbers"):
            summaries.quartiles(df.unionByName(spark.createDataFrame([("a", bad, "success")], df.schema)), "t").collect()
    with pytest.raises(Exception, match="no success"):
        summaries.quartiles(df.unionByName(spark.createDataFrame([("a", 1.0, "failed")], df.schema)), "t", status="status").collect()


def test_queries_have_one_genuine_reference(spark):
    rows = [("p1", "query"), ("p1", "true_reference"), ("p2", "query"), ("p3", "true_reference"), ("p3", "query"), ("p3", "true_reference"), ("p4", "distractor"), ("p5", "excluded")]
    audit = spark.createDataFrame([("primary", p, r) for p, r in rows], "cohort_policy string, person_id string, role string")
    assert tuples(quality.genuine_errors(audit)) == [("primary", 0, 1, "p2"), ("primary", 2, 1, "p3")]
    with pytest.raises(ValueError, match="one genuine reference"):
        quality.locked(audit)
    assert quality.locked(audit.where("person_id in ('p1', 'p4')")).count() == 3


def test_first_scan_in_order_of_input(spark):
    df = spark.createDataFrame([("b", "p", 0), ("a", "p", 1), ("c", "q", 2)], "case_id string, person_id string, ordinal long")
    assert [r.case_id for r in quality.first_scan(df).orderBy("case_id").collect()] == ["b", "c"]
    assert [r.case_id for r in quality.first_scan(df.drop("ordinal")).orderBy("case_id").collect()] == ["a", "c"]


@pytest.mark.parametrize("n, replicates, block", [(75, 40, 1 << 18), (75, 40, 64), (7, 100, 13), (3_000_000_000, 3, 1)])
def test_seeded_draws(spark, n, replicates, block):
    if n > 1 << 31:  # nearly a third of the numbers are rejected: the places must follow
        want = np.random.default_rng(42).integers(0, n, 4000)
        stream = inference._stream(42, 0, 9000)
        fair, index = inference._accepted(stream, n)
        assert (index[fair][:4000] == want).all() and not fair[:4000].all()
        assert (inference._stream(42, 777, 801) == stream[777:801]).all()
        return
    want = {}
    for b, row in enumerate(np.random.default_rng(42).integers(0, n, (replicates, n)).tolist()):
        for i in row:
            want[b, i] = want.get((b, i), 0) + 1
    sums = inference.seeded_draws(spark, n, replicates, 42, block).groupBy("replicate", "i").agg(F.sum("times").alias("times"))
    assert {(r.replicate, r.i): r.times for r in sums.collect()} == want


def test_seeded_draws_follow_rejections(spark, monkeypatch):
    # of a third that is rejected, blocks must still give one sequence
    n, total = 50, 400

    def accepted(stream, size):
        return stream % 3 != 0, (stream % size).astype(np.int64)

    monkeypatch.setattr(inference, "_accepted", accepted)
    stream = inference._stream(42, 0, 2000)
    index = (stream % n)[stream % 3 != 0][:total]
    want = {}
    for at, i in enumerate(index.tolist()):
        want[at // n, i] = want.get((at // n, i), 0) + 1
    sums = inference.seeded_draws(spark, n, total // n, 42, 37).groupBy("replicate", "i").agg(F.sum("times").alias("times"))
    assert {(r.replicate, r.i): r.times for r in sums.collect()} == want


def test_seeded_rates(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 30, 66).astype(float), rng.integers(1, 12, 66).astype(float)
    b[3] = np.nan
    rows = [(f"p{i:03d}", x, None if np.isnan(y) else y) for i, (x, y) in enumerate(zip(a.tolist(), b.tolist()))]
    df = spark.createDataFrame(rows, "query_person string, a double, b double").repartition(5)
    got = {(r.replicate, r.method, r.k): r.rate for r in inference.seeded_rates(df, (1, 5, 10), 200, 42, ("a", "b")).collect()}
    drawn = np.random.default_rng(42).integers(0, 66, (200, 66))
    for name, x in (("a", a), ("b", b)):
        for k in (1, 5, 10):
            assert [got[r, name, k] for r in range(200)] == pytest.approx((x <= k)[drawn].mean(1))

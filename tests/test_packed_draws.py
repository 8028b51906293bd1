"""The seeded bootstrap without a row for each draw."""

import numpy as np
import pytest

from candela.operators import inference


@pytest.mark.parametrize("block, packed", [(1 << 18, 1 << 20), (100, 30), (64, 1)])
def test_no_draw_leaves_its_task(spark, block, packed):
    rng = np.random.default_rng(6)
    x = rng.integers(1, 20, 70).astype(float)
    rows = [(f"p{i:03d}", v if i % 9 else None) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "query_person string, true_rank double").repartition(3)
    got = inference.seeded_rates(df, (10, 1, 4), 60, 42, block=block, packed=packed)
    rates = {(r.replicate, r.k): r.rate for r in got.collect()}
    drawn = np.random.default_rng(42).integers(0, 70, (60, 70))
    x[::9] = np.inf
    assert rates == {(r, k): pytest.approx((x <= k)[drawn[r]].mean()) for r in range(60) for k in (1, 4, 10)}
    assert " i#" not in got._jdf.queryExecution().optimizedPlan().toString()  # no column of drawn people

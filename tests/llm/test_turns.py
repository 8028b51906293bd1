"""op6 deals its lists in turns: the same links, with a bounded number of rows at a time."""

import numpy as np

from candela.llm import pq_dedup


def test_turns_cover_all_lists():
    load = np.array([3, 0, 5, 1] * 10)
    for most in (0, 20, 40, 1e9):
        turns = pq_dedup._turns(load, most)
        assert turns[0][0] == 0 and turns[-1][1] == 40 and all(a[1] == b[0] and a[1] % 8 == 0 for a, b in zip(turns, turns[1:]))
        assert all(load[a:b].sum() <= most or b - a <= 8 for a, b in turns)


def test_op6_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((60, 16))
    v = (centre[rng.integers(0, 60, 900)] + 0.12 * rng.standard_normal((900, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").persist()
    rows = lambda: sorted(tuple(r) for r in pq_dedup.near_duplicates(df).collect())
    want, staged, write = rows(), [], pq_dedup.stage

    def stage(table, name):
        staged.append((name, dict(table.dtypes).get("v")))
        return write(table, name)

    monkeypatch.setattr(pq_dedup, "stage", stage)
    for name, value in (("TURN_ROWS", 200), ("TURN_SHARE", 0.1), ("QUERY_ROWS", 40)):
        monkeypatch.setattr(pq_dedup, name, value)
    assert rows() == want and sum(r[1] for r in want) > 900
    assert [n for n, _ in staged].count("pq-links") > 2 and ("pq-codes", "array<float>") in staged
    assert "pq-queries" not in [n for n, _ in staged]  # no copy of the queries but the turn's shuffle

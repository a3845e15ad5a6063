"""k-means of many starts against a plain one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.operators import lloyd


def _plain(rows, centres, tolerance=1e-4):
    while True:
        at = ((rows[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([rows[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(len(centres))])
        move = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if move <= tolerance:
            return centres, ((rows[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_fits_agree_with_a_plain_one(spark):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(m, 0.3, (70, 3)) for m in (0, 2, 5)]) + 1000.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double").repartition(5)
    got = lloyd.fit_all(df, ["a", "b", "c"], [2, 3, 4], starts=4)
    for k in (2, 3, 4):
        fit = got[k]
        # at rest, with its cost
        centres, cost = _plain(rows, fit.centres)
        assert np.allclose(centres, fit.centres, atol=1e-3)
        assert fit.cost == pytest.approx(cost, rel=1e-4)
        picks = [lloyd.first_centres(rows, k, np.random.default_rng(i)) for i in range(4)]
        assert fit.cost <= min(_plain(rows, p)[1] for p in picks) * 1.2
        labelled = df.withColumn("n", lloyd.nearest(["a", "b", "c"], fit)).collect()
        for r in labelled:
            d = ((np.array(r[:3]) - fit.centres) ** 2).sum(axis=1)
            assert d[r["n"]] == d.min()


def test_copies_and_few_rows(spark):
    df = spark.range(50).select(F.lit(1.0).alias("a"), F.when(F.col("id") == 0, 5.0).otherwise(2.0).alias("b"))
    got = lloyd.fit_all(df, ["a", "b"], [2, 4], starts=3)
    assert got[2].cost == pytest.approx(0) and got[4].cost == pytest.approx(0)
    assert len(got[4].centres) == 4
    with pytest.raises(ValueError):
        lloyd.fit_all(df.filter("a > 1"), ["a", "b"], [2])


def test_passes_do_not_grow_with_starts(spark, monkeypatch):
    passes = []
    real = lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda p, f, m: passes.append(len(f)) or real(p, f, m))
    df = spark.range(60).select((F.col("id") % 3 * 10.0 + F.col("id") / 100).alias("a"))
    lloyd.fit_all(df, ["a"], [2, 3, 4, 5], starts=10)
    assert max(passes) == 40 and len(passes) < 25

"""A concentration step of the robust fit sums rows by their distance and orders none."""

import numpy as np
import pytest

from trialgauge.operators import anomalies as an


def nearest(x, h, mean, inverse):
    centred = x - mean
    distance = np.einsum("ni,ij,nj->n", centred, inverse, centred)
    own = x[distance <= np.sort(distance)[h - 1] + 1e-12]
    return own.mean(0), np.cov(own.T, bias=True)


@pytest.mark.parametrize("copies", [1, 7])
def test_step_takes_the_nearest_rows_and_their_equals(spark, copies):
    x = np.random.default_rng(3).normal(size=(700, 3)) * [1.0, 5.0, 0.01]
    x[:350, 2] = 0.25
    rows = np.repeat(x, copies, axis=0)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x0 double, x1 double, x2 double").repartition(5)
    mean, inverse = rows.mean(0), np.linalg.pinv(np.cov(rows.T))
    for h in (1, 400 * copies - 3, 600 * copies, len(rows)):
        got, want = an._nearest_moments(frame, 3, h, mean, inverse), nearest(rows, h, mean, inverse)
        assert np.allclose(got[0], want[0], rtol=1e-10) and np.allclose(got[1], want[1], rtol=1e-9, atol=1e-15)


def test_a_coordinate_all_taken_rows_share_has_no_variance(spark):
    x = np.random.default_rng(4).normal(size=(300, 2))
    x[:200] = x[:200] * [0.1, 0.0] + [0.0, 0.7]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "x0 double, x1 double")
    mean, cov = an._nearest_moments(frame, 2, 150, np.array([0.0, 0.7 - 1e-3]), np.diag([1.0, 1e6]))
    assert cov[1, 1] == 0.0 and cov[0, 1] == 0.0 and mean[1] == pytest.approx(0.7)


def test_fit_orders_distances_once(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(500, 2))
    calls, known = [], an.exact_quantiles
    monkeypatch.setattr(an, "exact_quantiles", lambda *a, **k: calls.append(1) or known(*a, **k))
    rows = [(f"s{i}", [float(c) for c in v]) for i, v in enumerate(x)]
    live, mean, _ = an.fit_robust(spark.createDataFrame(rows, "id string, vec array<double>"), 2)
    assert live == [0, 1] and np.abs(mean).max() < 0.3
    assert len(calls) == 1

"""Range counting against comparing all pairs."""

import numpy as np
import pytest

from flowsieve.operators import spectral as sp
from flowsieve.operators.boxes import within


def brute(q, d, r, w):
    return np.array([w[(np.abs(d - x) <= r).all(axis=1)].sum() for x in q])


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", ["ties", "plain", "one value", "far apart"])
def test_counts_are_those_of_all_pairs(dims, kind):
    rng = np.random.default_rng(dims)
    n = 5000 if dims in (2, 3) else 700
    d = {"ties": rng.integers(0, 12, (n, dims)) * 0.1, "plain": rng.normal(size=(n, dims)), "one value": np.full((n, dims), 0.3), "far apart": rng.normal(size=(n, dims)) * 10.0 ** rng.integers(-8, 9, (n, dims))}[kind]
    w = rng.integers(1, 5, n)
    q = np.concatenate([d[::9], rng.normal(size=(50, dims))])
    for r in (0.0, 0.1, 0.3):  # 0.1 and 0.3: differences of the ties lie on either side of the tolerance by rounding
        assert (within(q, d, r, w) == brute(q, d, r, w)).all()
    assert (within(q, d, 0.2) == brute(q, d, 0.2, np.ones(n))).all()


def test_empty_sides():
    none, some = np.zeros((0, 2)), np.zeros((3, 2))
    assert within(none, some, 1.0).tolist() == [] and within(some, none, 1.0).tolist() == [0, 0, 0]


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("crowd", [False, True])
def test_work_grows_little_faster_than_the_points(dims, crowd):
    rng, work = np.random.default_rng(5), []
    for n in (4000, 32000):
        x = rng.normal(size=(n, dims)) * (0.01 if crowd else 1.0)
        steps = []
        within(x, x, 0.2, steps=steps)
        work.append(sum(steps))
    assert np.log(work[1] / work[0]) / np.log(8) < 1.3


def test_flow_of_equal_gaps_and_one_outlier(spark):
    """A crowd of equal templates meets itself once, as one weighted template."""
    x = [1.0] * 3000 + [50.0] + [1.0, 2.0] * 500
    df = spark.createDataFrame([(1, i + 1, a) for i, a in enumerate(x)], "flow_id int, pos bigint, iat double")
    a, phi = np.array(x), []
    for m in (2, 3):
        t = np.lib.stride_tricks.sliding_window_view(a, m)
        phi.append(np.log(brute(t, t, 0.2 * a.std(), np.ones(len(t))) / len(t)).mean())
    for limit in (100, 1 << 16):
        got = sp.approximate_entropy(df, ["flow_id"], "pos", "iat", limit=limit).first()["approximate_entropy"]
        assert got == pytest.approx(max(0.0, phi[0] - phi[1]), abs=1e-9)

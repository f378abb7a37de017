"""The distributed ways for long flows give what the one-group way gives."""

import numpy as np
import pytest

from flowsieve.operators import spectral as sp, temporal as te
from flowsieve.plans import views as v


def as_dict(df):
    return {r["flow_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def gaps(spark, sf):
    return te.gap_series(v.packets(spark, sf)).cache()


def test_fourier_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=32)
    rows = [(7, int(j), float(x[j]), 0.0, 5) for j in range(32)]
    df = spark.createDataFrame(rows, "k int, j bigint, re double, im double, bits int")
    got = sorted((r["j"], complex(r["re"], r["im"])) for r in sp.fourier(df, ["k"]).collect())
    assert [j for j, _ in got] == list(range(32))
    assert np.allclose([c for _, c in got], np.fft.fft(x))
    back = sorted((r["j"], r["re"]) for r in sp.fourier(sp.fourier(df, ["k"]), ["k"], inverse=True).collect())
    assert np.allclose([c for _, c in back], x)


def test_long_flows_have_the_same_spectrum(gaps):
    short = as_dict(sp.gap_spectrum(gaps, ["flow_id"], "pos", "iat"))
    long = as_dict(sp.gap_spectrum(gaps, ["flow_id"], "pos", "iat", limit=60))
    assert short.keys() == long.keys()
    for k in short:
        for c in ("periodicity_strength", "dominant_frequency", "spectral_entropy"):
            assert long[k][c] == pytest.approx(short[k][c], abs=1e-6), (k, c)


def test_long_flows_have_the_same_approximate_entropy(gaps):
    short = as_dict(sp.approximate_entropy(gaps, ["flow_id"], "pos", "iat"))
    long = as_dict(sp.approximate_entropy(gaps, ["flow_id"], "pos", "iat", limit=20))
    assert short.keys() == long.keys()
    for k in short:
        assert long[k]["approximate_entropy"] == pytest.approx(short[k]["approximate_entropy"], abs=1e-9), k


def test_approximate_entropy_by_hand(spark):
    x = [1.0, 2.0, 1.0, 2.1, 1.0, 2.0, 1.2, 2.0, 1.0, 2.0, 1.0, 2.0]
    df = spark.createDataFrame([(1, i + 1, a) for i, a in enumerate(x)], "flow_id int, pos bigint, iat double")

    def phi(m):
        a = np.array(x)
        t = np.lib.stride_tricks.sliding_window_view(a, m)
        c = [(np.abs(t - q).max(axis=1) <= 0.2 * a.std()).mean() for q in t]
        return np.log(c).mean()

    got = sp.approximate_entropy(df, ["flow_id"], "pos", "iat").first()["approximate_entropy"]
    assert got == pytest.approx(max(0.0, phi(2) - phi(3)))

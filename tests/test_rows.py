import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import diagnostics
from platewise.operators.rows import edge_rows, following_values, number_rows
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """One series holds a third of the rows, fifty share the rest."""
    rng = np.random.default_rng(2)
    data = [("hot", float(t), float(v)) for t, v in zip(np.sort(rng.uniform(0, 50, 600)), rng.normal(5, 1, 600))]
    for i in range(50):
        n = int(rng.integers(1, 48))
        data += [(f"s{i}", float(t), float(v)) for t, v in zip(np.sort(rng.uniform(0, 20, n)), rng.normal(0, 2, n))]
    return data, spark.createDataFrame(data, "s string, time_h double, value double").repartition(6)


def by_series(data):
    out = {}
    for s, t, v in sorted(data):
        out.setdefault(s, []).append((t, v))
    return out


def test_numbers(hot):
    data, df = hot
    got = {(s, t): n for s, t, v, n in rows(number_rows(df, ["s"]))}
    assert got == {(s, t): i for s, ps in by_series(data).items() for i, (t, _) in enumerate(ps, 1)}


@pytest.mark.parametrize("chunk", [0.05, 1.0, 100.0])
@pytest.mark.parametrize("lags", [1, 4])
def test_neighbours_across_chunks(hot, chunk, lags):
    data, df = hot
    got = {(r["s"], r["time_h"]): tuple(r[f"next_{k}"] for k in range(1, lags + 1))
           for r in following_values(df, ["s"], lags=lags, chunk=chunk).collect()}
    want = {}
    for s, ps in by_series(data).items():
        v = [p[1] for p in ps] + [None] * lags
        want.update({(s, t): tuple(v[i + 1:i + 1 + lags]) for i, (t, _) in enumerate(ps)})
    assert got == want


def test_lags_are_positive(hot):
    with pytest.raises(ValueError):
        following_values(hot[1], ["s"], lags=0)


def test_edges(hot):
    data, df = hot
    got = edge_rows(df, ["s"], 3, last=True).groupBy("s").agg(F.avg("value").alias("m"))
    want = {s: np.mean([p[1] for p in ps[-3:]]) for s, ps in by_series(data).items()}
    assert {r["s"]: r["m"] for r in got.collect()} == pytest.approx(want)


def test_diagnostics_against_numpy(hot):
    data, df = hot
    fits = {r["s"]: r for r in diagnostics.ar1_fit(df, ["s"]).collect()}
    acf = {(r["s"], r["lag"]): r["r"] for r in diagnostics.autocorrelation(df, ["s"], 2).collect()}
    trend = {r["s"]: r for r in diagnostics.linear_trend(df, ["s"]).collect()}
    box = {r["s"]: r["q"] for r in diagnostics.box_pierce(df, ["s"], 2, "value").collect()}
    left = {}
    for r in diagnostics.ar1_residuals(df, ["s"]).collect():
        left.setdefault(r["s"], []).append((r["time_h"], r["residual"]))
    for s, ps in by_series(data).items():
        t, v = np.array(ps).T
        if len(v) < 5:
            continue
        phi, c = np.polyfit(v[:-1], v[1:], 1)
        e = v[1:] - c - phi * v[:-1]
        assert fits[s]["phi"] == pytest.approx(phi) and fits[s]["intercept"] == pytest.approx(c)
        assert fits[s]["sigma2"] == pytest.approx(np.mean(e ** 2)) and fits[s]["n"] == len(v) - 1
        assert [x for _, x in sorted(left[s])] == pytest.approx(list(e))
        d = v - v.mean()
        r = [np.sum(d[:-k] * d[k:]) / np.sum(d * d) for k in (1, 2)]
        assert [acf[s, 1], acf[s, 2]] == pytest.approx(r)
        assert box[s] == pytest.approx(len(v) * sum(x * x for x in r))
        slope, at0 = np.polyfit(t, v, 1)
        assert trend[s]["slope"] == pytest.approx(slope) and trend[s]["intercept"] == pytest.approx(at0)

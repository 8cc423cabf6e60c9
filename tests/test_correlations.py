"""Autocorrelations by window and by blocks, with missing values and bounds; in-sample predictions by label."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import statespace
from tidemark.operators import arima, diagnostics, windows
from tidemark.operators.arima import ARIMA

RNG = np.random.default_rng(5)
LONG = np.cumsum(RNG.normal(size=900))
GAPS = np.where(RNG.random(300) < 0.2, np.nan, RNG.normal(size=300))
SERIES = {"long": LONG, "gaps": GAPS, "flat": np.ones(9), "one": np.array([2.0]), "none": np.array([np.nan, np.nan])}


@pytest.fixture(scope="module")
def df(spark):
    rows = [(k, t, None if np.isnan(v) and t % 2 else float(v)) for k, y in SERIES.items() for t, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, t long, y double").cache()


def expected(y, nlags, adjusted=False, drop=False):
    """Brute force over pairs."""
    y = y[~np.isnan(y)] if drop else y
    d = y - np.nanmean(y)
    sums = [np.nansum(d[k:] * d[: len(d) - k]) for k in range(min(nlags + 1, len(d)))]
    pairs = [max(1, np.count_nonzero(~np.isnan(d[k:] * d[: len(d) - k]))) for k in range(len(sums))]
    return [s / sums[0] * (pairs[0] / c if adjusted else 1) for s, c in zip(sums, pairs, strict=True)]


def rows_of(found, name, column="r"):
    return [r[column] for r in found.where(F.col("series_id") == name).orderBy("lag").collect()]


@pytest.mark.parametrize("fft", [False, True])
@pytest.mark.parametrize("adjusted", [False, True])
def test_missing_values_by_window_and_by_blocks(df, monkeypatch, fft, adjusted):
    monkeypatch.setattr(windows, "BLOCK_ROWS", 64)
    for missing in ("conservative", "drop"):
        found = windows.acf(df, 40, adjusted, missing=missing, fft=fft).cache()
        for name in ("long", "gaps"):
            assert np.allclose(rows_of(found, name), expected(SERIES[name], 40, adjusted, missing == "drop"), atol=1e-9)
        assert set(rows_of(found, "flat")) <= {None} and rows_of(found, "one") == [None]
    found = windows.acf(df, 40, adjusted, fft=fft).cache()
    assert np.allclose(rows_of(found, "long"), expected(LONG, 40, adjusted), atol=1e-9)
    assert set(rows_of(found, "gaps")) == {None} and len(rows_of(found, "none")) == 2


def test_a_thousand_lags_without_a_thousand_columns(spark):
    y = RNG.normal(size=7000)
    rows = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)], "series_id string, t long, y double")
    found = windows.acf(rows, 1000)
    assert "p500" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert np.allclose(rows_of(found, "a"), expected(y, 1000), atol=1e-9)


def test_bounds_and_options(df):
    found = windows.acf(df.where("series_id = 'long'"), 3, alpha=0.05).orderBy("lag").collect()
    assert found[0].lower == found[0].upper == 1 and found[2].upper - found[2].r == pytest.approx(1.959964 * found[2].se, rel=1e-6)
    parts = diagnostics.pacf(df.where("series_id = 'long'"), 3, alpha=0.1).orderBy("lag").collect()
    assert parts[0].lower == 1 and parts[1].upper - parts[1].lower == pytest.approx(2 * 1.6448536 / 30, rel=1e-6)
    assert diagnostics.pacf(df, 3).columns == ["series_id", "lag", "r"]
    with pytest.warns(DeprecationWarning):
        diagnostics.pacf(df, 3, "ywunbiased")
    with pytest.raises(ValueError):
        windows.acf(df, 3, missing="other")
    with pytest.raises(Exception, match="missing values"):
        windows.acf(df, 3, missing="raise").collect()
    empty = df.where("false")
    assert windows.acf(empty, 3, fft=True).count() == windows.acf(empty, 3).count() == 0


@pytest.mark.parametrize("method", ["ywadjusted", "ldb", "ols"])
def test_partial_correlations_match_the_kernel(df, method):
    found = diagnostics.pacf(df.where("series_id in ('long', 'flat', 'one', 'gaps')") if method != "ols" else df.where("series_id = 'long'"), 9, method).cache()
    assert np.allclose(rows_of(found, "long"), statespace.pacf(LONG, 9, method), atol=1e-9)
    if method != "ols":
        assert rows_of(found, "flat") == [1.0] + [None] * 8 and rows_of(found, "one") == [1.0] and rows_of(found, "gaps") == [1.0] + [None] * 9
        assert np.allclose(rows_of(diagnostics.pacf(df, 70, method), "long"), statespace.pacf(LONG, 70, method), atol=1e-7)
    with pytest.raises(ValueError):
        diagnostics.pacf(df, 3, "other")


def test_in_sample_by_label_and_beyond_the_end(spark):
    days = [datetime(2020, 1, 1 + t) for t in range(24)]
    index = spark.createDataFrame([(k, t, x) for k in "ab" for t, x in enumerate(days)], "series_id string, t long, ts timestamp")
    df = index.where("t < 20").select("series_id", "t", F.sin(F.col("t")).alias("y"))
    models = ARIMA((1, 0, 0)).fit(df).cache()
    by_number = arima.predict_in_sample(models, 5, 9).orderBy("series_id", "t").collect()
    assert arima.predict_in_sample(models, days[5], days[9], index=index).orderBy("series_id", "t").collect() == by_number
    assert arima.predict_in_sample(models, 5, days[9], index=index).count() == 10
    assert arima.predict_in_sample(models, days[18], index=index).count() == 4
    ahead = arima.predict(models, 4).orderBy("series_id", "h").collect()
    for start, n in ((15, 9), (21, 3)):
        late = arima.predict_in_sample(models, start, days[23], index=index).orderBy("series_id", "t").collect()
        assert len(late) == 2 * n and [r.yhat for r in late if r.t >= 21] == pytest.approx([r.yhat for r in ahead if r.h > 1])
    with pytest.raises(TypeError):
        arima.predict_in_sample(models, days[3])
    with pytest.raises(Exception, match="no row is labelled"):
        arima.predict_in_sample(models, datetime(1999, 1, 1), index=index).collect()

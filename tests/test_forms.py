"""The state-space forms and the optimisers, against each other and against closed forms."""

import numpy as np
import pytest

from tidemark.functions import statespace
from tidemark.functions.optimise import METHODS
from tidemark.functions.statespace import Order
from tidemark.operators import arima
from tidemark.operators.arima import ARIMA
from tidemark.operators.auto import AutoARIMA
from tidemark.sources.datasets import SERIES

RNG = np.random.default_rng(8)
WINE, LYNX = (np.array(SERIES[k], float) for k in ("wineind", "lynx"))


@pytest.mark.parametrize("order", [Order(2, 0, 1, trend="c"), Order(0, 1, 2, 0, 1, 1, 12), Order(1, 1, 1, trend="c"), Order(3, 0, 0)])
def test_hamilton_form_has_the_same_likelihood(order):
    made = statespace.fit(WINE, order)
    spec = statespace.Spec(order, 0, hamilton_representation=True)
    other = statespace.kalman(spec, made.params[None], WINE, None)
    assert float(other.terms.sum()) == pytest.approx(made.llf, rel=1e-6)
    again = statespace.Fit(spec, made.params, WINE, None, other, True, 0.0)
    assert np.allclose(again.forecast(6)[0], made.forecast(6)[0], rtol=1e-5) and np.allclose(again.forecast(6)[1], made.forecast(6)[1], rtol=1e-5)
    assert statespace.fit(LYNX[:90], Order(2, 0, 0, trend="c"), hamilton_representation=True).llf == pytest.approx(statespace.fit(LYNX[:90], Order(2, 0, 0, trend="c")).llf, abs=1e-3)
    with pytest.raises(ValueError):
        statespace.Spec(Order(1, 0, 0, trend="ct"), 0, hamilton_representation=True)


def test_concentrated_scale_is_the_profile():
    order = Order(2, 0, 0, trend="c")
    plain, made = statespace.fit(LYNX[:90], order), statespace.fit(LYNX[:90], order, concentrate_scale=True)
    assert made.llf == pytest.approx(plain.llf, abs=1e-4) and np.allclose(made.params, plain.params, rtol=1e-2)
    # One parameter less is searched for, and counts; the scale has no standard error.
    assert made.criteria()["aic"] == pytest.approx(plain.criteria()["aic"] - 2, abs=1e-3)
    assert np.isnan(made.bse()[-1]) and np.allclose(made.bse()[:-1], plain.bse()[:-1], rtol=0.25)
    errors, variances = made.filtered.errors[0], made.filtered.variances[0]
    assert float(np.mean(errors**2 / variances)) == pytest.approx(1.0)


def test_measurement_error():
    """An AR(1) with noise on top is an ARMA(1, 1): the likelihoods are the same."""
    x = np.zeros(300)
    for t in range(1, 300):
        x[t] = 0.8 * x[t - 1] + RNG.normal()
    y = x + RNG.normal(scale=1.5, size=300)
    made = statespace.fit(y, Order(1, 0, 0), measurement_error=True)
    assert made.spec.names() == ["ar.L1", "var.measurement_error", "sigma2"]
    assert made.llf == pytest.approx(statespace.fit(y, Order(1, 0, 1)).llf, abs=1e-3)
    assert made.llf > statespace.fit(y, Order(1, 0, 0)).llf + 1
    _, se = made.forecast(1)
    assert se[0] ** 2 == pytest.approx(made.filtered.cov[0, 0, 0] + made.params[1])


def test_coefficients_as_states_are_least_squares():
    x = RNG.normal(size=(120, 2))
    y = x @ np.array([2.0, -1.0]) + RNG.normal(scale=0.5, size=120)
    made = statespace.fit(y, Order(), x, mle_regression=False)
    best = np.linalg.lstsq(x, y, rcond=None)[0]
    assert made.spec.names() == ["sigma2"] and made.nobs_effective == 118
    assert np.allclose(made.filtered.mean[0][-2:], best, rtol=1e-4)
    assert made.params[-1] == pytest.approx(float(((y - x @ best) ** 2).sum() / 118), rel=1e-2)
    ahead = RNG.normal(size=(3, 2))
    mean, se = made.forecast(3, ahead)
    assert np.allclose(mean, ahead @ best, rtol=1e-3) and (se > np.sqrt(made.params[-1])).all()


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e4, 1e9])
def test_coefficients_as_states_owe_nothing_to_their_start(scale):
    """Least squares on any scale of the series; coefficients that walk follow the scale too."""
    rng = np.random.default_rng(3)
    x = np.column_stack([np.arange(80) % 7 + 1.0, rng.normal(size=80) * 1e-3])
    y = (5 * x[:, 0] + rng.normal(size=80)) * scale
    spec = statespace.Spec(Order(), 2, mle_regression=False)
    for gone in ([], [0, 1, 7]):
        seen = np.delete(np.arange(80), gone)
        rows = y.copy()
        rows[gone] = np.nan
        got = statespace.kalman(spec, np.array([[scale**2]]), rows, x)
        best, cov = np.linalg.lstsq(x[seen], y[seen], rcond=None)[0], np.linalg.inv(x[seen].T @ x[seen]) * scale**2
        assert (np.abs(got.mean[0][-2:] - best) <= 1e-6 * np.sqrt(np.diag(cov))).all()
        assert np.allclose(got.cov[0][-2:, -2:], cov, rtol=1e-5)
    walk = statespace.Spec(Order(1, 0, 0), 1, mle_regression=False, time_varying_regression=True)
    params = lambda k: np.array([[0.5, 0.01 * k**2, k**2]])
    one, other = (statespace.kalman(walk, params(k), y * (k / scale), x[:, :1]) for k in (1.0, scale))
    assert np.allclose(other.mean, one.mean * scale, rtol=1e-8) and np.allclose(other.cov, one.cov * scale**2, rtol=1e-8)


def test_rows_that_do_not_determine_coefficients():
    """Two coefficients of one row, and of equal regressors, stay finite."""
    spec = statespace.Spec(Order(), 2, mle_regression=False)
    for n in (1, 30):
        got = statespace.kalman(spec, np.array([[1.0]]), np.full(n, 3.0), np.ones((n, 2)))
        assert np.isfinite(got.mean).all() and np.isfinite(got.cov).all() and got.mean[0][-2:].sum() == pytest.approx(3, rel=1e-5)


def test_coefficients_that_walk():
    x = RNG.normal(size=(250, 1)) + 1
    path = np.cumsum(RNG.normal(scale=0.2, size=250)) + 3
    y = path * x[:, 0] + RNG.normal(scale=0.3, size=250)
    made = statespace.fit(y, Order(), x, mle_regression=False, time_varying_regression=True)
    assert made.spec.names(["u"]) == ["var.u", "sigma2"]
    assert made.llf > statespace.fit(y, Order(), x, mle_regression=False).llf + 20
    assert np.sqrt(made.params[0]) == pytest.approx(0.2, rel=0.4) and np.sqrt(made.params[1]) == pytest.approx(0.3, rel=0.3)
    assert made.filtered.mean[0][-1] == pytest.approx(path[-1], abs=0.5)
    with pytest.raises(ValueError):
        ARIMA((0, 0, 0), sarimax_kwargs={"time_varying_regression": True})


def test_forms_go_through_tables(spark):
    x = RNG.normal(size=80)
    rows = [("a", t, float(2 * v + 1 + RNG.normal()), float(v)) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, t long, y double, u double")
    models = ARIMA((1, 0, 0), sarimax_kwargs={"mle_regression": False, "measurement_error": True, "concentrate_scale": True, "hamilton_representation": True}).fit(df, ["u"]).cache()
    row = models.first()
    assert row["error"] is None and row["param_names"] == ["intercept", "ar.L1", "var.measurement_error", "sigma2"]
    assert arima.moving_coefficients(models).first()["coef"] == pytest.approx(2, abs=0.5)
    ahead = spark.createDataFrame([("a", 80 + h, float(h)) for h in range(3)], "series_id string, t long, u double")
    assert arima.predict(models, 3, ahead).count() == 3 and arima.predict_in_sample(models).count() == 80
    again = arima.update(models, spark.createDataFrame([("a", 80, 1.0, 0.0)], df.schema)).first()
    assert again["options"]["hamilton_representation"] and not again["options"]["mle_regression"] and again["nobs"] == 81
    found = AutoARIMA(seasonal=False, max_p=1, start_p=0, max_q=0, start_q=0, d=0, sarimax_kwargs={"measurement_error": True}).fit(df.drop("u")).first()
    assert found["error"] is None and "var.measurement_error" in found["param_names"]


@pytest.mark.parametrize("method", sorted(METHODS))
def test_every_optimiser_reaches_the_likelihood(method):
    for y, order in ((LYNX[:90], Order(2, 0, 0, trend="c")), (WINE, Order(1, 1, 1))):
        made = statespace.fit(y, order, method=method, maxiter=60)
        assert made.llf == pytest.approx(statespace.fit(y, order).llf, abs=1e-3) and made.method == method

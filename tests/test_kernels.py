"""Golden values of the numeric kernels."""

import math

import numpy as np
import pytest

from tidemark.functions import statespace, unitroot
from tidemark.functions.statespace import Order
from tidemark.operators import auto
from tidemark.operators.transforms import box_cox_lambda
from tidemark.sources import datasets

AUSTRES, WINEIND, LYNX, AIR = (np.array(x, float) for x in (datasets.AUSTRES, datasets.WINEIND, datasets.LYNX, datasets.AIRPASSENGERS))


def test_unit_root_p_values():
    assert [round(unitroot.adf(AUSTRES, k)[1], 7) for k in (1, 2, None)] == [0.8488036, 0.7060733, 0.3493465]
    assert round(unitroot.pp(AUSTRES)[1], 7) == 0.9786066
    assert round(unitroot.pp(AUSTRES, False)[1], 7) == 0.9514589
    assert unitroot.kpss(AUSTRES)[1] == unitroot.kpss(AUSTRES, "trend")[1] == 0.01
    assert unitroot.ndiffs(AUSTRES) == 2


def test_seasonality():
    assert np.allclose([unitroot.canova_hansen(AUSTRES, m) for m in (3, 4, 24)], [0.07956102, 0.1935046, 4.134289], rtol=1e-5)
    assert np.allclose([unitroot.ocsb(AUSTRES, 4, "fixed", 3), unitroot.ocsb(AUSTRES, 4, "aic", 2), unitroot.ocsb(AUSTRES, 4, "aic", 3)], [-5.6280, -5.66870, -6.03761], rtol=0.01)
    assert [unitroot.nsdiffs(WINEIND, 52, 3, "ch"), unitroot.nsdiffs(WINEIND, 12, 3, "ch"), unitroot.nsdiffs(WINEIND, 52, 3), unitroot.nsdiffs(AUSTRES, 4, 3)] == [2, 0, 0, 0]
    with pytest.raises(ValueError):
        unitroot.ndiffs(AUSTRES, max_d=0)


def test_white_noise():
    made = statespace.fit(np.random.RandomState(42).rand(25), Order(trend="c"))
    c = made.criteria()
    assert np.allclose([c["aic"], c["aicc"], c["bic"]], [11.20131, 11.74676, 13.63906], atol=1e-4)
    mean, se = made.forecast(10)
    assert np.allclose(mean, 0.44079876, atol=1e-6)
    assert np.allclose(mean - 1.959963985 * se, -0.10692387, atol=1e-6)


def test_ar_and_seasonal_models():
    made = statespace.fit(LYNX[:90], Order(2, 0, 0, trend="c"))
    assert abs(made.criteria()["aic"] - 1487.885) < 1
    assert np.allclose(made.bse()[1:3], [0.069774, 0.095856], rtol=0.05)
    made = statespace.fit(WINEIND, Order(0, 1, 2, 0, 1, 1, 12))
    assert abs(made.llf + 1528.766) < 0.05
    assert np.allclose(made.params[:3], [-0.5756, -0.1065, -0.3848], atol=0.01)
    assert np.allclose(made.roots()[0], [])


def test_weights_and_pacf():
    psi = statespace.arma_to_ma(np.array([0.5, 0.6]), np.array([0.4, 0.3, 0.1, 0.05]), 6)
    assert np.allclose(psi, [0.9, 1.35, 1.315, 1.5175, 1.5477, 1.6843], atol=1e-3)
    p = statespace.pacf(LYNX, 5, "ols")
    assert p[0] == 1 and len(p) == 6


def test_box_cox_lambda_recovers_log():
    y = np.exp(np.random.default_rng(0).normal(size=2000))
    assert abs(box_cox_lambda(y)) < 0.05


def test_stepwise_is_near_the_published_order():
    config = auto.AutoARIMA(m=12, max_p=2, max_q=2, max_P=1, max_Q=1, start_p=1, start_q=1, error_action="ignore")
    best = auto.search(config, AIR[:100], None, {"max_steps": 8})
    assert best and math.isfinite(best[0][0].criteria()["aic"])
    assert best[0][0].spec.order.D == 1


def test_constant_and_polynomial():
    assert auto.search(auto.AutoARIMA(seasonal=False), np.ones(30), None)[0][0].spec.order.lags("p") == ()
    with pytest.raises(ValueError, match="simple polynomial"):
        auto.search(auto.AutoARIMA(seasonal=False, d=3), np.arange(8.0), None)


def test_validation():
    for bad in ({"m": 0}, {"information_criterion": "x"}, {"start_p": 6}, {"d": -1}, {"error_action": "x"}):
        with pytest.raises(ValueError):
            auto.AutoARIMA(**bad)
    with pytest.raises(ValueError):
        auto.StepwiseContext(max_steps=0)
    with auto.StepwiseContext(max_steps=5), auto.StepwiseContext(max_dur=2):
        assert auto._context.get() == {"max_steps": 5, "max_dur": 2}


def test_trends():
    t = np.arange(1, 201.0)
    y = 5 + 0.3 * t + 0.001 * t**2 + np.random.default_rng(0).normal(size=200)
    made = statespace.fit(y, Order(1, trend="111"))
    assert made.spec.names() == ["intercept", "drift", "trend.2", "ar.L1", "sigma2"]
    assert np.allclose(made.forecast(2)[0], 5 + 0.3 * np.array([201, 202]) + 0.001 * np.array([201, 202]) ** 2, atol=0.6)
    line = statespace.fit(y, Order(trend="ct"))
    assert np.allclose(line.params[:2][::-1], np.polyfit(t, y, 1), rtol=1e-3)
    assert Order(trend=(0, 1)).powers == Order(trend="t").powers == (1,)
    with pytest.raises(ValueError):
        _ = Order(trend="x").powers


def test_simple_differencing():
    # Far below the start variance of the differencing states, both ways are the same model.
    y = WINEIND / 1e4
    for order in (Order(0, 1, 1, 0, 1, 1, 12), Order(1, 1, 0, trend="c"), Order(1, 0, 0, 0, 1, 0, 12)):
        plain, simple = statespace.fit(y, order), statespace.fit(y, order, simple_differencing=True)
        assert np.allclose(plain.params, simple.params, atol=2e-3)
        for a, b in zip(plain.forecast(15), simple.forecast(15), strict=True):
            assert np.allclose(a, b, rtol=2e-3)
        assert np.allclose(plain.in_sample(100)[0], simple.in_sample(100)[0], rtol=2e-3)
        assert np.allclose(plain.in_sample(160, 170, True)[0], simple.in_sample(160, 170, True)[0], rtol=2e-3)
    assert np.isnan(simple.residuals()[:12]).all() and len(simple.residuals()) == len(y)
    # The exact likelihood of the differenced wine series.
    assert abs(statespace.fit(WINEIND, Order(0, 1, 2, 0, 1, 1, 12), simple_differencing=True).llf + 1497.95) < 0.05


def test_a_superset_has_no_lower_likelihood():
    for y, m in ((WINEIND, 12), (AUSTRES, 4)):
        found = auto.search(auto.AutoARIMA(d=1, D=0, m=m, start_p=1, start_q=1, max_p=2, max_q=2, max_P=1, max_Q=1), y, None)
        fits = [f for f, _, _ in found]
        for large in fits:
            for small in fits:
                if statespace.embedded(small, large.spec.order, 0) is not None:
                    assert large.llf >= small.llf - 1e-3, (large.spec.order, small.spec.order)


def test_filter_goes_on():
    spec = statespace.Spec(Order(1, 1, 1, 0, 1, 0, 4, "t"), 0)
    params = np.array([[0.1, 0.4, 0.3, 2.0]])
    whole = statespace.kalman(spec, params, AUSTRES, None)
    head = statespace.kalman(spec, params, AUSTRES[:40], None)
    tail = statespace.kalman(spec, params, AUSTRES[40:], None, (head.mean[0], head.cov[0], 40))
    assert np.allclose(np.concatenate([head.terms, tail.terms], 1), whole.terms) and np.allclose(tail.mean, whole.mean)

"""Many series and orders in one recursion, and searches by replay: the same results as one at a time."""

import math

import numpy as np
import pytest

from tests.test_kernels import AIR
from tidemark.functions import batch, statespace
from tidemark.functions.statespace import Order
from tidemark.operators import auto
from tidemark.operators.arima import ARIMA, packed

RNG = np.random.default_rng(3)


def series(n, level=0.0):
    e = RNG.normal(size=n)
    y = e.copy()
    for i in range(1, n):
        y[i] += 0.5 * y[i - 1] + 0.3 * e[i - 1]
    return y + level


@pytest.mark.parametrize("order", [Order(1, 0, 1, trend="c"), Order(0, 1, 1), Order(0, 0, 0, trend="ct"), Order((1, 3), 0, 0, trend="c"), Order(1, 0, 0, 1, 0, 0, 4, "c"), Order(0, 1, 1, 0, 1, 1, 4)])
def test_batch_fits_are_the_single_fits(order):
    ys = [series(int(n), 5.0) for n in RNG.integers(50, 90, 6)]
    xs = [RNG.normal(size=(len(y), 1)) for y in ys] if not order.n_diffuse else [None] * 6
    for made, y, x in zip(batch.fit_many(ys, order, xs), ys, xs, strict=True):
        one = statespace.fit(y, order, x)
        assert made.llf == pytest.approx(one.llf, abs=1e-3)
        again = statespace.kalman(made.spec, made.params[None], y, x)
        assert made.llf == pytest.approx(float(again.terms.sum()), rel=1e-9)
        assert np.allclose(made.residuals(), again.errors[0]) and np.allclose(made.filtered.mean, again.mean) and np.allclose(made.filtered.cov, again.cov, atol=1e-6)
        assert np.allclose(made.bse(), statespace.Fit(made.spec, made.params, y, x, again, True, 0.0).bse(), rtol=1e-2, equal_nan=True)


def test_orders_share_a_recursion():
    y = series(80, 2.0)
    orders = [Order(p, 0, q, trend=t) for p in range(3) for q in range(2) for t in ("n", "c")]
    together = batch.fit_many([y] * len(orders), orders)
    for order, made in zip(orders, together, strict=True):
        assert made.spec.order == order
        assert made.llf == pytest.approx(batch.fit_many([y], order)[0].llf, abs=1e-3)


def test_a_bad_series_changes_no_other():
    good, wild = series(70), np.full(70, 1e300)
    gap = good.copy()
    gap[10] = np.nan
    order = Order(2, 0, 1, trend="c")
    out = batch.fit_many([good, wild, gap, good[:0], good], order)
    assert out[0].llf == pytest.approx(statespace.fit(good, order).llf, abs=1e-6)
    assert out[4].llf == pytest.approx(out[0].llf, abs=1e-9)
    assert out[2].llf == pytest.approx(statespace.fit(gap, order).llf)
    assert "shorter" in batch.fit_many([good[:1]], Order(0, 1, 1))[0]


def test_mean_without_a_solution_stays_with_its_vector():
    """An autoregression at the unit circle has no mean: it is 0 there, and that of the others in the batch stays."""
    spec = statespace.Spec(Order(1, 0, 0, trend="c"), 0)
    a0 = spec.system(np.array([[2.0, 0.5, 1.0], [2.0, 1.0, 1.0]]))[3]
    assert a0.tolist() == [[4.0], [0.0]]


def test_simple_differencing_in_batches():
    y = np.cumsum(series(60))
    made = batch.fit_many([y, y[:50]], Order(1, 1, 0), simple_differencing=True)
    for m, z in zip(made, (y, y[:50]), strict=True):
        one = statespace.fit(z, Order(1, 1, 0), simple_differencing=True)
        assert m.llf == pytest.approx(one.llf, abs=1e-6) and np.allclose(m.forecast(3)[0], one.forecast(3)[0], atol=1e-4)


def test_search_of_many_is_the_search_of_each():
    config = auto.AutoARIMA(seasonal=False, max_p=2, max_q=2, d=0)
    ys = [series(60) for _ in range(5)] + [np.ones(20), np.arange(30.0)]
    many = auto.search_many(config, ys, [None] * len(ys))
    for y, found in zip(ys, many, strict=True):
        alone = auto.search_many(config, [y], [None])[0]
        assert found[0].key == alone[0].key and found[0].value == pytest.approx(alone[0].value, abs=1e-3)
    # What is fitted ahead is not visited: the order of visits is the serial one.
    seen, visits = {}, []
    plan = auto.prepared(config, ys[0], None)
    while True:
        wanted, ranked = auto.replay(config, plan, seen, 0, {}, ahead=1)
        if ranked is not None:
            break
        visits.append(wanted[0][0])
        seen[wanted[0][0]] = auto.fit_keys(config, [wanted[0][0]], [ys[0]], [None], [wanted[0][1]])[0]
    assert [o.key for o in ranked] == [o.key for o in many[0]] and len(visits) == len(set(visits))
    assert len(auto.search_many(config, [ys[0]], [None], {"max_steps": 3})[0]) <= 3


def test_rounds_over_candidates_are_the_search(spark):
    ys = {"air": AIR[:60], "noise": series(50), "flat": np.ones(12), "none": np.array([1.0, 2.0, 1.5])}
    df = spark.createDataFrame([(k, t, float(v)) for k, y in ys.items() for t, v in enumerate(y)], "series_id string, t long, y double")
    config = dict(seasonal=False, max_p=2, start_q=1, max_q=1, with_intercept=True)
    rows = {s: {r["series_id"]: r for r in auto.AutoARIMA(spread=s, **config).fit(df).collect()} for s in ("series", "candidates")}
    assert rows["series"].keys() == rows["candidates"].keys() == ys.keys()
    for k in ys:
        a, b = rows["series"][k], rows["candidates"][k]
        assert (a["label"], a["error"] is None) == (b["label"], b["error"] is None)
        if a["error"] is None:
            assert a["aic"] == pytest.approx(b["aic"], abs=1e-6) and np.allclose(a["params"], b["params"], atol=1e-5)
    every = auto.AutoARIMA(spread="candidates", **config).fit(df.where("series_id = 'noise'"), return_all=True).orderBy("rank").collect()
    assert [r["rank"] for r in every] == list(range(1, len(every) + 1)) and every[0]["aic"] == min(r["aic"] for r in every)
    with pytest.raises(ValueError):
        auto.AutoARIMA(spread="rows")


def test_packed_rows_keep_order_and_gaps(spark):
    df = spark.createDataFrame([("a", 2, 3.0, 1.0), ("a", 0, 1.0, 2.0), ("a", 1, None, 4.0), (None, 0, 5.0, 6.0)], "series_id string, t long, y double, z double")
    rows = {r["series_id"]: r for r in packed(df, ["z"]).collect()}
    assert rows["a"]["y"][0] == 1 and math.isnan(rows["a"]["y"][1]) and rows["a"]["x"] == [2.0, 4.0, 1.0] and rows[None]["y"] == [5.0]
    held = ARIMA((1, 0, 0), out_of_sample_size=4).fit(spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(series(40))], "series_id string, t long, y double")).first()
    assert held["nobs"] == 40 and len(held["oob_preds"]) == 4 and held["oob"] >= 0

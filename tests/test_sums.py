"""Tests, regressions and lambdas by sums that merge, against the kernels of one series; folds over packed series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import unitroot
from tidemark.functions.optimise import LeastSquares
from tidemark.operators import diagnostics, metrics, regression, transforms
from tidemark.operators.arima import ARIMA, fit_one
from tidemark.operators.auto import AutoARIMA
from tidemark.operators.pipeline import cross_val_predict, cross_validate, naive_predict

RNG = np.random.default_rng(11)
SERIES = {f"walk{i}": np.cumsum(RNG.normal(size=int(n))) * 10.0**i for i, n in zip(range(-3, 5), RNG.integers(25, 200, 8), strict=True)}
SERIES |= {f"noise{i}": RNG.normal(size=60) + 3 for i in range(2)} | {"square": np.cumsum(np.cumsum(RNG.normal(size=90)))}
#: Series without a statistic: constant, exact lines, too short.
ODD = {"flat": np.ones(30), "line": np.arange(40.0), "two": np.array([1.0, 2.0]), "one": np.array([4.0])}


def table(spark, series):
    return spark.createDataFrame([(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y)], "series_id string, t long, y double")


@pytest.fixture(scope="module")
def df(spark):
    return table(spark, SERIES | ODD).cache()


@pytest.mark.parametrize(("name", "options"), [("adf", {}), ("adf", {"k": 0}), ("adf", {"k": 3}), ("pp", {}), ("pp", {"lshort": False}), ("kpss", {}), ("kpss", {"null": "trend", "lshort": False})])
def test_statistics_are_the_kernels(df, name, options):
    rows = {r["series_id"]: r for r in getattr(diagnostics, name)(df, **options).collect()}
    assert rows.keys() == (SERIES | ODD).keys()
    for k, y in SERIES.items():
        stat, p = getattr(unitroot, name)(y, **options)
        assert rows[k]["stat"] == pytest.approx(stat, rel=1e-7, abs=1e-9) and rows[k]["pvalue"] == pytest.approx(p, abs=1e-7)
        assert rows[k]["should_diff"] == (p < 0.05 if name == "kpss" else p > 0.05)
    assert rows["flat"]["stat"] is None and rows["one"]["stat"] is None
    if name != "kpss":
        assert rows["line"]["stat"] is None and rows["two"]["should_diff"] is None


def test_many_lags_go_to_the_kernel(spark):
    y = np.cumsum(RNG.normal(size=120))
    got = diagnostics.adf(table(spark, {"a": y}), k=diagnostics.MOST_LAGS + 2).first()
    assert got["stat"] == pytest.approx(unitroot.adf(y, diagnostics.MOST_LAGS + 2)[0])


@pytest.mark.parametrize("test", ["kpss", "adf", "pp"])
def test_differences_of_all_orders_at_once(df, test):
    got = {r["series_id"]: r["d"] for r in diagnostics.ndiffs(df, test=test).collect()}
    assert got.keys() == (SERIES | ODD).keys()
    assert {k: got[k] for k in SERIES} == {k: unitroot.ndiffs(y, test=test) for k, y in SERIES.items()}
    assert got["flat"] == 0 and got["one"] == 0
    with pytest.raises(ValueError):
        diagnostics.ndiffs(df, test="ocsb")


def test_no_python_in_the_plans(df):
    """The tests are windows and aggregates: nothing leaves the JVM, and no series is one task's group."""
    for frame in (diagnostics.adf(df), diagnostics.pp(df), diagnostics.kpss(df), diagnostics.ndiffs(df), transforms.box_cox_lambdas(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_least_squares_by_products(spark):
    x = RNG.normal(size=(80, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 4 + RNG.normal(size=80)
    rows = spark.createDataFrame([("a", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [("b", 1.0, 1.0, 1.0, 1.0)] * 5, "series_id string, u double, v double, w double, y double")
    found = regression.products(rows, [F.lit(1.0), F.col("u"), F.col("v"), F.col("w"), F.col("y")], ["series_id"])
    ones = LeastSquares(y, np.column_stack([np.ones(80), x]))
    got = {r["series_id"]: r for r in regression.last_coefficient(found, 5, F.lit(4)).withColumn("b", F.lit(0)).collect()}
    assert got["a"]["t"] == pytest.approx(ones.tvalues[-1]) and got["a"]["beta"] == pytest.approx(ones.params[-1]) and got["a"]["ssr"] == pytest.approx(float(ones.resid @ ones.resid))
    assert got["b"]["t"] is None
    both = {r["series_id"]: r["x"] for r in found.select("series_id", regression.solution(F.col("gram"), 4).alias("x")).collect()}
    assert np.allclose(both["a"], ones.params) and both["b"] is None


def test_lambdas_by_sums(spark):
    series = {"logs": np.exp(RNG.normal(size=150)), "large": np.exp(RNG.normal(size=80) * 0.1) * 1e9, "squares": RNG.normal(size=200) ** 2 + 0.1, "plain": RNG.uniform(1, 2, 300)}
    got = {r["series_id"]: r["lmbda"] for r in transforms.box_cox_lambdas(table(spark, series | {"below": np.array([1.0, -2.0, 3.0])})).collect()}
    assert got.pop("below") is None
    assert got == pytest.approx({k: transforms.box_cox_lambda(y) for k, y in series.items()}, abs=1e-5)


def test_lambdas_with_digits_are_the_most_likely(spark):
    """Of the lambdas from -5 to 5 with so many digits, each alone, as SQL has it: not the best one rounded, and none beyond the ends."""
    rng = np.random.default_rng(4)
    series = {"above": 10 - np.exp(rng.normal(size=80) * 0.5), "below": 1 / (10 - np.exp(rng.normal(size=80) * 0.5)), **{f"s{k}": np.exp(rng.normal(size=12)) + k / 20 for k in range(20)}}
    for digits in (0, 1, 2):
        grid = np.arange(-5 * 10**digits, 5 * 10**digits + 1) / 10**digits
        got = {r["series_id"]: r["lmbda"] for r in transforms.box_cox_lambdas(table(spark, series), digits).collect()}
        assert got == pytest.approx({k: grid[np.argmax([transforms.box_cox_llf(y, x) for x in grid])] for k, y in series.items()}, abs=1e-9)
    plain = {r["series_id"]: r["lmbda"] for r in transforms.box_cox_lambdas(table(spark, series)).collect()}
    assert plain["above"] == 5 and plain["below"] == -5


def test_folds_over_packed_series(spark):
    series = {"a": SERIES["noise0"], "b": SERIES["walk0"][:40]}
    df = table(spark, series)
    for cv in (metrics.RollingForecastCV(2, 3, 20), metrics.SlidingWindowForecastCV(2, 4, 15)):
        folds = {(r["series_id"], r["fold"]): r for r in cv.folds(df).collect()}
        scores = {(r["series_id"], r["fold"]): r["test_score"] for r in cross_validate(ARIMA((1, 0, 0)), df, cv=cv).collect()}
        assert scores.keys() == folds.keys()
        for (k, f), row in folds.items():
            y = series[k]
            made = fit_one(ARIMA((1, 0, 0)), y[row["start"] : row["split"]], None)[0]
            assert scores[k, f] == pytest.approx(float(np.mean((y[row["split"] : row["stop"]] - made.forecast(2)[0]) ** 2)), rel=1e-3)
        raw = cross_val_predict(ARIMA((0, 0, 0)), df, cv=metrics.RollingForecastCV(2, 2, 20), return_raw_predictions=True).collect()
        assert all(r["t"] == 20 + 2 * r["fold"] + r["h"] - 1 and r["yhat"] == pytest.approx(float(series[r["series_id"]][: 20 + 2 * r["fold"]].mean()), rel=1e-5) for r in raw)
    assert cross_validate(AutoARIMA(seasonal=False, start_p=0, max_p=1, start_q=0, max_q=0), df, cv=metrics.RollingForecastCV(2, 10, 20)).where("isnan(test_score)").count() == 0
    last = {(r["series_id"], r["t"]): r["yhat"] for r in naive_predict(df, metrics.RollingForecastCV(1, 1, 20)).collect()}
    assert last["a", 30] == series["a"][29]


def test_many_folds_do_not_multiply_rows(spark, monkeypatch):
    """A series is sent once for FOLDS folds."""
    from tidemark.operators import pipeline

    df = table(spark, {"a": RNG.normal(size=200)})
    tasks = pipeline._fold_tasks(df, [], metrics.RollingForecastCV(1, 1, 20)).collect()
    assert len(tasks) == -(-180 // pipeline.FOLDS) and sum(len(r["folds"]) for r in tasks) == 180
    assert sorted(f["fold"] for r in tasks for f in r["folds"]) == list(range(180))

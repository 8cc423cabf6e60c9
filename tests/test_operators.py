"""DataFrame operators: goldens, round trips, and many series against one at a time."""

import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import statespace
from tidemark.operators import arima, auto, diagnostics, guards, metrics, pipeline, series, transforms, windows
from tidemark.operators.arima import ARIMA
from tidemark.sources import datasets, models
from tidemark.streaming import online


@pytest.fixture(scope="module")
def two(spark):
    return datasets.load(spark, "wineind").unionByName(datasets.load(spark, "austres"))


def values(df, column="y", key="wineind", by="t"):
    return np.array([r[column] for r in df.where(F.col("series_id") == key).orderBy(by).collect()], float)


def test_diff_and_inverse(two):
    y = np.array(datasets.WINEIND, float)
    assert np.allclose(values(windows.diff(two, 12)), y[12:] - y[:-12])
    back = values(windows.diff(windows.diff_inv(two, 3, 2), 3, 2))
    assert np.allclose(back, y)
    with pytest.raises(ValueError):
        windows.diff(two, 0)


def test_decompose_reconstructs(two):
    out = windows.decompose(two, "additive", 4).where("trend is not null").collect()
    assert all(abs(r.trend + r.seasonal + r.random - r.x) < 1e-6 for r in out)
    with pytest.raises(ValueError):
        windows.decompose(two, "other", 4)


def test_kpss_and_acf_match_kernels(two):
    from tidemark.functions import unitroot

    got = {r.series_id: r for r in diagnostics.kpss(two).collect()}
    stat, p = unitroot.kpss(np.array(datasets.AUSTRES, float))
    assert abs(got["austres"].stat - stat) < 1e-9 and got["austres"].pvalue == p and got["austres"].should_diff
    y = np.array(datasets.WINEIND, float)
    d = y - y.mean()
    assert np.allclose(values(windows.acf(two, 5), "r", by="lag"), [d[k:] @ d[: len(d) - k] / (d @ d) for k in range(6)])


def test_transforms_invert(two):
    for t in (transforms.BoxCoxEndogTransformer(), transforms.BoxCoxEndogTransformer(0.5, 2), transforms.LogEndogTransformer(1)):
        back = t.inverse_transform(t.fit_transform(two))
        assert np.allclose(values(back), datasets.WINEIND)
    with pytest.raises(ValueError):
        transforms.FourierFeaturizer(5, 3)
    with pytest.raises(ValueError):
        transforms.DateFeaturizer("t").transform(two)
    with pytest.raises(Exception, match="negative or zero"):
        transforms.LogEndogTransformer().fit_transform(two.withColumn("y", -F.col("y"))).collect()


def test_fourier_golden(spark):
    df = spark.range(3).select(F.lit("a").alias("series_id"), F.col("id").alias("t"))
    row = transforms.FourierFeaturizer(5, 2).transform(df).orderBy("t").first()
    assert np.allclose([row[2], row[3]], [0.9510565, 0.309017], atol=1e-6)


def test_smape_golden(spark):
    a = [0.07533, 0.07533, 0.07533, 0.07533, 0.07533, 0.07533, 0.0672, 0.0672]
    b = [0.102, 0.107, 0.047, 0.1, 0.032, 0.047, 0.108, 0.089]
    df = spark.createDataFrame([("a", x, y) for x, y in zip(a, b, strict=True)], "series_id string, y double, yhat double")
    assert abs(metrics.score(df, ["smape"]).first().smape - 42.60306631890196) < 1e-9
    with pytest.raises(ValueError):
        metrics.get_scoring_metric("nope")
    with pytest.raises(TypeError):
        metrics.get_scoring_metric(3)


def test_folds_and_split(two):
    cv = metrics.SlidingWindowForecastCV(4, 1, 90)
    with pytest.raises(Exception, match="too short"):
        cv.folds(two).collect()
    rows = cv.folds(two.where("series_id = 'wineind' and t < 100")).orderBy("fold").collect()
    assert len(rows) == 7 and (rows[0].start, rows[0].split, rows[-1].stop) == (0, 90, 100)
    train, test = metrics.train_test_split(two, test_size=10)
    assert train.count() + test.count() == 176 + 89 and test.count() == 20


def test_align_raises(two):
    with pytest.raises(Exception, match="different rows"):
        series.align(two, two.where("t > 3").withColumnRenamed("y", "x")).collect()


def test_approximate(spark):
    points = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 3.0), ("a", 2.0, 5.0)], "series_id string, x double, y double")
    ask = spark.createDataFrame([("a", -1.0), ("a", 1.0), ("a", 2.0), ("a", 9.0)], "series_id string, x double")
    assert [r.y for r in transforms.approximate(points, ask).orderBy("x").collect()] == [None, 2.5, 4.0, None]
    assert [r.y for r in transforms.approximate(points, ask, rule=2).orderBy("x").collect()] == [1.0, 2.5, 4.0, 4.0]


def test_models_of_many_series(spark, two, tmp_path):
    fitted = ARIMA((1, 1, 0), with_intercept=False).fit(two)
    rows = {r.series_id: r for r in fitted.collect()}
    alone = ARIMA((1, 1, 0), with_intercept=False).fit(two.where("series_id = 'austres'")).first()
    assert rows["austres"].params == alone.params and rows["austres"].error is None
    forecasts = arima.predict(fitted, 5)
    assert forecasts.count() == 10 and forecasts.where("lower > yhat or yhat > upper").count() == 0
    with pytest.raises(TypeError):
        arima.predict(fitted, 2.5)
    models.save(fitted, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    assert sorted(arima.predict(again, 5).collect()) == sorted(forecasts.collect())
    models.save(fitted.withColumn("pkg_version", F.lit("0")), str(tmp_path / "old"))
    with pytest.warns(UserWarning, match="version"):
        models.load(spark, str(tmp_path / "old"))
    more = arima.update(fitted, two.where("t < 0"))
    assert more.count() == 2
    short = ARIMA((5, 2, 5)).fit(two.where("t < 2"))
    assert all(r.error for r in short.collect())
    assert arima.summary(fitted).count() == 4 and arima.residual_diagnostics(fitted).count() == 2


def test_in_sample_and_hold_out(two):
    fitted = ARIMA((1, 0, 0), out_of_sample_size=10).fit(two)
    assert all(r.oob > 0 and len(r.oob_preds) == 10 and r.nobs in (176, 89) for r in fitted.collect())
    assert arima.predict_in_sample(fitted, 5, 9).count() == 10
    assert arima.predict_in_sample(fitted, 80, 88, dynamic=True).count() == 18


def test_stored_pipeline_fits_once(two):
    steps = [("log", transforms.LogEndogTransformer()), ("m", ARIMA((1, 0, 0)))]
    plain, stored = pipeline.Pipeline(steps).fit(two.where("t < 60")), pipeline.Pipeline(steps, store=True).fit(two.where("t < 60"))
    for step in (lambda p: p, lambda p: p.update(two.where("t between 60 and 69"))):
        step(plain), step(stored)
        assert "MapInPandas" not in stored.models_._jdf.queryExecution().executedPlan().toString()
        want, got = ([tuple(r) for r in p.predict(3).orderBy("series_id", "h").collect()] for p in (plain, stored))
        assert len(got) == 6 and all(np.allclose(a[1:], b[1:]) for a, b in zip(want, got, strict=True))
    with pytest.raises(ValueError):
        pipeline.Pipeline([("store", ARIMA())])


def test_pipeline_and_cross_validation(two):
    pipe = pipeline.Pipeline([("log", transforms.LogEndogTransformer()), ("f", transforms.FourierFeaturizer(12, 1)), ("m", ARIMA((1, 0, 0)))])
    out = pipe.fit(two).predict(4)
    assert out.count() == 8 and out.agg(F.min("yhat")).first()[0] > 1000
    with pytest.raises(TypeError):
        pipeline.Pipeline([("m", ARIMA()), ("n", ARIMA())])
    with pytest.raises(ValueError):
        pipeline.Pipeline([("a__b", ARIMA())])
    cv = metrics.RollingForecastCV(2, 40, 40)
    scores = pipeline.cross_validate(ARIMA((1, 0, 0)), two, cv=cv)
    assert scores.where("test_score is null").count() == 0
    raw = pipeline.cross_val_predict(ARIMA((0, 0, 0)), two, cv=metrics.RollingForecastCV(2, 1, 80), return_raw_predictions=True)
    assert raw.where("h = 2").count() == raw.where("h = 1").count()
    with pytest.raises(ValueError):
        pipeline.cross_val_predict(ARIMA(), two, cv=metrics.RollingForecastCV(1, 2))


def test_grid_search_picks_the_least(two):
    config = auto.AutoARIMA(start_p=0, start_q=0, max_p=1, max_q=1, seasonal=False, stepwise=False, d=1)
    every = config.fit(two, return_all=True).select("series_id", "aic", "rank").collect()
    best = {r.series_id: r.aic for r in config.fit(two).collect()}
    assert all(min(r.aic for r in every if r.series_id == k) == pytest.approx(v) for k, v in best.items())


def test_streams(spark, two, tmp_path):
    two.where("t < 40").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(two.schema).parquet(str(tmp_path / "in"))
    q = online.online_forecast(stream, ARIMA((1, 0, 0))).writeStream.outputMode("update").format("memory").queryName("online").start()
    try:
        q.processAllAvailable()
        two.where("t between 38 and 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table("online").where("series_id = 'wineind' and kind = 'forecast'").orderBy("t").collect()
    assert [r.t for r in rows] == [40, 51] and rows[1].refused == 2 and rows[1].n == 51 and rows[1].yhat > 0


def test_one_bad_series_costs_no_other(spark):
    rng = np.random.default_rng(3)
    rows = [("a", t, float(y)) for t, y in enumerate(rng.normal(size=40))] + [("b", t, float(t)) for t in range(8)] + [("c", t, math.inf if t == 5 else float(t % 3)) for t in range(30)]
    df = spark.createDataFrame(rows, "series_id string, t long, y double")
    for stepwise in (True, False):
        found = {r.series_id: r for r in auto.AutoARIMA(d=3 if stepwise else None, start_p=0, start_q=0, max_p=1, max_q=1, seasonal=False, stepwise=stepwise).fit(df).collect()}
        assert set(found) == {"a", "b", "c"}
        assert found["a"].error is None and found["c"].error


def test_diff_inv_with_heads(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=20).round(3)
    df = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(y)], "series_id string, t long, y double")
    for lag, times in ((1, 1), (2, 1), (1, 3), (3, 2)):
        back = windows.diff_inv(windows.diff(df, lag, times).select("series_id", "t", "y"), lag, times, y[: lag * times].tolist())
        assert np.allclose([r.y for r in back.orderBy("t").collect()], y)
    with pytest.raises(ValueError):
        windows.diff_inv(df, 2, 2, [1.0])


def test_smape_of_zeros_is_nan(spark):
    df = spark.createDataFrame([("s", 0.0, 0.0), ("s", 1.0, 2.0)], "series_id string, y double, yhat double")
    assert math.isnan(metrics.score(df, ["smape"]).first().smape)


def test_update_keeps_the_options(two):
    head, tail = two.where("t < 80"), two.where("t >= 80")
    models = ARIMA((1, 1, 1), sarimax_kwargs={"enforce_invertibility": False, "simple_differencing": True}).fit(head)
    rows = arima.update(models, tail).collect()
    assert {r.nobs for r in rows} == {176, 89}
    assert all(r.options == {"enforce_stationarity": True, "enforce_invertibility": False, "simple_differencing": True} and r.error is None for r in rows)
    made = arima.loaded(rows[0].asDict(recursive=True))
    assert np.allclose(made.residuals()[1:], rows[0].resid[1:])


def test_accessors(two):
    models = ARIMA((1, 0, 1), (1, 0, 0, 4)).fit(two).cache()
    row = arima.coefficients(models).where("series_id = 'austres'").first()
    assert len(row.arparams) == 5 and len(row.maparams) == 1
    assert arima.degrees(models).where("series_id = 'austres'").first().df_resid == 89 - 5
    assert all(r.lower <= r.upper for r in arima.conf_int(models).collect())


def test_fourier_updates_follow(two):
    f = transforms.FourierFeaturizer(12, 1).fit(two.where("t < 50"))
    assert f.update_and_transform(two.where("t between 50 and 59")).count() == 20
    assert f.update_and_transform(two.where("t between 60 and 61")).count() == 4
    with pytest.raises(Exception, match="must follow"):
        f.update_and_transform(two.where("t = 60")).collect()
    with pytest.raises(Exception, match="n_periods"):
        f.transform(two.where("t < 5"), n_periods=4).collect()
    assert f.transform(two.where("t < 4"), n_periods=4).count() == 8


def test_pipeline_arguments_and_fittedness(two):
    p = pipeline.Pipeline([("fourier", transforms.FourierFeaturizer(4, 1)), ("arima", ARIMA((1, 0, 0)))])
    with pytest.raises(guards.NotFittedError):
        p.predict(3)
    with pytest.raises(ValueError):
        p.fit(two, nope__x=1)
    p.fit(two.where("t < 80"), arima__maxiter=5)
    assert p.update(two.where("t between 80 and 85")).predict(3).count() == 6


def test_callables(two):
    cv = metrics.RollingForecastCV(2, 30, 40)
    worst = lambda y, p: np.abs(y - p).max()
    a, b = (pipeline.cross_val_score(ARIMA((0, 1, 0)), two, scoring=s, cv=cv).orderBy("series_id", "fold").collect() for s in (worst, "max_error"))
    assert a == b
    top = pipeline.cross_val_predict(ARIMA((0, 1, 0)), two, cv=metrics.RollingForecastCV(4, 2, 80), averaging=F.max)
    assert top.where("yhat is null").count() == 0
    with pytest.raises(TypeError):
        arima.kernel_score(3)


def test_labels_and_archives(spark, tmp_path):
    last = {n: datasets.labelled(datasets.load(spark, n)).orderBy(F.desc("t")).first().label for n in ("lynx", "wineind", "woolyrnq", "airpassengers", "heartrate")}
    assert last == {"lynx": "1934", "wineind": "Aug 1994", "woolyrnq": "Q3 1994", "airpassengers": "Dec 1960", "heartrate": None}
    (tmp_path / "a.csv").write_text("day,price\n2020-01-01,1.5\n2020-01-02,2.5\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "a.csv", "a.csv")
    rows = datasets.read_archive(spark, str(tmp_path / "a.tar.gz"), "day date, price double").collect()
    assert [r.price for r in rows] == [1.5, 2.5]


def test_guards():
    class Inner:
        def go(self):
            return 1

    class Outer:
        inner = Inner()

        @guards.delegated("inner")
        def go(self):
            return self.inner.go()

        @guards.delegated("inner")
        def stop(self):
            return 2

    assert Outer().go() == 1 and not hasattr(Outer(), "stop")
    with pytest.raises(TypeError):
        guards.check_is_fitted(Outer(), [])
    with pytest.raises(KeyError) as e, guards.reraised(ValueError, "other", KeyError):
        raise ValueError("first")
    assert isinstance(e.value.__cause__, ValueError)
    with pytest.warns(DeprecationWarning):
        guards.deprecated("g")(lambda: 1)()
    assert guards.versions()["numpy"]


def test_online_filter_alone_keeps_no_rows(spark, two, tmp_path):
    two.where("t < 40").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t long, y double").parquet(str(tmp_path / "in"))
    q = online.online_forecast(stream, ARIMA((1, 0, 0)), refit=False).writeStream.outputMode("update").format("memory").queryName("online_filter").start()
    try:
        q.processAllAvailable()
        two.where("t between 40 and 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("online_filter").where("series_id = 'wineind'").orderBy("t").collect()
    made = statespace.fit(np.array(datasets.WINEIND[:40], float), ARIMA((1, 0, 0)).spec())
    on = statespace.Fit(made.spec, made.params, np.array(datasets.WINEIND[:51], float), None, statespace.kalman(made.spec, made.params[None], np.array(datasets.WINEIND[:51], float), None), True, 0.0)
    assert [r.n for r in got] == [40, 51] and abs(got[1].yhat - on.forecast(1)[0][0]) < 1e-6

"""Online models: state from a model table, rows that come late or fail, series that expire."""

import time

import numpy as np
import pytest

from tidemark.operators.arima import ARIMA
from tidemark.streaming import online

RNG = np.random.default_rng(12)
ROWS = "series_id string, t long, y double"


def run(spark, batches, tmp_path, name, **options):
    """The output rows of batches that arrive one after another."""
    folder = str(tmp_path / name)
    spark.createDataFrame(batches[0], ROWS).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(ROWS).parquet(folder)
    q = online.online_forecast(stream, ARIMA((1, 0, 0)), **options).writeStream.outputMode("update").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        for rows in batches[1:]:
            spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


@pytest.mark.parametrize("refit", [True, False])
def test_bad_and_late_rows_cost_no_other_series(spark, tmp_path, refit):
    good = [("good", t, float(v)) for t, v in enumerate(RNG.normal(size=40))]
    bad = [("bad", t, float("inf") if t == 3 else 1.0) for t in range(40)]
    later = [("good", 39, 7.0), ("good", 40, 2.0), ("good", 40, 1.0), ("bad", 40, 1.0), ("few", 0, 1.0)]
    rows = run(spark, [good + bad, later], tmp_path, f"late_{refit}", refit=refit)
    mine = sorted((r["t"], r["kind"], r["n"], r["refused"], r["y"]) for r in rows if r["series_id"] == "good" and r["kind"] == "late")
    assert [(t, y) for t, *_, y in mine] == [(39, 7.0), (40, 2.0)]
    forecasts = sorted((r["n"], r["t"], r["refused"], np.isfinite(r["yhat"])) for r in rows if r["series_id"] == "good" and r["kind"] == "forecast")
    assert forecasts == [(40, 40, 0, True), (41, 41, 2, True)]
    assert [r["kind"] for r in rows if r["series_id"] == "bad"] == ["error", "error"] and all(r["error"] for r in rows if r["series_id"] == "bad")
    assert [(r["kind"], r["n"], r["yhat"]) for r in rows if r["series_id"] == "few"] == [("forecast", 1, None)]


def test_state_from_a_model_table(spark, tmp_path):
    y = RNG.normal(size=60).cumsum() * 0.3 + 5
    models = ARIMA((1, 0, 0)).fit(spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(y)], ROWS)).cache()
    rows = run(spark, [[("s", 60, 5.0), ("s", 3, 1.0)]], tmp_path, "started", refit=False, models=models)
    found = {r["kind"]: r for r in rows}
    params = models.first()["params"]
    assert found["forecast"]["n"] == 61 and found["forecast"]["t"] == 61 and found["late"]["t"] == 3
    assert found["forecast"]["yhat"] == pytest.approx(params[0] + params[1] * 5.0, rel=1e-6)


def test_silent_series_expire(spark, tmp_path):
    folder = str(tmp_path / "expiring")
    spark.createDataFrame([("a", t, float(t % 3)) for t in range(25)], ROWS).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(ROWS).parquet(folder)
    q = online.online_forecast(stream, ARIMA((1, 0, 0)), ttl_seconds=1.0).writeStream.trigger(processingTime="1 second").outputMode("update").format("memory").queryName("expiring").start()
    try:
        rows, until = [], time.time() + 60
        while time.time() < until and not [r for r in rows if r["kind"] == "expired"]:
            time.sleep(1)
            rows = spark.table("expiring").collect()
    finally:
        q.stop()
    assert [(r["kind"], r["n"]) for r in rows] == [("forecast", 25), ("expired", 25)]

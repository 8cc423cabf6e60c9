"""Streams: event windows to series, and models that are updated as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import statespace
from tidemark.operators.arima import ARIMA, fit_one, updated


def windowed(stream: DataFrame, key: str, ts: str, value: Column, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(series_id, ts, y): sums by key and tumbling or sliding window; rows later than the watermark are refused."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    sums = stream.withWatermark(ts, late).groupBy(F.col(key).alias("series_id"), w.alias("w")).agg(F.sum(value).alias("y"))
    return sums.select("series_id", F.col("w.start").alias("ts"), "y")


def sessions(stream: DataFrame, key: str, ts: str, value: Column, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(series_id, start, stop, y): sums by key and session."""
    sums = stream.withWatermark(ts, late).groupBy(F.col(key).alias("series_id"), F.session_window(ts, gap).alias("w")).agg(F.sum(value).alias("y"))
    return sums.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "y")


#: Rows of kind ``forecast``, ``late`` (a row at or before the last t, or a second one of its t), ``error`` (a model that could not be fitted) and ``expired``.
OUT = "series_id string, kind string, t long, yhat double, y double, n long, refused long, error string"
STATE = "params array<double>, y array<double>, mean array<double>, cov array<double>, n long, last long"


def online_forecast(stream: DataFrame, config: ARIMA, min_rows: int = 20, refit: bool = True, models: DataFrame | None = None, ttl_seconds: float | None = None) -> DataFrame:
    """Rows of OUT: after each micro-batch, the forecast of the next row of each series that had rows.

    New rows are appended in order of t and the model is refitted shortly from its old parameters; the state then
    holds the rows of a series. With refit=False, the parameters stay as first fitted and only the filter goes on:
    the state is the parameters and the last prediction, whatever the length of the series. Rows at or before the
    last t, and all but the least y of one t, are refused: they leave as rows of kind ``late`` and are counted. A series whose model
    can't be fitted gives a row of kind ``error`` and goes on collecting; no other series notices.

    ``models`` is a model table (ARIMA.fit) that the state starts from: its series forecast from their first new
    row on, with t from the fitted rows' number. A series without rows for ``ttl_seconds`` leaves the state, with a row of kind
    ``expired``. The state is kept by RocksDB, which the session is set to.
    """
    if not refit and config.flags().get("simple_differencing"):
        raise ValueError("refit=False needs a model without simple_differencing")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    first = None
    if models is not None:
        known = models.where("error is null").select("series_id", "params", "y")
        first = known.groupBy("series_id")
    rows = stream.select("series_id", "t", "y").groupBy("series_id")
    return rows.transformWithStateInPandas(OnlineModel(config, min_rows, refit, ttl_seconds), OUT, "Update", "ProcessingTime" if ttl_seconds else "None", first)


class OnlineModel(StatefulProcessor):
    """The state of one series and what its new rows make of it."""

    def __init__(self, config: ARIMA, min_rows: int, refit: bool, ttl_seconds: float | None):
        self.config, self.min_rows, self.refit, self.ttl = config, min_rows, refit, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("model", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        y = np.asarray(row["y"], float)
        self.state.update(([float(v) for v in row["params"]], y.tolist(), [], [], len(y), len(y) - 1))
        self._wait(timerValues)

    def _wait(self, timers) -> None:
        if self.ttl:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(1000 * self.ttl))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self.state.get()[4:6] if self.state.exists() else (0, -1)
        self.state.clear()
        yield self._out([(key[0], "expired", last + 1, np.nan, np.nan, n, 0, None)])

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["series_id", "kind", "t", "yhat", "y", "n", "refused", "error"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        params, y, mean, cov, n, last = self.state.get() if self.state.exists() else ([], [], [], [], 0, -1)
        params, mean, cov = (list(x) if x is not None else [] for x in (params, mean, cov))
        came = pd.concat(rows).sort_values(["t", "y"])
        fresh = (came.t > last) & ~came.t.duplicated()
        new, late = came[fresh].y.to_numpy(float), came[~fresh]
        before = np.asarray(y if y is not None else [], float)
        n += len(new)
        whole = before if mean else np.concatenate([before, new])
        last = int(max([last, *came.t]))
        yhat, error = np.nan, None
        try:
            params, mean, cov, yhat, whole = self._next(params, mean, cov, before, new, whole, n)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            error = f"{type(e).__name__}: {e}"
        self.state.update((params, whole.tolist(), mean, cov, n, last))
        self._wait(timerValues)
        out = [(key[0], "error" if error else "forecast", last + 1, yhat, np.nan, n, len(late), error)]
        yield self._out(out + [(key[0], "late", int(t), np.nan, float(v), n, 0, None) for t, v in zip(late.t, late.y, strict=True)])

    def _next(self, params: list, mean: list, cov: list, before: np.ndarray, new: np.ndarray, whole: np.ndarray, n: int):
        """(params, mean, cov, forecast, rows to keep) after the new rows."""
        config = self.config
        if mean:
            options = {k: v for k, v in config.flags().items() if k != "simple_differencing"}
            spec, old, size = statespace.Spec(config.spec(), 0, **options), np.asarray(params, float), len(mean)
            on = statespace.kalman(spec, old[None], new, None, (np.asarray(mean, float), np.asarray(cov, float).reshape(size, size), n - len(new)))
            return params, on.mean[0].tolist(), on.cov[0].ravel().tolist(), float(on.mean[0] @ spec.system(old[None])[2][0]), whole
        if not params and len(whole) < self.min_rows:
            return params, mean, cov, np.nan, whole
        if params:
            made = statespace.at_params(before, config.spec(), None, np.asarray(params, float), method=config.method, **config.flags())
            if len(new):
                made = updated(made, new, None, config.method) if self.refit else statespace.at_params(whole, config.spec(), None, made.params, method=config.method, **config.flags())
        else:
            made, _, _, error = fit_one(config, whole, None)
            if made is None:
                raise ValueError(error.partition(": ")[2] or error)
        yhat = float(made.forecast(1)[0][0])
        if not np.isfinite(yhat):
            raise ValueError("the forecast is not finite")
        if self.refit:
            return made.params.tolist(), [], [], yhat, whole
        return made.params.tolist(), made.filtered.mean[0].tolist(), made.filtered.cov[0].ravel().tolist(), yhat, np.empty(0)

    def close(self) -> None:
        pass

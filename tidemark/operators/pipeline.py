"""Pipelines of transformers ending in a model, and cross-validation over folds in parallel."""

from __future__ import annotations

import copy
import math
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import arima
from tidemark.operators.arima import ARIMA, fit_all, kernel_score, packed, unpacked
from tidemark.operators.auto import AutoARIMA, search_many
from tidemark.operators.guards import check_is_fitted
from tidemark.operators.metrics import BaseTSCrossValidator, average_forecasts, check_cv
from tidemark.operators.transforms import BaseEndogTransformer, BaseExogFeaturizer, BaseTransformer, UpdatableMixin, horizon
from tidemark.sources.scratch import written


class Pipeline:
    """Named transformers and, last, an ARIMA or AutoARIMA.

    ``models_`` is lazy, so every action on it fits again. With ``store``, fit() and update() run at once and leave their
    models as a table in the folder that driver and executors share: forecasts, summaries and updates read it.
    """

    def __init__(self, steps: list[tuple[str, object]], store: bool = False):
        names = [n for n, _ in steps]
        if len({*names}) != len(names):
            raise ValueError("step names must be unique")
        if any("__" in n for n in names):
            raise ValueError("step names must not contain '__'")
        if {"steps", "store"} & {*names}:
            raise ValueError("step names must not be names of the constructor's arguments")
        if any(not isinstance(s, BaseTransformer) for _, s in steps[:-1]):
            raise TypeError("all steps but the last must be transformers")
        if not steps or not isinstance(steps[-1][1], (ARIMA, AutoARIMA)):
            raise TypeError("the last step must be an ARIMA or AutoARIMA")
        self.steps = list(steps)
        self.store = store

    def __len__(self) -> int:
        return len(self.steps)

    @property
    def named_steps(self) -> dict[str, object]:
        return dict(self.steps)

    def _step_args(self, given: dict) -> dict[str, dict]:
        """Arguments called step__name, by step."""
        out: dict[str, dict] = {n: {} for n, _ in self.steps}
        for key, value in given.items():
            step, _, name = key.partition("__")
            if step not in out or not name:
                raise ValueError(f"{key!r} is not step__argument of one of the steps {sorted(out)}")
            out[step][name] = value
        return out

    def fit(self, df: DataFrame, exog: list[str] | None = None, **step_args) -> Pipeline:
        """Fit clones of the transformers, then the model; ``models_`` has the model rows. step_args are step__argument=value."""
        args = self._step_args(step_args)
        self.fitted_, self.exog_ = [], list(exog or [])
        base = df.columns
        for name, step in self.steps[:-1]:
            step = copy.deepcopy(step).fit(df, **args[name])
            before = df.columns
            df = step.transform(df)
            self.fitted_.append((name, step))
            self.exog_ = [c for c in self.exog_ if c in df.columns] + [c for c in df.columns if c not in before and c not in base]
        self.rows_ = df
        models = self.steps[-1][1].fit(df, self.exog_, **args[self.steps[-1][0]])
        self.models_ = written(models) if self.store else models
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        check_is_fitted(self, "models_")
        for _, step in self.fitted_:
            df = step.transform(df)
        return df

    def _future(self, n_periods: int, future: DataFrame | None) -> DataFrame | None:
        if not self.exog_:
            return None
        x = future if future is not None else horizon(self.rows_, n_periods)
        for _, step in self.fitted_:
            if isinstance(step, BaseExogFeaturizer):
                x = step.future(x)
        return x

    def _inverse(self, df: DataFrame, inverse_transform: bool) -> DataFrame:
        if inverse_transform:
            for _, step in reversed(self.fitted_):
                if isinstance(step, BaseEndogTransformer):
                    df = step.inverse_transform(df, ("yhat", "lower", "upper"))
        return df

    def predict(self, n_periods: int = 10, future: DataFrame | None = None, alpha: float = 0.05, inverse_transform: bool = True) -> DataFrame:
        """Forecasts on the scale of y: only exogenous steps run forward, endogenous steps backward."""
        check_is_fitted(self, "models_")
        return self._inverse(arima.predict(self.models_, n_periods, self._future(n_periods, future), alpha), inverse_transform)

    def predict_in_sample(self, inverse_transform: bool = True, **options) -> DataFrame:
        check_is_fitted(self, "models_")
        return self._inverse(arima.predict_in_sample(self.models_, **options), inverse_transform)

    def update(self, new: DataFrame, maxiter: int | None = None) -> Pipeline:
        """Rows after the end of the fitted ones: transformed, appended, refitted shortly."""
        check_is_fitted(self, "models_")
        for _, step in self.fitted_:
            new = step.update_and_transform(new) if isinstance(step, UpdatableMixin) else step.transform(new)
        models = arima.update(self.models_, new, maxiter)
        self.models_ = written(models) if self.store else models
        self.rows_ = self.rows_.select("series_id", "t", "y", *self.exog_).unionByName(new.select("series_id", "t", "y", *self.exog_))
        return self

    def summary(self) -> DataFrame:
        check_is_fitted(self, "models_")
        return arima.summary(self.models_)


#: Folds that a task row has of one series: so often is a series sent, however many folds it has.
FOLDS = 64


def _fold_tasks(df: DataFrame, exog: list[str], cv: BaseTSCrossValidator) -> DataFrame:
    """(series_id, y, x, folds): packed series with the bounds of up to FOLDS folds. What is shuffled grows with the rows, not with rows times folds."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = packed(df, exog).withColumn("all", cv.bounds(F.size("y")))
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / FOLDS).cast("int")), lambda i: F.slice("all", i * FOLDS + 1, FOLDS)))
    return series.select("series_id", "y", "x", parts.alias("folds")).repartition(width)


def _fit_folds(estimator: ARIMA | AutoARIMA, pdf: pd.DataFrame, exog: list[str]):
    """(series_id, fold, test values, forecasts or the error, seconds of the fit, seconds of the forecast) of all folds, fitted side by side."""
    tasks = []
    for i, y, x, folds in zip(pdf.series_id, *unpacked(pdf, exog), pdf.folds, strict=True):
        tasks += [(i, f, y, x) for f in folds]
    cut = lambda a, f, b, e: None if a is None else a[int(f[b]) : int(f[e])]
    ys, xs = [cut(y, f, "start", "split") for _, f, y, _ in tasks], [cut(x, f, "start", "split") for _, f, _, x in tasks]
    began = time.perf_counter()
    if isinstance(estimator, AutoARIMA):
        fits = [found if isinstance(found, str) else found[0].made for found in search_many(estimator, ys, xs)]
    else:
        fits = [made if error is None else error for made, _, _, error in fit_all([estimator] * len(ys), ys, xs, errors=False)]
    each = (time.perf_counter() - began) / max(len(tasks), 1)
    for (i, f, y, x), made in zip(tasks, fits, strict=True):
        test, began = cut(y, f, "split", "stop"), time.perf_counter()
        try:
            mean = made if isinstance(made, str) else made.forecast(len(test), cut(x, f, "split", "stop"))[0]
        except (ValueError, np.linalg.LinAlgError) as e:
            mean = f"{type(e).__name__}: {e}"
        yield i, f, test, mean, each, time.perf_counter() - began


def cross_validate(estimator: ARIMA | AutoARIMA, df: DataFrame, exog: list[str] | None = None, scoring: str | Callable = "mean_squared_error", cv: BaseTSCrossValidator | None = None, error_score: float | str = math.nan) -> DataFrame:
    """(series_id, fold, test_score, fit_time, score_time); the folds of a task are fitted side by side, so its fit times are means."""
    exog = exog or []
    if isinstance(error_score, str) and error_score != "raise":
        raise ValueError("error_score must be 'raise' or a number")
    score = kernel_score(scoring)

    def run(frames):
        for pdf in frames:
            rows = []
            for i, f, test, mean, fit_time, seconds in _fit_folds(estimator, pdf, exog):
                if isinstance(mean, str):
                    if error_score == "raise":
                        raise ValueError(mean)
                    rows.append((i, int(f["fold"]), float(error_score), math.nan, math.nan))
                    continue
                began = time.perf_counter()
                value = float(score(test, mean))
                rows.append((i, int(f["fold"]), value, fit_time, seconds + time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["series_id", "fold", "test_score", "fit_time", "score_time"])

    return _fold_tasks(df, exog, check_cv(cv)).mapInPandas(run, "series_id string, fold int, test_score double, fit_time double, score_time double")


def cross_val_score(estimator, df: DataFrame, **options) -> DataFrame:
    """(series_id, fold, test_score)."""
    return cross_validate(estimator, df, **options).select("series_id", "fold", "test_score")


def cross_val_predict(estimator: ARIMA | AutoARIMA, df: DataFrame, exog: list[str] | None = None, cv: BaseTSCrossValidator | None = None, averaging: str | Callable = "mean", return_raw_predictions: bool = False) -> DataFrame:
    """(series_id, t, yhat) averaged over folds, or raw (series_id, fold, t, h, yhat)."""
    exog = exog or []
    cv = check_cv(cv)
    if cv.step > cv.h:
        raise ValueError("the step of cross_val_predict must not be larger than the horizon")

    def run(frames):
        for pdf in frames:
            out = []
            for i, f, test, mean, *_ in _fit_folds(estimator, pdf, exog):
                if isinstance(mean, str):
                    raise ValueError(mean)
                out += [(i, int(f["fold"]), int(f["split"]) + h, h + 1, float(v)) for h, v in enumerate(mean)]
            yield pd.DataFrame(out, columns=["series_id", "fold", "t", "h", "yhat"])

    raw = _fold_tasks(df, exog, cv).mapInPandas(run, "series_id string, fold int, t long, h int, yhat double")
    return raw if return_raw_predictions else average_forecasts(raw, averaging)


def naive_predict(df: DataFrame, cv: BaseTSCrossValidator | None = None, averaging: str = "mean") -> DataFrame:
    """cross_val_predict of the last-value forecaster, as joins and aggregates only: a row a fold meets the last value before its split."""
    cv = check_cv(cv)
    last = df.select("series_id", (F.col("t") + 1).alias("split"), F.col("y").alias("yhat"))
    rows = cv.folds(df).join(last, ["series_id", "split"]).select("series_id", "yhat", F.explode(F.sequence("split", F.col("stop") - 1)).alias("t"))
    return average_forecasts(rows, averaging)

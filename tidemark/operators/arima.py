"""ARIMA models of many series: fit, predict, predict in sample and update as grouped kernels.

The fitted models are rows of a table (MODEL_SCHEMA), one a series; every operation reads and
returns DataFrames. Fits run over packed rows (one array a series), many series side by side in one
recursion; a failed fit is a row with ``error``.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from numbers import Integral
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import tidemark
from tidemark.functions import batch, statespace
from tidemark.functions.optimise import METHODS
from tidemark.functions.statespace import Order

_ROOTS = "array<struct<re:double,im:double>>"
MODEL_FIELDS = {
    "series_id": "string",
    "order": "struct<p:array<int>,d:int,q:array<int>>",
    "seasonal_order": "struct<P:array<int>,D:int,Q:array<int>,m:int>",
    "trend": "string",
    "with_intercept": "boolean",
    **dict.fromkeys(("params", "bse", "pvalues", "resid", "fitted", "y", "exog", "oob_preds"), "array<double>"),
    **dict.fromkeys(("param_names", "exog_names"), "array<string>"),
    **dict.fromkeys(("llf", "aic", "aicc", "bic", "hqic", "oob", "sigma2", "fit_time"), "double"),
    **dict.fromkeys(("nobs", "nobs_effective"), "long"),
    "df_model": "int",
    "ar_roots": _ROOTS,
    "ma_roots": _ROOTS,
    "converged": "boolean",
    "method": "string",
    "options": "map<string,boolean>",
    **dict.fromkeys(("label", "error", "pkg_version"), "string"),
}
MODEL_SCHEMA = ", ".join(f"`{k}` {v}" for k, v in MODEL_FIELDS.items())
COLUMNS = list(MODEL_FIELDS)

#: Hold-out scores by name, on arrays.
KERNEL_SCORES: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "mse": lambda y, p: float(np.mean((y - p) ** 2)),
    "mae": lambda y, p: float(np.mean(np.abs(y - p))),
    "smape": lambda y, p: float(np.mean(200 * np.abs(p - y) / (np.abs(p) + np.abs(y)))),
    "mean_squared_error": lambda y, p: float(np.mean((y - p) ** 2)),
    "mean_absolute_error": lambda y, p: float(np.mean(np.abs(y - p))),
    "root_mean_squared_error": lambda y, p: float(np.sqrt(np.mean((y - p) ** 2))),
    "mean_absolute_percentage_error": lambda y, p: float(np.mean(np.abs(y - p) / np.maximum(np.abs(y), 2.220446049250313e-16))),
    "mean_squared_log_error": lambda y, p: float(np.mean((np.log1p(y) - np.log1p(p)) ** 2)),
    "median_absolute_error": lambda y, p: float(np.median(np.abs(y - p))),
    "max_error": lambda y, p: float(np.max(np.abs(y - p))),
    "r2_score": lambda y, p: float(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2)),
}


def kernel_score(scoring: str | Callable) -> Callable[[np.ndarray, np.ndarray], float]:
    """A score of arrays by name, or the given callable of (y, yhat)."""
    if callable(scoring):
        return scoring
    if not isinstance(scoring, str):
        raise TypeError("scoring is a name or a callable")
    if scoring not in KERNEL_SCORES:
        raise ValueError(f"scoring must be one of {sorted(KERNEL_SCORES)}")
    return KERNEL_SCORES[scoring]


#: The state-space options.
FLAGS = ("enforce_stationarity", "enforce_invertibility", "simple_differencing", *statespace.Spec.FORMS)


def check_seasonal_order(order: tuple) -> tuple:
    """(0, 0, 0, 1) means no season."""
    order = tuple(order)
    if len(order) != 4:
        raise ValueError("seasonal_order has four parts")
    return (0, 0, 0, 0) if order[3] <= 1 and not any(order[:3]) else order


@dataclass
class ARIMA:
    """Configuration of one model for all series of a table."""

    order: tuple = (1, 0, 0)
    seasonal_order: tuple = (0, 0, 0, 0)
    start_params: list | None = None
    method: str = "lbfgs"
    maxiter: int = 50
    out_of_sample_size: int = 0
    scoring: str | Callable = "mse"
    trend: str | list | None = None
    with_intercept: bool = True
    sarimax_kwargs: dict = field(default_factory=dict)

    def __post_init__(self):
        self.seasonal_order = check_seasonal_order(self.seasonal_order)
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {sorted(METHODS)}")
        if not self.maxiter:
            raise ValueError("maxiter must be a positive integer")
        if self.out_of_sample_size < 0:
            raise ValueError("out_of_sample_size must be a non-negative integer")
        kernel_score(self.scoring)
        for k in self.sarimax_kwargs:
            if k not in FLAGS:
                raise TypeError(f"unknown option {k}")
        statespace.Spec(self.spec(), 0, **{k: v for k, v in self.flags().items() if k != "simple_differencing"})

    def spec(self) -> Order:
        trend = self.trend if self.trend is not None else "c" if self.with_intercept else "n"
        if not isinstance(trend, str):
            trend = "".join(str(int(x)) for x in trend)
        p, d, q = self.order
        P, D, Q, m = self.seasonal_order
        order = Order(p, d, q, P, D, Q, m, trend)
        order.powers  # noqa: B018  refuses unknown trends
        return order

    def flags(self) -> dict:
        return {k: bool(v) for k, v in self.sarimax_kwargs.items() if v is not None}

    # Operations over tables

    def fit(self, df: DataFrame, exog: list[str] | None = None, **fit_args) -> DataFrame:
        """Model rows of (series_id, t, y, exog...). fit_args override fields of the configuration (method, maxiter, ...)."""
        exog = exog or []
        config = replace(self, **fit_args) if fit_args else self

        def run(frames):
            for pdf in frames:
                for begin in range(0, len(pdf), ROWS):
                    part = pdf.iloc[begin : begin + ROWS]
                    fits = fit_all([config] * len(part), *unpacked(part, exog))
                    yield pd.DataFrame([model_row(i, *found, exog) for i, found in zip(part.series_id, fits, strict=True)], columns=COLUMNS)

        return packed(df, exog).mapInPandas(run, MODEL_SCHEMA)

    def fit_predict(self, df: DataFrame, exog: list[str] | None = None, n_periods: int = 10, future: DataFrame | None = None) -> DataFrame:
        return predict(self.fit(df, exog), n_periods, future)


#: Series whose model rows are made at once.
ROWS = 2000


def packed(df: DataFrame, exog: list[str] | None = None) -> DataFrame:
    """(series_id, y, x): one row a series, its values in order of t, and its regressors row by row.

    The rows are dealt to as many partitions as the shuffle has, so that tasks of few bytes and much work are not merged.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(math.nan))
    names = [f"x{i}" for i in range(len(exog or []))]
    rows = df.select("series_id", "t", value("y").alias("y"), *[value(c).alias(k) for c, k in zip(exog or [], names, strict=True)])
    rows = rows.repartition(n, "series_id").groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("t", "y", *names))).alias("rows"))
    x = F.flatten(F.transform("rows", lambda r: F.array(*[r[k] for k in names]))) if names else F.array().cast("array<double>")
    return rows.select("series_id", F.col("rows.y").alias("y"), x.alias("x"))


def unpacked(pdf: pd.DataFrame, exog: list[str]) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """The values and regressors of packed rows."""
    ys = [np.asarray(y, float) for y in pdf["y"]]
    return ys, [np.asarray(x, float).reshape(len(y), -1) if exog else None for x, y in zip(pdf["x"], ys, strict=True)]


def arrays(pdf: pd.DataFrame, exog: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
    pdf = pdf.sort_values("t")
    return pdf["y"].to_numpy(float), pdf[exog].to_numpy(float) if exog else None


def fit_one(config: ARIMA, y: np.ndarray, x: np.ndarray | None):
    """(Fit or None, hold-out score, hold-out forecasts, error)."""
    oob, preds = math.nan, None
    try:
        start = None if config.start_params is None else np.asarray(config.start_params, float)
        cut = config.out_of_sample_size
        if cut >= len(y) and cut:
            raise ValueError("out_of_sample_size must be less than the number of rows")
        made = statespace.fit(y[: len(y) - cut], config.spec(), None if x is None else x[: len(y) - cut], config.method, config.maxiter, start, **config.flags())
        if cut:
            preds, _ = made.forecast(cut, None if x is None else x[-cut:])
            oob = float(kernel_score(config.scoring)(y[-cut:], preds))
            made = updated(made, y[-cut:], None if x is None else x[-cut:], config.method)
        return made, oob, preds, None
    except (ValueError, np.linalg.LinAlgError) as e:
        return None, oob, preds, f"{type(e).__name__}: {e}"


def fit_all(configs: list[ARIMA], ys: list[np.ndarray], xs: list[np.ndarray | None], errors: bool = True) -> list[tuple]:
    """fit_one() of many series, each with its model (which differ in order, intercept and start only), side by side where the optimiser can."""
    config = configs[0]
    if config.method != "lbfgs":
        return [fit_one(c, y, x) for c, y, x in zip(configs, ys, xs, strict=True)]
    cut, orders = config.out_of_sample_size, [c.spec() for c in configs]
    starts = [None if c.start_params is None else np.asarray(c.start_params, float) for c in configs]
    out: list = [None] * len(ys)
    for i, y in enumerate(ys):
        if cut and cut >= len(y):
            out[i] = None, math.nan, None, "ValueError: out_of_sample_size must be less than the number of rows"
    left = [i for i in range(len(ys)) if out[i] is None]
    head = lambda a: a if a is None else a[: len(a) - cut]
    fits = batch.fit_many([head(ys[i]) for i in left], [orders[i] for i in left], [head(xs[i]) for i in left], config.maxiter, [starts[i] for i in left], errors=errors and not cut, **config.flags())
    for i, made in zip(left, fits, strict=True):
        out[i] = (None, math.nan, None, made) if isinstance(made, str) else (made, math.nan, None, None)
    if cut:
        # The hold-out is forecast, scored and then taken in by a short refit from the old parameters.
        good = [i for i in left if out[i][0] is not None]
        tails = [None if xs[i] is None else xs[i][-cut:] for i in good]
        preds = [out[i][0].forecast(cut, x)[0] for i, x in zip(good, tails, strict=True)]
        again = batch.fit_many([ys[i] for i in good], [orders[i] for i in good], [xs[i] for i in good], max(5, cut // 10), [out[i][0].params for i in good], errors=errors, **config.flags())
        for i, p, made in zip(good, preds, again, strict=True):
            oob = float(kernel_score(config.scoring)(ys[i][-cut:], p))
            out[i] = (None, oob, p, made) if isinstance(made, str) else (made, oob, p, None)
    return out


def updated(made: statespace.Fit, y: np.ndarray, x: np.ndarray | None, method: str | None = None, maxiter: int | None = None) -> statespace.Fit:
    """Rows appended and a short refit from the old parameters, under the first fit's options."""
    x = None if made.exog is None else np.concatenate([made.exog, x])
    return statespace.fit(np.concatenate([made.y, y]), made.spec.order, x, method or made.method, maxiter or max(5, len(y) // 10), made.params, **made.options())


def _roots(r: np.ndarray) -> list[dict]:
    return [{"re": float(np.real(z)), "im": float(np.imag(z))} for z in r]


def model_frame(series_id, made: statespace.Fit | None, oob: float, preds, error: str | None, exog: list[str]) -> pd.DataFrame:
    """The model row of one series as a frame."""
    return pd.DataFrame([model_row(series_id, made, oob, preds, error, exog)], columns=COLUMNS)


def model_row(series_id, made: statespace.Fit | None, oob: float, preds, error: str | None, exog: list[str]) -> dict:
    """The model row of one series."""
    row = dict.fromkeys(COLUMNS)
    row |= {"series_id": series_id, "error": error, "pkg_version": tidemark.__version__, "oob": None if math.isnan(oob) else oob, "oob_preds": None if preds is None else list(preds), "exog_names": list(exog)}
    if made is not None:
        o, spec = made.spec.order, made.spec
        ar, ma = made.roots()
        row |= {
            "order": {"p": list(o.lags("p")), "d": o.d, "q": list(o.lags("q"))},
            "seasonal_order": {"P": list(o.lags("P")), "D": o.D, "Q": list(o.lags("Q")), "m": o.s},
            "trend": o.trend, "with_intercept": 0 in o.powers, "params": list(made.params), "param_names": spec.names(list(exog) or None),
            "bse": list(made.bse()), "pvalues": list(made.pvalues()), "resid": list(made.residuals()), "fitted": list(made.fitted()), "y": list(made.y),
            "exog": None if made.exog is None else list(made.exog.ravel()), "llf": made.llf, "sigma2": float(made.params[-1]), "nobs": made.nobs,
            "nobs_effective": made.nobs_effective, "df_model": spec.k, "ar_roots": _roots(ar), "ma_roots": _roots(ma), "converged": made.converged,
            "method": made.method, "options": made.options(),
            "fit_time": made.fit_time, "label": o.label(), **made.criteria(),
        }
    return row


def loaded(row) -> statespace.Fit:
    """The Fit of a model row (a dict or a pandas row)."""
    if row["error"]:
        raise ValueError(row["error"])
    o, so = row["order"], row["seasonal_order"]
    lags = lambda x: tuple(int(i) for i in x)
    tidy = lambda x: len(x) if lags(x) == tuple(range(1, len(x) + 1)) else lags(x)
    order = Order(tidy(o["p"]), int(o["d"]), tidy(o["q"]), tidy(so["P"]), int(so["D"]), tidy(so["Q"]), int(so["m"]), row["trend"])
    y = np.asarray(row["y"], float)
    x = None if row["exog"] is None else np.asarray(row["exog"], float).reshape(len(y), -1)
    options = {k: bool(v) for k, v in dict(row["options"] or {}).items()}
    kind = statespace.DifferencedFit if options.pop("simple_differencing", False) else statespace.Fit
    params = np.asarray(row["params"], float)
    made = kind(statespace.Spec(order, 0 if x is None else x.shape[1], **options), params, y, x, None, bool(row["converged"]), float(row["fit_time"]), row["method"] or "lbfgs")
    spec, w, z = made.basis
    made.filtered = statespace.kalman(spec, params[None], w, z)
    return made


def check_periods(n_periods: int) -> None:
    if not isinstance(n_periods, int) or isinstance(n_periods, bool):
        raise TypeError("n_periods must be an integer")


def predict(models: DataFrame, n_periods: int = 10, future: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """(series_id, h, yhat, lower, upper) for h = 1..n_periods. future has the models' exogenous columns by (series_id, t)."""
    check_periods(n_periods)
    z = NormalDist().inv_cdf(1 - alpha / 2)
    schema = "series_id string, h int, yhat double, lower double, upper double"

    def one(row, x) -> pd.DataFrame:
        mean, se = loaded(row).forecast(n_periods, x)
        return pd.DataFrame({"series_id": row["series_id"], "h": np.arange(1, n_periods + 1, dtype=np.int32), "yhat": mean, "lower": mean - z * se, "upper": mean + z * se})

    models = models.where("error is null")
    if future is None:

        def batches(frames):
            for pdf in frames:
                rows = [one(r, None) for r in pdf.to_dict("records")]
                if rows:
                    yield pd.concat(rows)

        return models.mapInPandas(batches, schema)

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["series_id", "h", "yhat", "lower", "upper"])
        row = left.to_dict("records")[0]
        names = [str(x) for x in row["exog_names"]]
        return one(row, right.sort_values("t")[names].to_numpy(float) if names else None)

    return models.groupBy("series_id").cogroup(future.groupBy("series_id")).applyInPandas(pair, schema)


def _bounds(models: DataFrame, index: DataFrame | None, label: str, start, end) -> DataFrame:
    """models with first_row and last_row: start and end as row numbers, looked up in the index where they are labels."""
    named = {k: v for k, v in (("first_row", start), ("last_row", end)) if v is not None and not isinstance(v, Integral)}
    bounds = {k: F.lit(None if v is None else int(v)).cast("long") for k, v in (("first_row", start), ("last_row", end)) if k not in named}
    if named:
        if index is None:
            raise TypeError("start and end are row numbers unless an index is given")
        # Of rows with one label, the first is a start and the last an end.
        pick = {"first_row": F.min, "last_row": F.max}
        value = lambda v: F.lit(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v)
        rows = index.groupBy("series_id").agg(*[pick[k](F.when(F.col(label) == value(v), F.col("t"))).alias(k) for k, v in named.items()])
        models = models.drop(*named).join(rows, "series_id", "left")
        for k, v in named.items():
            bounds[k] = F.coalesce(F.col(k), F.raise_error(F.concat(F.lit(f"no row is labelled {v} in series "), "series_id")).cast("long")).cast("long")
    return models.withColumns(bounds)


def predict_in_sample(models: DataFrame, start=None, end=None, dynamic: bool = False, return_conf_int: bool = False, alpha: float = 0.05, index: DataFrame | None = None, label: str = "ts") -> DataFrame:
    """(series_id, t, yhat, lower, upper) of rows start..end, both included; rows beyond the last are forecasts.

    start and end are row numbers, or values (such as timestamps) of the column ``label`` of ``index`` (series_id, t, label);
    the job fails for a series without such a row. Only a start by number is held against the order of differencing.
    """
    if dynamic and return_conf_int:
        warnings.warn("dynamic predictions have no intervals here; dynamic=False is used", stacklevel=2)
        dynamic = False
    z = NormalDist().inv_cdf(1 - alpha / 2)

    def batches(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                made = loaded(row)
                first = 0 if pd.isna(row["first_row"]) else int(row["first_row"])
                if isinstance(start, Integral) and start < made.spec.order.d:
                    raise ValueError("in-sample predictions undefined for start < d when d > 0")
                last = made.nobs - 1 if pd.isna(row["last_row"]) else int(row["last_row"])
                if last < first:
                    raise ValueError("end is before start")
                if dynamic or last < made.nobs:
                    mean, se = made.in_sample(first, last, dynamic)
                else:
                    parts = [x[max(first - made.nobs, 0) :] for x in made.forecast(last - made.nobs + 1)]
                    mean, se = (np.concatenate(x) for x in zip(made.in_sample(first, made.nobs - 1), parts, strict=True))
                out.append(pd.DataFrame({"series_id": row["series_id"], "t": np.arange(first, last + 1), "yhat": mean, "lower": mean - z * se, "upper": mean + z * se}))
            if out:
                yield pd.concat(out)

    return _bounds(models.where("error is null"), index, label, start, end).mapInPandas(batches, "series_id string, t long, yhat double, lower double, upper double")


def update(models: DataFrame, new: DataFrame, maxiter: int | None = None, method: str | None = None) -> DataFrame:
    """Model rows after appending new rows (series_id, t, y, exog...); series without new rows stay as they are."""

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=COLUMNS)
        if not len(right):
            return left[COLUMNS]
        row = left.to_dict("records")[0]
        names = [str(x) for x in row["exog_names"]]
        y, x = arrays(right, names)
        try:
            made, error = updated(loaded(row), y, x, method, maxiter), None
        except (ValueError, np.linalg.LinAlgError) as e:
            made, error = None, f"{type(e).__name__}: {e}"
        return model_frame(row["series_id"], made, math.nan if row["oob"] is None else row["oob"], row["oob_preds"], error, names)

    return models.groupBy("series_id").cogroup(new.groupBy("series_id")).applyInPandas(pair, MODEL_SCHEMA)


def summary(models: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(series_id, param, coef, se, z, p, lower, upper): one row a parameter."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    rows = models.where("error is null").select("series_id", F.explode(F.arrays_zip("param_names", "params", "bse", "pvalues")).alias("x"))
    coef, se = F.col("x.params"), F.col("x.bse")
    return rows.select("series_id", F.col("x.param_names").alias("param"), coef.alias("coef"), se.alias("se"), F.try_divide(coef, se).alias("z"), F.col("x.pvalues").alias("p"), (coef - z * se).alias("lower"), (coef + z * se).alias("upper"))


def to_dict(models: DataFrame) -> DataFrame:
    """(series_id, model): the ten keys of a model as JSON."""
    keys = ["pvalues", "resid", "order", "seasonal_order", "oob", "aic", "aicc", "bic", "bse", "params"]
    return models.select("series_id", F.to_json(F.struct(*keys)).alias("model"))


def residual_diagnostics(models: DataFrame) -> DataFrame:
    """(series_id, ljung_box, jarque_bera, skew, kurtosis, heteroskedasticity) of the residuals after the differencing."""
    # Folds over the residual array of a model row: nothing is exploded or joined, so models are fitted once.
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    power = lambda c, k: total(F.transform(c, lambda v: F.pow(v, F.lit(float(k)))))
    e, d, n = F.col("e"), F.col("d"), F.col("n")
    rows = models.where("error is null").select("series_id", F.expr("slice(resid, cast(nobs - nobs_effective as int) + 1, cast(nobs_effective as int))").alias("e"))
    rows = rows.withColumn("n", F.size("e")).withColumn("mean", F.try_divide(total(e), n)).withColumn("d", F.transform(e, lambda v: v - F.col("mean")))
    third = F.round(n / 3).cast("int")
    # Pairs end in a null where the second list is shorter.
    next_to = total(F.transform(F.arrays_zip(d.alias("a"), F.slice(d, 2, n).alias("b")), lambda v: F.coalesce(v["a"] * v["b"], F.lit(0.0))))
    rows = rows.select(
        "series_id", "n", (power(d, 2) / n).alias("m2"), (power(d, 3) / n).alias("m3"), (power(d, 4) / n).alias("m4"), (next_to / n).alias("c1"),
        F.try_divide(power(F.slice(e, n - third + 1, third), 2), power(F.slice(e, 1, third), 2)).alias("heteroskedasticity"),
    )
    skew, kurtosis = F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5))), F.try_divide(F.col("m4"), F.col("m2") ** 2)
    q = n * (n + 2) * F.try_divide(F.col("c1"), F.col("m2")) ** 2 / (n - 1)
    return rows.select("series_id", q.alias("ljung_box"), (n / 6 * (skew**2 + (kurtosis - 3) ** 2 / 4)).alias("jarque_bera"), skew.alias("skew"), kurtosis.alias("kurtosis"), "heteroskedasticity")


def coefficients(models: DataFrame) -> DataFrame:
    """(series_id, arparams, maparams): the coefficients of the reduced AR (1 - ...) and MA (1 + ...) polynomials."""

    def batches(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                made = loaded(row)
                ar, ma = made.spec.polynomials(made.params[None])
                out.append((row["series_id"], list(ar[0]), list(ma[0])))
            yield pd.DataFrame(out, columns=["series_id", "arparams", "maparams"])

    return models.where("error is null").mapInPandas(batches, "series_id string, arparams array<double>, maparams array<double>")


def moving_coefficients(models: DataFrame) -> DataFrame:
    """(series_id, param, coef, se): the coefficients that are states (mle_regression=False), after the last row."""

    def batches(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                made = loaded(row)
                k = made.spec.k_moving
                if k:
                    at = slice(made.spec.n_states - k, made.spec.n_states)
                    se = np.sqrt(np.maximum(np.diag(made.filtered.cov[0])[at], 0))
                    out += [(row["series_id"], str(n), float(v), float(e)) for n, v, e in zip(row["exog_names"], made.filtered.mean[0][at], se, strict=True)]
            yield pd.DataFrame(out, columns=["series_id", "param", "coef", "se"])

    return models.where("error is null").mapInPandas(batches, "series_id string, param string, coef double, se double")


def psi_weights(ar: Column, ma: Column, max_deg: int) -> Column:
    """The first max_deg weights of the infinite moving average of arrays of AR (1 - ...) and MA (1 + ...) coefficients."""

    def step(psi: Column, i: Column) -> Column:
        # The weight before the first one is 1; psi has those after it.
        earlier = lambda j: F.when(j == i, 1.0).otherwise(F.coalesce(F.get(psi, i - j - 1), F.lit(0.0)))
        lags = F.transform(ar, lambda a, j: F.when(j <= i, a * earlier(j)).otherwise(0.0))
        return F.concat(psi, F.array(F.coalesce(F.get(ma, i), F.lit(0.0)) + F.aggregate(lags, F.lit(0.0), lambda acc, v: acc + v)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(max_deg - 1)), F.array().cast("array<double>"), step)


def conf_int(models: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(series_id, param, lower, upper)."""
    return summary(models, alpha).select("series_id", "param", "lower", "upper")


def degrees(models: DataFrame) -> DataFrame:
    """(series_id, df_model, df_resid): parameters, and rows after the differencing less parameters."""
    return models.where("error is null").select("series_id", "df_model", (F.col("nobs_effective") - F.col("df_model")).alias("df_resid"))

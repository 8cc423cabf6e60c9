"""Forecast accuracy as aggregate expressions over columns, and sequential splits and folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import whole


def smape(y: Column, yhat: Column) -> Column:
    """Symmetric mean absolute percentage error, 0 to 200; NaN if both are zero anywhere."""
    size = F.abs(yhat) + F.abs(y)
    return F.avg(F.when(size == 0, F.lit(float("nan"))).otherwise(F.try_divide(200 * F.abs(yhat - y), size)))


def _r2(y: Column, yhat: Column) -> Column:
    return 1 - F.try_divide(F.sum((y - yhat) ** 2), F.var_pop(y) * F.count(y))


#: Name -> aggregate expression of (y, yhat).
SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "mse": lambda y, p: F.avg((y - p) ** 2),
    "mean_squared_error": lambda y, p: F.avg((y - p) ** 2),
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "mean_absolute_error": lambda y, p: F.avg(F.abs(y - p)),
    "root_mean_squared_error": lambda y, p: F.sqrt(F.avg((y - p) ** 2)),
    "mean_absolute_percentage_error": lambda y, p: F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))),
    "mean_squared_log_error": lambda y, p: F.avg((F.log1p(y) - F.log1p(p)) ** 2),
    "median_absolute_error": lambda y, p: F.median(F.abs(y - p)),
    "max_error": lambda y, p: F.max(F.abs(y - p)),
    "r2_score": _r2,
    "smape": smape,
}


def get_scoring_metric(metric: str | Callable) -> Callable[[Column, Column], Column]:
    """A score by name, or the given callable of two columns."""
    if callable(metric):
        return metric
    if not isinstance(metric, str):
        raise TypeError("a scoring metric is a name or a callable")
    if metric not in SCORES:
        raise ValueError(f"{metric!r} is not a valid scoring metric; known: {sorted(SCORES)}")
    return SCORES[metric]


def score(df: DataFrame, metrics: list[str], by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Scores of columns y and yhat, by key."""
    return df.groupBy(*by).agg(*[get_scoring_metric(m)(F.col("y"), F.col("yhat")).alias(m) for m in metrics])


def forecast_errors(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """(series_id, t, y, yhat, error) of the rows that both have."""
    both = actual.select("series_id", "t", "y").join(forecast.select("series_id", "t", "yhat"), ["series_id", "t"])
    return both.withColumn("error", F.col("y") - F.col("yhat"))


def best_rows(df: DataFrame, by: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each series in the given order."""
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(*by))
    return df.withColumn("place", place).where(F.col("place") <= k).drop("place")


def average_forecasts(df: DataFrame, averaging: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """(series_id, t, yhat): forecasts of several folds for one t, averaged without nulls and NaN.

    averaging is mean, median or an aggregate function of a column.
    """
    if not callable(averaging) and averaging not in ("mean", "median"):
        raise ValueError("averaging must be 'mean' or 'median' or a callable")
    how = averaging if callable(averaging) else F.avg if averaging == "mean" else F.median
    return df.where("yhat is not null and not isnan(yhat)").groupBy("series_id", "t").agg(how("yhat").alias("yhat"))


def train_test_split(df: DataFrame, test_size: float | None = None, train_size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Heads and tails of all series, without shuffling; sizes are counts or shares, default a quarter for the test."""
    if test_size is None and train_size is None:
        test_size = 0.25
    n = F.count(F.lit(1)).over(whole())

    def rows(size, up: bool) -> Column:
        if isinstance(size, int):
            return F.lit(size)
        return (F.ceil if up else F.floor)(n * size)

    n_test = rows(test_size, True) if test_size is not None else n - rows(train_size, False)
    n_train = rows(train_size, False) if train_size is not None else n - n_test
    marked = df.withColumn("n_train", n_train).withColumn("n_test", n_test)
    tail = (F.col("t") >= F.col("n_train")) & (F.col("t") < F.col("n_train") + F.col("n_test"))
    return tuple(marked.where(c).drop("n_train", "n_test") for c in (F.col("t") < F.col("n_train"), tail))


class BaseTSCrossValidator:
    """folds(df) gives (series_id, fold, start, split, stop): train [start, split), test [split, stop)."""

    def __init__(self, h: int = 1, step: int = 1):
        if h < 1:
            raise ValueError("h must be a positive value")
        if step < 1:
            raise ValueError("step must be a positive value")
        self.h, self.horizon, self.step = h, h, step

    def _first(self, n: Column) -> Column:
        raise NotImplementedError

    def _start(self, split: Column, n: Column) -> Column:
        raise NotImplementedError

    def bounds(self, n: Column) -> Column:
        """The folds of a series of n rows, as an array of (fold, start, split, stop)."""
        first, last = self._first(n), n.cast("long") - self.h
        short = F.raise_error(F.lit("the series is too short for the first fold"))
        splits = F.sequence(first, F.when(last >= first, last).otherwise(short.cast("long")), F.lit(self.step).cast("long"))
        return F.transform(splits, lambda s, i: F.struct(i.alias("fold"), self._start(s, n).alias("start"), s.alias("split"), (s + self.h).alias("stop")))

    def folds(self, df: DataFrame) -> DataFrame:
        sizes = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
        return sizes.select("series_id", F.inline(self.bounds(F.col("n"))))

    def split(self, df: DataFrame) -> DataFrame:
        """(series_id, fold, t, role): every row of every fold; an equi-join on the exploded positions."""
        rows = self.folds(df).select("series_id", "fold", "split", F.explode(F.sequence("start", F.col("stop") - 1)).alias("t"))
        role = F.when(F.col("t") < F.col("split"), "train").otherwise("test")
        return rows.select("series_id", "fold", "t", role.alias("role"))


class RollingForecastCV(BaseTSCrossValidator):
    """Expanding train windows from ``initial`` rows (a third of the series by default)."""

    def __init__(self, h: int = 1, step: int = 1, initial: int | None = None):
        super().__init__(h, step)
        if initial is not None and initial < 1:
            raise ValueError("initial must be a positive value")
        self.initial = initial

    def _first(self, n: Column) -> Column:
        return F.lit(self.initial).cast("long") if self.initial else F.greatest(F.lit(1), F.floor(n / 3)).cast("long")

    def _start(self, split: Column, n: Column) -> Column:
        return F.lit(0).cast("long")


class SlidingWindowForecastCV(BaseTSCrossValidator):
    """Train windows of a fixed size (a fifth of the series, at least 3, by default)."""

    def __init__(self, h: int = 1, step: int = 1, window_size: int | None = None):
        super().__init__(h, step)
        if window_size is not None and window_size < 3:
            raise ValueError("window_size must be larger than 2")
        self.window_size = window_size

    def _first(self, n: Column) -> Column:
        return F.lit(self.window_size).cast("long") if self.window_size else F.greatest(F.lit(3), F.floor(n / 5)).cast("long")

    def _start(self, split: Column, n: Column) -> Column:
        return split - self._first(n)


def check_cv(cv: BaseTSCrossValidator | None = None) -> BaseTSCrossValidator:
    if cv is None:
        return RollingForecastCV()
    if not isinstance(cv, BaseTSCrossValidator):
        raise TypeError("cv must be a BaseTSCrossValidator")
    return cv


def rows_of_folds(df: DataFrame, cv: BaseTSCrossValidator) -> DataFrame:
    """df joined to its folds: one row for each fold that a row of df is in."""
    return df.join(cv.split(df), ["series_id", "t"])



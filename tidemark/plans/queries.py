"""The registered queries of the time-series operators, and their DuckDB SQL.

Base series: S5 is monthly revenue by market segment (orders joined to customer), S2 is the
daily sum of events by type. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import statespace, unitroot
from tidemark.operators import arima, auto, diagnostics, metrics, pipeline, series, transforms, windows
from tidemark.operators.arima import ARIMA
from tidemark.sources import datasets
from tidemark.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

S5_SQL = """
WITH base_m AS (SELECT c_mktsegment AS series_id, date_trunc('month', o_orderdate) AS ts, round(sum(o_totalprice), 2) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
base_b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM base_m GROUP BY 1),
base_c AS (SELECT series_id, hi, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS ts FROM base_b),
s AS (SELECT base_c.series_id, row_number() OVER (PARTITION BY base_c.series_id ORDER BY base_c.ts) - 1 AS t, base_c.ts, coalesce(base_m.y, 0) AS y FROM base_c LEFT JOIN base_m ON base_c.series_id = base_m.series_id AND base_c.ts = base_m.ts WHERE base_c.ts < base_c.hi)
"""
S2_SQL = """
WITH base_m AS (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, round(sum(value), 2) AS y FROM events GROUP BY 1, 2),
base_b AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM base_m GROUP BY 1),
base_c AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM base_b),
s AS (SELECT base_c.series_id, row_number() OVER (PARTITION BY base_c.series_id ORDER BY base_c.ts) - 1 AS t, base_c.ts, coalesce(base_m.y, 0) AS y FROM base_c LEFT JOIN base_m ON base_c.series_id = base_m.series_id AND base_c.ts = base_m.ts)
"""


def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return series.regular(orders.join(customer, orders.o_custkey == customer.c_custkey), "c_mktsegment", "o_orderdate", F.col("o_totalprice"), "month", drop_last=True).withColumn("y", F.round("y", 2))


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.regular(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value"), "event_type", "ts", F.col("value"), "day").withColumn("y", F.round("y", 2))


def r(c: Column | str, name: str, digits: int = 4) -> Column:
    """Rounded, without negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0).alias(name)


def register(name: str, sql: str | None = None, base: str = S5_SQL):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (base + sql).strip()
        return f

    return put


# Sources


def _dataset(key: str, name: str):
    """A classic series as a regressor beside the base series: rows of equal t."""
    values = ", ".join(f"({t}, {float(y)})" for t, y in enumerate(datasets.SERIES[name]))
    sql = f", v AS (SELECT CAST(t AS BIGINT) AS t, CAST(x AS DOUBLE) AS x FROM (VALUES {values}) AS v(t, x)) SELECT s.series_id, s.t, round(s.y, 2) AS y, v.x FROM s JOIN v ON v.t = s.t"

    def run(spark, sf_dir):
        beside = datasets.load(spark, name).select("t", F.col("y").alias("x"))
        return s5(spark, sf_dir).join(beside, "t").select("series_id", "t", r("y", "y", 2), "x")

    register(key, sql)(run)


for _key, _name in (("O01_airpassengers", "airpassengers"), ("O03_austres", "austres"), ("O04_heartrate", "heartrate"), ("O05_lynx", "lynx"), ("O07_wineind", "wineind"), ("O08_woolyrnq", "woolyrnq")):
    _dataset(_key, _name)


@register("O18_regular_series", "SELECT series_id, t, round(y, 2) AS y FROM s")
def o18(spark, sf_dir):
    return s5(spark, sf_dir).select("series_id", "t", r("y", "y", 2))


@register("O18_daily_events", "SELECT series_id, t, round(y, 2) AS y FROM s", S2_SQL)
def o18b(spark, sf_dir):
    return s2(spark, sf_dir).select("series_id", "t", r("y", "y", 2))


# Projection, filter, validation


@register("O20_check_endog", "SELECT series_id, t, round(y, 2) AS y FROM s")
def o20(spark, sf_dir):
    return series.check_endog(s5(spark, sf_dir), force_all_finite=True).select("series_id", "t", r("y", "y", 2))


@register("O21_check_exog", "SELECT series_id, t, round(y / 1000, 6) AS x FROM s")
def o21(spark, sf_dir):
    return series.check_exog(s5(spark, sf_dir).withColumn("x", F.col("y") / 1000), ["x"]).select("series_id", "t", r("x", "x", 6))


@register("O22_as_series", "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY y) - 1 AS t, round(y, 2) AS y FROM s")
def o22(spark, sf_dir):
    return series.as_series(s5(spark, sf_dir).select("series_id", "y"), "y").select("series_id", "t", r("y", "y", 2))


@register("O23_concatenate", ", p AS (SELECT series_id, 0 AS k, t, y FROM s UNION ALL SELECT series_id, 1, t, -y FROM s) SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY k, t) - 1 AS t, round(y, 2) AS y FROM p")
def o23(spark, sf_dir):
    df = s5(spark, sf_dir)
    return series.concatenate(df, df.withColumn("y", -F.col("y"))).select("series_id", "t", r("y", "y", 2))


@register("O25_is_constant", "SELECT series_id, min(y) = max(y) AS is_constant FROM s GROUP BY 1")
def o25(spark, sf_dir):
    return series.constant(s5(spark, sf_dir))


@register("O26_safe_indexing", "SELECT series_id, t, round(y, 2) AS y FROM s WHERE t % 3 = 1")
def o26(spark, sf_dir):
    df = s5(spark, sf_dir)
    return series.at(df, df.where("t % 3 = 1")).select("series_id", "t", r("y", "y", 2))


@register("O27_reorder_exog", "SELECT series_id, t, round(-y, 2) AS x_b, round(y / 2, 4) AS x_a FROM s")
def o27(spark, sf_dir):
    df = s5(spark, sf_dir).withColumns({"x_a": F.col("y") / 2, "x_b": -F.col("y"), "x_c": F.lit(1)})
    return series.reorder(df, ["x_b", "x_a"]).select("series_id", "t", r("x_b", "x_b", 2), r("x_a", "x_a"))


@register("O28_floor_values", ", a AS (SELECT series_id, avg(y) AS a FROM s GROUP BY 1) SELECT s.series_id, t, round(CASE WHEN y - a <= 0 THEN 0.5 ELSE y - a END, 4) AS y FROM s JOIN a ON s.series_id = a.series_id")
def o28(spark, sf_dir):
    df = s5(spark, sf_dir).withColumn("y", F.col("y") - F.avg("y").over(series.whole()))
    return series.floor_values(df, 0.5, "ignore").select("series_id", "t", r("y", "y"))


@register("O29_complete_lags", ", l AS (SELECT series_id, t, y, lag(y, 2) OVER (PARTITION BY series_id ORDER BY t) AS y2 FROM s) SELECT series_id, t, round(y2, 2) AS y2 FROM l WHERE y2 IS NOT NULL")
def o29(spark, sf_dir):
    return windows.embed(s5(spark, sf_dir), 3).select("series_id", "t", r("lag_2", "y2", 2))


# Joins


@register("O35_bind_features", "SELECT series_id, t, round(y, 2) AS y, round(sin(CAST(CAST(2 * pi() / 12 AS FLOAT) AS DOUBLE) * (t + 1)), 6) + 0.0 AS f FROM s")
def o35(spark, sf_dir):
    df = s5(spark, sf_dir)
    features = transforms.FourierFeaturizer(12, 1).transform(df.select("series_id", "t")).withColumnRenamed("FOURIER_S12-0", "f").drop("FOURIER_C12-0")
    return series.bind(df, features).select("series_id", "t", r("y", "y", 2), r("f", "f", 6))


@register("O37_align", "SELECT series_id, t, round(y, 2) AS y, round(y * 2, 2) AS x FROM s")
def o37(spark, sf_dir):
    df = s5(spark, sf_dir).select("series_id", "t", "y")
    return series.align(df, df.select("series_id", "t", (F.col("y") * 2).alias("x"))).select("series_id", "t", r("y", "y", 2), r("x", "x", 2))


_NAIVE = ", f AS (SELECT series_id, t, y, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS yhat FROM s), g AS (SELECT * FROM f WHERE yhat IS NOT NULL) "


def naive(spark, sf_dir) -> DataFrame:
    df = s5(spark, sf_dir)
    return windows.embed(df, 2).select("series_id", "t", F.col("lag_0").alias("y"), F.col("lag_1").alias("yhat"))


@register("O38_forecast_actual", _NAIVE + "SELECT series_id, t, round(y - yhat, 2) AS error FROM g")
def o38(spark, sf_dir):
    df = s5(spark, sf_dir).select("series_id", "t", "y")
    forecast = df.select("series_id", (F.col("t") + 1).alias("t"), F.col("y").alias("yhat"))
    return metrics.forecast_errors(df, forecast).select("series_id", "t", r("error", "error", 2))


_FOLDS = ", n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT series_id, n, unnest(generate_series({first}, n - 4, 6)) AS split FROM n), g AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY split) - 1 AS fold, {start} AS start, split, split + 4 AS stop FROM f) "


@register("O39_fold_rows", _FOLDS.format(first="40", start="split - 40") + "SELECT s.series_id, g.fold, s.t, CASE WHEN s.t < g.split THEN 'train' ELSE 'test' END AS role, round(s.y, 2) AS y FROM s JOIN g ON s.series_id = g.series_id AND s.t >= g.start AND s.t < g.stop")
def o39(spark, sf_dir):
    return metrics.rows_of_folds(s5(spark, sf_dir), metrics.SlidingWindowForecastCV(4, 6, 40)).select("series_id", "fold", "t", "role", r("y", "y", 2))


# Aggregates


@register("O40_smape", _NAIVE + "SELECT series_id, round(avg(200 * abs(yhat - y) / (abs(yhat) + abs(y))), 6) AS smape FROM g GROUP BY 1")
def o40(spark, sf_dir):
    return metrics.score(naive(spark, sf_dir), ["smape"]).select("series_id", r("smape", "smape", 6))


@register("O41_mse_mae", _NAIVE + "SELECT series_id, round(avg((y - yhat) * (y - yhat)) / 1e9, 6) AS mse, round(avg(abs(y - yhat)), 2) AS mae FROM g GROUP BY 1")
def o41(spark, sf_dir):
    return metrics.score(naive(spark, sf_dir), ["mse", "mae"]).select("series_id", r(F.col("mse") / 1e9, "mse", 6), r("mae", "mae", 2))


@register(
    "O42_scores",
    _NAIVE + "SELECT series_id, round(sqrt(avg((y - yhat) * (y - yhat))), 2) AS rmse, round(avg(abs(y - yhat) / abs(y)), 6) AS mape, round(median(abs(y - yhat)), 2) AS medae, round(max(abs(y - yhat)), 2) AS worst, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2 FROM g GROUP BY 1",
)
def o42(spark, sf_dir):
    names = ["root_mean_squared_error", "mean_absolute_percentage_error", "median_absolute_error", "max_error", "r2_score"]
    s = metrics.score(naive(spark, sf_dir), names)
    return s.select("series_id", r(names[0], "rmse", 2), r(names[1], "mape", 6), r(names[2], "medae", 2), r(names[3], "worst", 2), r(names[4], "r2", 6))


_MEAN = _FOLDS.format(first="30", start="0") + ", k AS (SELECT g.series_id, g.fold, g.split, g.stop, s.y AS yhat FROM g JOIN s ON s.series_id = g.series_id AND s.t = g.split - 1), z AS (SELECT k.series_id, s.t, k.yhat FROM k JOIN s ON s.series_id = k.series_id AND s.t >= k.split AND s.t < k.stop) SELECT series_id, t, round({how}(yhat), 2) AS yhat FROM z GROUP BY 1, 2"


@register("O43_fold_average", _MEAN.format(how="median"))
def o43(spark, sf_dir):
    return pipeline.naive_predict(s5(spark, sf_dir), metrics.RollingForecastCV(4, 6, 30), "median").select("series_id", "t", r("yhat", "yhat", 2))


@register("O44_seasonal_means", "SELECT series_id, t % 12 AS phase, round(avg(y), 4) AS y FROM s GROUP BY 1, 2")
def o44(spark, sf_dir):
    return s5(spark, sf_dir).groupBy("series_id", F.pmod("t", F.lit(12)).alias("phase")).agg(r(F.avg("y"), "y"))


@register("O45_line_residuals", ", f AS (SELECT series_id, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM s GROUP BY 1) SELECT s.series_id, t, round(y - a - b * t, 2) AS y FROM s JOIN f ON s.series_id = f.series_id")
def o45(spark, sf_dir):
    return windows.residuals_of_line(s5(spark, sf_dir).select("series_id", "t", "y"), True).select("series_id", "t", r("y", "y", 2))


@register("O46_tie_means", "SELECT series_id, t % 7 AS x, round(avg(y), 4) AS y FROM s GROUP BY 1, 2")
def o46(spark, sf_dir):
    return s5(spark, sf_dir).groupBy("series_id", (F.col("t") % 7).alias("x")).agg(r(F.avg("y"), "y"))


# Windows


@register("O50_diff", ", a AS (SELECT series_id, t, y - lag(y, 12) OVER w AS y FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)), b AS (SELECT series_id, t, y - lag(y, 12) OVER w AS y FROM a WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, t - 24 AS t, round(y, 2) AS y FROM b WHERE t >= 24")
def o50(spark, sf_dir):
    return windows.diff(s5(spark, sf_dir), 12, 2).select("series_id", "t", r("y", "y", 2))


@register("O51_diff_inv", ", z AS (SELECT series_id, t + 3 AS t, y FROM s UNION ALL SELECT DISTINCT series_id, k, 0 FROM s, range(3) AS k(k)) SELECT series_id, t, round(sum(y) OVER (PARTITION BY series_id, t % 3 ORDER BY t), 2) AS y FROM z")
def o51(spark, sf_dir):
    return windows.diff_inv(s5(spark, sf_dir), 3).select("series_id", "t", r("y", "y", 2))


@register("O52_embed", ", a AS (SELECT series_id, t, y AS lag_0, lag(y) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, t, round(lag_0, 2) AS lag_0, round(lag_1, 2) AS lag_1, round(lag_2, 2) AS lag_2 FROM a WHERE t >= 2")
def o52(spark, sf_dir):
    return windows.embed(s5(spark, sf_dir), 3).select("series_id", "t", *[r(f"lag_{i}", f"lag_{i}", 2) for i in range(3)])


@register("O53_lags_of_difference", ", d AS (SELECT series_id, t - 7 AS t, y - lag(y, 7) OVER (PARTITION BY series_id ORDER BY t) AS y FROM s), e AS (SELECT * FROM d WHERE t >= 0), a AS (SELECT series_id, t, y AS lag_0, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS lag_1 FROM e) SELECT series_id, t, round(lag_0, 2) AS lag_0, round(lag_1, 2) AS lag_1 FROM a WHERE t >= 1", S2_SQL)
def o53(spark, sf_dir):
    return windows.embed(windows.diff(s2(spark, sf_dir), 7), 2).select("series_id", "t", r("lag_0", "lag_0", 2), r("lag_1", "lag_1", 2))


@register("O54_cumulative", ", e AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS y FROM s) SELECT series_id, t, round(sum(y) OVER (PARTITION BY series_id ORDER BY t), 2) + 0.0 AS y FROM e")
def o54(spark, sf_dir):
    return windows.cumulative(windows.residuals_of_line(s5(spark, sf_dir).select("series_id", "t", "y"))).select("series_id", "t", r("y", "y", 2))


_DECOMPOSE = """
, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {h} PRECEDING AND {k} FOLLOWING) AS mean FROM s),
d AS (SELECT series_id, t, y, CASE WHEN t >= {h} AND t < n - {h} THEN mean END AS trend FROM n),
e AS (SELECT *, {plain} AS plain FROM d),
p AS (SELECT series_id, (t - {h} + {m}) % {m} AS phase, avg(plain) AS seasonal FROM e GROUP BY 1, 2)
SELECT e.series_id, e.t, round(e.trend, 4) AS trend, round(p.seasonal, 4) AS seasonal, round({random}, 4) + 0.0 AS random
FROM e JOIN p ON e.series_id = p.series_id AND p.phase = (e.t + {h}) % {m}"""


@register("O55_decompose_additive", _DECOMPOSE.format(h=6, k=5, m=12, plain="y - trend", random="e.plain - p.seasonal"))
def o55(spark, sf_dir):
    return windows.decompose(s5(spark, sf_dir), "additive", 12).select("series_id", "t", r("trend", "trend"), r("seasonal", "seasonal"), r("random", "random"))


@register("O55_decompose_multiplicative", _DECOMPOSE.format(h=3, k=3, m=7, plain="y / trend", random="e.plain / p.seasonal"), S2_SQL)
def o55b(spark, sf_dir):
    return windows.decompose(s2(spark, sf_dir), "multiplicative", 7).select("series_id", "t", r("trend", "trend"), r("seasonal", "seasonal"), r("random", "random"))


@register("O56_acf", ", e AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS d FROM s), v AS (SELECT series_id, sum(d * d) AS v FROM e GROUP BY 1) SELECT a.series_id, CAST(k AS INTEGER) AS lag, round(sum(a.d * b.d) / any_value(v), 6) + 0.0 AS r FROM e a JOIN range(13) AS k(k) ON true JOIN e b ON a.series_id = b.series_id AND b.t = a.t + k JOIN v ON v.series_id = a.series_id GROUP BY 1, 2")
def o56(spark, sf_dir):
    return windows.acf(s5(spark, sf_dir), 12).select("series_id", "lag", r("r", "r", 6))


_PAIRS = ", e AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS d, count(*) OVER (PARTITION BY series_id) AS n FROM z), p AS (SELECT a.series_id, k, a.n, sum(a.d * b.d) AS p, count(a.d * b.d) AS c FROM e a JOIN range({lags}) AS k(k) ON true JOIN e b ON a.series_id = b.series_id AND b.t = a.t + k GROUP BY 1, 2, 3), r AS (SELECT p.series_id, p.k, p.n, p.p / o.p * {shrink} AS r FROM p JOIN p o ON o.series_id = p.series_id AND o.k = 0)"


@register("O56_acf_long", ", z AS (SELECT series_id, t, y FROM s)" + _PAIRS.format(lags=101, shrink="1.0") + " SELECT series_id, CAST(k AS INTEGER) AS lag, round(r, 6) + 0.0 AS r FROM r", S2_SQL)
def o56b(spark, sf_dir):
    return windows.acf(s2(spark, sf_dir), 100).select("series_id", "lag", r("r", "r", 6))


@register("O56_acf_missing", ", z AS (SELECT series_id, t, CASE WHEN t % 7 <> 3 THEN y END AS y FROM s)" + _PAIRS.format(lags=13, shrink="o.c / greatest(p.c, 1)") + " SELECT series_id, CAST(k AS INTEGER) AS lag, round(r, 6) + 0.0 AS r, round(r - 1.959963984540054 * CASE WHEN k = 0 THEN 0 ELSE sqrt((1 + 2 * coalesce(sum(CASE WHEN k > 0 THEN r * r ELSE 0 END) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END, 6) + 0.0 AS lower FROM r")
def o56c(spark, sf_dir):
    gaps = s5(spark, sf_dir).withColumn("y", F.when(F.col("t") % 7 != 3, F.col("y")))
    return windows.acf(gaps, 12, adjusted=True, alpha=0.05, missing="conservative").select("series_id", "lag", r("r", "r", 6), r("lower", "lower", 6))


# Durbin and Levinson: the coefficients of one order from those of the order before, as lists.
_PACF = """
, e AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS d FROM s),
n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT a.series_id, k, sum(a.d * b.d) / any_value(n - k) AS g FROM e a JOIN range(13) AS k(k) ON true JOIN e b ON a.series_id = b.series_id AND b.t = a.t + k JOIN n ON n.series_id = a.series_id GROUP BY 1, 2),
l AS (SELECT series_id, list(g ORDER BY k) AS g FROM g GROUP BY 1),
rec(series_id, k, phi, v, g) AS (
  SELECT series_id, 0, CAST([] AS DOUBLE[]), g[1], g FROM l
  UNION ALL
  SELECT series_id, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - r * phi[k + 1 - i]), r), v * (1 - r * r), g
  FROM (SELECT *, (g[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * g[k + 2 - i])), 0)) / v AS r FROM rec WHERE k < 12)
)
SELECT series_id, CAST(k AS INTEGER) AS lag, round(CASE WHEN k = 0 THEN 1 ELSE phi[k] END, 6) + 0.0 AS r FROM rec"""


@register("O57_pacf", _PACF, S5_SQL.replace("WITH base_m", "WITH RECURSIVE base_m"))
def o57(spark, sf_dir):
    return diagnostics.pacf(s5(spark, sf_dir), 12).select("series_id", "lag", r("r", "r", 6))


_LRV = ", e AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS d FROM s), n AS (SELECT series_id, count(*) AS n, sum(d * d) AS v FROM e GROUP BY 1), c AS (SELECT a.series_id, sum(2 * (1 - k / 4.0) * a.d * b.d) AS c FROM e a JOIN range(1, 4) AS k(k) ON true JOIN e b ON a.series_id = b.series_id AND b.t = a.t + k GROUP BY 1) "


@register("O58_long_run_variance", _LRV + "SELECT n.series_id, round((v + c) / n / 1e6, 4) AS variance FROM n JOIN c ON n.series_id = c.series_id")
def o58(spark, sf_dir):
    e = windows.residuals_of_line(s5(spark, sf_dir).select("series_id", "t", "y"))
    return windows.long_run_variance(e, 3).select("series_id", r(F.col("variance") / 1e6, "variance"))


# Sort, limit, sets


@register("O61_best_rows", ", k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y, t) AS k FROM s) SELECT series_id, t, round(y, 2) AS y FROM k WHERE k = 1")
def o61(spark, sf_dir):
    return metrics.best_rows(s5(spark, sf_dir), [F.col("y"), F.col("t")]).select("series_id", "t", r("y", "y", 2))


@register("O62_train_test_split", ", n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s) SELECT series_id, t, CASE WHEN t < n - ceil(n * 0.25) THEN 'train' ELSE 'test' END AS role FROM n")
def o62(spark, sf_dir):
    train, test = metrics.train_test_split(s5(spark, sf_dir))
    return train.select("series_id", "t", F.lit("train").alias("role")).unionByName(test.select("series_id", "t", F.lit("test").alias("role")))


@register("O63_holdout", ", n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s) SELECT series_id, t, round(y, 2) AS y FROM n WHERE t >= n - 10")
def o63(spark, sf_dir):
    return series.holdout(s5(spark, sf_dir), 10).select("series_id", "t", r("y", "y", 2))


@register("O66_future_rows", ", n AS (SELECT series_id, max(t) AS t FROM s GROUP BY 1) SELECT series_id, t + k AS t FROM n, range(1, 13) AS k(k)")
def o66(spark, sf_dir):
    return transforms.horizon(s5(spark, sf_dir), 12)


@register("O70_append", ", n AS (SELECT series_id, max(t) + 1 AS n FROM s GROUP BY 1) SELECT series_id, t, round(y, 2) AS y FROM s UNION ALL SELECT s.series_id, t + n, round(y + 1, 2) FROM s JOIN n ON s.series_id = n.series_id WHERE t < 5")
def o70(spark, sf_dir):
    df = s5(spark, sf_dir)
    return series.append(df, df.where("t < 5").withColumn("y", F.col("y") + 1)).select("series_id", "t", r("y", "y", 2))


@register("O72_unique_x", "SELECT DISTINCT series_id, t % 12 AS x FROM s")
def o72(spark, sf_dir):
    return s5(spark, sf_dir).select("series_id", (F.col("t") % 12).alias("x")).distinct()


@register("O73_candidate_grid", ", n AS (SELECT series_id, count(*) // 3 AS most FROM s WHERE t % 8 = 0 GROUP BY 1) SELECT series_id, p, q, bp, bq FROM n, range(4) a(p), range(4) b(q), range(3) c(bp), range(3) d(bq) WHERE p <= most AND q <= most AND p + q + bp + bq <= 5")
def o73(spark, sf_dir):
    config = auto.AutoARIMA(max_p=3, max_q=3, m=12, max_order=5, d=0, D=0)
    every_eighth = s5(spark, sf_dir).where("t % 8 = 0").withColumn("t", F.col("t") / 8)
    long = lambda c: F.col(c).cast("long")
    return auto.candidates(config, every_eighth).select("series_id", long("p").alias("p"), long("q").alias("q"), long("seasonal_p").alias("bp"), long("seasonal_q").alias("bq"))


# Transforms


@register(
    "O80_boxcox_fit",
    ", g AS (SELECT series_id, exp(avg(ln(y))) AS g, count(*) AS n FROM s GROUP BY 1), k AS (SELECT s.series_id, l / 100.0 AS l, -any_value(n) / 2.0 * ln(var_pop(CASE WHEN l = 0 THEN ln(y / g) ELSE (pow(y / g, l / 100.0) - 1) / (l / 100.0) END)) AS llf FROM s JOIN g ON s.series_id = g.series_id, range(-500, 501) AS r(l) GROUP BY 1, 2) SELECT series_id, round(CAST(arg_max(l, llf) AS DOUBLE), 2) + 0.0 AS lmbda FROM k GROUP BY 1",
)
def o80(spark, sf_dir):
    return transforms.BoxCoxEndogTransformer(digits=2).fit(s5(spark, sf_dir)).lambdas_.select("series_id", r("lmbda", "lmbda", 2))


@register("O81_boxcox", "SELECT series_id, t, round((pow(y + 1, 0.5) - 1) / 0.5, 6) AS y FROM s")
def o81(spark, sf_dir):
    return transforms.BoxCoxEndogTransformer(0.5, 1.0).fit_transform(s5(spark, sf_dir)).select("series_id", "t", r("y", "y", 6))


@register("O82_boxcox_inverse", "SELECT series_id, t, round(CASE WHEN (y / 1e5 - 2) * 0.3 + 1 >= 0 THEN pow((y / 1e5 - 2) * 0.3 + 1, 1 / 0.3) - 0.5 END, 6) AS y FROM s")
def o82(spark, sf_dir):
    df = s5(spark, sf_dir).withColumn("y", F.col("y") / 1e5 - 2)
    return transforms.BoxCoxEndogTransformer(0.3, 0.5).fit(df).inverse_transform(df).select("series_id", "t", r("y", "y", 6))


@register("O83_log", "SELECT series_id, t, round(ln(y + 10), 8) AS y FROM s")
def o83(spark, sf_dir):
    return transforms.LogEndogTransformer(10).fit_transform(s5(spark, sf_dir)).select("series_id", "t", r("y", "y", 8))


def _fourier_sql(t: str) -> str:
    parts = [f"round({f}(CAST(CAST(2 * pi() * {j + 1} / 12 AS FLOAT) AS DOUBLE) * ({t} + 1)), 6) + 0.0 AS {n}{j}" for j in range(3) for f, n in (("sin", "s"), ("cos", "c"))]
    return ", ".join(parts)


def _fourier(df: DataFrame) -> DataFrame:
    f = transforms.FourierFeaturizer(12, 3)
    out = f.transform(df)
    return out.select("series_id", "t", *[r(F.col(f"`FOURIER_{n.upper()}12-{j}`"), f"{n}{j}", 6) for j in range(3) for n in "sc"])


@register("O84_fourier", f"SELECT series_id, t, {_fourier_sql('t')} FROM s")
def o84(spark, sf_dir):
    return _fourier(s5(spark, sf_dir))


@register("O85_fourier_future", f", n AS (SELECT series_id, max(t) AS last FROM s GROUP BY 1), h AS (SELECT series_id, last + k AS t FROM n, range(1, 7) AS k(k)) SELECT series_id, t, {_fourier_sql('t')} FROM h")
def o85(spark, sf_dir):
    return _fourier(transforms.horizon(s5(spark, sf_dir), 6))


@register("O86_date_features", "SELECT series_id, t, CAST(isodow(ts) = 1 AS INTEGER) AS monday, CAST(isodow(ts) = 7 AS INTEGER) AS sunday, CAST(day(ts) AS INTEGER) AS dom FROM s", S2_SQL)
def o86(spark, sf_dir):
    out = transforms.DateFeaturizer("ts").transform(s2(spark, sf_dir))
    return out.select("series_id", "t", F.col("`DATE-WEEKDAY-0`").alias("monday"), F.col("`DATE-WEEKDAY-6`").alias("sunday"), F.col("`DATE-DAY-OF-MONTH`").alias("dom"))


@register("O87_approx", ", k AS (SELECT series_id, t, y, lead(y) OVER (PARTITION BY series_id ORDER BY t) AS y1 FROM s) SELECT series_id, CAST(t + 0.25 AS DOUBLE) AS x, round(y + (y1 - y) * 0.25, 4) AS y FROM k WHERE y1 IS NOT NULL")
def o87(spark, sf_dir):
    df = s5(spark, sf_dir).select("series_id", F.col("t").cast("double").alias("x"), "y")
    asked = df.select("series_id", (F.col("x") + 0.25).alias("x"))
    return transforms.approximate(df, asked).where("y is not null").select("series_id", "x", r("y", "y"))


_PSI = """
, c AS (SELECT series_id, [round(avg(y) / max(y) / 2, 6), round(min(y) / max(y) / 3, 6)] AS ar, [round(min(y) / avg(y) / 2, 6), 0.3, 0.1] AS ma FROM s GROUP BY 1),
w AS (
  SELECT series_id, ar, ma, 0 AS lag, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM c
  UNION ALL
  SELECT series_id, ar, ma, lag + 1, ar[1] * a + ar[2] * b + coalesce(ma[lag + 1], 0), a FROM w WHERE lag < 12)
SELECT series_id, CAST(lag AS INTEGER) AS lag, round(a, 6) + 0.0 AS psi FROM w WHERE lag > 0"""


@register("O88_arma_to_ma", _PSI, S5_SQL.replace("WITH base_m", "WITH RECURSIVE base_m"))
def o88(spark, sf_dir):
    y = lambda f: f("y")
    low, mean, high = y(F.min), y(F.avg), y(F.max)
    rows = s5(spark, sf_dir).groupBy("series_id").agg(F.array(F.round(mean / high / 2, 6), F.round(low / high / 3, 6)).alias("ar"), F.array(F.round(low / mean / 2, 6), F.lit(0.3), F.lit(0.1)).alias("ma"))
    weights = rows.select("series_id", F.posexplode(arima.psi_weights(F.col("ar"), F.col("ma"), 12)).alias("at", "psi"))
    return weights.select("series_id", (F.col("at") + 1).cast("int").alias("lag"), r("psi", "psi", 6))


@register("O89_critical_values", ", n AS (SELECT DISTINCT series_id, 2 + t % 23 AS m FROM s) SELECT series_id, m, round(-0.2937411 * exp(-0.2850853 * (ln(m) - 0.7656451) - 0.05983644 * (ln(m) - 0.7656451) * (ln(m) - 0.7656451)) - 1.652202, 6) AS ocsb, round(CASE m " + " ".join(f"WHEN {k + 2} THEN {v}" for k, v in enumerate(unitroot.CANOVA_HANSEN)) + " WHEN 24 THEN 5.098624 ELSE 0.269 * pow(m, 0.928) END, 6) AS ch FROM n")
def o89(spark, sf_dir):
    seasons = s5(spark, sf_dir).select("series_id", (F.col("t") % 23 + 2).alias("m")).distinct()
    return seasons.select("series_id", "m", r(diagnostics.ocsb_critical(F.col("m")), "ocsb", 6), r(diagnostics.canova_hansen_critical(F.col("m")), "ch", 6))


@register("O90_is_finite", "SELECT series_id, t, t % 3 <> 0 AS finite FROM s")
def o90(spark, sf_dir):
    odd = F.when(F.col("t") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("y"))
    return s5(spark, sf_dir).select("series_id", "t", series.is_finite(odd).alias("finite"))


# Tests


@register(
    "O100_kpss",
    ", e AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS d FROM s), u AS (SELECT series_id, t, d, sum(d) OVER (PARTITION BY series_id ORDER BY t) AS s FROM e), n AS (SELECT series_id, count(*) AS n, sum(d * d) AS v, sum(s * s) AS eta FROM u GROUP BY 1), c AS (SELECT a.series_id, sum(2 * (1 - k / (floor(4 * pow(n / 100.0, 0.25)) + 1)) * a.d * b.d) AS c FROM e a JOIN n ON n.series_id = a.series_id JOIN range(1, 10) AS k(k) ON k <= floor(4 * pow(n / 100.0, 0.25)) JOIN e b ON a.series_id = b.series_id AND b.t = a.t + k GROUP BY 1), z AS (SELECT n.series_id, eta / n / n / ((v + c) / n) AS stat FROM n JOIN c ON n.series_id = c.series_id) SELECT series_id, round(stat, 6) AS stat, round(CASE WHEN stat >= 0.739 THEN 0.01 WHEN stat >= 0.574 THEN 0.025 + (0.01 - 0.025) * (stat - 0.574) / (0.739 - 0.574) WHEN stat >= 0.463 THEN 0.05 + (0.025 - 0.05) * (stat - 0.463) / (0.574 - 0.463) WHEN stat >= 0.347 THEN 0.1 + (0.05 - 0.1) * (stat - 0.347) / (0.463 - 0.347) ELSE 0.1 END, 6) AS pvalue FROM z",
)
def o100(spark, sf_dir):
    return diagnostics.kpss(s5(spark, sf_dir)).select("series_id", r("stat", "stat", 6), r("pvalue", "pvalue", 6))


def _rounded_test(df: DataFrame) -> DataFrame:
    return df.select("series_id", r("stat", "stat", 5), *[c for c in df.columns if c not in ("series_id", "stat", "pvalue", "critical")])


# The regression of the differences on a line and the row before, by residuals of the line (Frisch, Waugh and Lovell).
_LAGGED = """
, a AS (SELECT series_id, t, y / 1e6 AS y, lag(y / 1e6) OVER (PARTITION BY series_id ORDER BY t) AS x FROM s),
b AS (SELECT * FROM a WHERE x IS NOT NULL),
c AS (SELECT series_id, regr_slope({left}, t) AS b1, regr_intercept({left}, t) AS a1, regr_slope(x, t) AS b2, regr_intercept(x, t) AS a2 FROM b GROUP BY 1),
e AS (SELECT b.series_id, t, x, {left} - a1 - b1 * t AS u, x - a2 - b2 * t AS v FROM b JOIN c ON b.series_id = c.series_id),
f AS (SELECT series_id, count(*) AS n, sum(u * v) / sum(v * v) AS k, sum(v * v) AS vv, sum(u * u) - sum(u * v) * sum(u * v) / sum(v * v) AS ssr FROM e GROUP BY 1)
"""


@register("O101_adf_without_lags", _LAGGED.format(left="(y - x)") + "SELECT series_id, round(k / sqrt(ssr / (n - 3) / vv), 5) AS stat FROM f")
def o101b(spark, sf_dir):
    return diagnostics.adf(_scaled(spark, sf_dir), 0).select("series_id", r("stat", "stat", 5))


_PP = _LAGGED.format(left="y") + """
, r AS (SELECT e.series_id, row_number() OVER (PARTITION BY e.series_id ORDER BY t) AS i, n, k, ssr, x, u - k * v AS u FROM e JOIN f ON e.series_id = f.series_id),
w AS (SELECT p.series_id, sum(2 * (1 - l / (floor(4 * pow(p.n / 100.0, 0.25)) + 1)) * p.u * q.u) / any_value(p.n) AS w FROM r p JOIN range(1, 12) AS g(l) ON l <= floor(4 * pow(p.n / 100.0, 0.25)) JOIN r q ON q.series_id = p.series_id AND q.i = p.i + l GROUP BY 1),
d AS (SELECT series_id, any_value(CAST(n AS DOUBLE)) AS n, any_value(k) AS k, sum(x * x) AS xx, sum(x * i) AS xi, sum(x) AS x FROM r GROUP BY 1),
pp AS (SELECT d.series_id, n, n * (k - 1) - pow(n, 6) / (24 * (n * n * (n * n - 1) * xx / 12 - n * xi * xi + n * (n + 1) * xi * x - n * (n + 1) * (2 * n + 1) * x * x / 6)) * w AS stat FROM d JOIN w ON d.series_id = w.series_id)"""


@register("O102_pp_statistic", _PP + " SELECT series_id, round(stat, 4) AS stat FROM pp")
def o102b(spark, sf_dir):
    return diagnostics.pp(_scaled(spark, sf_dir)).select("series_id", r("stat", "stat", 4))


def _between(x: str, xs, ys) -> str:
    """SQL of linear interpolation, with the end values outside."""
    parts = [f"WHEN {x} <= {xs[0]} THEN {ys[0]}"]
    parts += [f"WHEN {x} <= {b} THEN {low} + ({high} - {low}) * ({x} - {a}) / ({b} - {a})" for a, b, low, high in zip(xs, xs[1:], ys, ys[1:], strict=False)]
    return "CASE " + " ".join(parts) + f" ELSE {ys[-1]} END"


def _share(table, rows: str, keys: str = "series_id") -> str:
    """SQL of a test's p value: quantiles of the table at n, then the share at the statistic. ``rows`` has (keys, n, stat)."""
    quantiles = ", ".join(f"{_between('n', unitroot.SIZES, row)} AS q{i}" for i, row in enumerate(table))
    names = [f"q{i}" for i in range(len(table))]
    return f"SELECT {keys}, stat, {_between('stat', names, unitroot.SHARES)} AS p FROM (SELECT {keys}, stat, {quantiles} FROM {rows})"


def _adf_sql(rows: str, keys: str = "series_id") -> str:
    """CTEs of the Dickey-Fuller regression of each series of ``rows``: columns as lists, their products, and a recursion that eliminates one of them after another. ``adf`` has (keys, stat, p)."""
    return f"""
, z AS (SELECT *, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS z FROM {rows} WINDOW w AS (PARTITION BY {keys})),
l AS (SELECT {keys}, list(z ORDER BY t) AS z, count(*) AS n, CAST(floor(pow(count(*) - 1, 1 / 3.0)) AS BIGINT) + 1 AS k FROM z GROUP BY ALL),
c AS (SELECT {keys}, n, k,
  [list_transform(range(k, n), lambda t: CAST(1 AS DOUBLE)), list_transform(range(k, n), lambda t: t / CAST(n AS DOUBLE) - 0.5)]
  || list_transform(range(1, k), lambda j: list_transform(range(k, n), lambda t: z[t - j + 1] - z[t - j]))
  || [list_transform(range(k, n), lambda t: z[t]), list_transform(range(k, n), lambda t: z[t + 1] - z[t])] AS c FROM l),
e AS (
  SELECT {keys}, n, k, CAST(1 AS BIGINT) AS j, list_transform(c, lambda a: list_transform(c, lambda b: list_dot_product(a, b))) AS m FROM c
  UNION ALL
  SELECT {keys}, n, k, j + 1, list_transform(m, lambda r, i: CASE WHEN i <= j THEN r ELSE list_transform(r, lambda v, q: v - r[j] / m[j][j] * m[j][q]) END) FROM e WHERE j < k + 3),
f AS (SELECT {keys}, n - 1 AS n, m[k + 2][k + 3] / m[k + 2][k + 2] / sqrt(m[k + 3][k + 3] / (n - k - k - 2) / m[k + 2][k + 2]) AS stat FROM e WHERE j = k + 3),
adf AS ({_share(unitroot.DICKEY_FULLER, "f", keys)})"""


_RECURSIVE = S5_SQL.replace("WITH base_m", "WITH RECURSIVE base_m")


@register("O101_adf", _adf_sql("s") + " SELECT series_id, round(stat, 5) AS stat, p > 0.05 AS should_diff FROM adf", _RECURSIVE)
def o101(spark, sf_dir):
    return _rounded_test(diagnostics.adf(s5(spark, sf_dir)))


@register("O102_pp", _PP + f", h AS ({_share(unitroot.PHILLIPS_PERRON, 'pp')}) SELECT series_id, round(stat, 5) AS stat, p > 0.05 AS should_diff FROM h")
def o102(spark, sf_dir):
    return _rounded_test(diagnostics.pp(s5(spark, sf_dir)))


@register("O103_canova_hansen")
def o103(spark, sf_dir):
    return _rounded_test(diagnostics.canova_hansen(s5(spark, sf_dir), 12))


@register("O104_ocsb")
def o104(spark, sf_dir):
    return _rounded_test(diagnostics.ocsb(s5(spark, sf_dir), 12))


def _kpss_share(rows: str, k: int) -> str:
    """SQL of stage k: whether the KPSS statistic of rows (series_id, t, y) is beyond its 5 % value."""
    return f"""
, e{k} AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS d, count(*) OVER (PARTITION BY series_id) AS n FROM {rows}),
u{k} AS (SELECT *, sum(d) OVER (PARTITION BY series_id ORDER BY t) AS c FROM e{k}),
v{k} AS (SELECT series_id, any_value(n) AS n, sum(d * d) AS v, sum(c * c) AS eta FROM u{k} GROUP BY 1),
w{k} AS (SELECT a.series_id, sum(2 * (1 - l / (floor(4 * pow(a.n / 100.0, 0.25)) + 1)) * a.d * b.d) AS w FROM e{k} a JOIN range(1, 12) AS g(l) ON l <= floor(4 * pow(a.n / 100.0, 0.25)) JOIN e{k} b ON a.series_id = b.series_id AND b.t = a.t + l GROUP BY 1),
s{k} AS (SELECT v{k}.series_id, eta / n / (v + w) > 0.463 AS more FROM v{k} JOIN w{k} ON v{k}.series_id = w{k}.series_id)"""


_NDIFFS = (
    _kpss_share("s", 0)
    + ", d1 AS (SELECT * FROM (SELECT series_id, t, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS y FROM s) WHERE y IS NOT NULL)"
    + _kpss_share("d1", 1)
    + " SELECT s0.series_id, CAST(CASE WHEN NOT s0.more THEN 0 WHEN NOT s1.more THEN 1 ELSE 2 END AS INTEGER) AS d FROM s0 JOIN s1 ON s0.series_id = s1.series_id"
)


@register("O105_ndiffs", _NDIFFS)
def o105(spark, sf_dir):
    return diagnostics.ndiffs(s5(spark, sf_dir))


@register("O106_nsdiffs")
def o106(spark, sf_dir):
    return diagnostics.nsdiffs(s5(spark, sf_dir), 12)


_NDIFFS_ADF = (
    ", d AS (SELECT series_id, 0 AS d, t, y FROM s UNION ALL SELECT * FROM (SELECT series_id, 1, t - 1 AS t, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS y FROM s) WHERE t >= 0)"
    + _adf_sql("d", "series_id, d")
    + " SELECT a.series_id, CAST(CASE WHEN a.p <= 0.05 THEN 0 WHEN b.p <= 0.05 THEN 1 ELSE 2 END AS INTEGER) AS d FROM adf a JOIN adf b ON a.series_id = b.series_id AND a.d = 0 AND b.d = 1"
)


@register("O105_ndiffs_adf", _NDIFFS_ADF, _RECURSIVE)
def o105b(spark, sf_dir):
    return diagnostics.ndiffs(s5(spark, sf_dir), test="adf")


@register("O107_is_stationary", _PP + f", h AS ({_share(unitroot.PHILLIPS_PERRON, 'pp')}) SELECT series_id, p > 0.05 AS should_diff FROM h")
def o107(spark, sf_dir):
    return diagnostics.is_stationary(s5(spark, sf_dir), "pp").select("series_id", "should_diff")


_PACF_BOUNDS = "SELECT series_id, CAST(k AS INTEGER) AS lag, round(CASE WHEN k = 0 THEN 1 ELSE phi[k] - 1.959963984540054 / sqrt(n) END, 6) + 0.0 AS lower, round(CASE WHEN k = 0 THEN 1 ELSE phi[k] + 1.959963984540054 / sqrt(n) END, 6) + 0.0 AS upper FROM rec JOIN n USING (series_id)"


@register("O57_pacf_bounds", _PACF[: _PACF.rindex("SELECT series_id, CAST(k")] + _PACF_BOUNDS, S5_SQL.replace("WITH base_m", "WITH RECURSIVE base_m"))
def o57b(spark, sf_dir):
    return diagnostics.pacf(s5(spark, sf_dir), 12, alpha=0.05).select("series_id", "lag", r("lower", "lower", 6), r("upper", "upper", 6))


# Models. The maximum likelihood of white noise around a mean has a closed form, so SQL can state what fits of it give.


_WHITE = """
, z AS (SELECT series_id, t, y / 1e6 AS y FROM s),
m AS (SELECT series_id, avg(y) AS c, var_pop(y) AS v, count(*) AS n FROM z GROUP BY 1),
f AS (SELECT *, -n / 2.0 * (ln(2 * pi() * v) + 1) AS llf FROM m)"""
_Z95 = "1.959963984540054"


def _white(spark, sf_dir) -> DataFrame:
    return ARIMA((0, 0, 0)).fit(_scaled(spark, sf_dir))


@register("O111_fit_white_noise", _WHITE + " SELECT series_id, round(llf, 3) AS llf, round(c, 3) AS c, round(v, 2) AS sigma2, n AS nobs FROM f")
def o111b(spark, sf_dir):
    return _white(spark, sf_dir).select("series_id", r("llf", "llf", 3), r(F.col("params")[0], "c", 3), r("sigma2", "sigma2", 2), "nobs")


@register("O47_information_criteria_white_noise", _WHITE + " SELECT series_id, round(4 - 2 * llf, 3) AS aic, round(4 - 2 * llf + 4 * (n / (n - 3.0) - 1), 3) AS aicc, round(2 * ln(n) - 2 * llf, 3) AS bic, round(4 * ln(ln(n)) - 2 * llf, 3) AS hqic FROM f")
def o47b(spark, sf_dir):
    return _white(spark, sf_dir).select("series_id", *[r(c, c, 3) for c in ("aic", "aicc", "bic", "hqic")])


@register("O112_predict_white_noise", _WHITE + f" SELECT series_id, CAST(h AS INTEGER) AS h, round(c, 3) AS yhat, round(c - {_Z95} * sqrt(v), 2) + 0.0 AS lower, round(c + {_Z95} * sqrt(v), 2) AS upper FROM f, range(1, 13) AS k(h)")
def o112b(spark, sf_dir):
    return arima.predict(_white(spark, sf_dir), 12).select("series_id", "h", r("yhat", "yhat", 3), r("lower", "lower", 2), r("upper", "upper", 2))


@register("O113_predict_in_sample_white_noise", _WHITE + f" SELECT z.series_id, t, round(c, 3) AS yhat, round(c + {_Z95} * sqrt(v), 2) AS upper FROM f JOIN z ON z.series_id = f.series_id")
def o113b(spark, sf_dir):
    return arima.predict_in_sample(_white(spark, sf_dir)).select("series_id", "t", r("yhat", "yhat", 3), r("upper", "upper", 2))


@register("O113_predict_in_sample_labels", _WHITE + f", b AS (SELECT series_id, min(CASE WHEN ts = TIMESTAMP '1996-01-01' THEN t END) AS a, max(CASE WHEN ts = TIMESTAMP '1997-06-01' THEN t END) AS b FROM s GROUP BY 1) SELECT f.series_id, z.t, round(c, 3) AS yhat, round(c - {_Z95} * sqrt(v), 2) + 0.0 AS lower FROM f JOIN b ON b.series_id = f.series_id JOIN z ON z.series_id = f.series_id AND z.t BETWEEN b.a AND b.b")
def o113c(spark, sf_dir):
    found = arima.predict_in_sample(_white(spark, sf_dir), datetime(1996, 1, 1), datetime(1997, 6, 1), index=s5(spark, sf_dir))
    return found.select("series_id", "t", r("yhat", "yhat", 3), r("lower", "lower", 2))


@register("O115_update_white_noise", _WHITE + " SELECT series_id, n AS nobs, round(c, 3) AS c, round(llf, 3) AS llf FROM f")
def o115b(spark, sf_dir):
    df = _scaled(spark, sf_dir)
    made = arima.update(ARIMA((0, 0, 0)).fit(df.where("t < 50")), df.where("t >= 50"), 50)
    return made.select("series_id", "nobs", r(F.col("params")[0], "c", 3), r("llf", "llf", 3))


@register("O116_regression", ", z AS (SELECT series_id, t, y / 1e6 AS y, t % 12 AS x FROM s), f AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(t) AS last FROM z GROUP BY 1) SELECT series_id, CAST(h AS INTEGER) AS h, round(a + b * ((last + h) % 12), 3) AS yhat FROM f, range(1, 7) AS k(h)")
def o116b(spark, sf_dir):
    df = _scaled(spark, sf_dir).withColumn("x", (F.col("t") % 12).cast("double"))
    future = transforms.horizon(df, 6).withColumn("x", (F.col("t") % 12).cast("double"))
    return ARIMA((0, 0, 0)).fit_predict(df, ["x"], 6, future).select("series_id", "h", r("yhat", "yhat", 3))


@register("O110_linear_trend", ", z AS (SELECT series_id, t + 1 AS x, y / 1e6 AS y FROM s), f AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(x) AS last FROM z GROUP BY 1) SELECT series_id, CAST(h AS INTEGER) AS h, round(a + b * (last + h), 3) AS yhat FROM f, range(1, 7) AS k(h)")
def o110(spark, sf_dir):
    return arima.predict(ARIMA((0, 0, 0), trend="ct").fit(_scaled(spark, sf_dir)), 6).select("series_id", "h", r("yhat", "yhat", 3))


@register("O114_simple_differencing", ", z AS (SELECT series_id, t, y / 1e6 AS y FROM s), d AS (SELECT series_id, t, y - lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS d FROM z), v AS (SELECT series_id, avg(d * d) AS v, max(t) AS last FROM d GROUP BY 1) SELECT z.series_id, CAST(t - last + 12 AS INTEGER) AS h, round(y, 3) AS yhat, round(y + " + _Z95 + " * sqrt(v), 2) AS upper FROM z JOIN v ON z.series_id = v.series_id WHERE t > last - 12")
def o114(spark, sf_dir):
    config = ARIMA((0, 0, 0), (0, 1, 0, 12), with_intercept=False, sarimax_kwargs={"simple_differencing": True})
    return arima.predict(config.fit(_scaled(spark, sf_dir)), 12).select("series_id", "h", r("yhat", "yhat", 3), r("upper", "upper", 2))


# Standard errors from the outer product of the two scores: e / v and (e^2 / v - 1) / (2 v).
_SUMMARY = """
, g AS (SELECT z.series_id, sum((y - c) * (y - c)) / any_value(v * v) AS a, sum((y - c) / v * ((y - c) * (y - c) / v - 1) / (2 * v)) AS b, sum(pow(((y - c) * (y - c) / v - 1) / (2 * v), 2)) AS d FROM z JOIN f ON z.series_id = f.series_id GROUP BY 1)
SELECT f.series_id, 'intercept' AS param, round(c, 3) AS coef, round(sqrt(d / (a * d - b * b)), 3) AS se FROM f JOIN g ON f.series_id = g.series_id
UNION ALL SELECT f.series_id, 'sigma2', round(v, 3), round(sqrt(a / (a * d - b * b)), 3) FROM f JOIN g ON f.series_id = g.series_id"""


@register("O17_summary_white_noise", _WHITE + _SUMMARY)
def o17c(spark, sf_dir):
    return arima.summary(_white(spark, sf_dir)).select("series_id", "param", r("coef", "coef", 3), r("se", "se", 3))


@register("O117_degrees", _WHITE + " SELECT series_id, 2 AS df_model, n - 2 AS df_resid FROM f")
def o117(spark, sf_dir):
    return arima.degrees(_white(spark, sf_dir))


@register("O117_coefficients")
def o117b(spark, sf_dir):
    return arima.coefficients(_models(spark, sf_dir)).select("series_id", r(F.col("arparams")[0], "ar", 2), r(F.col("maparams")[0], "ma", 2))


def _scaled(spark, sf_dir) -> DataFrame:
    return s5(spark, sf_dir).withColumn("y", F.col("y") / 1e6)


def _models(spark, sf_dir) -> DataFrame:
    return ARIMA((1, 0, 1)).fit(_scaled(spark, sf_dir))


@register("O111_fit")
def o111(spark, sf_dir):
    return _models(spark, sf_dir).select("series_id", r("llf", "llf", 2), r("aic", "aic", 2), "nobs", "label")


@register("O47_information_criteria")
def o47(spark, sf_dir):
    return _models(spark, sf_dir).select("series_id", *[r(c, c, 2) for c in ("aic", "aicc", "bic", "hqic")])


@register("O112_predict")
def o112(spark, sf_dir):
    return arima.predict(_models(spark, sf_dir), 12).select("series_id", "h", *[r(c, c, 3) for c in ("yhat", "lower", "upper")])


@register("O113_predict_in_sample")
def o113(spark, sf_dir):
    return arima.predict_in_sample(_models(spark, sf_dir)).select("series_id", "t", r("yhat", "yhat", 3))


@register("O115_update")
def o115(spark, sf_dir):
    df = _scaled(spark, sf_dir)
    return arima.update(ARIMA((1, 0, 1)).fit(df.where("t < 70")), df.where("t >= 70")).select("series_id", "nobs", r("llf", "llf", 1))


@register("O116_exog_fit_predict")
def o116(spark, sf_dir):
    f = transforms.FourierFeaturizer(12, 1)
    names = f.names()
    df = f.transform(_scaled(spark, sf_dir))
    return ARIMA((1, 0, 0)).fit_predict(df, names, 6, f.transform(transforms.horizon(df, 6))).select("series_id", "h", r("yhat", "yhat", 3))


@register("O17_summary")
def o17(spark, sf_dir):
    return arima.summary(_models(spark, sf_dir)).select("series_id", "param", r("coef", "coef", 2))


@register("O16_to_dict")
def o16(spark, sf_dir):
    return arima.to_dict(_models(spark, sf_dir))


@register("O119_label", ", n AS (SELECT DISTINCT series_id FROM s) SELECT series_id, ' ARIMA(0,1,0)(0,0,0)[0] ' AS label FROM n")
def o119(spark, sf_dir):
    return ARIMA((0, 1, 0), with_intercept=False).fit(_scaled(spark, sf_dir)).select("series_id", "label")


@register("O130_auto_arima")
def o130(spark, sf_dir):
    config = auto.AutoARIMA(max_p=2, max_q=2, start_p=1, start_q=1, seasonal=False)
    return config.fit(_scaled(spark, sf_dir)).select("series_id", "label", r("aic", "aic", 1))


@register("O133_grid_search")
def o133(spark, sf_dir):
    config = auto.AutoARIMA(start_p=0, start_q=0, max_p=1, max_q=1, seasonal=False, stepwise=False)
    return config.fit(_scaled(spark, sf_dir)).select("series_id", "label", r("aic", "aic", 1))


# Searches whose candidates all have closed forms: noise around a mean or around zero, for every second series less its mean.
_NOISE = """
, z AS (SELECT series_id, t, round(y / 1e6 - CASE WHEN series_id < 'G' THEN avg(y) OVER (PARTITION BY series_id) / 1e6 ELSE 0 END, 6) AS y FROM s),
m AS (SELECT series_id, count(*) AS n, var_pop(y) AS v, avg(y * y) AS q FROM z GROUP BY 1),
a AS (SELECT series_id, 4 + n * (ln(2 * pi() * v) + 1) AS mean, 2 + n * (ln(2 * pi() * q) + 1) AS zero FROM m)
SELECT series_id, ' ARIMA(0,0,0)(0,0,0)[0] ' || CASE WHEN mean < zero THEN 'intercept' ELSE '' END AS label, round(least(mean, zero), 2) AS aic FROM a"""


def _noise(spark, sf_dir) -> DataFrame:
    mean = F.avg("y").over(series.whole()) / 1e6
    return s5(spark, sf_dir).withColumn("y", F.round(F.col("y") / 1e6 - F.when(F.col("series_id") < "G", mean).otherwise(0.0), 6))


@register("O130_search_of_noise", _NOISE)
def o130b(spark, sf_dir):
    config = auto.AutoARIMA(start_p=0, start_q=0, max_p=0, max_q=0, d=0, seasonal=False, with_intercept=True)
    return config.fit(_noise(spark, sf_dir)).select("series_id", "label", r("aic", "aic", 2))


@register("O132_search_in_rounds", _NOISE)
def o132b(spark, sf_dir):
    config = auto.AutoARIMA(start_p=0, start_q=0, max_p=0, max_q=0, d=0, seasonal=False, with_intercept=True, spread="candidates")
    return config.fit(_noise(spark, sf_dir)).select("series_id", "label", r("aic", "aic", 2))


# A seasonal random walk with or without drift: the changes over a year are noise.
_YEARLY = """
, z AS (SELECT series_id, y / 1e6 - lag(y / 1e6, 12) OVER (PARTITION BY series_id ORDER BY t) AS y FROM s),
m AS (SELECT series_id, count(y) AS n, var_pop(y) AS v, avg(y * y) AS q FROM z GROUP BY 1),
a AS (SELECT series_id, 4 + n * (ln(2 * pi() * v) + 1) AS mean, 2 + n * (ln(2 * pi() * q) + 1) AS zero FROM m)
SELECT series_id, ' ARIMA(0,0,0)(0,1,0)[12] ' || CASE WHEN mean < zero THEN 'intercept' ELSE '' END AS label, round(least(mean, zero), 1) AS aic FROM a"""


@register("O132_seasonal_walks", _YEARLY)
def o132c(spark, sf_dir):
    config = auto.AutoARIMA(m=12, d=0, D=1, start_p=0, start_q=0, max_p=0, max_q=0, start_P=0, start_Q=0, max_P=0, max_Q=0, with_intercept=True)
    return config.fit(_scaled(spark, sf_dir)).select("series_id", "label", r("aic", "aic", 1))


@register("O133_grid_of_walks", ", z AS (SELECT series_id, y / 1e6 - lag(y / 1e6) OVER (PARTITION BY series_id ORDER BY t) AS y FROM s), m AS (SELECT series_id, count(y) AS n, avg(y * y) AS q FROM z GROUP BY 1) SELECT series_id, ' ARIMA(0,1,0)(0,0,0)[0] ' AS label, round(2 + n * (ln(2 * pi() * q) + 1), 1) AS aic FROM m")
def o133b(spark, sf_dir):
    config = auto.AutoARIMA(start_p=0, start_q=0, max_p=0, max_q=0, d=1, seasonal=False, stepwise=False, with_intercept=False)
    return config.fit(_scaled(spark, sf_dir)).select("series_id", "label", r("aic", "aic", 1))


# State-space forms and optimisers in their closed forms.


@register("O120_coefficient_as_state", ", z AS (SELECT series_id, y / 1e6 AS y, (t % 7 + 1.0) AS x FROM s) SELECT series_id, round(sum(x * y) / sum(x * x), 4) AS coef FROM z GROUP BY 1")
def o120(spark, sf_dir):
    rows = _scaled(spark, sf_dir).withColumn("x", F.col("t") % 7 + 1.0)
    models = ARIMA((0, 0, 0), with_intercept=False, sarimax_kwargs={"mle_regression": False}).fit(rows, ["x"])
    return arima.moving_coefficients(models).select("series_id", r("coef", "coef"))


@register("O120_concentrated_scale", _WHITE + " SELECT series_id, round(llf, 3) AS llf, round(v, 2) AS sigma2, round(2 - 2 * llf, 3) AS aic FROM f")
def o120b(spark, sf_dir):
    models = ARIMA((0, 0, 0), sarimax_kwargs={"concentrate_scale": True}).fit(_scaled(spark, sf_dir))
    return models.select("series_id", r("llf", "llf", 3), r("sigma2", "sigma2", 2), r("aic", "aic", 3))


@register("O120_hamilton_form", _WHITE + " SELECT series_id, round(llf, 3) AS llf, round(v, 2) AS sigma2 FROM f")
def o120c(spark, sf_dir):
    models = ARIMA((0, 0, 0), sarimax_kwargs={"hamilton_representation": True}).fit(_scaled(spark, sf_dir))
    return models.select("series_id", r("llf", "llf", 3), r("sigma2", "sigma2", 2))


@register("O120_coefficient_that_walks")
def o120d(spark, sf_dir):
    rows = _scaled(spark, sf_dir).withColumn("x", F.col("t") % 7 + 1.0)
    models = ARIMA((0, 0, 0), sarimax_kwargs={"mle_regression": False, "time_varying_regression": True}).fit(rows, ["x"])
    return arima.moving_coefficients(models).select("series_id", "param", r("coef", "coef", 2))


@register("O120_measurement_error")
def o120e(spark, sf_dir):
    models = ARIMA((1, 0, 0), sarimax_kwargs={"measurement_error": True}).fit(_scaled(spark, sf_dir))
    return models.select("series_id", "param_names", r("llf", "llf", 1))


@register("O121_optimisers", _WHITE + ", k AS (SELECT unnest(['basinhopping', 'bfgs', 'cg', 'lbfgs', 'ncg', 'newton', 'nm', 'powell']) AS method) SELECT series_id, method, round(llf, 2) AS llf FROM f, k")
def o121(spark, sf_dir):
    base = _scaled(spark, sf_dir)
    each = [ARIMA((0, 0, 0), method=m).fit(base).select("series_id", F.lit(m).alias("method"), r("llf", "llf", 2)) for m in ("basinhopping", "bfgs", "cg", "lbfgs", "ncg", "newton", "nm", "powell")]
    return reduce(DataFrame.unionByName, each)


_CLAMPS = ", n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1) "


@register("O137_constant_series", ", n AS (SELECT DISTINCT series_id FROM s) SELECT series_id, ' ARIMA(0,0,0)(0,0,0)[0] ' AS label FROM n")
def o137(spark, sf_dir):
    flat = s5(spark, sf_dir).withColumn("y", F.lit(5.0))
    return auto.AutoARIMA(seasonal=False).fit(flat).select("series_id", "label")


@register("O132_seasonal_search")
def o132(spark, sf_dir):
    config = auto.AutoARIMA(m=12, d=0, D=1, start_p=0, start_q=0, max_p=1, max_q=1, start_P=0, start_Q=0, max_P=1, max_Q=1)
    return config.fit(_scaled(spark, sf_dir)).select("series_id", "label", r("aic", "aic", 1))


@register("O138_order_clamps", _CLAMPS + "SELECT series_id, least(40, n // 3) AS max_p FROM n")
def o138(spark, sf_dir):
    return auto.orders(auto.AutoARIMA(d=0, max_p=40, seasonal=False), s5(spark, sf_dir)).select("series_id", F.col("max_p").cast("long").alias("max_p"))


@register("O146_pipeline")
def o146(spark, sf_dir):
    steps = [("log", transforms.LogEndogTransformer()), ("fourier", transforms.FourierFeaturizer(12, 1)), ("arima", ARIMA((1, 0, 0)))]
    return pipeline.Pipeline(steps).fit(_scaled(spark, sf_dir)).predict(6).select("series_id", "h", r("yhat", "yhat", 3))


@register("O146_pipeline_log_mean", ", f AS (SELECT series_id, avg(ln(y / 1e6)) AS c, var_pop(ln(y / 1e6)) AS v FROM s GROUP BY 1) SELECT series_id, CAST(h AS INTEGER) AS h, round(exp(c), 3) AS yhat, round(exp(c + " + _Z95 + " * sqrt(v)), 2) AS upper FROM f, range(1, 7) AS k(h)")
def o146b(spark, sf_dir):
    steps = [("log", transforms.LogEndogTransformer()), ("arima", ARIMA((0, 0, 0)))]
    return pipeline.Pipeline(steps).fit(_scaled(spark, sf_dir), arima__maxiter=100).predict(6).select("series_id", "h", r("yhat", "yhat", 3), r("upper", "upper", 2))


@register("O155_rolling_cv", _FOLDS.format(first="n // 3", start="0") + "SELECT series_id, fold, start, split, stop FROM g")
def o155(spark, sf_dir):
    return metrics.RollingForecastCV(4, 6).folds(s5(spark, sf_dir)).select("series_id", F.col("fold").cast("long").alias("fold"), "start", "split", "stop")


@register("O156_sliding_cv", _FOLDS.format(first="40", start="split - 40") + "SELECT series_id, fold, start, split, stop FROM g")
def o156(spark, sf_dir):
    return metrics.SlidingWindowForecastCV(4, 6, 40).folds(s5(spark, sf_dir)).select("series_id", F.col("fold").cast("long").alias("fold"), "start", "split", "stop")


@register("O158_cross_validate")
def o158(spark, sf_dir):
    return pipeline.cross_val_score(ARIMA((1, 0, 0)), _scaled(spark, sf_dir), cv=metrics.RollingForecastCV(4, 12, 40)).select("series_id", "fold", r("test_score", "test_score", 3))


@register("O158_cross_validate_mean", _FOLDS.format(first="40", start="0").replace(", 6))", ", 12))") + ", k AS (SELECT g.series_id, g.fold, g.split, g.stop, avg(s.y / 1e6) AS c FROM g JOIN s ON s.series_id = g.series_id AND s.t < g.split GROUP BY ALL) SELECT k.series_id, CAST(k.fold AS INTEGER) AS fold, round(max(abs(s.y / 1e6 - c)), 3) AS test_score FROM k JOIN s ON s.series_id = k.series_id AND s.t >= k.split AND s.t < k.stop GROUP BY 1, 2")
def o158b(spark, sf_dir):
    worst = lambda y, p: np.abs(y - p).max()
    return pipeline.cross_val_score(ARIMA((0, 0, 0)), _scaled(spark, sf_dir), scoring=worst, cv=metrics.RollingForecastCV(4, 12, 40)).select("series_id", "fold", r("test_score", "test_score", 3))


@register("O160_cross_val_predict", _MEAN.format(how="avg").replace("n - 4, 6", "n - 4, 4"))
def o160(spark, sf_dir):
    # A random walk without drift forecasts its last value, so SQL can state what the fitted folds give.
    return pipeline.cross_val_predict(ARIMA((0, 1, 0), with_intercept=False), s5(spark, sf_dir), cv=metrics.RollingForecastCV(4, 4, 30)).select("series_id", "t", r("yhat", "yhat", 2))


@register("O160_naive_predict", _MEAN.format(how="avg"))
def o160b(spark, sf_dir):
    return pipeline.naive_predict(s5(spark, sf_dir), metrics.RollingForecastCV(4, 6, 30)).select("series_id", "t", r("yhat", "yhat", 2))


@register("O160_cross_val_predict_arma")
def o160c(spark, sf_dir):
    return pipeline.cross_val_predict(ARIMA((1, 0, 0)), _scaled(spark, sf_dir), cv=metrics.RollingForecastCV(4, 4, 40)).select("series_id", "t", r("yhat", "yhat", 3))


@register("O165_histogram", ", b AS (SELECT series_id, min(y) AS lo, max(y) AS hi FROM s GROUP BY 1) SELECT s.series_id, CAST(least(floor((y - lo) * 25 / (hi - lo)), 24) AS INTEGER) AS bin, count(*) AS count FROM s JOIN b ON s.series_id = b.series_id GROUP BY 1, 2")
def o165(spark, sf_dir):
    return diagnostics.histogram(s5(spark, sf_dir)).select("series_id", "bin", "count")


@register("O166_residual_quantiles")
def o166(spark, sf_dir):
    return diagnostics.residual_panels(_models(spark, sf_dir))["quantiles"].select("series_id", r("y", "y", 2), r("share", "share", 6))


_STANDARD = _WHITE + ", q AS (SELECT z.series_id, (y - c) / sqrt(v) AS y FROM z JOIN f ON z.series_id = f.series_id)"


@register("O166_residual_quantiles_white_noise", _STANDARD + " SELECT series_id, round(y, 3) + 0.0 AS y, round((row_number() OVER (PARTITION BY series_id ORDER BY y) - 0.5) / count(*) OVER (PARTITION BY series_id), 6) AS share FROM q")
def o166b(spark, sf_dir):
    return diagnostics.residual_panels(_white(spark, sf_dir))["quantiles"].select("series_id", r("y", "y", 3), r("share", "share", 6))


@register("O166_residual_density_white_noise", _STANDARD + ", b AS (SELECT series_id, stddev_samp(y) * pow(count(*), -0.2) AS h, count(*) AS n FROM q GROUP BY 1) SELECT q.series_id, round(CAST(i AS DOUBLE) * (8.0 / 60) - 4, 4) + 0.0 AS x, round(sum(exp(-0.5 * pow((i * (8.0 / 60) - 4 - y) / h, 2)) / (n * h * sqrt(2 * pi()))), 4) AS density FROM q JOIN b ON q.series_id = b.series_id, range(61) AS r(i) GROUP BY 1, 2")
def o166c(spark, sf_dir):
    return diagnostics.residual_panels(_white(spark, sf_dir))["density"].select("series_id", r("x", "x"), r("density", "density"))


@register(
    "O17_residual_diagnostics_white_noise",
    _STANDARD.replace("AS y FROM z JOIN", "AS y, t, n FROM z JOIN") + ", l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS before FROM q), k AS (SELECT series_id, count(*) AS n, avg(coalesce(y * before, 0)) AS c1, avg(pow(y, 3)) AS skew, avg(pow(y, 4)) AS kurtosis, sum(CASE WHEN t >= n - round(n / 3) THEN y * y END) / sum(CASE WHEN t < round(n / 3) THEN y * y END) AS h FROM l GROUP BY 1) SELECT series_id, round(n * (n + 2) * c1 * c1 / (n - 1), 3) AS ljung_box, round(n / 6.0 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4), 2) AS jarque_bera, round(skew, 3) + 0.0 AS skew, round(kurtosis, 3) AS kurtosis, round(h, 3) AS heteroskedasticity FROM k",
)
def o17d(spark, sf_dir):
    return arima.residual_diagnostics(_white(spark, sf_dir)).select("series_id", r("ljung_box", "ljung_box", 3), r("jarque_bera", "jarque_bera", 2), *[r(c, c, 3) for c in ("skew", "kurtosis", "heteroskedasticity")])


@register("O17_residual_diagnostics")
def o17b(spark, sf_dir):
    return arima.residual_diagnostics(_models(spark, sf_dir)).select("series_id", *[r(c, c, 2) for c in ("ljung_box", "jarque_bera", "skew", "kurtosis", "heteroskedasticity")])


@register("O150_windowed_events", "SELECT event_type AS series_id, date_trunc('day', ts) AS ts, round(sum(value), 2) AS y FROM events GROUP BY 1, 2", "")
def o150(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    return online.windowed(events, "event_type", "ts", F.col("value")).select("series_id", "ts", r("y", "y", 2))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue by segment: automatic order, 12 months of forecasts with intervals."""
    models = auto.AutoARIMA(max_p=2, max_q=2, start_p=1, start_q=1, seasonal=False).fit(_scaled(spark, sf_dir))
    return arima.predict(models, 12)



"""Tests of stationarity and seasonality over many series, and the data behind the plots."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import statespace, unitroot
from tidemark.operators import windows
from tidemark.operators.guards import deprecated
from tidemark.operators.regression import at, interpolated, last_coefficient, products, solution
from tidemark.operators.series import by_time, whole

_TEST = "series_id string, stat double, pvalue double, should_diff boolean"


def _grouped(df: DataFrame, kernel, schema: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf.series_id.iloc[0], *kernel(pdf.sort_values("t").y.to_numpy(float)))])

    return df.select("series_id", "t", "y").groupBy("series_id").applyInPandas(run, schema)


def longest(df: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> int:
    """Rows of the longest series: a count by key, which reads no values."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _p_value(table, df: DataFrame) -> DataFrame:
    """(series_id, stat, pvalue) of (series_id, n, stat): the table's quantiles at n, then the share at the statistic."""
    quantiles = df.select("series_id", "stat", *[interpolated(F.col("n"), list(unitroot.SIZES), list(row)).alias(f"q{i}") for i, row in enumerate(table)])
    return quantiles.select("series_id", "stat", interpolated(F.col("stat"), [F.col(f"q{i}") for i in range(len(table))], list(unitroot.SHARES)).alias("pvalue"))


def _standard(df: DataFrame) -> DataFrame:
    """(series_id, t, z, length): values in standard units, which no statistic here depends on, and the series' length."""
    z = F.try_divide(F.col("y") - F.avg("y").over(whole()), F.stddev_pop("y").over(whole()))
    return df.select("series_id", "t", z.alias("z"), F.count(F.lit(1)).over(whole()).alias("length"))


def _width(n: Column, short: bool) -> Column:
    return F.floor((4 if short else 12) * F.pow(n / 100, 0.25))


def _bartlett(width: Column, most: int, names: str = "p") -> Column:
    """Twice the weighted lag products p1.., up to a series' own bandwidth."""
    return sum((F.when(width >= k, 2 * (1 - k / (width + 1)) * F.coalesce(F.col(f"{names}{k}"), F.lit(0.0))).otherwise(0.0) for k in range(1, most + 1)), F.lit(0.0))


def kpss(df: DataFrame, null: str = "level", lshort: bool = True, alpha: float = 0.05, most_rows: int | None = None) -> DataFrame:
    """(series_id, stat, pvalue, should_diff): running sums and lag products in one window pass, then one aggregate.

    Lag products are taken up to the bandwidth of the longest series (of ``most_rows`` rows, counted
    if not given) and weighted to zero beyond a series' own.
    """
    if null not in ("level", "trend"):
        raise ValueError("null must be 'level' or 'trend'")
    most = unitroot.bandwidth(most_rows or longest(df) or 1, lshort)
    line = F.avg("y").over(whole()) if null == "level" else F.regr_intercept("y", "t").over(whole()) + F.regr_slope("y", "t").over(whole()) * F.col("t")
    e = df.select("series_id", "t", (F.col("y") - line).alias("e"), F.count(F.lit(1)).over(whole()).alias("n"))
    lags = [(F.col("e") * F.lag("e", k).over(by_time())).alias(f"p{k}") for k in range(1, most + 1)]
    rows = e.select("series_id", "n", "e", F.sum("e").over(by_time().rowsBetween(Window.unboundedPreceding, 0)).alias("s"), *lags)
    sums = rows.groupBy("series_id", "n").agg(F.sum(F.col("s") ** 2).alias("eta"), F.sum(F.col("e") ** 2).alias("v"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, most + 1)])
    stat = F.try_divide(F.col("eta") / F.col("n") ** 2, (F.col("v") + _bartlett(_width(F.col("n"), lshort), most)) / F.col("n"))
    values = unitroot.KPSS_LEVEL if null == "level" else unitroot.KPSS_TREND
    out = sums.select("series_id", stat.alias("stat"))
    out = out.withColumn("pvalue", interpolated(F.col("stat"), list(values[::-1]), list(unitroot.KPSS_SHARES[::-1])))
    return out.withColumn("should_diff", F.col("pvalue") < alpha)


#: The most lags of differences whose products are columns of one aggregate (n of about 8000 by the default rule).
MOST_LAGS = 20


def adf(df: DataFrame, k: int | None = None, alpha: float = 0.05, most_rows: int | None = None) -> DataFrame:
    """(series_id, stat, pvalue, should_diff): the augmented Dickey-Fuller regression by sums of lag products.

    A series' own number of lags follows from its length (unless k is given); columns beyond it are
    zero, with 1 in the matrix. A series without a solution (constant, or too short) has a null statistic.
    """
    if k is not None and k < 0:
        raise ValueError("k must be a non-negative integer")
    own = lambda n: (F.floor(F.pow(n - 1, F.lit(1 / 3))) if k is None else F.lit(k)) + 1
    most = (int(max((most_rows or longest(df)) - 1, 0) ** (1 / 3)) if k is None else k) + 1
    if most > MOST_LAGS:
        # So many lags are a matrix for a kernel: one series a task.
        return _grouped(df, lambda y: (*(r := unitroot.adf(y, k)), r[1] > alpha), _TEST)
    z = _standard(df).withColumn("before", F.lag("z").over(by_time()))
    rows = z.select("series_id", "t", "length", "before", (F.col("z") - F.col("before")).alias("d"), own(F.col("length")).alias("k"))
    lags = [F.when(F.col("k") > j, F.lag("d", j).over(by_time())).otherwise(0.0).alias(f"d{j}") for j in range(1, most)]
    rows = rows.select("*", *lags).where(F.col("t") >= F.col("k"))
    columns = [F.lit(1.0), F.col("t") / F.col("length") - 0.5, *[F.col(f"d{j}") for j in range(1, most)], F.col("before"), F.col("d")]
    found = products(rows, columns, ["series_id", "length", "k"])
    spare = F.transform("gram", lambda row, i: F.transform(row, lambda v, j: v + F.when((i == j) & (i >= F.col("k") + 1) & (i <= most), 1.0).otherwise(0.0)))
    fits = last_coefficient(found.withColumn("gram", spare), len(columns), F.col("k") + 2)
    out = _p_value(unitroot.DICKEY_FULLER, fits.select("series_id", (F.col("length") - 1).alias("n"), F.col("t").alias("stat")))
    return _every_series(df, out).withColumn("should_diff", F.col("pvalue") > alpha)


def pp(df: DataFrame, lshort: bool = True, alpha: float = 0.05, most_rows: int | None = None) -> DataFrame:
    """(series_id, stat, pvalue, should_diff): Phillips and Perron's Z(alpha), by two aggregates: the regression, then its residuals' lag products."""
    most = unitroot.bandwidth(max((most_rows or longest(df)) - 1, 1), lshort)
    z = _standard(df).withColumn("before", F.lag("z").over(by_time())).where("before is not null").withColumn("length", F.col("length") - 1)
    columns = [F.lit(1.0), F.col("t") - F.col("length") / 2, F.col("before"), F.col("z")]
    fits = products(z, columns, ["series_id"], F.sum(F.col("before") * F.col("t")).alias("xt"))
    fits = fits.select("series_id", "xt", solution(F.col("gram"), 3).alias("b"), at(F.col("gram"), 2, 2).alias("xx"), at(F.col("gram"), 0, 2).alias("x"))
    u = z.join(fits, "series_id").withColumn("u", F.col("z") - F.get("b", F.lit(0)) - F.get("b", F.lit(1)) * (F.col("t") - F.col("length") / 2) - F.get("b", F.lit(2)) * F.col("before"))
    lags = [(F.col("u") * F.lag("u", k).over(by_time())).alias(f"p{k}") for k in range(1, most + 1)]
    facts = [F.first(c).alias(c) for c in ("xt", "xx", "x")]
    rows = u.select("series_id", F.col("length").alias("n"), "u", "xt", "xx", "x", F.get("b", F.lit(2)).alias("rho"), *lags)
    sums = rows.groupBy("series_id", "n").agg(F.first("rho").alias("rho"), *facts, *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, most + 1)])
    n = F.col("n").cast("double")
    more = _bartlett(_width(n, lshort), most) / n
    d = n**2 * (n**2 - 1) * F.col("xx") / 12 - n * F.col("xt") ** 2 + n * (n + 1) * F.col("xt") * F.col("x") - n * (n + 1) * (2 * n + 1) * F.col("x") ** 2 / 6
    stat = n * (F.col("rho") - 1) - F.try_divide(n**6, 24 * d) * more
    out = _p_value(unitroot.PHILLIPS_PERRON, sums.select("series_id", "n", stat.alias("stat")))
    return _every_series(df, out).withColumn("should_diff", F.col("pvalue") > alpha)


def _every_series(df: DataFrame, found: DataFrame) -> DataFrame:
    """Results with a row of nulls for each series that has none (too short for any row of the regression)."""
    return df.select("series_id").distinct().join(found, "series_id", "left")


def ocsb_critical(m: Column) -> Column:
    """The OCSB test's critical value for m seasons."""
    z = F.ln(m.cast("double")) - 0.7656451
    return -0.2937411 * F.exp(-0.2850853 * z - 0.05983644 * z * z) - 1.652202


def canova_hansen_critical(m: Column) -> Column:
    """The Canova-Hansen test's critical value for m seasons."""
    out = 0.269 * F.pow(m.cast("double"), F.lit(0.928))
    for k, v in [*unitroot.CANOVA_HANSEN_LONG.items(), *((k + 2, v) for k, v in enumerate(unitroot.CANOVA_HANSEN))]:
        out = F.when(m == k, v).otherwise(out)
    return out


def canova_hansen(df: DataFrame, m: int) -> DataFrame:
    """(series_id, stat, critical, d)."""
    return _grouped(df, lambda y: (unitroot.canova_hansen(y, m), unitroot.canova_hansen_critical(m), unitroot.ch_differences(y, m)), "series_id string, stat double, critical double, d int")


def ocsb(df: DataFrame, m: int, lag_method: str = "aic", max_lag: int = 3) -> DataFrame:
    """(series_id, stat, critical, d)."""
    return _grouped(df, lambda y: (s := unitroot.ocsb(y, m, lag_method, max_lag), c := unitroot.ocsb_critical(m), int(s > c)), "series_id string, stat double, critical double, d int")


def ndiffs(df: DataFrame, alpha: float = 0.05, test: str = "kpss", max_d: int = 2, **kw) -> DataFrame:
    """(series_id, d): the differences that the test asks for.

    All of d = 0..max_d are tested at once, each (series, d) as a series of its own, and the first d
    counts that is constant or not rejected; a d without a statistic ends the search one before it.
    """
    if max_d <= 0:
        raise ValueError("max_d must be a positive integer")
    if test not in ("kpss", "adf", "pp"):
        raise ValueError(f"{test!r} must be one of adf, kpss, pp")
    before = [F.lag("y", k).over(by_time()).alias(f"y{k}") for k in range(1, max_d + 1)]
    rows = df.select("series_id", "t", "y", *before)
    value = lambda d: sum(((-1) ** k * math.comb(d, k) * (F.col(f"y{k}") if k else F.col("y")) for k in range(d + 1)), F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("t") - d).alias("t"), value(d).alias("y")) for d in range(max_d + 1)]))
    rows = rows.select("series_id", each.alias("x")).where("x.t >= 0").select(F.struct("series_id", "x.d").alias("series_id"), "x.t", "x.y")
    tests = {"kpss": kpss, "adf": adf, "pp": pp}
    flat = rows.groupBy("series_id").agg((F.min("y") == F.max("y")).alias("flat"))
    found = flat.join(tests[test](rows, alpha=alpha, most_rows=longest(df), **kw), "series_id", "left")
    found = found.select("series_id.series_id", "series_id.d", F.struct("flat", F.col("pvalue").isNull().alias("none"), "should_diff").alias("x"))
    table = found.groupBy("series_id").agg(*[F.max(F.when(F.col("d") == d, F.col("x"))).alias(f"x{d}") for d in range(max_d + 1)])
    out = F.lit(max_d)
    for d in range(max_d, -1, -1):
        x = F.col(f"x{d}")
        out = F.when(x.isNull(), max(d - 1, 0)).when(x["flat"], d).when(x["none"], max(d - 1, 0)).when(~x["should_diff"], d).otherwise(out)
    return table.select("series_id", out.cast("int").alias("d"))


def nsdiffs(df: DataFrame, m: int, max_D: int = 2, test: str = "ocsb", **kw) -> DataFrame:
    """(series_id, D)."""
    if max_D <= 0:
        raise ValueError("max_D must be a positive integer")
    return _grouped(df, lambda y: (unitroot.nsdiffs(y, m, max_D, test, **kw),), "series_id string, D int")


@deprecated("kpss, adf or pp")
def is_stationary(df: DataFrame, test: str = "kpss", alpha: float = 0.05) -> DataFrame:
    """(series_id, pvalue, should_diff) of one of the three tests."""
    tests = {"kpss": kpss, "adf": adf, "pp": pp}
    if test not in tests:
        raise ValueError(f"test must be one of {sorted(tests)}")
    return tests[test](df, alpha=alpha).select("series_id", "pvalue", "should_diff")


def density(df: DataFrame, points: int = 61, span: float = 4.0, column: str = "y") -> DataFrame:
    """(series_id, x, density): Gaussian kernel density at equally spaced points from -span to span, with Scott's bandwidth.

    Each row is exploded to the points and summed before the shuffle, so a series' length costs no more than its rows.
    """
    sizes = df.groupBy("series_id").agg((F.stddev_samp(column) * F.pow(F.count(column), F.lit(-0.2))).alias("h"), F.count(column).alias("n"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * (2 * span / (points - 1)) - span))
    rows = df.join(sizes, "series_id").select("series_id", "h", "n", F.col(column).alias("v"), grid.alias("x"))
    bump = F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), 2)) / (F.col("n") * F.col("h") * (2 * math.pi) ** 0.5)
    return rows.groupBy("series_id", "x").agg(F.sum(bump).alias("density"))


#: Methods of the partial autocorrelation whose covariances are divided by the number of pairs, and by the number of rows.
ADJUSTED = ("yw", "ywadjusted", "ywa", "ld", "lda", "ldadjusted")
BIASED = ("ywm", "ywmle", "ldb", "ldbiased")


def pacf(df: DataFrame, nlags: int, method: str = "ywadjusted", alpha: float | None = None) -> DataFrame:
    """(series_id, lag, r); with alpha also se (one over the root of the rows, none at lag 0), lower and upper.

    Sums of lag products, then Durbin and Levinson's recursion as a fold over their array; only "ols" needs a series
    in one task. Constant series and series with missing values have null beyond lag 0.
    """
    name = method.replace("unbiased", "adjusted") if "unbiased" in method else {"ywu": "ywa", "ldu": "lda"}.get(method, method)
    if name != method:
        warnings.warn(f"{method!r} is an old name of {name!r}", DeprecationWarning, stacklevel=2)
    if name == "ols":
        found = _pacf_by_regressions(df, nlags)
    elif name in (*ADJUSTED, *BIASED):
        found = _pacf_by_recursion(df, nlags, name in ADJUSTED)
    else:
        raise ValueError(f"{method!r} is not a method of the partial autocorrelation")
    return found.drop("se") if alpha is None else windows.bounded(found, alpha)


def _pacf_by_recursion(df: DataFrame, nlags: int, adjusted: bool) -> DataFrame:
    y = F.when(~F.isnan(F.col("y").cast("double")), F.col("y").cast("double"))
    rows = df.select("series_id", "t", y.alias("y")).select("series_id", "t", F.count(F.lit(1)).over(whole()).alias("n"), (F.col("y") - F.avg("y").over(whole())).alias("d"))
    sums = windows.lag_sums(rows, nlags).withColumn("whole", F.get("c", F.lit(0)) == F.col("n"))
    share = F.transform("p", lambda x, k: F.when(F.col("whole"), F.try_divide(x, F.col("n") - k if adjusted else F.col("n"))))
    sums = sums.select("series_id", "n", share.alias("g"))
    # phi[j - 1] is the coefficient of lag j; an order's last one is the partial autocorrelation.
    one = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def step(s, k):
        known = F.aggregate(F.transform(s["phi"], lambda x, j: x * F.get("g", k - 1 - j)), F.lit(0.0), lambda a, x: a + x)
        last = F.try_divide(F.get("g", k) - known, s["v"])
        follow = lambda a: F.concat(F.transform(s["phi"], lambda x, j: x - a * F.get(s["phi"], k - 2 - j)), F.array(a))
        return one(last, lambda a: F.struct(follow(a).alias("phi"), (s["v"] * (1 - a * a)).alias("v"), F.concat(s["r"], F.array(a)).alias("r")))

    # Arrays whose type says that they may hold nulls, which the fold needs.
    head = lambda n: F.slice(F.array(F.lit(1.0), F.lit(None).cast("double")), 1, n)
    start = F.struct(head(0).alias("phi"), F.get("g", F.lit(0)).alias("v"), head(1).alias("r"))
    most = F.least(F.lit(nlags).cast("long"), F.col("n") - 1).cast("int")
    orders = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    found = sums.select("series_id", "n", F.aggregate(orders, start, step)["r"].alias("r"))
    se = F.when(F.col("lag") == 0, 0.0).otherwise(1 / F.sqrt("n"))
    return found.select("series_id", "n", F.posexplode("r").alias("lag", "r")).select("series_id", "lag", "r", se.alias("se"))


def _pacf_by_regressions(df: DataFrame, nlags: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t").y.to_numpy(float)
        k = min(nlags, len(y) - 1)
        se = np.append(0.0, np.full(k, len(y) ** -0.5))
        return pd.DataFrame({"series_id": pdf.series_id.iloc[0], "lag": range(k + 1), "r": statespace.pacf(y, k, "ols"), "se": se})

    return df.select("series_id", "t", "y").groupBy("series_id").applyInPandas(run, "series_id string, lag int, r double, se double")


def histogram(df: DataFrame, bins: int = 25, column: str = "y") -> DataFrame:
    """(series_id, bin, low, high, count)."""
    spans = df.groupBy("series_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0))), F.lit(bins - 1)).cast("int")
    counts = df.join(spans, "series_id").groupBy("series_id", "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select("series_id", "bin", (F.col("lo") + width * F.col("bin")).alias("low"), (F.col("lo") + width * (F.col("bin") + 1)).alias("high"), "count")


def tsdisplay(df: DataFrame, lag_max: int = 50, bins: int = 25) -> dict[str, DataFrame]:
    """The data of the series, autocorrelation and histogram panels."""
    return {"series": df.select("series_id", "t", "y"), "acf": windows.acf(df, lag_max), "histogram": histogram(df, bins)}


def residual_panels(models: DataFrame, bins: int = 25, lags: int = 10) -> dict[str, DataFrame]:
    """Standardized residuals, their histogram, normal quantiles and autocorrelations of model rows."""
    rows = models.where("error is null").select("series_id", F.posexplode(F.expr("slice(resid, cast(nobs - nobs_effective as int) + 1, cast(nobs_effective as int))")).alias("t", "e"))
    standard = rows.select("series_id", F.col("t").cast("long").alias("t"), F.try_divide(F.col("e") - F.avg("e").over(whole()), F.stddev_pop("e").over(whole())).alias("y"))
    place = (F.row_number().over(Window.partitionBy("series_id").orderBy("y")) - 0.5) / F.count(F.lit(1)).over(whole())
    return {"residuals": standard, "histogram": histogram(standard, bins), "density": density(standard), "quantiles": standard.select("series_id", "y", place.alias("share")), "acf": windows.acf(standard, lags)}


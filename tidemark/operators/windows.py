"""Lag and window operators. All windows share one partitioning and order, so that Spark keeps
one exchange and one sort for a chain of them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import by_time, whole


def diff(df: DataFrame, lag: int = 1, differences: int = 1, columns: tuple[str, ...] = ("y",)) -> DataFrame:
    """y[t] - y[t - lag], repeated. The first lag * differences rows go; t starts at 0 again."""
    if lag < 1 or differences < 1:
        raise ValueError("lag and differences must be positive integers")
    for _ in range(differences):
        df = df.select("series_id", "t", *[(F.col(c) - F.lag(c, lag).over(by_time())).alias(c) for c in columns])
    cut = lag * differences
    return df.where(F.col("t") >= cut).withColumn("t", F.col("t") - cut)


def diff_inv(df: DataFrame, lag: int = 1, differences: int = 1, xi: list[float] | None = None) -> DataFrame:
    """The inverse of diff: n + lag * differences rows. xi are the values that diff has lost, zeros if not given."""
    if lag < 1 or differences < 1:
        raise ValueError("lag and differences must be positive integers")
    if xi is not None and len(xi) != lag * differences:
        raise ValueError("xi must have lag * differences values")
    # The heads of the series and of its differences, the last difference first.
    heads, rest = [], [float(x) for x in xi or [0.0] * (lag * differences)]
    for _ in range(differences):
        heads.insert(0, rest[:lag])
        rest = [b - a for a, b in zip(rest, rest[lag:], strict=False)]
    for values in heads:
        lost = F.posexplode(F.array(*[F.lit(x) for x in values])).alias("t", "y")
        head = df.select("series_id").distinct().select("series_id", lost).select("series_id", F.col("t").cast("long").alias("t"), "y")
        rows = head.unionByName(df.select("series_id", (F.col("t") + lag).alias("t"), "y"))
        phase = Window.partitionBy("series_id", F.pmod("t", F.lit(lag))).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        df = rows.withColumn("y", F.sum("y").over(phase))
    return df


def embed(df: DataFrame, k: int) -> DataFrame:
    """Lag matrix, most recent first: columns lag_0 .. lag_{k-1}, rows with a full history."""
    if k < 1:
        raise ValueError("k must be a positive integer")
    lags = [F.lag("y", i).over(by_time()).alias(f"lag_{i}") for i in range(k)]
    return df.select("series_id", "t", *lags).where(F.col("t") >= k - 1)


def cumulative(df: DataFrame) -> DataFrame:
    """Running sum of y."""
    return df.withColumn("y", F.sum("y").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))


def residuals_of_line(df: DataFrame, trend: bool = False) -> DataFrame:
    """y less its mean, or less its least-squares line over t."""
    if not trend:
        return df.withColumn("y", F.col("y") - F.avg("y").over(whole()))
    fit = df.groupBy("series_id").agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("base"))
    return df.join(fit, "series_id").withColumn("y", F.col("y") - F.col("base") - F.col("slope") * F.col("t")).drop("slope", "base")


def decompose(df: DataFrame, kind: str, m: int, filter_: list[float] | None = None) -> DataFrame:
    """(series_id, t, x, trend, seasonal, random).

    The trend is the mean of m neighbours (row p - m//2 onward) or a given filter, null at the
    edges; the seasonal part is the phase mean of the detrended rows, not re-centred. For odd
    m it is shifted by one phase, as the rotation by half a period of the reference procedure
    makes it.
    """
    if kind not in ("additive", "multiplicative"):
        raise ValueError("kind must be 'additive' or 'multiplicative'")
    if not isinstance(m, int) or m <= 1:
        raise ValueError("m must be an integer larger than 1")
    h = m // 2
    n = F.count(F.lit(1)).over(whole())
    df = df.select("series_id", "t", F.col("y").alias("x"), n.alias("n"))
    short = F.raise_error(F.lit("series is shorter than two periods")).cast("long")
    df = df.withColumn("n", F.when(F.col("n") >= 2 * m, F.col("n")).otherwise(short))
    if filter_ is None:
        trend = F.avg("x").over(by_time().rowsBetween(-h, m - 1 - h))
    else:
        if len(filter_) != m:
            raise ValueError("filter_ must have m weights")
        # Convolution: the weights run against the rows.
        trend = sum(F.lit(float(w)) * F.lag("x", h - m + 1 + k).over(by_time()) for k, w in enumerate(filter_))
    inside = (F.col("t") >= h) & (F.col("t") < F.col("n") - h)
    df = df.withColumn("trend", F.when(inside, trend))
    plain = F.col("x") - F.col("trend") if kind == "additive" else F.try_divide(F.col("x"), F.col("trend"))
    df = df.withColumn("plain", plain)
    # Row p takes the mean of the rows whose phase, counted from the other half, is its own.
    means = df.groupBy("series_id", F.pmod(F.col("t") - h, F.lit(m)).alias("phase")).agg(F.avg("plain").alias("seasonal"))
    df = df.withColumn("phase", F.pmod(F.col("t") + h, F.lit(m))).join(means, ["series_id", "phase"])
    random = F.col("plain") - F.col("seasonal") if kind == "additive" else F.try_divide(F.col("plain"), F.col("seasonal"))
    return df.select("series_id", "t", "x", "trend", "seasonal", random.alias("random"))


#: Lags up to which autocorrelations are columns of one window pass; more are correlated by blocks, with the same results.
WINDOW_LAGS = 64
#: Rows of a block of a long series, at least; a block is never shorter than the lags.
BLOCK_ROWS = 4096
MISSING = ("none", "raise", "conservative", "drop")


def acf(df: DataFrame, nlags: int, adjusted: bool = False, alpha: float | None = None, missing: str = "none", fft: bool | None = None) -> DataFrame:
    """(series_id, lag, r, se, q): autocorrelations, Bartlett standard errors, Ljung-Box Q; with alpha also lower and upper bounds.

    Null and NaN are missing. ``missing``: "none" gives null for a series that has such rows, "raise" fails the job, "drop"
    closes the gaps, "conservative" sums the pairs that have both values (``adjusted`` then divides by their number).
    Standard errors and Q count all rows. ``fft`` chooses between one window pass with a column a lag and
    correlations of blocks by Fourier transforms; without it the number of lags does.
    """
    if missing not in MISSING:
        raise ValueError(f"{missing!r} must be one of {', '.join(MISSING)}")
    value = F.when(~F.isnan(F.col("y").cast("double")), F.col("y").cast("double"))
    if missing == "raise":
        value = F.coalesce(value, F.raise_error(F.lit("y has missing values")).cast("double"))
    rows = df.select("series_id", "t", value.alias("y")).select("series_id", "t", F.count(F.lit(1)).over(whole()).alias("n"), (F.col("y") - F.avg("y").over(whole())).alias("d"))
    if missing == "drop":
        rows = rows.where("d is not null")
    sums = lag_sums(rows, nlags, fft)
    pairs = lambda k: F.greatest(F.get("c", k), F.lit(1))
    share = F.transform("p", lambda x, k: F.try_divide(x, F.get("p", F.lit(0))) * (F.col("valid") / pairs(k) if adjusted else F.lit(1.0)))
    sums = sums.withColumn("valid", F.get("c", F.lit(0)))
    rows = sums.select("series_id", "n", "valid", F.posexplode(share).alias("lag", "r")).where("lag < valid" if missing == "drop" else "lag < n")
    if missing == "none":
        rows = rows.withColumn("r", F.when(F.col("valid") == F.col("n"), F.col("r")))
    before = Window.partitionBy("series_id").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("series_id").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    square = F.when(F.col("lag") > 0, F.col("r") * F.col("r")).otherwise(0.0)
    se = F.when(F.col("lag") == 0, 0.0).otherwise(F.sqrt((1 + 2 * F.sum(square).over(before)) / F.col("n")))
    q = F.when(F.col("lag") > 0, F.col("n") * (F.col("n") + 2) * F.sum(square / (F.col("n") - F.col("lag"))).over(upto))
    return bounded(rows.select("series_id", "lag", "r", se.alias("se"), q.alias("q")), alpha)


def bounded(df: DataFrame, alpha: float | None) -> DataFrame:
    """df with lower and upper, r less and plus its standard errors at the level alpha; df as it is without one."""
    if alpha is None:
        return df
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return df.withColumns({"lower": F.col("r") - z * F.col("se"), "upper": F.col("r") + z * F.col("se")})


def lag_sums(rows: DataFrame, nlags: int, fft: bool | None = None) -> DataFrame:
    """(series_id, n, p, c): of (series_id, t, n, d), the sums and numbers of the products of d with lags 0..nlags."""
    return (_sums_by_blocks if (nlags > WINDOW_LAGS if fft is None else fft) else _sums_by_window)(rows, nlags)


def _sums_by_window(rows: DataFrame, nlags: int) -> DataFrame:
    """One shuffle, whatever the number of lags."""
    lagged = [(F.col("d") * F.lag("d", k).over(by_time())).alias(f"p{k}") for k in range(1, nlags + 1)]
    products = rows.select("series_id", "n", (F.col("d") * F.col("d")).alias("p0"), *lagged)
    each = [f(F.col(f"p{k}")).alias(f"{name}{k}") for name, f in (("p", F.sum), ("c", F.count)) for k in range(nlags + 1)]
    return products.groupBy("series_id", "n").agg(*each).select("series_id", "n", *[F.array(*[F.col(f"{name}{k}") for k in range(nlags + 1)]).alias(name) for name in "pc"])


def _sums_by_blocks(rows: DataFrame, nlags: int) -> DataFrame:
    """Each block of rows has the lags' number of rows of the next one beside it, so no task holds a series.

    A block is correlated with itself and these rows by Fourier transforms; its sums are added to the others' by lag.
    """
    size = max(BLOCK_ROWS, nlags)
    at = F.row_number().over(by_time()) - 1
    own = F.floor(F.col("i") / size)
    blocks = F.explode(F.when((F.col("i") % size < nlags) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own)))
    dealt = rows.select("series_id", "n", "d", at.alias("i")).select("series_id", "n", "i", "d", blocks.alias("block"))
    packed = dealt.groupBy("series_id", "n", "block").agg(F.sort_array(F.collect_list(F.struct("i", "d"))).alias("rows"))
    packed = packed.select("series_id", "n", F.transform(F.col("rows.d"), lambda x: F.coalesce(x, F.lit(math.nan))).alias("d"))

    def correlated(frames):
        for pdf in frames:
            out = []
            for d in pdf["d"]:
                d = np.asarray(d, float)
                here = ~np.isnan(d)
                width = 1 << (min(len(d), size) + nlags).bit_length()
                sums = []
                for x in (np.where(here, d, 0.0), here.astype(float)):
                    # Products of a block's own rows with those k rows later; the width keeps them from going round.
                    pairs = np.fft.irfft(np.conj(np.fft.rfft(x[:size], width)) * np.fft.rfft(x, width), width)
                    sums.append(pairs[: nlags + 1])
                out.append((sums[0].tolist(), np.rint(sums[1]).astype(np.int64).tolist()))
            yield pd.DataFrame({"series_id": pdf["series_id"], "n": pdf["n"], "p": [x for x, _ in out], "c": [x for _, x in out]})

    parts = packed.mapInPandas(correlated, "series_id string, n long, p array<double>, c array<long>")
    lags = parts.select("series_id", "n", F.posexplode(F.arrays_zip("p", "c")).alias("lag", "x")).groupBy("series_id", "n", "lag").agg(F.sum("x.p").alias("p"), F.sum("x.c").alias("c"))
    ordered = lags.groupBy("series_id", "n").agg(F.sort_array(F.collect_list(F.struct("lag", "p", "c"))).alias("x"))
    return ordered.select("series_id", "n", F.col("x.p").alias("p"), F.col("x.c").alias("c"))


def default_lags(n: int) -> int:
    """min(10 log10 n, n - 1), rounded down."""
    from math import log10

    return min(int(10 * log10(n)), n - 1)


def long_run_variance(df: DataFrame, lags: int) -> DataFrame:
    """(series_id, variance): Bartlett-weighted (Newey-West) variance of residuals y."""
    products = df.select("series_id", "y", *[(F.col("y") * F.lag("y", k).over(by_time())).alias(f"p{k}") for k in range(1, lags + 1)])
    weights = sum((F.lit(2 * (1 - k / (lags + 1.0))) * F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    return products.groupBy("series_id").agg(((F.sum(F.col("y") * F.col("y")) + weights) / F.count(F.lit(1))).alias("variance"))

"""Unit-root and seasonality tests of one series, as numpy kernels."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.optimise import LeastSquares

#: Sample sizes, probabilities and quantiles of the published Dickey-Fuller tables.
SIZES = (25, 50, 100, 250, 500, 100000)
SHARES = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
DICKEY_FULLER = (
    (-4.38, -4.15, -4.04, -3.99, -3.98, -3.96),
    (-3.95, -3.80, -3.73, -3.69, -3.68, -3.66),
    (-3.60, -3.50, -3.45, -3.43, -3.42, -3.41),
    (-3.24, -3.18, -3.15, -3.13, -3.13, -3.12),
    (-1.14, -1.19, -1.22, -1.23, -1.24, -1.25),
    (-0.80, -0.87, -0.90, -0.92, -0.93, -0.94),
    (-0.50, -0.58, -0.62, -0.64, -0.65, -0.66),
    (-0.15, -0.24, -0.28, -0.31, -0.32, -0.33),
)
PHILLIPS_PERRON = (
    (-22.5, -25.7, -27.4, -28.4, -28.9, -29.5),
    (-19.9, -22.4, -23.6, -24.4, -24.8, -25.1),
    (-17.9, -19.8, -20.7, -21.3, -21.5, -21.8),
    (-15.6, -16.8, -17.5, -18.0, -18.1, -18.3),
    (-3.66, -3.71, -3.74, -3.75, -3.76, -3.77),
    (-2.51, -2.60, -2.62, -2.64, -2.65, -2.66),
    (-1.53, -1.66, -1.73, -1.78, -1.78, -1.79),
    (-0.43, -0.65, -0.75, -0.82, -0.84, -0.87),
)
KPSS_SHARES = (0.01, 0.025, 0.05, 0.10)
KPSS_LEVEL = (0.739, 0.574, 0.463, 0.347)
KPSS_TREND = (0.216, 0.176, 0.146, 0.119)
#: Canova-Hansen critical values for 2 to 12 seasons, and for 24, 52 and 365.
CANOVA_HANSEN = (0.4617146, 0.7479655, 1.0007818, 1.2375350, 1.4625240, 1.6920200, 1.9043096, 2.1169602, 2.3268562, 2.5406922, 2.7391007)
CANOVA_HANSEN_LONG = {24: 5.098624, 52: 10.341416, 365: 65.44445}


def from_table(table, n: int, stat: float) -> float:
    """p value: the table's quantiles at n, then the probability at the statistic; clamped outside."""
    quantiles = [np.interp(n, SIZES, row) for row in table]
    return float(np.interp(stat, quantiles, SHARES))


def long_run_variance(u: np.ndarray, lags: int) -> float:
    n = len(u)
    extra = sum((1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, lags + 1) if k < n)
    return float((u @ u + 2 * extra) / n)


def bandwidth(n: int, short: bool) -> int:
    return int((4 if short else 12) * (n / 100) ** 0.25)


def kpss(y: np.ndarray, null: str = "level", lshort: bool = True) -> tuple[float, float]:
    """(statistic, p value); small p means difference."""
    n = len(y)
    t = np.arange(1, n + 1)
    e = y - y.mean() if null == "level" else y - np.polyval(np.polyfit(t, y, 1), t)
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / long_run_variance(e, bandwidth(n, lshort)))
    values = KPSS_LEVEL if null == "level" else KPSS_TREND
    return stat, float(np.interp(stat, values[::-1], KPSS_SHARES[::-1]))


def adf(y: np.ndarray, k: int | None = None) -> tuple[float, float]:
    """(statistic, p value); large p means difference."""
    k = (int((len(y) - 1) ** (1 / 3)) if k is None else k) + 1
    d = np.diff(y)
    n = len(d)
    if k > n:
        raise ValueError("the series is too short for the number of lags")
    rows = np.arange(k - 1, n)
    design = [np.ones(len(rows)), y[rows], rows + 1.0, *(d[rows - i] for i in range(1, k))]
    fit = LeastSquares(d[rows], np.column_stack(design))
    stat = float(fit.tvalues[1])
    return stat, from_table(DICKEY_FULLER, n, stat)


def pp(y: np.ndarray, lshort: bool = True) -> tuple[float, float]:
    """Phillips-Perron Z(alpha): (statistic, p value); large p means difference."""
    now, before = y[1:], y[:-1]
    n = len(now)
    t = np.arange(1, n + 1)
    x = np.column_stack([np.ones(n), t - n / 2, before])
    params = np.linalg.lstsq(x, now, rcond=None)[0]
    u = now - x @ params
    s0 = float(u @ u / n)
    s = long_run_variance(u, bandwidth(n, lshort))
    weighted, total = float(before @ t), float(before.sum())
    d = n**2 * (n**2 - 1) * float(before @ before) / 12 - n * weighted**2 + n * (n + 1) * weighted * total - n * (n + 1) * (2 * n + 1) * total**2 / 6
    stat = float(n * (params[2] - 1) - n**6 / (24 * d) * (s - s0))
    return stat, from_table(PHILLIPS_PERRON, n, stat)


def canova_hansen(y: np.ndarray, m: int) -> float:
    """Statistic of stable seasonality with m seasons (0 if the covariance is singular)."""
    n = len(y)
    t = np.arange(1, n + 1)
    waves = [f(2 * math.pi * i * t / m) for i in range(1, m + 1) for f in (np.cos, np.sin)]
    x = np.column_stack(waves[: m - 1])
    with_mean = np.column_stack([np.ones(n), x])
    e = y - with_mean @ np.linalg.lstsq(with_mean, y, rcond=None)[0]
    scores = x * e[:, None]
    lags = round(m * (n / 100) ** 0.25)
    cov = scores.T @ scores
    for k in range(1, lags + 1):
        cross = scores[k:].T @ scores[:-k] * (1 - k / (lags + 1))
        cov = cov + cross + cross.T
    cov = cov / n
    # Frequencies below the middle have two columns each; the middle one of an even m has one.
    used = 2 * (m // 2 - 1) + 1 if m % 2 == 0 else 2 * (m // 2 - 1) + 1
    cov, sums = cov[:used, :used], np.cumsum(scores, axis=0)[:, :used]
    if np.linalg.svd(cov, compute_uv=False).min() < np.finfo(float).eps:
        return 0.0
    return float(np.trace(np.linalg.solve(cov, sums.T @ sums)) / n**2)


def canova_hansen_critical(m: int) -> float:
    if m <= 12:
        return CANOVA_HANSEN[m - 2]
    return CANOVA_HANSEN_LONG.get(m, 0.269 * m**0.928)


def ch_differences(y: np.ndarray, m: int) -> int:
    if m < 2:
        raise ValueError("m must be at least 2")
    return 0 if len(y) < 2 * m + 5 else int(canova_hansen(y, m) > canova_hansen_critical(m))


def ocsb_critical(m: int) -> float:
    z = math.log(m) - 0.7656451
    return -0.2937411 * math.exp(-0.2850853 * z - 0.05983644 * z**2) - 1.652202


def lag_columns(y: np.ndarray, lag: int) -> np.ndarray:
    """Rows t >= lag - 1, columns y[t], y[t-1] .. y[t-lag+1]."""
    return np.column_stack([y[lag - 1 - i : len(y) - i] for i in range(lag)])


def _ocsb_fit(y: np.ndarray, m: int, lag: int, max_lag: int) -> LeastSquares:
    seasonal = y[m:] - y[:-m]
    if not len(seasonal):
        raise ValueError("no rows are left after the seasonal difference; a longer series is needed")
    if lag < 1:
        raise np.linalg.LinAlgError("Singular matrix")
    both = np.diff(seasonal)
    ones = lambda x: np.column_stack([np.ones(len(x)), x])
    target = both[max_lag:]
    lags = lag_columns(both, lag)[: len(target)]
    ar = LeastSquares(target, ones(lags))

    def filtered(x: np.ndarray) -> np.ndarray:
        return x[lag:] - ar.predict(ones(lag_columns(x, lag)[: len(x) - lag]))

    z4, z5 = filtered(seasonal), filtered(np.diff(y))
    n = len(lags)
    return LeastSquares(target, np.column_stack([lags, z4[:n], z5[:n]]))


def ocsb(y: np.ndarray, m: int, lag_method: str = "aic", max_lag: int = 3) -> float:
    """OCSB statistic. The criterion picks the best lag L; lag L - 2 is then fitted, and where
    that has no solution the criterion's own fit counts."""
    chosen = None
    lag = max_lag
    if max_lag > 0 and lag_method != "fixed":
        fits: list[LeastSquares | None] = []
        values = []
        for k in range(1, max_lag + 1):
            try:
                fits.append(_ocsb_fit(y, m, k, max_lag))
                values.append(fits[-1].criterion(lag_method))
            except np.linalg.LinAlgError:
                fits.append(None)
                values.append(np.nan)
        if np.isnan(values).all():
            raise ValueError("every lag gives a singular matrix; a longer series or another test is needed")
        best = int(np.nanargmin(values))
        chosen, lag = fits[best], best - 1
    try:
        fit = _ocsb_fit(y, m, lag, lag)
    except np.linalg.LinAlgError:
        if chosen is None:
            raise ValueError("no solution; a longer series, another lag or another test is needed") from None
        fit = chosen
    return float(fit.tvalues[-1])


def ocsb_differences(y: np.ndarray, m: int, lag_method: str = "aic", max_lag: int = 3) -> int:
    return int(ocsb(y, m, lag_method, max_lag) > ocsb_critical(m))


def should_diff(y: np.ndarray, test: str, alpha: float = 0.05, **kw) -> tuple[float, bool]:
    """(p value, whether to difference)."""
    if len(y) == 0:
        return math.nan, False
    if test == "kpss":
        p = kpss(y, **kw)[1]
        return p, p < alpha
    if test not in ("adf", "pp"):
        raise ValueError(f"{test!r} must be one of adf, kpss, pp")
    p = (adf if test == "adf" else pp)(y, **kw)[1]
    return p, p > alpha


def is_constant(y: np.ndarray) -> bool:
    return len(y) > 0 and bool((y == y[0]).all())


def ndiffs(y: np.ndarray, alpha: float = 0.05, test: str = "kpss", max_d: int = 2, **kw) -> int:
    if max_d <= 0:
        raise ValueError("max_d must be a positive integer")
    if is_constant(y):
        return 0
    d = 0
    try:
        p, again = should_diff(y, test, alpha, **kw)
        if math.isnan(p):
            return 0
        while again and d < max_d:
            d += 1
            y = np.diff(y)
            if is_constant(y):
                return d
            p, again = should_diff(y, test, alpha, **kw)
            if math.isnan(p):
                return d - 1
    except np.linalg.LinAlgError as e:
        raise ValueError(f"the {test} test has no solution for this series; try another test") from e
    return d


def nsdiffs(y: np.ndarray, m: int, max_D: int = 2, test: str = "ocsb", **kw) -> int:
    if max_D <= 0:
        raise ValueError("max_D must be a positive integer")
    tests = {"ch": ch_differences, "ocsb": ocsb_differences}
    if test not in tests:
        raise ValueError(f"{test!r} must be one of ch, ocsb")
    if is_constant(y):
        return 0
    d = 0
    again = tests[test](y, m, **kw)
    while again and d < max_D:
        d += 1
        y = y[m:] - y[:-m]
        if is_constant(y) or len(y) < m:
            return d
        again = tests[test](y, m, **kw)
    return d

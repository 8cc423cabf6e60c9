"""Seasonal ARIMA with regressors by maximum likelihood, as a numpy kernel for one series.

State: d levels, then D rings of s seasonal states of the d-times differenced series, then
the ARMA block in companion form; y = levels + last ring states + first ARMA state. The
differencing states start with mean 0 and variance 1e6 (approximately diffuse) and the first
d + s*D terms of the log likelihood are dropped; the ARMA block starts stationary.

The filter runs over a *batch* of parameter vectors at once, so that a numeric gradient costs
one pass over the series, and stops updating the covariance once it has settled.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np

from tidemark.functions.optimise import METHODS, lbfgs

DIFFUSE = 1e6


@dataclass(frozen=True)
class Order:
    """(p, d, q)(P, D, Q, s). p, q, P, Q are counts or tuples of lags.

    The trend is "n", "c", "t", "ct", or flags of the powers of time from 0 on, as a tuple or as a string of 0 and 1.
    """

    p: int | tuple = 0
    d: int = 0
    q: int | tuple = 0
    P: int | tuple = 0
    D: int = 0
    Q: int | tuple = 0
    s: int = 0
    trend: str | tuple = "n"

    def lags(self, name: str) -> tuple[int, ...]:
        x = getattr(self, name)
        return tuple(range(1, x + 1)) if isinstance(x, int) else tuple(x)

    @property
    def n_diffuse(self) -> int:
        return self.d + self.D * max(self.s, 0)

    @property
    def powers(self) -> tuple[int, ...]:
        """The powers of time (1 at the first row) that the trend has."""
        named = {"n": (), "c": (0,), "t": (1,), "ct": (0, 1)}
        if self.trend in named:
            return named[self.trend]
        flags = [int(x) for x in self.trend]
        if not flags or not {*flags} <= {0, 1}:
            raise ValueError("trend must be n, c, t, ct or flags of powers")
        return tuple(k for k, on in enumerate(flags) if on)

    def differenced(self, x: np.ndarray) -> np.ndarray:
        for _ in range(self.D):
            x = x[self.s :] - x[: -self.s]
        for _ in range(self.d):
            x = np.diff(x, axis=0)
        return x

    def label(self) -> str:
        return f" ARIMA({self.p},{self.d},{self.q})({self.P},{self.D},{self.Q})[{self.s}] " + ("intercept" if 0 in self.powers else "")


def stationary(x: np.ndarray) -> np.ndarray:
    """Free numbers (batch, k) to the coefficients of a stationary autoregression, by partial autocorrelations."""
    r = x / np.sqrt(1 + x**2)
    out = r.copy()
    for k in range(1, x.shape[1]):
        head = out[:, :k] - r[:, k : k + 1] * out[:, k - 1 :: -1][:, :k]
        out = np.concatenate([head, r[:, k:]], axis=1)
        out[:, k] = r[:, k]
    return out


def unstationary(phi: np.ndarray) -> np.ndarray:
    """The inverse of stationary() for one vector; coefficients outside are pulled in first."""
    a, k = phi.astype(float).copy(), len(phi)
    r = np.zeros(k)
    for i in range(k - 1, -1, -1):
        r[i] = np.clip(a[i], -0.97, 0.97)
        if i:
            a = (a[:i] + r[i] * a[:i][::-1]) / (1 - r[i] ** 2)
    return r / np.sqrt(1 - r**2)


class Spec:
    """How a parameter vector is laid out: trend, regression, AR, MA, seasonal AR, seasonal MA, variances of the coefficients and of the measurement, variance.

    With ``mle_regression=False`` the coefficients are states instead, diffuse at the start, which the
    observation row of the time's regressors sees; ``time_varying_regression`` lets them walk. ``measurement_error``
    adds noise to the observation. ``concentrate_scale`` takes the variance out of the search: the start of the
    differencing states scales with it, and the best one follows from the other parameters.
    ``hamilton_representation`` has the ARMA block as lags of an autoregression, seen through the MA weights.
    """

    def __init__(self, order: Order, k_exog: int, enforce_stationarity: bool = True, enforce_invertibility: bool = True, measurement_error: bool = False, concentrate_scale: bool = False, mle_regression: bool = True, time_varying_regression: bool = False, hamilton_representation: bool = False):
        self.order, self.k_exog = order, k_exog
        self.enforce_stationarity, self.enforce_invertibility = enforce_stationarity, enforce_invertibility
        if time_varying_regression and mle_regression:
            raise ValueError("coefficients that vary are states, so mle_regression must be False")
        if hamilton_representation and not {*order.powers} <= {0}:
            raise ValueError("the Hamilton form has no other trend than an intercept")
        self.measurement_error, self.concentrate_scale, self.mle_regression, self.time_varying_regression, self.hamilton_representation = measurement_error, concentrate_scale, mle_regression, time_varying_regression, hamilton_representation
        self.k_moving = 0 if mle_regression else k_exog
        parts = [("c", len(order.powers)), ("x", k_exog - self.k_moving), ("p", len(order.lags("p"))), ("q", len(order.lags("q"))), ("P", len(order.lags("P"))), ("Q", len(order.lags("Q"))), ("w", k_exog * time_varying_regression), ("m", int(measurement_error)), ("v", 1)]
        self.at, k = {}, 0
        for name, n in parts:
            self.at[name] = slice(k, k + n)
            k += n
        self.k = k
        s = max(order.s, 0)
        self.k_ar = max(order.lags("p"), default=0) + s * max(order.lags("P"), default=0)
        self.k_ma = max(order.lags("q"), default=0) + s * max(order.lags("Q"), default=0)
        self.r = max(self.k_ar, self.k_ma + 1, 1)
        self.n_states = order.n_diffuse + self.r + self.k_moving
        #: Rows whose likelihood terms are dropped.
        self.burn = order.n_diffuse + self.k_moving
        #: Parameters that are searched for.
        self.k_free = self.k - concentrate_scale

    #: The options beside the bounds of the coefficients.
    FORMS = ("measurement_error", "concentrate_scale", "mle_regression", "time_varying_regression", "hamilton_representation")

    @property
    def plain(self) -> bool:
        """No other form than the usual one."""
        return self.mle_regression and not any(getattr(self, k) for k in self.FORMS if k != "mle_regression")

    def options(self) -> dict[str, bool]:
        forms = {k: getattr(self, k) for k in self.FORMS if getattr(self, k) != (k == "mle_regression")}
        return {"enforce_stationarity": self.enforce_stationarity, "enforce_invertibility": self.enforce_invertibility} | forms

    def names(self, exog: list[str] | None = None) -> list[str]:
        o = self.order
        s = o.s
        trend = ["intercept" if k == 0 else "drift" if k == 1 else f"trend.{k}" for k in o.powers]
        exog = list(exog or [f"x{i + 1}" for i in range(self.k_exog)])
        noise = [f"var.{x}" for x in exog if self.time_varying_regression] + ["var.measurement_error"] * self.measurement_error
        return trend + exog * self.mle_regression + [f"ar.L{i}" for i in o.lags("p")] + [f"ma.L{i}" for i in o.lags("q")] + [f"ar.S.L{i * s}" for i in o.lags("P")] + [f"ma.S.L{i * s}" for i in o.lags("Q")] + noise + ["sigma2"]

    def _full(self, lags: tuple[int, ...]) -> bool:
        return lags == tuple(range(1, len(lags) + 1))

    def constrain(self, z: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Free vectors (batch, k) to parameters."""
        out = z * scale
        for name, sign, on in (("p", 1, self.enforce_stationarity), ("P", 1, self.enforce_stationarity), ("q", -1, self.enforce_invertibility), ("Q", -1, self.enforce_invertibility)):
            part = self.at[name]
            if on and part.stop > part.start and self._full(self.order.lags(name)):
                out[:, part] = sign * stationary(z[:, part])
        spread = slice(self.at["w"].start, self.k)
        out[:, spread] = np.exp(np.clip(z[:, spread], -60, 60)) * scale[..., spread]
        return out

    def free(self, params: np.ndarray, scale: np.ndarray) -> np.ndarray:
        out = params / scale
        for name, sign, on in (("p", 1, self.enforce_stationarity), ("P", 1, self.enforce_stationarity), ("q", -1, self.enforce_invertibility), ("Q", -1, self.enforce_invertibility)):
            part = self.at[name]
            if on and part.stop > part.start and self._full(self.order.lags(name)):
                out[part] = unstationary(sign * params[part])
        spread = slice(self.at["w"].start, self.k)
        out[spread] = np.log(np.maximum(params[spread] / scale[spread], 1e-20))
        return out

    def polynomials(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """AR (1 - ...) and MA (1 + ...) coefficients after the leading one, (batch, k_ar) and (batch, k_ma)."""
        out = []
        for small, large, sign, n in (("p", "P", -1, self.k_ar), ("q", "Q", 1, self.k_ma)):
            full = np.zeros((len(params), n + 1))
            full[:, 0] = 1
            base = np.zeros_like(full)
            base[:, 0] = 1
            for i, lag in enumerate(self.order.lags(small)):
                base[:, lag] = sign * params[:, self.at[small]][:, i]
            full = base.copy()
            for i, lag in enumerate(self.order.lags(large)):
                shift = lag * self.order.s
                full[:, shift:] += sign * params[:, self.at[large]][:, i : i + 1] * base[:, : n + 1 - shift]
            out.append(full[:, 1:])
        return -out[0], out[1]

    def trend_path(self, params: np.ndarray, first: int, n: int) -> np.ndarray:
        """What the trend adds to the first ARMA state of rows first..first + n - 1, (batch, n)."""
        time = np.arange(first + 1, first + n + 1, dtype=float)
        return params[:, self.at["c"]] @ np.array([time**k for k in self.order.powers]).reshape(-1, n)

    def settled_mean(self, params: np.ndarray, ar: np.ndarray) -> np.ndarray:
        """The mean (B, r) that the ARMA block keeps under the trend of the first row; 0 where an autoregression has none."""
        rest = np.zeros((len(params), self.r))
        rest[:, : self.k_ar] = np.cumsum(ar[:, ::-1], axis=1)[:, ::-1]
        with np.errstate(all="ignore"):
            first = self.trend_path(params, 0, 1)[:, 0] / (1 - ar.sum(1))
        first = np.where(np.isfinite(first), first, 0)
        rest[:, 1:] *= first[:, None]
        rest[:, 0] = first
        return rest

    def observation(self) -> np.ndarray:
        """The states that add up to a row: levels, ends of the seasonal rings, the first ARMA state."""
        z = np.zeros(self.n_states)
        z[: self.order.d] = 1
        z[[self.order.d + (i + 1) * self.order.s - 1 for i in range(self.order.D)]] = 1
        z[self.order.n_diffuse] = 1
        return z

    def _block(self, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Transition (B, r, r), noise column (B, r) and observation row (B, r) of the ARMA block."""
        b, r = len(ar), self.r
        t, noise, seen = np.zeros((b, r, r)), np.zeros((b, r)), np.zeros((b, r))
        noise[:, 0] = seen[:, 0] = 1
        if self.hamilton_representation:
            t[:, 0, : self.k_ar] = ar
            t[:, range(1, r), range(r - 1)] = 1
            seen[:, 1 : 1 + self.k_ma] = ma
        else:
            t[:, : self.k_ar, 0] = ar
            t[:, range(r - 1), range(1, r)] = 1
            noise[:, 1 : 1 + self.k_ma] = ma
        return t, noise, seen

    def system(self, params: np.ndarray):
        """Transition (B, n, n), noise column (B, n), observation row (n), start mean and covariance, variance."""
        b, o, n, r = len(params), self.order, self.n_states, self.r
        ar, ma = self.polynomials(params)
        k, s, base, end = o.d, o.s, o.n_diffuse, o.n_diffuse + r
        t, z = np.zeros((b, n, n)), np.broadcast_to(self.observation(), (b, n)).copy()
        block, column, seen = self._block(ar, ma)
        ring_ends = [k + (i + 1) * s - 1 for i in range(o.D)]
        for i in range(k):
            t[:, i, i:k] = 1
            t[:, i, ring_ends] = 1
            t[:, i, base:end] = seen
        for i in range(o.D):
            first = k + i * s
            t[:, first, ring_ends[i:]] = 1
            t[:, first, base:end] = seen
            for j in range(1, s):
                t[:, first + j, first + j - 1] = 1
        t[:, base:end, base:end] = block
        t[:, range(end, n), range(end, n)] = 1
        z[:, base:end] = seen
        noise = np.zeros((b, n))
        noise[:, base:end] = column
        v = params[:, self.at["v"]][:, 0]
        a0 = np.zeros((b, n))
        p0 = np.zeros((b, n, n))
        diffuse = [*range(base), *range(end, n)]
        p0[:, diffuse, diffuse] = DIFFUSE * (v[:, None] if self.concentrate_scale else 1)
        p0[:, base:end, base:end] = lyapunov(block, column[:, :, None] * column[:, None, :] * v[:, None, None])
        if o.powers:
            path = self.input_path(params, 0, 1)[:, 0]
            if self.hamilton_representation:
                with np.errstate(all="ignore"):
                    mean = path / (1 - ar.sum(1))
                a0[:, base:end] = np.where(np.isfinite(mean), mean, 0)[:, None]
            else:
                a0[:, base:end] = self.settled_mean(params, ar)
        return t, noise, z, a0, p0, v

    def input_path(self, params: np.ndarray, first: int, n: int) -> np.ndarray:
        """What the trend adds to the block's first state: in the Hamilton form the MA weights are still to come."""
        path = self.trend_path(params, first, n)
        if self.hamilton_representation and self.order.powers:
            path = path / (1 + self.polynomials(params)[1].sum(1))[:, None]
        return path

    def state_noise(self, params: np.ndarray, noise: np.ndarray, v: np.ndarray) -> np.ndarray:
        q = noise[:, :, None] * noise[:, None, :] * v[:, None, None]
        if self.time_varying_regression:
            moving = range(self.n_states - self.k_moving, self.n_states)
            q[:, moving, moving] += params[:, self.at["w"]] * (v[:, None] if self.concentrate_scale else 1)
        return q

    def measured(self, params: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The variance of the observation's own noise (B,)."""
        return params[:, self.at["m"]][:, 0] * (v if self.concentrate_scale else 1) if self.measurement_error else np.zeros(len(params))


def lyapunov(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P = T P T' + Q for a batch, by doubling; those without a solution are approximately diffuse and leave the others alone."""
    p, left, a = q.copy(), np.arange(len(t)), t.copy()
    with np.errstate(all="ignore"):
        for _ in range(40):
            step = a @ p[left] @ a.transpose(0, 2, 1)
            p[left] += step
            more = ~(np.abs(step).max((1, 2)) <= 1e-12 * np.abs(p[left]).max((1, 2))) & np.isfinite(step).all((1, 2))
            left, a = left[more], a[more]
            if not len(left):
                break
            a = a @ a
    p[~np.isfinite(p).all((1, 2))] = DIFFUSE * np.eye(t.shape[1])
    return p


@dataclass
class Filtered:
    """What a pass of the filter leaves: log likelihood terms (B, n), prediction errors, fitted values, last prediction."""

    terms: np.ndarray
    errors: np.ndarray
    variances: np.ndarray
    mean: np.ndarray
    cov: np.ndarray


def _widths(spec: Spec, y: np.ndarray, exog: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Start variances (B, k) of the coefficients that are states: DIFFUSE in units of what a coefficient may be."""
    seen = ~np.isnan(y)
    power = (exog[seen] ** 2).sum(0)
    units = np.divide((y[seen] ** 2).sum(), power, out=np.ones(spec.k_moving), where=power > 0)
    units = np.where(np.isfinite(units) & (units > 0), units, 1)
    return DIFFUSE * units * (v[:, None] if spec.concentrate_scale else np.ones((len(v), 1)))


def _without_start(a: np.ndarray, p: np.ndarray, across: np.ndarray, mean: np.ndarray, cov: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the states without the start N(0, widths) of the coefficients, if the rows determine them.

    across (B, n, k) is the covariance of the states with the coefficients at the start, whose own mean and covariance follow.
    """
    size = np.sqrt(widths)
    left = np.eye(widths.shape[1]) - cov / size[:, :, None] / size[:, None, :]
    across, mean = across / size[:, None, :], mean / size[:, :]
    a, p = a.copy(), p.copy()
    for i in range(len(a)):
        if np.isfinite(left[i]).all() and np.linalg.eigvalsh(left[i]).min() > 1e-6:
            a[i] += across[i] @ np.linalg.solve(left[i], mean[i])
            p[i] += across[i] @ np.linalg.solve(left[i], across[i].T)
    return a, p


def kalman(spec: Spec, params: np.ndarray, y: np.ndarray, exog: np.ndarray | None, begin: tuple[np.ndarray, np.ndarray, int] | None = None) -> Filtered:
    """Filter y for each parameter vector of a batch; a missing value (NaN) is skipped.

    ``begin`` goes on after earlier rows: their last prediction (mean, covariance) and their number.
    The last prediction owes nothing to the start of coefficients that are states, as soon as the rows determine them.
    """
    t, noise, z, a, p, v = spec.system(params)
    b, n = len(params), len(y)
    first = 0
    tracked = spec.k_moving > 0 and begin is None
    if tracked:
        widths, moving = _widths(spec, y, exog, v), np.arange(spec.n_states - spec.k_moving, spec.n_states)
        p[:, moving, moving] = widths
        # The coefficients at the start, given the rows so far, and their covariance with the states.
        across, start_mean, start_cov = p[:, :, moving].copy(), np.zeros((b, spec.k_moving)), p[:, moving[:, None], moving].copy()
    if begin is not None:
        a, p, first = np.broadcast_to(begin[0], a.shape).copy(), np.broadcast_to(begin[1], p.shape).copy(), begin[2]
    base, path = spec.order.n_diffuse, spec.input_path(params, first, n + 1)
    q, own = spec.state_noise(params, noise, v), spec.measured(params, v)
    obs = np.broadcast_to(y, (b, n))
    if spec.k_exog and spec.mle_regression:
        obs = obs - params[:, spec.at["x"]] @ exog.T
    terms, errors, variances = np.zeros((b, n)), np.zeros((b, n)), np.zeros((b, n))
    settled = False
    missing = np.isnan(y)
    tt = t.transpose(0, 2, 1)
    gain = f = None
    with np.errstate(all="ignore"):
        for i in range(n):
            if spec.k_moving:
                z[:, -spec.k_moving :] = exog[i]
                settled = False
            if not settled:
                pz = (p @ z[:, :, None])[:, :, 0]
                f = (pz * z).sum(1) + own
            e = obs[:, i] - (a * z).sum(1)
            variances[:, i] = f
            if missing[i]:
                errors[:, i] = np.nan
                if tracked:
                    across = t @ across
                a = np.einsum("bij,bj->bi", t, a)
                a[:, base] += path[:, i + 1]
                p = t @ p @ tt + q
                settled = False
                continue
            errors[:, i] = e
            terms[:, i] = -0.5 * (np.log(2 * np.pi * f) + e * e / f)
            if not settled:
                gain = np.einsum("bij,bj->bi", t, pz) / f[:, None]
                new = t @ p @ tt + q - gain[:, :, None] * gain[:, None, :] * f[:, None, None]
                if first + i > spec.burn and i % 4 == 0 and not missing[i:].any():
                    settled = bool(np.abs(new - p).max(axis=(1, 2)).max() <= 1e-9 * np.abs(new).max() * 1e-3)
                p = new
            if tracked:
                told = np.einsum("bnk,bn->bk", across, z)
                start_mean += told * (e / f)[:, None]
                start_cov -= told[:, :, None] * told[:, None, :] / f[:, None, None]
                across = t @ across - gain[:, :, None] * told[:, None, :]
            a = np.einsum("bij,bj->bi", t, a) + gain * e[:, None]
            a[:, base] += path[:, i + 1]
        if tracked:
            a, p = _without_start(a, p, across, start_mean, start_cov, widths)
    terms[:, : max(0, spec.burn - first)] = 0
    return Filtered(terms, errors, variances, a, p)


@dataclass
class Fit:
    """A fitted model of one series."""

    spec: Spec
    params: np.ndarray
    y: np.ndarray
    exog: np.ndarray | None
    filtered: Filtered
    converged: bool
    fit_time: float
    method: str = "lbfgs"
    #: Standard errors, where the fit has found them already.
    errors: np.ndarray | None = None

    @property
    def basis(self) -> tuple[Spec, np.ndarray, np.ndarray | None]:
        """What the filter runs over."""
        return self.spec, self.y, self.exog

    def options(self) -> dict[str, bool]:
        """The state-space options that a refit has to keep."""
        return self.spec.options()

    @property
    def order(self) -> Order:
        return self.spec.order

    @property
    def llf(self) -> float:
        return float(self.filtered.terms[0].sum())

    @property
    def nobs(self) -> int:
        return len(self.y)

    @property
    def nobs_effective(self) -> int:
        return self.nobs - self.spec.burn

    def criteria(self) -> dict[str, float]:
        """aic, aicc, bic, hqic: aicc counts all rows, bic and hqic those after the differencing."""
        k, n, ne = self.spec.k_free, self.nobs, max(self.nobs_effective, 2)
        aic = -2 * self.llf + 2 * k
        aicc = aic + 2 * k * (n / (n - k - 1) - 1) if n > k + 1 else math.inf
        return {"aic": aic, "aicc": aicc, "bic": -2 * self.llf + k * math.log(ne), "hqic": -2 * self.llf + 2 * k * math.log(math.log(ne)) if ne > 2 else math.nan}

    def residuals(self) -> np.ndarray:
        return self.filtered.errors[0]

    def fitted(self) -> np.ndarray:
        return self.y - self.residuals()

    def bse(self) -> np.ndarray:
        """Standard errors by the outer product of the score, from central differences."""
        if self.errors is not None:
            return self.errors
        h = 1e-6 * np.maximum(np.abs(self.params), 1e-2)
        steps = np.diag(h)
        spec, y, exog = self.basis
        f = kalman(spec, np.concatenate([self.params + steps, self.params - steps]), y, exog)
        k = len(h)
        scores = (f.terms[:k] - f.terms[k:]) / (2 * h[:, None])
        free = self.spec.k_free
        info = scores[:free] @ scores[:free].T
        try:
            return np.append(np.sqrt(np.maximum(np.diag(np.linalg.inv(info)), 0)), [np.nan] * (k - free))
        except np.linalg.LinAlgError:
            return np.full(k, np.nan)

    def pvalues(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            z = np.abs(self.params / self.bse())
        return np.array([2 * (1 - NormalDist().cdf(x)) if math.isfinite(x) else math.nan for x in z])

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        ar, ma = self.spec.polynomials(self.params[None])
        find = lambda x: np.roots(np.concatenate([x[::-1], [1.0]])) if len(x) else np.empty(0)
        return find(np.trim_zeros(-ar[0], "b")), find(np.trim_zeros(ma[0], "b"))

    def forecast(self, steps: int, exog: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Means and standard errors."""
        if self.spec.k_exog and (exog is None or len(exog) != steps):
            raise ValueError("the model was fitted with exogenous columns, so a forecast needs as many rows of them as periods")
        t, noise, z, _, _, v = self.spec.system(self.params[None])
        base, path = self.spec.order.n_diffuse, self.spec.input_path(self.params[None], self.nobs + 1, steps)[0]
        a, p, z = self.filtered.mean[0], self.filtered.cov[0], z[0]
        q, own = self.spec.state_noise(self.params[None], noise, v)[0], self.spec.measured(self.params[None], v)[0]
        mean, var = np.empty(steps), np.empty(steps)
        for h in range(steps):
            if self.spec.k_moving:
                z[-self.spec.k_moving :] = exog[h]
            mean[h], var[h] = a @ z, z @ p @ z + own
            a, p = t[0] @ a, t[0] @ p @ t[0].T + q
            a[base] += path[h]
        if self.spec.k_exog and self.spec.mle_regression:
            mean = mean + exog @ self.params[self.spec.at["x"]]
        return mean, np.sqrt(np.maximum(var, 0))

    def in_sample(self, start: int = 0, end: int | None = None, dynamic: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of rows start..end (inclusive); dynamic: forecasts from start on."""
        end = self.nobs - 1 if end is None else end
        if dynamic:
            cut = Fit(self.spec, self.params, self.y[:start], None if self.exog is None else self.exog[:start], kalman(self.spec, self.params[None], self.y[:start], None if self.exog is None else self.exog[:start]), True, 0.0)
            return cut.forecast(end - start + 1, None if self.exog is None else self.exog[start : end + 1])
        mean, se = self.fitted(), np.sqrt(self.filtered.variances[0])
        return mean[start : end + 1], se[start : end + 1]


class DifferencedFit(Fit):
    """A model of the rows after the differencing (simple_differencing), with forecasts on the scale of y.

    ``filtered`` is of the differenced rows; residuals of the first d + s * D rows are NaN, and the information
    criteria count the differenced rows only.
    """

    @property
    def basis(self) -> tuple[Spec, np.ndarray, np.ndarray | None]:
        o = self.spec.order
        inner = Spec(replace(o, d=0, D=0), self.spec.k_exog, **self.spec.options())
        return inner, o.differenced(self.y), None if self.exog is None else o.differenced(self.exog)

    def options(self) -> dict[str, bool]:
        return super().options() | {"simple_differencing": True}

    def inner(self) -> Fit:
        spec, w, x = self.basis
        return Fit(spec, self.params, w, x, self.filtered, self.converged, self.fit_time, self.method)

    def criteria(self) -> dict[str, float]:
        return self.inner().criteria()

    def residuals(self) -> np.ndarray:
        return np.concatenate([np.full(self.spec.order.n_diffuse, np.nan), self.filtered.errors[0]])

    def forecast(self, steps: int, exog: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        o, k = self.spec.order, self.spec.order.n_diffuse
        if self.spec.k_exog and (exog is None or len(exog) != steps):
            raise ValueError("the model was fitted with exogenous columns, so a forecast needs as many rows of them as periods")
        x = None if self.exog is None else o.differenced(np.concatenate([self.exog[self.nobs - k :], exog]))
        change, _ = self.inner().forecast(steps, x)
        # (1 - B)^d (1 - B^s)^D as one polynomial: what is not its leading 1 leads from changes to levels.
        poly = np.ones(1)
        for _ in range(o.d):
            poly = np.convolve(poly, [1.0, -1.0])
        for _ in range(o.D):
            poly = np.convolve(poly, [1.0, *[0.0] * (o.s - 1), -1.0])
        level = list(self.y[self.nobs - k :])
        for c in change:
            level.append(c - poly[1:] @ np.array(level[::-1][:k]))
        ar, ma = self.spec.polynomials(self.params[None])
        whole = np.convolve(np.concatenate([[1.0], -ar[0]]), poly)
        psi = np.concatenate([[1.0], arma_to_ma(-whole[1:], ma[0], steps)])[:steps]
        return np.array(level[k:]), np.sqrt(self.params[-1] * np.cumsum(psi**2))

    def in_sample(self, start: int = 0, end: int | None = None, dynamic: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if dynamic:
            if start <= self.spec.order.n_diffuse:
                raise ValueError("a dynamic prediction starts after the rows that the differencing takes")
            cut = DifferencedFit(self.spec, self.params, self.y[:start], None if self.exog is None else self.exog[:start], self.filtered, True, 0.0)
            spec, w, x = cut.basis
            cut.filtered = kalman(spec, self.params[None], w, x)
            end = self.nobs - 1 if end is None else end
            return cut.forecast(end - start + 1, None if self.exog is None else self.exog[start : end + 1])
        se = np.concatenate([np.full(self.spec.order.n_diffuse, np.nan), np.sqrt(self.filtered.variances[0])])
        end = self.nobs - 1 if end is None else end
        return self.fitted()[start : end + 1], se[start : end + 1]


def start_params(spec: Spec, y: np.ndarray, exog: np.ndarray | None) -> np.ndarray:
    """Regression by least squares on the differenced rows, then Hannan-Rissanen for the ARMA part."""
    o = spec.order
    out = np.zeros(spec.k)

    w = o.differenced(y)
    w = np.where(np.isnan(w), np.nanmean(w) if np.isfinite(w).any() else 0.0, w)
    time = np.arange(o.n_diffuse + 1, len(y) + 1, dtype=float)
    trend = np.array([time**k for k in o.powers]).reshape(-1, len(time)).T
    beta = np.zeros(0)
    centred = w
    if spec.k_exog or len(o.powers):
        design = np.column_stack([trend, o.differenced(exog)]) if spec.k_exog else trend
        size = np.maximum(np.abs(design).max(0, initial=0), 1e-300)
        beta = np.linalg.lstsq(design / size, w, rcond=None)[0] / size
        if spec.mle_regression:
            out[spec.at["x"]] = beta[len(o.powers) :]
        centred = w - design @ beta
    lag_sets = [("p", o.lags("p")), ("P", tuple(i * o.s for i in o.lags("P")))]
    ma_sets = [("q", o.lags("q")), ("Q", tuple(i * o.s for i in o.lags("Q")))]
    longest = max([0, *(x for _, ls in lag_sets + ma_sets for x in ls)])
    resid = centred
    if any(ls for _, ls in ma_sets):
        k = min(max(longest + 1, 2 * max(spec.k_ma, 1)), max(0, len(centred) // 3))
        if k:
            x = np.column_stack([centred[k - i : len(centred) - i] for i in range(1, k + 1)])
            fit = np.linalg.lstsq(x, centred[k:], rcond=None)[0]
            resid = np.concatenate([np.zeros(k), centred[k:] - x @ fit])
    if longest and len(centred) > 2 * longest + 2:
        columns, where = [], []
        for name, ls in lag_sets:
            for i, lag in enumerate(ls):
                columns.append(centred[longest - lag : len(centred) - lag])
                where.append(spec.at[name].start + i)
        for name, ls in ma_sets:
            for i, lag in enumerate(ls):
                columns.append(resid[longest - lag : len(resid) - lag])
                where.append(spec.at[name].start + i)
        x = np.column_stack(columns)
        fit = np.linalg.lstsq(x, centred[longest:], rcond=None)[0]
        out[where] = np.clip(np.nan_to_num(fit), -0.9, 0.9)
        resid = centred[longest:] - x @ fit
    ar, _ = spec.polynomials(out[None])
    out[spec.at["c"]] = beta[: len(o.powers)] * (1 - ar[0].sum())
    out[spec.at["v"]] = max(float(np.mean(resid**2)) if len(resid) else 1.0, 1e-10)
    # Noise of the measurement starts at a third of the variance, steps of a coefficient at what moves the rows by a tenth of it over the series.
    share = 1.0 if spec.concentrate_scale else out[-1]
    out[spec.at["m"]] = share / 3
    if spec.time_varying_regression:
        out[spec.at["w"]] = 0.1 * share / np.maximum((exog**2).mean(0) * len(y), 1e-12)
    return out


def fit(y: np.ndarray, order: Order, exog: np.ndarray | None = None, method: str = "lbfgs", maxiter: int = 50, start: np.ndarray | None = None, simple_differencing: bool = False, **flags) -> Fit:
    """Maximum likelihood. ValueError for impossible orders or a likelihood that is not finite."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}")
    if maxiter is None:
        raise ValueError("maxiter must be a positive integer")
    began = time.perf_counter()
    y = np.asarray(y, float)
    exog = None if exog is None or exog.shape[1] == 0 else np.asarray(exog, float)
    spec = Spec(order, 0 if exog is None else exog.shape[1], **flags)
    if len(y) <= order.n_diffuse:
        raise ValueError("the series is shorter than the differencing needs")
    if simple_differencing:
        inner = fit(order.differenced(y), replace(order, d=0, D=0), None if exog is None else order.differenced(exog), method, maxiter, start, **flags)
        return DifferencedFit(spec, inner.params, y, exog, inner.filtered, inner.converged, inner.fit_time, method)
    params = start_params(spec, y, exog) if start is None else np.asarray(start, float)
    scale = np.ones(spec.k)
    spread = slice(spec.at["w"].start, spec.k)
    scale[spread] = np.maximum(params[spread], 1e-10)
    scale[spec.at["c"]] = [max(np.sqrt(scale[-1]), 1e-8) / float(len(y)) ** k for k in order.powers]
    if spec.k_exog and spec.mle_regression:
        scale[spec.at["x"]] = np.maximum(np.sqrt(scale[-1]) / np.maximum(exog.std(0), 1e-8), 1e-8)

    def whole(z: np.ndarray) -> np.ndarray:
        """Parameter vectors of points of the search; a variance that is not searched for follows from the errors."""
        if not spec.concentrate_scale:
            return spec.constrain(z, scale)
        full = spec.constrain(np.column_stack([z, np.zeros(len(z))]), scale)
        full[:, -1] = 1
        f = kalman(spec, full, y, exog)
        with np.errstate(all="ignore"):
            full[:, -1] = np.nanmean(f.errors[:, spec.burn :] ** 2 / f.variances[:, spec.burn :], axis=1)
        return full

    def terms(z: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return -kalman(spec, whole(z), y, exog).terms / len(y)

    def cost(z: np.ndarray) -> np.ndarray:
        v = terms(z).sum(1)
        return np.where(np.isfinite(v), v, 1e10)

    z = spec.free(params, scale)[: spec.k_free]
    if start is None and spec.at["p"].start < spec.at["v"].start:
        # A likelihood has several hills: the search starts from the best of three points.
        starts = np.array([z * np.where(np.arange(len(z)) < spec.at["p"].start, 1.0, f) for f in (1.0, 0.5, 0.1)])
        z = starts[np.argmin(cost(starts))]
    z, value, ok = METHODS[method](cost, z, maxiter, **({"terms": terms} if METHODS[method] is lbfgs else {}))
    params = whole(z[None])
    if value >= 1e10:
        raise ValueError("the likelihood is not finite")
    return Fit(spec, params[0], y, exog, kalman(spec, params, y, exog), ok, time.perf_counter() - began, method)


def at_params(y: np.ndarray, order: Order, exog: np.ndarray | None, params: np.ndarray, converged: bool = True, fit_time: float = 0.0, method: str = "lbfgs", simple_differencing: bool = False, **flags) -> Fit:
    """The Fit of known parameters."""
    spec = Spec(order, 0 if exog is None else exog.shape[1], **flags)
    made = (DifferencedFit if simple_differencing else Fit)(spec, np.asarray(params, float), y, exog, None, converged, fit_time, method)
    inner, w, x = made.basis
    made.filtered = kalman(inner, made.params[None], w, x)
    return made


def embedded(small, order: Order, k_exog: int, **flags) -> np.ndarray | None:
    """The parameters of a fit (or an outcome: its order and parameters) as those of a larger order (new ones are 0), or None if the order isn't larger."""
    o, spec = small.order, Spec(order, k_exog, **flags)
    mine_at = Spec(o, k_exog, **flags).at
    if (o.d, o.D) != (order.d, order.D) or not {*o.powers} <= {*order.powers} or any(not {*o.lags(n)} <= {*order.lags(n)} for n in "pqPQ") or (o.s != order.s and (o.lags("P") or o.lags("Q"))):
        return None
    out = np.zeros(spec.k)
    for name, mine, theirs in (("c", o.powers, order.powers), *((n, o.lags(n), order.lags(n)) for n in "pqPQ")):
        for i, lag in enumerate(mine):
            out[spec.at[name].start + theirs.index(lag)] = small.params[mine_at[name].start + i]
    out[spec.at["x"]] = small.params[mine_at["x"]]
    for name in "wmv":
        out[spec.at[name]] = small.params[mine_at[name]]
    return out


def arma_to_ma(ar: np.ndarray, ma: np.ndarray, max_deg: int) -> np.ndarray:
    """The first max_deg weights of the infinite moving average."""
    psi = np.zeros(max_deg)
    for i in range(max_deg):
        psi[i] = (ma[i] if i < len(ma) else 0.0) + sum(ar[j] * (psi[i - j - 1] if i > j else 1.0) for j in range(min(i + 1, len(ar))))
    return psi


def pacf(y: np.ndarray, nlags: int, method: str = "ywadjusted") -> np.ndarray:
    """Partial autocorrelations by Durbin-Levinson (yw..., ld...) or by regressions (ols)."""
    n = len(y)
    d = y - y.mean()
    if method == "ols":
        out = [1.0]
        for k in range(1, nlags + 1):
            x = np.column_stack([np.ones(n - nlags), *(y[nlags - i : n - i] for i in range(1, k + 1))])
            out.append(float(np.linalg.lstsq(x, y[nlags:], rcond=None)[0][-1]))
        return np.array(out)
    if method not in ("yw", "ywadjusted", "ywa", "ywm", "ywmle", "ld", "lda", "ldadjusted", "ldb", "ldbiased"):
        raise ValueError(f"{method!r} is not a method of the partial autocorrelation")
    adjusted = method in ("yw", "ywadjusted", "ywa", "ld", "lda", "ldadjusted")
    cov = np.array([d[k:] @ d[: n - k] / (n - k if adjusted else n) for k in range(nlags + 1)])
    phi, out, v = np.zeros(nlags + 1), [1.0], cov[0]
    for k in range(1, nlags + 1):
        a = (cov[k] - phi[1:k] @ cov[k - 1 : 0 : -1]) / v
        phi[1:k] = phi[1:k] - a * phi[k - 1 : 0 : -1]
        phi[k] = a
        v *= 1 - a * a
        out.append(float(a))
    return np.array(out)

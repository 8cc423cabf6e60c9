"""Small numeric optimisers on numpy: quasi-Newton, Newton, conjugate and direct searches, bounded search, least squares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def bounded_minimum(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-8) -> float:
    """Golden-section search."""
    ratio = (5**0.5 - 1) / 2
    a, b = low, high
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    fx, fy = f(x), f(y)
    while b - a > tolerance:
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - ratio * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + ratio * (b - a)
            fy = f(y)
    return (a + b) / 2


def lbfgs(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int = 50, memory: int = 10, tolerance: float = 1e-5, terms: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, float, bool]:
    """Minimise with limited-memory BFGS. ``many`` values a whole batch of points at once, so a
    central-difference gradient is one call; returns (x, value, converged).

    ``terms`` gives the summands (batch, n) whose sum is the value of a negative log likelihood: the outer product of
    their gradients then stands for the first curvature, which ill-scaled likelihoods need.
    """
    k = len(x)

    def with_gradient(z: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal curvature
        h = 1e-5 * np.maximum(1.0, np.abs(z))
        steps = np.diag(h)
        points = np.concatenate([z[None], z + steps, z - steps])
        if terms is None:
            v = many(points)
            return float(v[0]), (v[1 : k + 1] - v[k + 1 :]) / (2 * h)
        v = terms(points)
        slopes = (v[1 : k + 1] - v[k + 1 :]) / (2 * h[:, None])
        outer = slopes @ slopes.T * v.shape[1]
        curvature = outer + np.diag(1e-4 * np.diag(outer) + 1e-10) if np.isfinite(outer).all() else None
        return float(v[0].sum()), slopes.sum(1)

    curvature: np.ndarray | None = None

    if k == 0:
        return x, float(many(x[None])[0]), True
    value, g = with_gradient(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    small = 0
    for _ in range(maxiter):
        if not np.isfinite(value) or np.abs(g).max() < tolerance:
            return x, value, bool(np.isfinite(value))
        q = g.copy()
        alphas = []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if curvature is not None:
            q = np.linalg.solve(curvature, q)
        elif s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        else:
            q /= max(1.0, float(np.abs(g).max()))
        for s, y, a in zip(s_list, y_list, reversed(alphas), strict=True):
            q += s * (a - y @ q / (y @ s))
        slope = -(g @ q)
        if slope >= 0:
            q, slope = g.copy(), -(g @ g)
            s_list, y_list = [], []
        # The whole step, or the first of many shorter ones (one batch) that decreases enough.
        old_value, old_curvature = value, curvature
        new = x - q
        new_value, g_new = with_gradient(new)
        if not (np.isfinite(new_value) and np.isfinite(g_new).all() and new_value <= value + 1e-4 * slope):
            lengths = 0.5 ** np.arange(1, 13)
            values = many(x - lengths[:, None] * q)
            good = np.flatnonzero(np.isfinite(values) & (values <= value + 1e-4 * lengths * slope))
            curvature = old_curvature
            if len(good):
                new = x - lengths[good[0]] * q
                new_value, g_new = with_gradient(new)
        else:
            good = [0]
        if not len(good) and s_list:
            # The curvature misleads: start again along the gradient.
            s_list, y_list = [], []
            continue
        if not len(good):
            return x, value, bool(np.abs(g).max() < 1e-3)
        value = new_value
        s, y = new - x, g_new - g
        if y @ s > 1e-12:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        x, g = new, g_new
        # One small step may be a bad direction: two in a row end the search.
        small = small + 1 if abs(old_value - value) < 1e-9 * max(1.0, abs(value)) else 0
        if small == 2:
            return x, value, bool(np.abs(g).max() < 1e-3)
    return x, value, bool(np.abs(g).max() < tolerance)


def nelder_mead(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int = 50) -> tuple[np.ndarray, float, bool]:
    """Downhill simplex; the start simplex is valued as one batch."""
    k = len(x)
    points = np.concatenate([x[None], x + np.diag(np.where(x != 0, 0.05 * x, 0.00025))])
    values = many(points)
    one = lambda z: float(many(z[None])[0])
    for _ in range(maxiter * max(1, k)):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if np.abs(values[-1] - values[0]) < 1e-8 and np.abs(points[-1] - points[0]).max() < 1e-6:
            return points[0], float(values[0]), True
        centre = points[:-1].mean(0)
        mirror = 2 * centre - points[-1]
        v = one(mirror)
        if v < values[0]:
            far = 3 * centre - 2 * points[-1]
            w = one(far)
            points[-1], values[-1] = (far, w) if w < v else (mirror, v)
        elif v < values[-2]:
            points[-1], values[-1] = mirror, v
        else:
            near = (centre + (mirror if v < values[-1] else points[-1])) / 2
            w = one(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = many(points[1:])
    best = int(np.argmin(values))
    return points[best], float(values[best]), False


class _Slopes:
    """Values, central-difference gradients and curvatures of a function that values whole batches of points."""

    def __init__(self, many: Callable[[np.ndarray], np.ndarray]):
        self.many = many

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        h = 1e-5 * np.maximum(1.0, np.abs(x))
        steps = np.diag(h)
        v = self.many(np.concatenate([x[None], x + steps, x - steps]))
        k = len(x)
        return float(v[0]), (v[1 : k + 1] - v[k + 1 :]) / (2 * h)

    def curvature(self, x: np.ndarray) -> np.ndarray:
        """The Hessian by second differences, in one batch."""
        k, h = len(x), 1e-4 * np.maximum(1.0, np.abs(x))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        e = np.diag(h)
        corners = np.concatenate([[x + e[i] + e[j], x + e[i] - e[j], x - e[i] + e[j], x - e[i] - e[j]] for i, j in pairs])
        v = self.many(corners).reshape(-1, 4)
        out = np.empty((k, k))
        for (i, j), (pp, pm, mp, mm) in zip(pairs, v, strict=True):
            out[i, j] = out[j, i] = (pp - pm - mp + mm) / (4 * h[i] * h[j])
        return out

    def along(self, x: np.ndarray, value: float, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, float] | None:
        """A point along d that decreases enough: the longest of many steps, all valued as one batch."""
        slope = float(g @ d)
        if not slope < 0:
            return None
        lengths = 2.0 ** np.arange(2, -16, -1)
        v = self.many(x + lengths[:, None] * d)
        good = np.isfinite(v) & (v <= value + 1e-4 * lengths * slope)
        if not good.any():
            return None
        best = int(np.argmin(np.where(good, v, np.inf)))
        return x + lengths[best] * d, float(v[best])


def _descend(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int, direction: Callable, tolerance: float = 1e-5) -> tuple[np.ndarray, float, bool]:
    """Line searches along ``direction(slopes, x, g, memory)``; downhill where that does not lead down."""
    slopes, memory, small = _Slopes(many), {}, 0
    value, g = slopes(x)
    for _ in range(maxiter if len(x) else 0):
        if not np.isfinite(value) or np.abs(g).max() < tolerance:
            break
        found = slopes.along(x, value, g, direction(slopes, x, g, memory))
        if found is None:
            memory.clear()
            found = slopes.along(x, value, g, -g / max(1.0, float(np.abs(g).max())))
            if found is None:
                break
        new, _ = found
        old = value
        value, g_new = slopes(new)
        memory["s"], memory["y"], memory["g"] = new - x, g_new - g, g
        x, g = new, g_new
        small = small + 1 if abs(old - value) < 1e-10 * max(1.0, abs(value)) else 0
        if small == 3:
            break
    return x, value, bool(np.isfinite(value) and (not len(x) or np.abs(g).max() < 1e-3))


def bfgs(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int = 50) -> tuple[np.ndarray, float, bool]:
    """The whole inverse curvature, updated by each step."""

    def direction(slopes, x, g, memory):
        inverse = memory.setdefault("inverse", np.eye(len(x)))
        if "s" in memory and (sy := float(memory["s"] @ memory["y"])) > 1e-12:
            s, y = memory["s"], memory["y"]
            if memory.setdefault("first", True):
                inverse, memory["first"] = np.eye(len(x)) * sy / (y @ y), False
            left = np.eye(len(x)) - np.outer(s, y) / sy
            inverse = memory["inverse"] = left @ inverse @ left.T + np.outer(s, s) / sy
        return -inverse @ g

    return _descend(many, x, maxiter, direction)


def conjugate_gradient(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int = 50) -> tuple[np.ndarray, float, bool]:
    """Polak and Ribiere's directions, never with a negative share of the last one. A step costs little, so there are more of them."""

    def direction(slopes, x, g, memory):
        d = -g
        if "d" in memory and "y" in memory:
            d = d + max(0.0, float(g @ memory["y"]) / max(float(memory["g"] @ memory["g"]), 1e-300)) * memory["d"]
        memory["d"] = d
        return d / max(1.0, float(np.abs(d).max()))

    return _descend(many, x, 6 * maxiter, direction)


def newton(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int = 50) -> tuple[np.ndarray, float, bool]:
    """Newton's steps, with negative or small curvatures turned up."""

    def direction(slopes, x, g, memory):
        h = slopes.curvature(x)
        if not np.isfinite(h).all():
            return -g
        w, v = np.linalg.eigh(h)
        return -v @ ((v.T @ g) / np.maximum(np.abs(w), 1e-8 * max(float(np.abs(w).max()), 1e-8)))

    return _descend(many, x, maxiter, direction)


def newton_cg(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int = 50) -> tuple[np.ndarray, float, bool]:
    """Newton's equation solved by conjugate gradients, cut off at negative curvature; products with the curvature are differences of gradients."""

    def direction(slopes, x, g, memory):
        d, r = np.zeros_like(x), -g
        p, enough = r.copy(), min(0.5, float(np.sqrt(np.linalg.norm(g)))) * float(np.linalg.norm(g))
        for _ in range(2 * len(x)):
            h = 1e-4 / max(float(np.linalg.norm(p)), 1e-12)
            hp = (slopes(x + h * p)[1] - slopes(x - h * p)[1]) / (2 * h)
            bend = float(p @ hp)
            if not bend > 1e-12 * float(p @ p):
                return d if d.any() else -g
            a = float(r @ r) / bend
            d, new = d + a * p, r - a * hp
            if np.linalg.norm(new) < enough:
                break
            p, r = new + float(new @ new) / float(r @ r) * p, new
        return d

    return _descend(many, x, maxiter, direction)


def powell(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int = 50) -> tuple[np.ndarray, float, bool]:
    """Line minima along a set of directions, in which the whole step replaces the one that gained most. No gradients."""
    k = len(x)
    directions, value = np.eye(k), float(many(x[None])[0])

    def line(x: np.ndarray, value: float, d: np.ndarray) -> tuple[np.ndarray, float]:
        # Ever finer batches of steps around the best one.
        at, span = 0.0, 1.0
        for _ in range(12):
            steps = at + span * np.linspace(-1, 1, 17)
            v = many(x + steps[:, None] * d)
            best = int(np.nanargmin(np.where(np.isfinite(v), v, np.inf)))
            if v[best] < value:
                at, value = float(steps[best]), float(v[best])
            span *= 1.0 if best in (0, len(steps) - 1) else 0.2
        return x + at * d, value

    for _ in range(maxiter if k else 0):
        begin, before, gains = x, value, []
        for d in directions:
            last = value
            x, value = line(x, value, d)
            gains.append(last - value)
        step = x - begin
        if before - value <= 1e-10 * max(1.0, abs(value)):
            return x, value, True
        x, value = line(x, value, step)
        directions[int(np.argmax(gains))] = step / max(float(np.linalg.norm(step)), 1e-300)
    return x, value, k == 0


def basin_hopping(many: Callable[[np.ndarray], np.ndarray], x: np.ndarray, maxiter: int = 50, hops: int = 8) -> tuple[np.ndarray, float, bool]:
    """L-BFGS from the start and from random moves away from the best point so far (of a fixed seed)."""
    rng = np.random.default_rng(0)
    best = lbfgs(many, x, maxiter)
    for _ in range(hops if len(x) else 0):
        found = lbfgs(many, best[0] + rng.normal(scale=0.5, size=len(x)), maxiter)
        if found[1] < best[1]:
            best = found
    return best


#: Optimiser names.
METHODS = {"lbfgs": lbfgs, "bfgs": bfgs, "newton": newton, "cg": conjugate_gradient, "ncg": newton_cg, "basinhopping": basin_hopping, "nm": nelder_mead, "powell": powell}


class LeastSquares:
    """Ordinary least squares by QR, with t values and information criteria. Singular designs raise LinAlgError."""

    def __init__(self, y: np.ndarray, x: np.ndarray):
        n, k = x.shape
        q, r = np.linalg.qr(x)
        d = np.abs(np.diag(r))
        if n < k or not len(d) or d.min() <= 1e-12 * max(d.max(), 1e-300):
            raise np.linalg.LinAlgError("Singular matrix")
        self.params = np.linalg.solve(r, q.T @ y)
        self.resid = y - x @ self.params
        self.n, self.k = n, k
        ssr = float(self.resid @ self.resid)
        inverse = np.linalg.inv(r)
        with np.errstate(all="ignore"):
            scale = ssr / (n - k) if n > k else np.nan
            self.bse = np.sqrt(scale * (inverse**2).sum(1))
            self.tvalues = self.params / self.bse
            self.llf = -n / 2 * (np.log(2 * np.pi) + np.log(ssr / n) + 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.params

    def criterion(self, name: str) -> float:
        aic = -2 * self.llf + 2 * self.k
        if name == "aic":
            return aic
        if name == "bic":
            return -2 * self.llf + self.k * np.log(self.n)
        if name == "aicc":
            return aic + 2 * self.k * (self.n / (self.n - self.k - 1) - 1)
        raise ValueError(f"{name!r} is an invalid method; must be one of aic, aicc, bic, fixed")

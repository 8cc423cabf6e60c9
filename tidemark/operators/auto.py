"""Automatic order selection.

A stepwise search is a replay: given the outcomes of the orders visited so far, it says which order
comes next. So the same search runs in two ways. Spread over series, a task replays many series and
fits what they ask for next side by side. Spread over candidates, each round is a job: series ask
for their next orders and likely later ones, rows (series, order) that no earlier round has fitted
are dealt to all tasks, and outcomes join the table of visited orders. A long series then
uses the whole cluster. Grid and random search spread (series, candidates) rows.
"""

from __future__ import annotations

import contextvars
import itertools
import math
import random
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import statespace, unitroot
from tidemark.operators.arima import ARIMA, COLUMNS, MODEL_SCHEMA, ROWS, arrays, fit_all, model_row, packed, unpacked
from tidemark.operators.guards import ModelFitWarning
from tidemark.sources.scratch import written

CRITERIA = ("aic", "aicc", "bic", "hqic", "oob")
#: Moves of the stepwise search in the order they are tried: changes of (P, Q) and then of (p, q).
SEASONAL_MOVES = ((-1, 0), (0, -1), (1, 0), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))

_context: contextvars.ContextVar[dict] = contextvars.ContextVar("stepwise", default={})


class StepwiseContext:
    """Bounds of the stepwise searches that are started inside of a with block; inner ones override outer ones."""

    def __init__(self, max_steps: int | None = None, max_dur: float | None = None):
        if max_steps is not None and not 1 <= max_steps <= 1000:
            raise ValueError("max_steps must be between 1 and 1000")
        if max_dur is not None and max_dur <= 0:
            raise ValueError("max_dur must be greater than zero")
        self.values = {k: v for k, v in (("max_steps", max_steps), ("max_dur", max_dur)) if v is not None}

    def __enter__(self):
        self._token = _context.set(_context.get() | self.values)
        return self

    def __exit__(self, *_):
        _context.reset(self._token)


@dataclass
class AutoARIMA:
    """Order search for all series of a table."""

    start_p: int = 2
    d: int | None = None
    start_q: int = 2
    max_p: int = 5
    max_d: int = 2
    max_q: int = 5
    start_P: int = 1
    D: int | None = None
    start_Q: int = 1
    max_P: int = 2
    max_D: int = 1
    max_Q: int = 2
    max_order: int | None = 5
    m: int = 1
    seasonal: bool = True
    stationary: bool = False
    information_criterion: str = "aic"
    alpha: float = 0.05
    test: str = "kpss"
    seasonal_test: str = "ocsb"
    stepwise: bool = True
    random: bool = False
    n_fits: int = 10
    random_state: int | None = None
    method: str = "lbfgs"
    maxiter: int = 50
    out_of_sample_size: int = 0
    scoring: str | Callable = "mse"
    with_intercept: bool | str = "auto"
    error_action: str = "trace"
    strict_roots: bool = False
    #: "series": a task searches many series (lazy). "candidates": jobs of (series, order) rows, for few long series (runs at once).
    spread: str = "series"
    sarimax_kwargs: dict = field(default_factory=dict)

    def __post_init__(self):
        check_m(self.m, self.seasonal)
        if self.information_criterion not in CRITERIA:
            raise ValueError(f"auto_arima does not know the criterion {self.information_criterion!r}; one of {CRITERIA}")
        if self.information_criterion == "oob" and not self.out_of_sample_size:
            raise ValueError("the criterion oob needs an out_of_sample_size")
        for low, high in (("start_p", "max_p"), ("start_q", "max_q"), ("start_P", "max_P"), ("start_Q", "max_Q")):
            a, b = getattr(self, low), getattr(self, high)
            if a is None or a < 0 or b < 0:
                raise ValueError(f"{low} and {high} must be non-negative integers")
            if a > b:
                raise ValueError(f"{high} must be at least {low}")
        for name in ("d", "D"):
            v = getattr(self, name)
            if v is not None and v < 0:
                raise ValueError(f"{name} must be None or a non-negative integer")
        if self.spread not in ("series", "candidates"):
            raise ValueError("spread must be series or candidates")
        if self.error_action not in ("warn", "raise", "ignore", "trace"):
            raise ValueError("error_action must be one of warn, raise, ignore, trace")

    def base(self) -> ARIMA:
        return ARIMA((0, 0, 0), method=self.method, maxiter=self.maxiter, out_of_sample_size=self.out_of_sample_size, scoring=self.scoring, sarimax_kwargs=self.sarimax_kwargs)

    # Tables

    def fit(self, df: DataFrame, exog: list[str] | None = None, return_all: bool = False) -> DataFrame:
        """The best model row of each series (return_all: every valid one, with its rank).

        A series that can't be modelled gets a row with an error, and doesn't fail the others,
        unless error_action is "raise".
        """
        exog = exog or []
        if not self.stepwise:
            return self._grid(df, exog, return_all)
        if self.spread == "candidates":
            return self._rounds(df, exog, return_all)
        config, bounds = self, dict(_context.get())

        def run(frames):
            for pdf in frames:
                for begin in range(0, len(pdf), ROWS):
                    part = pdf.iloc[begin : begin + ROWS]
                    found = search_many(config, *unpacked(part, exog), bounds)
                    rows = [row for i, outcomes in zip(part.series_id, found, strict=True) for row in _rows(i, outcomes, exog, return_all)]
                    yield pd.DataFrame(rows, columns=[*COLUMNS, "rank"] if return_all else COLUMNS)

        return packed(df, exog).mapInPandas(run, MODEL_SCHEMA + ", rank int" * return_all)

    def _rounds(self, df: DataFrame, exog: list[str], return_all: bool) -> DataFrame:
        """The stepwise search with a job a round. What comes to the driver is the number of orders that a round asks for."""
        config, bounds, spark = self, dict(_context.get()), df.sparkSession
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        series = written(packed(df, exog))
        began = time.time()

        def ask(frames):
            for pdf in frames:
                ys, xs = unpacked(pdf, exog)
                out = []
                for i, y, x, seen in zip(pdf.series_id, ys, xs, pdf.seen, strict=True):
                    known = {tuple(int(v) for v in o["key"]): Outcome.of(o, config) for o in ([] if seen is None else seen)}
                    try:
                        late = time.time() - began > bounds.get("max_dur", math.inf)
                        wanted, ranked = replay(config, prepared(config, y, x), known, 0 if x is None else x.shape[1], bounds, ahead=len(MOVES), late=late)
                    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                        if config.error_action == "raise":
                            raise
                        out.append((i, None, None, f"{type(e).__name__}: {e}", None))
                        continue
                    out += [(i, list(key), None if start is None else list(start), None, None) for key, start in wanted]
                    if ranked is not None:
                        out.append((i, None, None, None if ranked else NO_CANDIDATE, [list(o.key) for o in ranked]))
                yield pd.DataFrame(out, columns=["series_id", "key", "start", "why", "ranked"])

        def fit(frames):
            for pdf in frames:
                yield pd.DataFrame([(i, o.row()) for i, o in zip(pdf.series_id, _outcomes(config, pdf, exog), strict=True)], columns=["series_id", "outcome"])

        same = F.col("series_id").eqNullSafe(F.col("id"))
        visited, rounds = None, 0
        while True:
            state = series.withColumn("seen", F.lit(None).cast(f"array<{OUTCOME}>"))
            if visited is not None:
                seen = visited.groupBy(F.col("series_id").alias("id")).agg(F.collect_list("outcome").alias("seen"))
                state = series.join(seen, same, "left").drop("id")
            asked = written(state.mapInPandas(ask, "series_id string, key array<int>, start array<double>, why string, ranked array<array<int>>"))
            wanted = asked.where("key is not null")
            if visited is not None:
                done = visited.select(F.col("series_id").alias("id"), F.col("outcome.key").alias("old"))
                wanted = wanted.join(done, same & (F.col("key") == F.col("old")), "left_anti")
            rounds += 1
            if wanted.isEmpty() or rounds > 10 * MOST_STEPS:
                break
            tasks = wanted.select(F.col("series_id").alias("id"), "key", "start").join(series, same).drop("id").repartition(width)
            fits = written(tasks.mapInPandas(fit, f"series_id string, outcome {OUTCOME}"))
            visited = fits if visited is None else visited.unionByName(fits)
        final = asked.where("key is null").select(F.col("series_id").alias("id"), "why", F.coalesce("ranked", F.array().cast("array<array<int>>")).alias("ranked"))
        state = series.join(final, same).drop("id").withColumn("seen", F.lit(None).cast(f"array<{OUTCOME}>"))
        if visited is not None:
            state = state.drop("seen").join(seen, same, "left").drop("id")

        def finish(frames):
            for pdf in frames:
                ys, xs = unpacked(pdf, exog)
                rows = []
                for i, y, x, seen, ranked, why in zip(pdf.series_id, ys, xs, pdf.seen, pdf.ranked, pdf.why, strict=True):
                    known = {tuple(int(v) for v in o["key"]): Outcome.of(o, config) for o in ([] if seen is None else seen)}
                    best = [known[tuple(int(v) for v in key)] for key in ranked]
                    rows += _rows(i, [o.refit(config, y, x) for o in (best if return_all else best[:1])] or why or NO_CANDIDATE, exog, return_all)
                yield pd.DataFrame(rows, columns=[*COLUMNS, "rank"] if return_all else COLUMNS)

        return state.repartition(width, "series_id").mapInPandas(finish, MODEL_SCHEMA + ", rank int" * return_all)

    def _grid(self, rows: DataFrame, exog: list[str], return_all: bool) -> DataFrame:
        """One task row a series and CHUNK candidates, so that a series is shuffled once for so many fits. The series'
        own d, D and clamps are found first; a task fits the same candidate of all its series side by side."""
        config = self
        series = packed(rows, exog)

        def plan(frames):
            for pdf in frames:
                out = []
                for i, y, x in zip(pdf.series_id, *unpacked(pdf, exog), strict=True):
                    try:
                        candidates = grid(config, y, x)
                    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                        if config.error_action == "raise":
                            raise
                        out.append((i, y, [] if x is None else x.ravel(), 0, [], f"{type(e).__name__}: {e}"))
                        continue
                    # Dealt in turn: large orders, which come last, spread over the chunks.
                    n = -(-len(candidates) // CHUNK)
                    out += [(i, y, [] if x is None else x.ravel(), k, [[*o, *s, int(c), 0] for o, s, c in candidates[k::n]], None) for k in range(n)]
                yield pd.DataFrame(out, columns=["series_id", "y", "x", "chunk", "candidates", "why"])

        plans = series.mapInPandas(plan, "series_id string, y array<double>, x array<double>, chunk int, candidates array<array<int>>, why string")
        tasks = plans.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id", "chunk")

        def run(frames):
            for pdf in frames:
                failed = pdf[pdf.why.notna()]
                out = [model_row(i, None, math.nan, None, why, exog) for i, why in zip(failed.series_id, failed.why, strict=True)]
                each = pdf[pdf.why.isna()].explode("candidates").rename(columns={"candidates": "key"}).reset_index(drop=True)
                if len(each):
                    for i, o in zip(each.series_id, _outcomes(config, each, exog, errors=True), strict=True):
                        good = o.made is not None and o.root
                        out.append(model_row(i, o.made if good else None, o.oob, o.preds, o.error if o.made is None else None if good else "ValueError: a root is close to the unit circle", exog))
                yield pd.DataFrame(out, columns=COLUMNS)

        fits = tasks.mapInPandas(run, MODEL_SCHEMA)
        ic = F.col(self.information_criterion)
        valid = F.coalesce(F.col("error").isNull() & ~F.isnan(ic) & (ic < math.inf), F.lit(False))
        # Series without a valid fit keep one row, with its error.
        w = Window.partitionBy("series_id").orderBy(F.desc("valid"), ic, "fit_time")
        ranked = fits.withColumn("valid", valid).withColumn("rank", F.row_number().over(w)).where("valid or rank = 1")
        ranked = ranked.withColumn("error", F.when(~F.col("valid"), F.coalesce("error", F.lit(NO_CANDIDATE)))).drop("valid")
        return ranked if return_all else ranked.where("rank = 1").drop("rank")


#: Candidates of a grid search that one task row fits.
CHUNK = 8
#: The error of a series none of whose fits is valid.
NO_CANDIDATE = "ValueError: no candidate has a finite criterion"


def orders(config: AutoARIMA, df: DataFrame, exog: list[str] | None = None) -> DataFrame:
    """(series_id, d, seasonal_d, max_p, max_q, max_sp, max_sq, with_intercept, error): what a search of each series starts from."""
    exog = exog or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"series_id": pdf.series_id.iloc[0], **dict.fromkeys(("d", "seasonal_d", "max_p", "max_q", "max_sp", "max_sq", "with_intercept", "error"))}
        try:
            c, constant, only = prepared(config, *arrays(pdf, exog))
            # A series with one candidate only has that one's orders.
            (p, d, q), (P, D, Q, _), constant = only[0] if only else ((c.max_p, c.d, c.max_q), (c.max_P, c.D, c.max_Q, 0), constant)
            row |= {"d": d, "seasonal_d": D, "max_p": p, "max_q": q, "max_sp": P, "max_sq": Q, "with_intercept": constant}
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
        return pd.DataFrame([row])

    schema = "series_id string, d int, seasonal_d int, max_p int, max_q int, max_sp int, max_sq int, with_intercept boolean, error string"
    return df.select("series_id", "t", "y", *exog).groupBy("series_id").applyInPandas(run, schema)


def candidates(config: AutoARIMA, df: DataFrame, exog: list[str] | None = None) -> DataFrame:
    """(series_id, p, d, q, seasonal_p, seasonal_d, seasonal_q, m, with_intercept): the orders that a grid or random search of each series fits."""
    columns = ["series_id", "p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "m", "with_intercept"]

    def run(frames):
        for pdf in frames:
            out = []
            for i, y, x in zip(pdf.series_id, *unpacked(pdf, exog or []), strict=True):
                out += [(i, *o, *s, bool(c)) for o, s, c in grid(config, y, x)]
            yield pd.DataFrame(out, columns=columns)

    return packed(df, exog).mapInPandas(run, "series_id string, " + ", ".join(f"{c} int" for c in columns[1:-1]) + ", with_intercept boolean")


def auto_arima(df: DataFrame, exog: list[str] | None = None, return_valid_fits: bool = False, **options) -> DataFrame:
    return AutoARIMA(**options).fit(df, exog, return_valid_fits)


def check_m(m: int, seasonal: bool) -> None:
    if (m < 1 and seasonal) or m < 0:
        raise ValueError("m must be a positive integer (> 0)")
    if seasonal is False and m > 1:
        warnings.warn(f"m ({m}) set for a non-seasonal fit; it is ignored", stacklevel=3)


def root_test(made: statespace.Fit, strict: bool = False) -> bool:
    """False if an inverse root is beyond 0.99. Unless strict, a model with MA terms is judged by its MA roots alone."""
    ar, ma = made.roots()
    largest = lambda r: max((1 / abs(z) for z in r if abs(z) > 0), default=0.0)
    if strict:
        return max(largest(ar), largest(ma)) <= 0.99
    return (largest(ma) if len(ma) else largest(ar)) <= 0.99


def prepared(config: AutoARIMA, y: np.ndarray, x: np.ndarray | None) -> tuple[AutoARIMA, bool, list | None]:
    """The config with the series' own d, D, clamps and intercept; or a list with the only candidate."""
    m = config.m if config.seasonal else 1
    c = replace(config, m=m)
    if unitroot.is_constant(y):
        return c, False, [((0, 0, 0), (0, 0, 0, 0), False)]
    n = len(y)
    c = replace(c, max_p=min(c.max_p, n // 3), max_q=min(c.max_q, n // 3))
    if m == 1:
        c = replace(c, max_P=0, max_Q=0, start_P=0, start_Q=0)
    work = y
    if x is not None:
        ones = np.column_stack([np.ones(n), x])
        work = y - ones @ np.linalg.lstsq(ones, y, rcond=None)[0]
    flat = lambda a: bool((np.ptp(a, axis=0) == 0).any()) if a is not None and len(a) else False
    D = d = 0
    dx, xd = work, x
    if c.stationary:
        intercept_sum = 0
    else:
        D = c.D
        if m == 1:
            D = 0
        elif D is None:
            D = unitroot.nsdiffs(work, m, c.max_D, c.seasonal_test) if c.max_D else 0
            if D > 0 and x is not None and flat(x[m:] - x[:-m]):
                D -= 1
        for _ in range(D):
            dx = dx[m:] - dx[:-m]
            xd = None if xd is None else xd[m:] - xd[:-m]
        d = c.d
        if d is None:
            d = unitroot.ndiffs(dx, c.alpha, c.test, c.max_d) if c.max_d else 0
            if d > 0 and xd is not None and flat(np.diff(xd, axis=0)):
                d -= 1
        for _ in range(d):
            dx = np.diff(dx)
        # A search that is not seasonal counts D as -1 in the intercept rule.
        intercept_sum = d + (D if config.seasonal else -1)
    intercept = c.with_intercept if c.with_intercept != "auto" else (c.stationary or intercept_sum in (0, 1))
    c = replace(c, d=d, D=D)
    if len(dx) and unitroot.is_constant(dx):
        if d >= 3 and D <= 0:
            raise ValueError("data follow a simple polynomial and are not suitable for ARIMA modeling")
        return c, bool(intercept), [((0, d, 0), (0, D, 0, m if D else 0), bool(intercept) and d + D < 2)]
    if m > 1:
        if c.max_P > 0:
            c = replace(c, max_p=min(c.max_p, m - 1))
        if c.max_Q > 0:
            c = replace(c, max_q=min(c.max_q, m - 1))
    if n < 10:
        c = replace(c, start_p=min(c.start_p, 1), start_q=min(c.start_q, 1), start_P=0, start_Q=0)
    return c, bool(intercept), None


def grid(config: AutoARIMA, y: np.ndarray, x: np.ndarray | None) -> list[tuple]:
    """Candidates (order, seasonal order, intercept) of a grid or random search."""
    c, intercept, only = prepared(config, y, x)
    if only:
        return only
    most = math.inf if c.max_order is None else c.max_order
    sizes = itertools.product(range(c.max_p + 1), range(c.max_q + 1), range(c.max_P + 1), range(c.max_Q + 1))
    out = [((p, c.d, q), (P, c.D, Q, c.m if c.m > 1 else 0), intercept) for p, q, P, Q in sizes if p + q + P + Q <= most]
    return random.Random(c.random_state).sample(out, min(c.n_fits, len(out))) if c.random else out


#: Moves of the stepwise search, as it tries them: changes of (p, q, P, Q), then of the intercept.
MOVES = tuple((0, 0, dP, dQ, False) for dP, dQ in SEASONAL_MOVES) + tuple((dp, dq, 0, 0, False) for dp, dq in SEASONAL_MOVES) + ((0, 0, 0, 0, True),)
#: Orders that a search visits at most, unless a StepwiseContext says otherwise.
MOST_STEPS = 100
#: Numbers (models x states squared) that a search fits ahead of what it needs.
AHEAD = 1500
OUTCOME = "struct<key:array<int>,value:double,llf:double,root:boolean,params:array<double>,seconds:double,oob:double,preds:array<double>,converged:boolean,error:string>"


@dataclass
class Outcome:
    """What a fit of one order has given. The key is p, d, q, P, D, Q, m, intercept, and whether it starts from a smaller model (1) or not (0)."""

    key: tuple
    order: statespace.Order
    value: float = math.inf
    llf: float = math.nan
    root: bool = False
    params: np.ndarray | None = None
    seconds: float = 0.0
    oob: float = math.nan
    preds: np.ndarray | None = None
    converged: bool = False
    error: str | None = None
    made: statespace.Fit | None = None

    @classmethod
    def judged(cls, key: tuple, config: AutoARIMA, made, oob, preds, error) -> Outcome:
        out = cls(key, model_of(config, key).spec(), oob=oob, preds=preds, error=error, made=made)
        if made is not None:
            out.llf, out.params, out.seconds, out.converged, out.root = made.llf, made.params, made.fit_time, made.converged, root_test(made, config.strict_roots)
            value = oob if config.information_criterion == "oob" else made.criteria()[config.information_criterion]
            out.value = value if out.root and math.isfinite(value) else math.inf
        return out

    def row(self) -> dict:
        listed = lambda x: None if x is None else [float(v) for v in x]
        return {"key": list(self.key), "value": self.value, "llf": self.llf, "root": self.root, "params": listed(self.params), "seconds": self.seconds, "oob": self.oob, "preds": listed(self.preds), "converged": self.converged, "error": self.error}

    @classmethod
    def of(cls, row, config: AutoARIMA) -> Outcome:
        key = tuple(int(v) for v in row["key"])
        array = lambda x: None if x is None else np.asarray(x, float)
        number = lambda x: math.nan if x is None else float(x)
        return cls(key, model_of(config, key).spec(), number(row["value"]), number(row["llf"]), bool(row["root"]), array(row["params"]), row["seconds"], number(row["oob"]), array(row["preds"]), bool(row["converged"]), row["error"])

    def refit(self, config: AutoARIMA, y: np.ndarray, x: np.ndarray | None) -> Outcome:
        """With its model again, from its parameters."""
        made = statespace.at_params(y, self.order, x, self.params, self.converged, self.seconds, config.method, **config.base().flags())
        return replace(self, made=made)


def model_of(config: AutoARIMA, key: tuple, start: np.ndarray | None = None) -> ARIMA:
    return replace(config.base(), order=key[:3], seasonal_order=key[3:7], with_intercept=bool(key[7]), start_params=None if start is None else list(start))


def _outcomes(config: AutoARIMA, pdf: pd.DataFrame, exog: list[str], errors: bool = False) -> list[Outcome]:
    """The outcomes of rows (series_id, y, x, key, start), those of one order side by side."""
    ys, xs = unpacked(pdf, exog)
    keys = [tuple(int(v) for v in k) for k in pdf.key]
    starts = [None if s is None else np.asarray(s, float) for s in pdf.start] if "start" in pdf else [None] * len(keys)
    return fit_keys(config, keys, ys, xs, starts, errors)


def fit_keys(config: AutoARIMA, keys: list[tuple], ys: list, xs: list, starts: list, errors: bool = False) -> list[Outcome]:
    if not keys:
        return []
    models = [model_of(config, key, start) for key, start in zip(keys, starts, strict=True)]
    return [Outcome.judged(key, config, *found) for key, found in zip(keys, fit_all(models, ys, xs, errors), strict=True)]


class _Missing(Exception):
    """The search needs an order's outcome that it has not got yet."""

    def __init__(self, key: tuple, start: np.ndarray | None):
        self.key, self.start = key, start


def replay(config: AutoARIMA, plan: tuple, seen: dict[tuple, Outcome], k_exog: int, bounds: dict, ahead: int = 1, late: bool = False) -> tuple[list[tuple], list[Outcome] | None]:
    """Hyndman and Khandakar's stepwise search over the outcomes seen so far.

    Either ([(key, start)], None): the order that the search visits next, and up to ``ahead`` orders
    in all that it may visit after it; or ([], outcomes), best first, if the search has ended.
    """
    c, intercept, only = plan
    m = c.m if c.m > 1 else 0
    if only:
        (order, seasonal, constant) = only[0]
        key = (*order, *seasonal, int(constant), 0)
        if key not in seen:
            return [(key, None)], None
        if seen[key].error:
            raise ValueError(seen[key].error)
        return [], [seen[key]]
    limit = bounds.get("max_steps", MOST_STEPS)
    forms = {k: v for k, v in c.base().flags().items() if k != "simple_differencing"}
    tried: dict[tuple, Outcome] = {}
    best = math.inf
    state = (min(c.start_p, c.max_p), min(c.start_q, c.max_q), min(c.start_P, c.max_P), min(c.start_Q, c.max_Q), bool(intercept))

    def key_of(at: tuple, again: int = 0) -> tuple:
        p, q, P, Q, constant = at
        return (p, c.d, q, P, c.D, Q, m, int(constant), again)

    def outcome(key: tuple, start: np.ndarray | None = None) -> Outcome:
        if key not in seen:
            raise _Missing(key, start)
        return seen[key]

    def better(at: tuple) -> bool:
        nonlocal best, state
        if at in tried or len(tried) >= limit:
            return False
        found = outcome(key_of(at))
        if found.error is None:
            inside = sorted((f for f in tried.values() if f.error is None and f.llf > found.llf + 1e-6), key=lambda f: -f.llf)
            for small in inside:
                # A model that holds another one can't have a lower likelihood: go on from the smaller one's parameters.
                start = statespace.embedded(small, found.order, k_exog, **forms)
                if start is None:
                    continue
                again = outcome(key_of(at, 1), start)
                if again.error is None and again.llf > found.llf:
                    found = again
                break
        elif c.error_action == "raise":
            raise ValueError(found.error)
        tried[at] = found
        if found.value < best:
            best, state = found.value, at
            return True
        return False

    def neighbours(at: tuple):
        p, q, P, Q, constant = at
        for dp, dq, dP, dQ, other in MOVES:
            if 0 <= p + dp <= c.max_p and 0 <= q + dq <= c.max_q and 0 <= P + dP <= c.max_P and 0 <= Q + dQ <= c.max_Q:
                yield p + dp, q + dq, P + dP, Q + dQ, constant != other

    first = [state, (0, 0, 0, 0, bool(intercept))]
    if c.max_p or c.max_P:
        first.append((min(1, c.max_p), 0, min(1, c.max_P), 0, bool(intercept)))
    if c.max_q or c.max_Q:
        first.append((0, min(1, c.max_q), 0, min(1, c.max_Q), bool(intercept)))
    if intercept:
        first.append((0, 0, 0, 0, False))
    try:
        for at in first:
            better(at)
        while len(tried) < limit and not late:
            if not any(better(at) for at in neighbours(state)):
                break
    except _Missing as e:
        if not late or not tried:
            wanted = {e.key: e.start}
            more = [at for at in first if at not in tried] or [at for at in neighbours(state) if at not in tried]
            for key in map(key_of, more[: limit - len(tried)]):
                if len(wanted) < ahead and key not in seen:
                    wanted.setdefault(key, None)
            return list(wanted.items()), None
    if late:
        warnings.warn("early termination of the stepwise search: max_dur is over", stacklevel=2)
    if c.error_action in ("warn", "trace"):
        for found in tried.values():
            if found.error:
                warnings.warn(f"{found.order.label().strip()} could not be fitted: {found.error}", ModelFitWarning, stacklevel=2)
    return [], sorted((f for f in tried.values() if math.isfinite(f.value)), key=lambda f: (f.value, f.seconds))


def search_many(config: AutoARIMA, ys: list[np.ndarray], xs: list[np.ndarray | None], bounds: dict | None = None) -> list[list[Outcome] | str]:
    """The stepwise search of each series: its outcomes, best first, or the error. Orders that several series ask for are fitted side by side."""
    bounds, began = bounds or {}, time.time()
    out: list = [None] * len(ys)
    plans: dict[int, tuple] = {}
    seen: list[dict[tuple, Outcome]] = [{} for _ in ys]
    for i, (y, x) in enumerate(zip(ys, xs, strict=True)):
        try:
            plans[i] = prepared(config, y, x)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            if config.error_action == "raise":
                raise
            out[i] = f"{type(e).__name__}: {e}"
    left = list(plans)
    while left:
        late = time.time() - began > bounds.get("max_dur", math.inf)
        asked = []
        for i in left:
            # Few small models at once cost as much as one: they are fitted ahead.
            states = plans[i][0].d + plans[i][0].m * (1 + plans[i][0].D) if plans[i][0].m > 1 else 4
            ahead = max(1, min(len(MOVES), AHEAD // (len(left) * states**2)))
            try:
                wanted, ranked = replay(config, plans[i], seen[i], 0 if xs[i] is None else xs[i].shape[1], bounds, ahead, late)
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                if config.error_action == "raise":
                    raise
                out[i] = f"{type(e).__name__}: {e}"
                continue
            if ranked is not None:
                out[i] = ranked or NO_CANDIDATE
            asked += [(i, key, start) for key, start in wanted]
        left = [i for i in left if out[i] is None]
        found = fit_keys(config, [k for _, k, _ in asked], [ys[i] for i, *_ in asked], [xs[i] for i, *_ in asked], [s for *_, s in asked])
        for (i, key, _), o in zip(asked, found, strict=True):
            seen[i][key] = o
    return out


def search(config: AutoARIMA, y: np.ndarray, x: np.ndarray | None, bounds: dict | None = None) -> list[tuple]:
    """The stepwise search of one series: [(fit, oob, oob forecasts)], best first."""
    found = search_many(config, [y], [x], bounds)[0]
    if isinstance(found, str):
        raise ValueError(found.removeprefix("ValueError: "))
    return [(o.made, o.oob, o.preds) for o in found]


def _rows(series_id, outcomes: list[Outcome] | str, exog: list[str], every: bool) -> list[dict]:
    """Model rows of the best outcome (or of every one, with its rank), or the row of an error."""
    if isinstance(outcomes, str):
        return [model_row(series_id, None, math.nan, None, outcomes, exog) | {"rank": 1}]
    return [model_row(series_id, o.made, o.oob, o.preds, None, exog) | {"rank": k + 1} for k, o in enumerate(outcomes if every else outcomes[:1])]

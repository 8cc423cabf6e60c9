"""Least squares of many series by sums of products: no series is in one worker.

The products of the design's columns are summed by series (partial sums before the shuffle), and the
small matrix that is left is eliminated row by row, as a fold over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot this small beside its column's own sum of squares means that the columns are dependent.
SINGULAR = 1e-11


def products(rows: DataFrame, columns: list[Column], keys: list[str], *more: Column) -> DataFrame:
    """(keys, n, gram, more): the sums of products of all pairs of columns, as rows of a matrix, over rows without a null in them."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = rows.select("*", *[c.cast("double").alias(n) for n, c in zip(names, columns, strict=True)]).dropna(subset=names)
    size = len(names)
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *more)
    gram = F.array(*[F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(size)]) for i in range(size)])
    kept = [c for c in found.columns if not c.startswith("g") or "_" not in c]
    return found.select(*kept, gram.alias("gram"))


def eliminated(gram: Column, pivots: int) -> Column:
    """The matrix after its first ``pivots`` columns have been eliminated from the rows below them."""

    def step(matrix: Column, j: Column) -> Column:
        pivot = F.get(matrix, j)

        def row(r: Column, i: Column) -> Column:
            factor = F.try_divide(F.get(r, j), F.get(pivot, j))
            return F.when(i <= j, r).otherwise(F.zip_with(r, pivot, lambda a, b: a - factor * b))

        return F.transform(matrix, row)

    return F.aggregate(F.sequence(F.lit(0), F.lit(pivots - 1)), gram, step)


def at(matrix: Column, i: int, j: int) -> Column:
    return F.get(F.get(matrix, F.lit(i)), F.lit(j))


def last_coefficient(gram: DataFrame, size: int, used: Column) -> DataFrame:
    """``beta``, ``t`` and ``ssr`` of the last regressor, where the matrix's last column is the left side and ``used`` the number of regressors that count."""
    done = gram.withColumn("done", eliminated(F.col("gram"), size - 1))
    k = size - 2
    whole = F.lit(True)
    for i in range(size - 1):
        whole = whole & (at(F.col("done"), i, i) > SINGULAR * at(F.col("gram"), i, i))
    pivot, ssr = at(F.col("done"), k, k), at(F.col("done"), size - 1, size - 1)
    beta = F.try_divide(at(F.col("done"), k, size - 1), pivot)
    error = F.sqrt(F.try_divide(F.greatest(ssr, F.lit(0.0)), F.nullif(F.greatest(F.col("n") - used, F.lit(0)), F.lit(0))) / pivot)
    return done.select("*", F.when(whole, beta).alias("beta"), F.when(whole, F.try_divide(beta, error)).alias("t"), F.when(whole, F.greatest(ssr, F.lit(0.0))).alias("ssr")).drop("gram")


def solution(gram: Column, regressors: int) -> Column:
    """The coefficients, by eliminating and substituting back; the left side is the matrix's last column. Null if the columns are dependent."""
    done = eliminated(gram, regressors)

    def back(found: Column, step: Column) -> Column:
        # found has the coefficients of the later columns, the last one first.
        i = regressors - 1 - step
        row = F.get(done, i)
        known = F.aggregate(F.sequence(F.lit(0), step), F.lit(0.0), lambda acc, k: acc + F.when(k < step, F.get(row, regressors - 1 - k) * F.get(found, k)).otherwise(0.0))
        return F.concat(found, F.array(F.try_divide(F.get(row, F.lit(regressors)) - known, F.get(row, i))))

    whole = F.lit(True)
    for i in range(regressors):
        whole = whole & (at(done, i, i) > SINGULAR * at(gram, i, i))
    return F.when(whole, F.reverse(F.aggregate(F.sequence(F.lit(0), F.lit(regressors - 1)), F.array().cast("array<double>"), back)))


def interpolated(x: Column, xs: list, ys: list) -> Column:
    """Linear in between, the end values outside; xs ascend. Points are numbers or columns."""
    column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    xs, ys = list(map(column, xs)), list(map(column, ys))
    out = F.when(x.isNull(), None).when(x <= xs[0], ys[0])
    for a, b, low, high in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= b, low + (high - low) * F.try_divide(x - a, b - a))
    return out.otherwise(ys[-1])

"""Building, checking and aligning series: tables of (series_id, t, ts, y, x_...).

One series is one key; ``t`` is dense from 0. Everything here is a projection, an aggregate
or an equi-join on (series_id, t).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("t")


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def regular(events: DataFrame, key: str | Column, ts: str, value: Column, unit: str = "month", drop_last: bool = False, fill: float = 0.0) -> DataFrame:
    """Sum ``value`` by key and calendar period, with every period from a key's first to its last.

    Partial sums are combined before the shuffle, so only key-period rows move; the calendar
    is exploded from each key's own span. ``drop_last`` drops each key's last (partial) period.
    """
    key = F.col(key) if isinstance(key, str) else key
    sums = events.groupBy(key.alias("series_id"), F.date_trunc(unit, ts).alias("ts")).agg(F.sum(value).alias("y"))
    spans = sums.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    calendar = spans.select("series_id", "hi", F.posexplode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("t", "ts"))
    if drop_last:
        calendar = calendar.where("ts < hi")
    return calendar.drop("hi").join(sums, ["series_id", "ts"], "left").select("series_id", F.col("t").cast("long").alias("t"), "ts", F.coalesce("y", F.lit(fill)).alias("y"))


def check_endog(df: DataFrame, column: str = "y", force_all_finite: bool = False) -> DataFrame:
    """The column as double. With force_all_finite, NaN, infinity and null raise at run time."""
    y = F.col(column).cast("double")
    if force_all_finite:
        y = F.when(is_finite(y), y).otherwise(F.raise_error(F.lit(f"{column} contains NaN, infinity or null")).cast("double"))
    return df.withColumn(column, y)


def check_exog(df: DataFrame, columns: list[str], force_all_finite: bool = True) -> DataFrame:
    """Exogenous columns as doubles; non-finite values raise at run time unless allowed."""
    if not columns:
        raise ValueError("at least one exogenous column is needed")
    return reduce(lambda d, c: check_endog(d, c, force_all_finite), columns, df)


def is_finite(c: Column) -> Column:
    """False for null, NaN and both infinities."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def as_series(df: DataFrame, order: str, key: str = "series_id") -> DataFrame:
    """df with ``t`` counted from 0 in the order of a column, by key."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def concatenate(*parts: DataFrame) -> DataFrame | None:
    """Series one after another: each part's t goes on where the part before ended. No parts: None."""
    if not parts:
        return None
    tagged = [p.select("series_id", F.lit(k).alias("part"), "t", "y") for k, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged)
    w = Window.partitionBy("series_id").orderBy("part", "t")
    return rows.select("series_id", (F.row_number().over(w) - 1).cast("long").alias("t"), "y")


def is_iterable(x) -> bool:
    return not isinstance(x, str) and isinstance(x, Iterable)


def constant(df: DataFrame) -> DataFrame:
    """(series_id, is_constant)."""
    return df.groupBy("series_id").agg((F.min("y") == F.max("y")).alias("is_constant"))


def at(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows at (series_id, t) positions."""
    return df.join(positions.select("series_id", "t"), ["series_id", "t"], "left_semi")


def reorder(df: DataFrame, columns: list[str]) -> DataFrame:
    """The remembered exogenous columns, in their order."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing exogenous columns: {missing}")
    return df.select("series_id", "t", *columns)


def bind(df: DataFrame | None, features: DataFrame) -> DataFrame:
    """Columns of features beside those of df, by (series_id, t); df None gives the features."""
    return features if df is None else df.join(features, ["series_id", "t"])


def align(y: DataFrame, x: DataFrame) -> DataFrame:
    """y and x by (series_id, t); a row without its partner raises at run time."""
    both = y.withColumn("has_y", F.lit(True)).join(x.withColumn("has_x", F.lit(True)), ["series_id", "t"], "full")
    ok = F.col("has_y") & F.col("has_x")
    checked = F.when(ok, F.col("t")).otherwise(F.raise_error(F.lit("y and X have different rows")).cast("long"))
    return both.withColumn("t", checked).drop("has_y", "has_x")


def holdout(df: DataFrame, size: int) -> DataFrame:
    """The last ``size`` rows of each series."""
    if size < 0:
        raise ValueError("out_of_sample_size must be a non-negative integer")
    return df.withColumn("n", F.count(F.lit(1)).over(whole())).where(F.col("t") >= F.col("n") - size).drop("n")


def append(df: DataFrame, new: DataFrame) -> DataFrame:
    """df and, after its last row, the rows of new (whose t counts from 0)."""
    ends = df.groupBy("series_id").agg((F.max("t") + 1).alias("n"))
    later = new.join(ends, "series_id", "left").select("series_id", (F.col("t") + F.coalesce("n", F.lit(0))).alias("t"), "y")
    return df.select("series_id", "t", "y").unionByName(later)


def floor_values(df: DataFrame, floor: float = 1e-16, neg_action: str = "raise") -> DataFrame:
    """Values at or below zero become ``floor``; "raise" raises at run time instead."""
    if neg_action not in ("raise", "warn", "ignore"):
        raise ValueError("neg_action must be one of raise, warn, ignore")
    low = F.col("y") <= 0
    to = F.raise_error(F.lit("negative or zero values present in y")).cast("double") if neg_action == "raise" else F.lit(floor)
    return df.withColumn("y", F.when(low, to).otherwise(F.col("y")))


def get_callable(key: str, table: dict[str, Callable]) -> Callable:
    if key not in table:
        raise ValueError(f"{key!r} must be one of {sorted(table)}")
    return table[key]

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], medians of three after a warm-up, and fits of long and many series; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.arima import ARIMA
from tidemark.operators.auto import AutoARIMA
from tidemark.plans import queries as series_queries
from tidemark.sources import datasets

NAMES = ("O18_regular_series", "O50_diff", "O55_decompose_additive", "O56_acf", "O100_kpss", "O42_scores", "O43_fold_average", "O111_fit", "O112_predict", "O130_auto_arima", "O133_grid_search", "O146_pipeline", "O101_adf", "O105_ndiffs", "O158_cross_validate", "O80_boxcox_fit")


#: Sizes of the generated series: rows of the long one, series and rows of the many.
LONG, MANY, SEARCHED, SHORT = 2750, 10_000, 1000, 100
ROUNDS = 3


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def generated(spark: SparkSession) -> dict[str, float]:
    """Seconds of fits of a long series, series a second of fits and stepwise searches of many, candidates a second of a grid."""
    noise = F.randn(7)
    by_time = Window.partitionBy("series_id").orderBy("t")
    long = spark.range(LONG).select(F.lit("long").alias("series_id"), F.col("id").alias("t"), noise.alias("e")).select("series_id", "t", (0.4 * F.sum("e").over(by_time) + F.col("e") + 5 * F.sin(F.col("t") / 21)).alias("y"))
    many = spark.range(MANY * SHORT).select((F.col("id") % MANY).alias("k"), F.floor(F.col("id") / MANY).alias("t"), noise.alias("e"))
    many = many.withColumn("series_id", F.col("k").cast("string")).select("series_id", "k", "t", (F.col("e") + 0.6 * F.lag("e", 1, 0.0).over(by_time)).alias("y"))
    wine = datasets.load(spark, "wineind")
    grid = AutoARIMA(m=12, d=1, D=1, max_p=2, max_q=2, max_P=1, max_Q=1, start_P=0, start_Q=0, stepwise=False)
    return {
        "fit_n2750_(0,1,0)_sec": round(timed(ARIMA((0, 1, 0), with_intercept=False).fit(long)), 3),
        "fit_n2750_(2,1,2)(1,0,1)[12]_sec": round(timed(ARIMA((2, 1, 2), (1, 0, 1, 12)).fit(long)), 3),
        f"fit_(1,0,1)_of_{MANY}_series_per_sec": round(MANY / timed(ARIMA((1, 0, 1)).fit(many)), 2),
        f"stepwise_of_{SEARCHED}_series_per_sec": round(SEARCHED / timed(AutoARIMA(seasonal=False, max_p=2, max_q=2).fit(many.where(F.col("k") < SEARCHED))), 2),
        "grid_candidates_per_sec": round(3 * 3 * 2 * 2 / timed(grid.fit(wine)), 2),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    timed(series_queries.QUERIES["O62_train_test_split"](spark, sf_dir))
    timed(series_queries.QUERIES["O111_fit_white_noise"](spark, sf_dir))
    for name in NAMES:
        took[name] = round(statistics.median(timed(series_queries.QUERIES[name](spark, sf_dir)) for _ in range(ROUNDS)), 3)
    more = {"generated": generated(spark)} if os.environ.get("BENCH_EXTRA", "1") != "0" else {}
    print(json.dumps({"metric": "headline query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")} | more))
    spark.stop()


if __name__ == "__main__":
    main()

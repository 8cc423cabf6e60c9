"""Model tables in files, with a check of the version that wrote them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

import tidemark


def save(models: DataFrame, path: str, mode: str = "errorifexists") -> None:
    models.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The model rows; warns if another version wrote some of them."""
    models = spark.read.parquet(path)
    other = models.where(models.pkg_version != tidemark.__version__).select("pkg_version").distinct().limit(5).collect()
    if other:
        warnings.warn(f"models were written by version {', '.join(r[0] for r in other)}, this is {tidemark.__version__}", stacklevel=2)
    return models

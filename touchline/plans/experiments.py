"""Grids of settings, each scored once: results are kept in a table under the key of their settings, and what is there isn't run again."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "key string, config string, metric string, value double"


def grid(**values: Iterable) -> list[dict]:
    """All combinations of the values, as settings."""
    return [dict(zip(values, x, strict=True)) for x in itertools.product(*values.values())]


def key_of(config: dict, data: str = "") -> str:
    """The sha1 of the settings in one spelling (keys in order, no spaces) and of what the data is called."""
    return hashlib.sha1(f"{data}|{json.dumps(config, sort_keys=True, separators=(',', ':'), default=str)}".encode()).hexdigest()


def cached(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(RESULT).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULT)


def run(spark: SparkSession, configs: list[dict], evaluate: Callable[[dict], DataFrame], folder: str, data: str = "") -> tuple[DataFrame, int]:
    """(results of all configs, how many were run now). evaluate(config) gives rows (metric, value); its rows are appended under
    the config's key. Which keys lack is an anti-join with the table in folder, so any number of results may lie there."""
    asked = spark.createDataFrame([(key_of(c, data), json.dumps(c, sort_keys=True, default=str)) for c in configs], "key string, config string").distinct()
    lacking = {r["key"] for r in asked.join(cached(spark, folder).select("key").distinct(), "key", "left_anti").collect()}  # of the configs asked for
    done = set()
    for config in configs:
        key = key_of(config, data)
        if key in lacking and key not in done:
            rows = evaluate(config).select(F.lit(key).alias("key"), F.lit(json.dumps(config, sort_keys=True, default=str)).alias("config"), "metric", F.col("value").cast("double").alias("value"))
            rows.write.mode("append").parquet(folder)
            done.add(key)
    return cached(spark, folder).join(asked.select("key"), "key", "left_semi"), len(done)


def best(results: DataFrame, metric: str) -> DataFrame:
    """The config with the least of a metric; ties to the first by its text."""
    return results.where(F.col("metric") == metric).orderBy("value", "config").limit(1)

"""Feeds and settings: breach ranges as text, issues as JSON, layered settings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def breach_ranges(spark: SparkSession, path: str) -> DataFrame:
    """prefix, line of files named by their five-character prefix, each with lines suffix:count. Input of validate.breach_count."""
    name = F.regexp_extract(F.input_file_name(), r"([0-9A-Fa-f]{5})[^/]*$", 1)
    return spark.read.text(path).select(F.upper(name).alias("prefix"), F.trim("value").alias("line")).where("line <> ''")


def issues(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON feed that are no pull requests."""
    schema = "number long, title string, state string, created_at string, pull_request struct<url: string>"
    return spark.read.schema(schema).json(path).where(F.col("pull_request").isNull()).drop("pull_request")


def setting(name: str, default: str | None = None) -> str | None:
    """The environment's value unless empty, else the text of the file that NAME_FILE names, else the default."""
    if value := os.environ.get(name):
        return value
    if path := os.environ.get(f"{name}_FILE"):
        with open(path, encoding="utf-8") as f:
            return f.read().strip()
    return default

"""Readers of message tables: whole bodies from text, and what is in scope of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.scalars import contains_prefix, looks_like_json
from ..operators import scope


def bodies(spark: SparkSession, path: str, host: str = "stdin") -> DataFrame:
    """One message for each file below path: msg_id, host and body; an empty file is none."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.xxhash64(F.input_file_name()).alias("msg_id"), F.lit(host).alias("host"), F.col("value").alias("body"))


def requests(messages: DataFrame, settings: Settings) -> DataFrame:
    """Messages (host, content_type, body) that are looked at: allowed hosts first, then JSON bodies."""
    return messages.where(scope.host_allowed(F.col("host"), settings.hosts)).where(looks_like_json(F.col("content_type"), F.col("body")))


def responses(messages: DataFrame, settings: Settings) -> DataFrame:
    """Messages that hold the start of a placeholder; the others need no restoring."""
    return messages.where(contains_prefix(F.col("body"), settings.prefix))

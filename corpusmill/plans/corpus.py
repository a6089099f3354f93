"""The engine's relations over the data folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path, content, language, directory."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("directory"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as known texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), F.col("text").alias("content"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as commits: hash, author, message, subject."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("hash"), F.col("role").alias("author"), F.col("text").alias("message"), F.substring_index("text", "\n", 1).alias("subject"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run log."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("command"), F.col("user_id").alias("project"), "value", (F.col("event_type") == "error").alias("failed"), "props")

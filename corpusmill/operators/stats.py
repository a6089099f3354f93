"""Size, line and token statistics; exact duplicates. `files` has path, content, language, directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import approximate_tokens, byte_size, line_count


def measured(files: DataFrame) -> DataFrame:
    """Each file with size, lines and tokens."""
    return files.select("path", "language", "directory", byte_size(F.col("content")).alias("size"), line_count(F.col("content")).alias("lines"), approximate_tokens(F.col("content")).alias("tokens"))


def _sums() -> list:
    total = F.sum("size")
    return [F.count("*").alias("files"), total.alias("bytes"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"), F.round(total / F.count("*"), 4).alias("average_size")]


def totals(files: DataFrame) -> DataFrame:
    return measured(files).agg(*_sums())


def totals_by(files: DataFrame, column: str) -> DataFrame:
    return measured(files).groupBy(column).agg(*_sums())


def totals_and_languages(files: DataFrame) -> DataFrame:
    """Totals and totals by language in one pass; `level` is 0 for a language, 1 for all."""
    return measured(files).groupingSets([["language"], []], "language").agg(*_sums(), F.grouping_id().cast("int").alias("level"))


def largest(files: DataFrame, n: int) -> DataFrame:
    return files.select("path", byte_size(F.col("content")).alias("size")).orderBy(F.desc("size"), "path").limit(n)


def duplicates(files: DataFrame) -> DataFrame:
    """Contents that several files have: hash, number of files, the least path, bytes that copies waste. Copies are summed
    before the shuffle, so a content that very many files have is no burden."""
    keyed = files.where(F.col("content").isNotNull()).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), byte_size(F.col("content")).alias("size"))
    groups = keyed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max("size").alias("size"))
    return groups.where("copies > 1").select("hash", "copies", "first_path", (F.col("size") * (F.col("copies") - 1)).alias("wasted"))

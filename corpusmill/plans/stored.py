"""Indexes of the data folder's documents, built once for each state of the table and kept in the shared folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import index
from corpusmill.plans.corpus import files, snippets
from corpusmill.sources import folders

#: Identifiers in a chunk.
CHUNK = 400


def marked(docs: DataFrame) -> DataFrame:
    """path, mark, content; a text's mark is its length."""
    return docs.select(F.col("path").cast("string").alias("path"), F.length("content").cast("string").alias("mark"), "content")


def stored(spark: SparkSession, sf_dir: str, limit: int | None) -> str:
    """The folder of the index of documents, or of their chunks."""
    state = f"{sf_dir} {folders.mark(spark, f'{sf_dir}/documents.parquet')} {limit}"
    base = f"{folders.shared(spark)}/index-{hashlib.sha1(state.encode()).hexdigest()[:16]}"
    if index.latest(spark, base) is None:
        folders.remove(spark, base)  # what a build that failed has left
        index.build(marked(files(spark, sf_dir)), base, limit)
    return base


def updated(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an index that was built over other texts (long documents in capitals, and the benchmark's besides), and then brought up to
    date with the documents as they are."""
    base = f"{folders.shared(spark)}/updated-{hashlib.sha1(f'{sf_dir} {folders.mark(spark, f"{sf_dir}/documents.parquet")}'.encode()).hexdigest()[:16]}"
    folders.remove(spark, base)
    now = files(spark, sf_dir)
    long = F.length("content") > 2000
    old = now.withColumn("content", F.when(long, F.upper(F.substring("content", 1, 1000))).otherwise(F.col("content")))
    extra = snippets(spark, sf_dir).select(F.concat(F.lit("benchmark/"), "path").alias("path"), "content")
    index.build(marked(old).unionByName(marked(extra)), base)
    index.update(marked(now), base)
    return base

"""What a stored index finds, with the lines that show why: only the texts of the answers are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import lines
from corpusmill.functions.vectors import TOKEN
from corpusmill.operators import index, search

#: How many of a question's terms are named, and looked for in the texts; and lines shown for a file.
STRONGEST, SAMPLES = 8, 3
HITS = "path string, score double, matched_terms array<string>, samples array<struct<line_number:bigint,line:string>>"


def sampled(texts: DataFrame, terms: list[str], most: int = SAMPLES) -> DataFrame:
    """path, samples: the first lines that hold a term in any case, by the terms' order, then the lines'; a line that holds several terms
    comes once for each."""
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("term")) for k, t in enumerate(terms)])
    held = F.transform(lines(F.col("content")), lambda x, i: F.transform(F.filter(wanted, lambda t: F.contains(F.lower(x), t["term"])), lambda t: F.struct(t["k"].alias("k"), (i + 1).cast("long").alias("line_number"), x.alias("line"))))
    first = F.slice(F.array_sort(F.flatten(held)), 1, most)
    return texts.select("path", F.transform(first, lambda h: F.struct(h["line_number"].alias("line_number"), h["line"].alias("line"))).alias("samples"))


def semantic_hits(spark: SparkSession, base: str, query: str, top: int, files: DataFrame | None = None, digits: int = 6) -> tuple[DataFrame, bool]:
    """(path, score, matched_terms, samples) of the documents nearest to the expanded query, and whether an index answered. Where
    there is none, the keyword search of `files` answers, if these are given."""
    now = index.latest(spark, base)
    if now is None:
        if files is None:
            return spark.createDataFrame([], HITS), False
        return search.keyword_search(files, query, top), False
    terms = [t.lower() for t in TOKEN.findall(" ".join(search.expanded(query)))]
    best = index.ask(spark, base, terms, top, digits).collect()  # `top` rows
    if not best:
        return spark.createDataFrame([], HITS), True
    strongest = index.question(spark, base, now, terms).terms[:STRONGEST]
    found = spark.createDataFrame([(r["path"], r["score"]) for r in best], "path string, score double").withColumn("matched_terms", F.array(*map(F.lit, strongest)))
    samples = sampled(index.texts_of(spark, base, [r["path"] for r in best]), strongest)
    return found.join(F.broadcast(samples), "path").orderBy(F.desc("score"), "path"), True  # `top` rows, of SAMPLES lines each


def chunk_texts(spark: SparkSession, base: str, question: str, top: int = 6) -> DataFrame:
    """path, chunk_index, start_line, end_line, score, content of the chunks nearest to a question; empty where there is no index."""
    best = index.ask(spark, base, TOKEN.findall(question), top, 4)
    found = best.collect()  # `top` rows
    if not found:
        return best.withColumn("content", F.lit(""))
    texts = index.texts_of(spark, base, sorted({r["path"] for r in found}))
    body = F.array_join(F.slice(lines(F.col("content")), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    rows = spark.createDataFrame(found, best.schema).join(texts, "path")
    return rows.withColumn("content", body).orderBy(F.desc("score"), "path", "chunk_index")

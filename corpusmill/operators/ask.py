"""Questions to a language model: the client is a function the caller gives; retrieval is ours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import approximate_tokens
from corpusmill.operators import index, retrieval
from corpusmill.operators.collect import chunked
from corpusmill.operators.search import chunks, retrieve
from corpusmill.sources import folders

#: Tokens of summaries that one reducing prompt takes, and calls that a task makes.
PROMPT_TOKENS, CALLS = 12_000, 16

#: complete(prompt, system) -> answer
Client = Callable[[str, str], str]


def no_client(prompt: str, system: str) -> str:
    """Where none is set up."""
    raise RuntimeError("no language model is configured")


def context(docs: DataFrame, question: str, top: int = 6) -> list[dict]:
    """The chunks that a question's answer may use, with their text; at most `top`."""
    found = retrieve(docs, question, top)
    best = docs.sparkSession.createDataFrame(found.collect(), found.schema)  # `top` rows
    few = docs.join(F.broadcast(best.select("path").distinct()), "path", "left_semi")
    rows = chunks(few).join(F.broadcast(best.select("path", "chunk_index", "score")), ["path", "chunk_index"])
    return [r.asDict() for r in rows.orderBy(F.desc("score"), "path", "chunk_index").collect()]


def answer(docs: DataFrame, question: str, client: Client = no_client, top: int = 6) -> tuple[str | None, list[dict]]:
    """An answer and the chunks it rests on; where nothing is found, no model is asked."""
    return _answered(question, context(docs, question, top), client)


def answer_from(spark: SparkSession, base: str, question: str, client: Client = no_client, top: int = 6) -> tuple[str | None, list[dict]]:
    """The same from a stored index of chunks; it is an error if there is none, and no model is asked."""
    if index.latest(spark, base) is None:
        raise LookupError(f"no index of chunks at {base}; build one first")
    return _answered(question, [r.asDict() for r in retrieval.chunk_texts(spark, base, question, top).collect()], client)


def _answered(question: str, found: list[dict], client: Client) -> tuple[str | None, list[dict]]:
    if not found:
        return None, []
    body = "\n\n".join(f"[{r['path']}:{r['start_line']}-{r['end_line']}]\n{r['content']}" for r in found)
    return client(f"{body}\n\nQuestion: {question}", "Answer from the excerpts only, and name them."), found


def summarised(parts: DataFrame, client: Client, question: str = "Summarise.") -> DataFrame:
    """Map step: path, ord and the model's summary of each part (path, ord, content), on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([client(x or "", question) for x in batch["content"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["ord"], texts], ["path", "ord", "summary"])

    rows = parts.select(F.col("path").cast("string").alias("path"), F.col("ord").cast("long").alias("ord"), "content")
    return rows.mapInArrow(run, "path string, ord long, summary string")


def summary(parts: DataFrame, client: Client, question: str = "Summarise.", limit: int = PROMPT_TOKENS) -> str | None:
    """One text from all parts (path, ord, content): each is summarised, then runs of summaries that fit one prompt of about `limit` tokens
    (two at least), until one is left. All calls are made by tasks, of CALLS parts each; each round is written to the shared folder, so
    a lost executor or driver repeats the calls of tasks that hadn't ended only. The driver sees the last text. A single
    part needs no second call; without parts the answer is null."""
    spread = lambda df: df.repartition(max(1, -(-df.count() // CALLS)))
    made = folders.written(summarised(spread(parts), client, question))
    while (n := made.count()) > 1:
        placed = made.select(F.lit("").alias("all"), F.struct("path", "ord").alias("place"), F.greatest(F.lit(1).cast("long"), approximate_tokens(F.coalesce("summary", F.lit("")))).alias("tokens"))
        chunks_ = chunked(placed, "all", "place", limit).select("place.path", "place.ord", "chunk")
        if chunks_.select("chunk").distinct().count() == n:  # each fills a prompt by itself
            chunks_ = chunked(placed.withColumn("tokens", F.lit(1).cast("long")), "all", "place", 2).select("place.path", "place.ord", "chunk")
        runs = made.join(chunks_, ["path", "ord"]).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("path", "ord", "summary"))).alias("in"))  # what one prompt takes
        body = F.array_join(F.transform("in", lambda x: x["summary"]), "\n\n", "")
        made = folders.written(summarised(spread(runs.select(F.lit("").alias("path"), F.col("chunk").alias("ord"), body.alias("content"))), client, question))
    row = made.first()
    return None if row is None else row["summary"]

"""Change streams: re-run on change, append logs, windowed counts. Offsets and state are in the query's checkpoint."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import index
from corpusmill.sources import folders


def on_change(spark: SparkSession, folder: str, schema: str, checkpoint: str, run: Callable[[DataFrame, int], None], seconds: float | None = None, form: str = "parquet") -> StreamingQuery:
    """Call run(rows, batch number) for what arrives in a folder: all that is there, then (with seconds) at each interval
    where something came. Without seconds it ends when it has caught up."""
    rows = spark.readStream.schema(schema).format(form).load(folder)
    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def watched(fingerprint: Callable[[], DataFrame], run: Callable[[bool], None], seconds: float = 2.0, polls: int | None = None, wait: Callable[[float], None] = time.sleep) -> int:
    """Call run(True) at once, then run(False) after each poll that finds paths added, removed or changed, and return how often
    it ran. fingerprint() gives the present (path, mark); of these only a digest of fixed size is kept."""

    def digest() -> tuple:
        h = F.xxhash64("path", "mark")
        return tuple(fingerprint().agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())

    last, times = digest(), 1
    run(True)
    for _ in itertools.count() if polls is None else range(polls):
        wait(seconds)
        now = digest()
        if now != last:
            last, times = now, times + 1
            run(False)
    return times


def follow_index(docs: DataFrame, base: str, checkpoint: str, limit: int | None = None) -> StreamingQuery:
    """Put a stream of documents (path, mark, content, and where there is one removed: true takes the path out) into a stored index, until all
    is read. A batch writes a segment of its own documents only. Of a path that comes twice in a batch, the row of the greatest
    mark counts. A batch that is run again after a failure finds its number in the index, and changes nothing."""

    def merge(rows: DataFrame, batch: int) -> None:
        removed = F.col("removed") if "removed" in rows.columns else F.lit(False)
        one = rows.groupBy("path").agg(F.max(F.struct("mark", removed.alias("removed"), "content")).alias("x")).select("path", "x.*")
        if index.latest(rows.sparkSession, base) is None:
            index.build(one.limit(0), base, limit)
        index.change(base, one.where("not removed").drop("removed"), one.where("removed").select("path"), batch)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(events: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Rows by window and key, with a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def follow_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(folder)


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the events by type, through a stream that ends when all is read. Each batch's counts are written; the sum
    over batches is the result."""
    base = f"{folders.shared(spark)}/{uuid.uuid4().hex}"
    table = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(table).schema

    def count(rows: DataFrame, batch: int) -> None:
        rows.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/counts/batch={batch}")

    # A pattern, as a plain path must be a folder; the table may also be one file.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    query = rows.writeStream.foreachBatch(count).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = spark.read.schema("event_type string, n long").parquet(f"{base}/counts")
    return counts.groupBy("event_type").agg(F.sum("n").alias("n"))

"""Rows as HTTP posts: each once, also over failures, with a ledger of what was sent and a table of what could not be.

The ledger is a folder that all machines see. A task appends the id of each row to a file of its own as soon as the endpoint has taken it, and
skips ids that any task of the same batch has noted before. So a batch that is run again, after a failed task or a restart, sends only
what is left; a row could go twice only if a machine is lost between the endpoint's answer and the note, and for that case each post has
its key in the Idempotency-Key header.
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULT = "id string, ok boolean, status int, attempts int, error string"
#: (url, body, headers) -> status
Post = Callable[[str, bytes, dict[str, str]], int]


def http_post(url: str, body: bytes, headers: dict[str, str], timeout: float = 10) -> int:
    request = urllib.request.Request(url, data=body, headers={"content-type": "application/json"} | headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status
    except urllib.error.HTTPError as e:
        return e.code


def delivered(rows: DataFrame, url: str, ledger: str, batch: int, retries: int = 3, wait: float = 0.5, post: Post = http_post) -> DataFrame:
    """id, ok, status, attempts, error of the rows (id, json) that this run had to send. Answers of 500 and above, 429 and failed
    connections are tried again, after `wait` seconds, then twice that, and so on. Lazy: count or write the result once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Path(ledger, f"batch={batch}")
        os.makedirs(folder, exist_ok=True)
        noted = {line for f in folder.glob("*.sent") for line in f.read_text().splitlines()}
        with open(folder / f"{uuid.uuid4().hex}.sent", "a") as notes:
            for rows_ in batches:
                out = []
                for id_, body in zip(rows_["id"].to_pylist(), rows_["json"].to_pylist(), strict=True):
                    if str(id_) in noted:
                        continue
                    status, error, attempt = None, None, 0
                    for attempt in range(1, retries + 2):  # noqa: B007 - used after the loop
                        try:
                            status, error = post(url, (body or "").encode(), {"Idempotency-Key": f"{batch}:{id_}"}), None
                        except OSError as e:
                            status, error = None, str(e)
                        if status is not None and status < 500 and status != 429:
                            break
                        if attempt <= retries:
                            time.sleep(wait * 2 ** (attempt - 1))
                    ok = status is not None and 200 <= status < 300
                    if ok:
                        notes.write(f"{id_}\n")
                        notes.flush()
                        os.fsync(notes.fileno())
                        noted.add(str(id_))
                    out.append((str(id_), ok, status, attempt, error))
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "ok", "status", "attempts", "error"])

    return rows.select(F.col("id").cast("string").alias("id"), "json").mapInArrow(run, RESULT)


def follow(rows: DataFrame, url: str, checkpoint: str, ledger: str, retries: int = 3, wait: float = 0.5) -> StreamingQuery:
    """Send a stream's rows (id, json) until all is read. What an endpoint refuses, or what fails to the end, is in the table
    `dead` (with batch) in the ledger's folder; the stream goes on."""

    def send(some: DataFrame, batch: int) -> None:
        results = delivered(some, url, ledger, batch, retries, wait)
        results.where("not ok").write.mode("append").parquet(f"{ledger}/dead/batch={batch}")

    return rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

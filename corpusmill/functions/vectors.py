"""Term vectors of documents, or of their chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import IDENTIFIER

TOKEN = re.compile(IDENTIFIER)
#: A-Z lower-cased and nothing else (identifiers are ASCII).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UNITS = "path string, mark string, chunk_index long, start_line long, end_line long, total long, terms array<string>, counts array<int>"
#: Terms of the units that a task gathers before it sends them on.
TERMS_HELD = 100_000

Unit = tuple[int, int, int, Counter[str]]


def units(text: str, limit: int | None) -> Iterator[Unit]:
    """(index, first line, last line, how often each term) of a text: all of it, or lines gathered while the identifiers in
    them stay within the limit (a line counts 1 at least; a longer line is a chunk by itself)."""
    number, first, held, last = 0, 1, 0, 0
    terms: Counter[str] = Counter()
    for last, line in enumerate(text.splitlines(), 1):  # noqa: B007 - used after the loop
        found = TOKEN.findall(line)
        size = len(found) or 1
        if limit is not None and held and held + size > limit:
            yield number, first, last - 1, terms
            number, first, held, terms = number + 1, last, 0, Counter()
        held += size
        terms.update(found)
    if held or limit is None:
        yield number, first, last, terms


def vectors(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """The units of documents (path, mark, content) with their terms and counts. Without a limit each document is one, also an empty or null
    one; with it, each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in UNITS.split(", ")]
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.string()), pa.list_(pa.int32())]
        out: list[tuple] = []
        held = 0

        def sent() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for path, mark, text in zip(*(batch[c] for c in ("path", "mark", "content")), strict=True):
                plain = (text.as_py() or "").encode().translate(LOWER).decode()
                for number, first, last, terms in units(plain, limit):
                    order = sorted(terms)
                    out.append((path.as_py(), mark.as_py(), number, first, last, sum(terms.values()), order, [terms[t] for t in order]))
                    held += len(order) + 1
                    if held > TERMS_HELD:
                        yield sent()
                        out, held = [], 0
        yield sent()

    rows = docs.select(F.col("path").cast("string").alias("path"), F.col("mark").cast("string").alias("mark"), "content")
    return rows.mapInArrow(run, UNITS)

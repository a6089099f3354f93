"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows are its runs of WINDOW words (or all of it, where it has fewer). A text holds a window only
if it holds every word of it, so the one rarest is a prefix that is enough to find it: each window is filed under
its rarest word, by the counts of the benchmark's words in all documents. An occurrence of that word in a text fixes
where the window would begin (its place in the window is known); the candidates that would begin before the text or
end after it are left out by these positions and lengths, and the others are verified word by word: by the words' hashes
first, then by the words. Words inside an occurrence are hit.

Words: A-Z lower-cased, then runs of digits, a-z and anything beyond ASCII. The benchmark is taken in blocks of at
most BLOCK_BYTES of text, each of which is broadcast; documents pass all blocks in one go, without a shuffle, and
each document's hits are kept as spans of words. So a passage that most documents hold needs no more memory. The driver
reads the benchmark and its words' counts; a benchmark of many blocks takes as many steps over each batch of documents.
Repeated documents come out as often; an empty table of documents gives no rows.

Null and empty texts have no words and no hits; items without words are never found; repeated items count once;
without items nothing is hit. Items with a null id hit like others; in `items` they are all one null, at the end, which
counts as one in n_items and is left out of the joined ids that items_sha256 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import LOWER, WordHasher, blocks, light, raw

WINDOW = 13
#: Text of benchmark items that is broadcast at a time.
BLOCK_BYTES = 4 << 20

LETTER = np.ones(256, bool)
LETTER[:128] = [chr(i).isalnum() for i in range(128)]
HASHER = WordHasher(LETTER, 7)


@dataclass
class Windows:
    """A block's windows: hashes of words (padded), lengths, the words (with one blank between), place of the rarest word, items; filed by that word."""

    words: np.ndarray
    length: np.ndarray
    texts: list[bytes]
    place: np.ndarray
    items: list[list[str | None]]
    keys: np.ndarray  # distinct rarest words, sorted
    first: np.ndarray  # where each key's windows begin in `filed`
    filed: np.ndarray
    quick: np.ndarray  # by 16 bits of a word's hash: may it be a key?


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    words, at = HASHER.words(*raw(pa.array(texts, pa.large_string())))
    return [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def plain_words(text: str | None) -> list[bytes]:
    """A text's words, lower-cased."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    low = LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(*HASHER.edges(data, np.array([0, len(data)])), strict=True)]


def in_order(names: set[str | None]) -> list[str | None]:
    """Sorted, the null last."""
    return sorted(names, key=lambda x: (x is None, x or ""))


def build(items: list[tuple[str | None, str | None]], counts: dict[int, int]) -> Windows:
    """File the windows of (item_id, text) under their rarest words."""
    held: dict[bytes, tuple[list[int], set[str | None]]] = {}
    for (name, text), words in zip(items, item_words([t for _, t in items]), strict=True):
        hashes, w = words.tolist(), plain_words(text)
        for k in range(max(1, len(w) - WINDOW + 1) if w else 0):
            held.setdefault(b" ".join(w[k : k + WINDOW]), (hashes[k : k + WINDOW], set()))[1].add(name)
    texts = sorted(held)
    windows = [held[t][0] for t in texts]
    length = np.array([len(w) for w in windows], np.int64)
    words = np.zeros((len(windows), WINDOW), np.uint64)
    place = np.zeros(len(windows), np.int64)
    for n, w in enumerate(windows):
        words[n, : len(w)] = w
        place[n] = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i]))
    rare = words[np.arange(len(windows)), place] if windows else np.zeros(0, np.uint64)
    filed = np.argsort(rare, kind="stable")
    keys, first = np.unique(rare[filed], return_index=True)
    quick = np.zeros(1 << 16, bool)
    quick[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Windows(words, length, texts, place, [in_order(held[t][1]) for t in texts], keys, np.append(first, len(filed)), filed, quick)


def occurrences(index: Windows, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of all verified occurrences among words; begin and end: bounds of the text that each is in."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(index.quick[(words & np.uint64(0xFFFF)).astype(np.int64)]) if len(index.keys) else none[0]
    key = np.searchsorted(index.keys, words[at])
    hit = key < len(index.keys)
    at, key = at[hit], key[hit]
    same = index.keys[key] == words[at] if len(key) else np.zeros(0, bool)
    at, key = at[same], key[same]
    if not len(at):
        return none
    many = index.first[key + 1] - index.first[key]
    rank = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    window = index.filed[np.repeat(index.first[key], many) + rank]
    at = np.repeat(at, many)
    start = at - index.place[window]
    ok = (start >= begin[at]) & (start + index.length[window] <= end[at])
    start, window = start[ok], window[ok]
    for k in range(WINDOW):  # word by word, among those that are left
        near = k < index.length[window]
        ok = ~near | (words[np.where(near, start + k, 0)] == index.words[window, k])
        start, window = start[ok], window[ok]
    return start, window


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping [start, end) spans put together, sorted."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], 1)


def batch_hits(index: Windows, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, set[str | None]]]:
    """For each text: words, hit spans, items found."""
    data, offsets = raw(texts)
    for a, b in blocks(offsets):
        block, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        begins, ends = HASHER.edges(block, bounds)
        words, at = HASHER.hashes(block, begins, ends), np.searchsorted(begins, bounds)
        row = np.repeat(np.arange(b - a), np.diff(at))
        start, window = occurrences(index, words, at[row], at[row + 1])
        same = [b" ".join(LOWER[block[begins[k] : ends[k]]].tobytes() for k in range(s, s + index.length[w])) == index.texts[w] for s, w in zip(start.tolist(), window.tolist(), strict=True)]
        start, window = start[np.array(same, bool)], window[np.array(same, bool)]
        own = row[start]
        order = np.argsort(own, kind="stable")
        start, window, own = start[order], window[order], own[order]
        bounds = np.searchsorted(own, np.arange(b - a + 1))
        for k in range(b - a):
            lo, hi = bounds[k], bounds[k + 1]
            s, w = start[lo:hi] - at[k], window[lo:hi]
            found = {x for n in np.unique(w) for x in index.items[n]}
            yield int(at[k + 1] - at[k]), merged(np.stack([s, s + index.length[w]], 1)), found


def benchmark_blocks(benchmark: DataFrame) -> list[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size (one longer item is a block). The driver holds the benchmark, not documents."""
    out: list[list[tuple[str | None, str | None]]] = []
    size = BLOCK_BYTES + 1
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").distinct().orderBy("i", "text").toLocalIterator():
        n = len((r["text"] or "").encode())
        if size + n > BLOCK_BYTES:
            out.append([])
            size = 0
        out[-1].append((r["i"], r["text"]))
        size += n
    return out


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each of the benchmark's words is in all documents; a row for each word and task is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known) + 1, np.int64)
        quick = np.zeros(1 << 16, bool)
        quick[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = raw(batch["text"])
            for a, b in blocks(offsets):
                words, _ = HASHER.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words = words[quick[(words & np.uint64(0xFFFF)).astype(np.int64)]]
                at = np.searchsorted(known, words)
                at[at == len(known)] = 0
                total += np.bincount(np.where(known[at] == words, at, len(known)), minlength=len(total))
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    if not len(vocabulary):
        return {}
    rows = docs.select("text").mapInArrow(light(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r["word"]]): r["n"] for r in rows}


MARKS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def span_lists(spans: list[np.ndarray]) -> pa.Array:
    """Each text's spans as a list of structs."""
    flat = np.concatenate([np.zeros((0, 2), np.int64), *spans])
    ends = np.cumsum([0, *map(len, spans)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["start", "end"]))


def hit_words() -> Column:
    """How many words are in the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`row` (each row of docs as a struct), n_words, spans (of words hit, [start, end), merged and sorted) and items (ids found, sorted as strings; null last)."""
    parts = benchmark_blocks(benchmark)
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for part in parts for w in item_words([t for _, t in part]))]))
    counts = word_counts(docs, vocabulary)
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    row = T.StructField("row", out.schema["row"].dataType)
    state = T.StructType([row, T.StructField("n_words", T.LongType()), T.StructField("spans", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
    last = T.StructType([row, *T._parse_datatype_string(MARKS).fields])
    place = docs.columns.index("text")

    def step(index: Windows, is_last: bool):  # noqa: ANN202
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(0)
                n_words, spans, items = [], [], []
                before = zip(batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True) if batch.num_columns > 1 else None
                for n, s, found in batch_hits(sent.value, rows.field(place)):
                    if before:
                        old, names = next(before)
                        s, found = merged(np.concatenate([np.frombuffer(old, np.int64).reshape(-1, 2), s])), found | set(names)
                    n_words.append(n)
                    spans.append(s)
                    items.append(in_order(found))
                marks = span_lists(spans) if is_last else pa.array([s.tobytes() for s in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([rows, pa.array(n_words, pa.int64()), marks, pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

        return run

    for k, part in enumerate(parts or [[]]):
        is_last = k >= len(parts) - 1
        out = out.mapInArrow(light(step(build(part, counts), is_last)), last if is_last else state)
    return out


def contaminated(percent: int = 5) -> Column:
    """At least this share of the words is hit (and at least one is)."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans, contaminated of each row."""
    return hits(docs, benchmark).withColumn("n_hit", hit_words()).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    return hits(docs, benchmark).withColumn("n_hit", hit_words()).where(~contaminated()).select("row.*")


def items_digest(items: Column) -> Column:
    """SHA-256 of the comma-joined ids, without the null."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def digest(items: list[str | None]) -> str:
    """The same in Python."""
    return hashlib.sha256(",".join(x for x in items if x is not None).encode()).hexdigest()

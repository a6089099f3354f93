"""Removal of passages that earlier documents have, by super-k-mers.

A window is `width` consecutive words of one document. Its minimiser is the least hash of the KMER-word runs in it. Consecutive
windows with the same minimiser make a piece (a super-k-mer, at most MOST_WINDOWS windows); equal windows have equal minimisers,
so each is only compared within its minimiser's bucket. In four steps:

1. Each text is cut into pieces: minimiser, a 64-bit digest of the piece's windows, where it is. No text moves. Pieces
   whose minimiser is in one document only are done with.
2. Of equal pieces (minimiser and digest), the one of the smallest doc_id stands for all: in every other document the whole
   piece goes, whatever else its bucket holds. So a group of copies of any size costs one row a task and piece.
3. Where a minimiser has several different pieces, each travels once to the minimiser's bucket, as one string of its words
   with single blanks. A bucket's windows are sorted, windows of equal digest are told apart by their bytes, and the smallest doc_id
   of each is held against the piece's own. A minimiser with more than BUCKET different pieces (a line that very many documents have)
   isn't gathered: its windows are counted one by one, by MD5 of their words, in an aggregation that Spark spreads.
4. What goes is carried back to the documents as spans of words.

Each document's text is shuffled once. Steps 1, 3 and 4 take texts in blocks, so a very long text needs a few times its size.

Words are runs of anything but blank and the control characters 9 to 13, unchanged. Null and empty texts have no words and keep
an empty text. Rows that repeat a doc_id don't remove from each other, and each comes out; a null doc_id counts as greater
than all others. Equal windows within one document stay. An empty table gives no rows; further columns are left alone (`row`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import BLOCK, U64, WordHasher, blocks, cut, light, mixed, raw

WIDTH, KMER = 50, 5
#: Windows in a piece, different pieces in a bucket, and bytes of pieces that a task resolves at a time (whole buckets).
MOST_WINDOWS, BUCKET, RESOLVED_BYTES = 256, 4_000, 4 << 20
#: Words of a text that are cut into pieces at a time.
WORDS = 1 << 16
#: What a null doc_id counts as.
NO_ID = (1 << 63) - 1

LETTER = np.ones(256, bool)
LETTER[[32, *range(9, 14)]] = False
HASHER = WordHasher(LETTER, 12, np.arange(256, dtype=np.uint8))
FACTOR, KFACTOR = (int(x) | 1 for x in np.random.default_rng(12).integers(1 << 60, 1 << 63, 2))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1, modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def rolled(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of `width` words, from prefix sums of a polynomial modulo 2 ** 64."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    return mixed((sums[width:] - sums[: n - width + 1]) * powers(pow(base, -1, 1 << 64), n - width + 1))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values, reach = np.minimum(values[:-reach], values[reach:]), 2 * reach
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def pieces(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """row, start (word in the row), windows, minimiser and digest of the pieces of rows whose words are at bounds[k] to bounds[k + 1]."""
    kmer = min(KMER, width)
    digests = rolled(hashes, width, FACTOR)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(np.arange(len(digests)) + width <= bounds[row[: len(digests)] + 1])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    minimiser = least(rolled(hashes, kmer, KFACTOR), width - kmer + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(row[at]) > 0) | (minimiser[1:] != minimiser[:-1])
    first = np.flatnonzero(new)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    rank %= MOST_WINDOWS
    first = np.flatnonzero(rank == 0)
    digest = np.add.reduceat(mixed(digests[at] + rank.astype(np.uint64) * U64(FACTOR)), first)
    return row[at[first]], at[first] - bounds[row[at[first]]], np.diff(np.append(first, len(at))), minimiser[first], digest


def slices(data: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """A long text in parts of about `limit` bytes, cut between words."""
    a = 0
    while a < len(data):
        b = min(a + limit, len(data))
        while b < len(data) and LETTER[data[b]]:
            b += 1
        yield a, b
        a = b


def all_pieces(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of a batch of texts, block by block."""
    data, offsets = raw(texts)
    with np.errstate(over="ignore"):
        for a, b in blocks(offsets):
            block = data[offsets[a] : offsets[b]]
            if b - a > 1 or len(block) <= BLOCK:
                hashes, bounds = HASHER.words(block, offsets[a : b + 1] - offsets[a])
            else:
                hashes = np.concatenate([HASHER.words(block[x:y], np.array([0, y - x]))[0] for x, y in slices(block)])
                bounds = np.array([0, len(hashes)])
            if len(hashes) <= 2 * WORDS or b - a > 1:
                row, *rest = pieces(hashes, bounds, width)
                yield row + a, *rest
                continue
            for k in range(0, len(hashes) - width + 1, WORDS):
                part = hashes[k : k + WORDS + width - 1]
                row, start, *rest = pieces(part, np.array([0, len(part)]), width)
                yield row + a, start + k, *rest


def keyed(docs: DataFrame) -> DataFrame:
    """Each row of docs as the struct `row`, its text, and what tells it from others: id, and a hash of the text."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(row, F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"))


def cut_up(rows: DataFrame, width: int) -> DataFrame:
    """All pieces: m (minimiser), d (digest), id, th, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_, th = (batch[c].to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for row, start, n, m, d in all_pieces(batch["text"], width):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m.view(np.int64), d.view(np.int64), id_[row], th[row], start, n)], ["m", "d", "id", "th", "start", "n"])

    return rows.select("text", "id", "th").mapInArrow(light(run), "m long, d long, id long, th long, start long, n long")


PACKED = "m long, d long, id long, many boolean, words string"


def packed(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted pieces (id, th, m, d, start, n, many) as strings of their words."""
    lists = wanted.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "n", "m", "d", "many"))).alias("pieces"))  # at most a document's pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            data, offsets = raw(batch["text"])
            id_, th, pieces_ = batch["id"].to_pylist(), batch["th"].to_pylist(), batch["pieces"]
            for k in range(batch.num_rows):
                if (id_[k], th[k]) == before:  # a repeated row
                    continue
                before, out = (id_[k], th[k]), []
                text = data[offsets[k] : offsets[k + 1]]
                begins, ends = HASHER.edges(text, np.array([0, len(text)]))
                plain = text.tobytes()
                for p in pieces_[k].as_py():
                    a, b = p["start"], p["start"] + p["n"] + width - 1
                    out.append((p["m"], p["d"], id_[k], p["many"], b" ".join(plain[x:y] for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True))))
                for a in range(0, len(out), 2_000):
                    cols = zip(*out[a : a + 2_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["m", "d", "id", "many", "words"])

    return rows.select("text", "id", "th").join(lists, ["id", "th"]).mapInArrow(light(run), PACKED.replace("words string", "words binary"))


def resolved(words: pa.Array, ids: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """Of each packed piece, the spans of words in windows that a smaller id has too."""
    data, offsets = raw(words)
    begins, ends = HASHER.edges(data, offsets)
    bounds = np.searchsorted(begins, offsets)
    with np.errstate(over="ignore"):
        digests = rolled(HASHER.hashes(data, begins, ends), width, FACTOR)
    row = np.repeat(np.arange(len(ids)), np.diff(bounds))
    at = np.flatnonzero(np.arange(len(digests)) + width <= bounds[row[: len(digests)] + 1])
    order = at[np.argsort(digests[at], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = digests[order[1:]] != digests[order[:-1]]
    first = np.append(np.flatnonzero(new), len(order))
    several = np.flatnonzero(np.diff(first) > 1)
    plain, hit = data.tobytes(), []
    for a, b in zip(first[several].tolist(), first[several + 1].tolist(), strict=True):
        same: dict[bytes, list[int]] = {}
        for k in order[a:b].tolist():
            same.setdefault(plain[begins[k] : ends[k + width - 1]], []).append(k)
        for places in same.values():
            low = ids[row[places]].min()
            hit += [k for k in places if ids[row[k]] > low]
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    for k in sorted(hit):
        own, r = out[row[k]], int(row[k])
        start = int(k - bounds[r])
        if own and start <= own[-1][1]:
            own[-1] = own[-1][0], start + width
        else:
            own.append((start, start + width))
    return out


SPANS = "array<struct<start:long,end:long>>"


def in_buckets(pieces_: DataFrame, width: int) -> DataFrame:
    """m, d, spans of the packed pieces, each bucket whole in one task."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def solve(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        spans = resolved(batch["words"].cast(pa.large_binary()).combine_chunks().view(pa.large_string()), batch["id"].to_numpy(), width)
        some = [k for k, s in enumerate(spans) if s]
        lists = pa.array([[{"start": a, "end": b} for a, b in spans[k]] for k in some], kind)
        yield pa.RecordBatch.from_arrays([batch[c].combine_chunks().take(pa.array(some, pa.int64())) for c in ("m", "d")] + [lists], ["m", "d", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < RESOLVED_BYTES:
                continue
            whole = pa.Table.from_batches(held)
            m = whole["m"].to_numpy()
            last = int(np.searchsorted(m, m[-1]))  # where the last bucket begins, which may go on
            if last:
                yield from solve(whole.slice(0, last))
            held = whole.slice(last).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    sent = pieces_.where("not many").select("m", "d", "id", "words").repartition("m").sortWithinPartitions("m")
    return sent.mapInArrow(light(run), f"m long, d long, spans {SPANS}")


def one_by_one(pieces_: DataFrame, width: int) -> DataFrame:
    """The same of the pieces whose buckets are too large to gather: windows by MD5."""
    words = pieces_.where("many").select("m", "d", "id", F.split(F.col("words").cast("string"), " ").alias("w"))
    windows = words.select("m", "d", "id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)).alias("start"))
    windows = windows.select("m", "d", "id", "start", F.md5(F.array_join(F.slice("w", F.col("start"), width), " ").cast("binary")).alias("window"))
    low = windows.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    hit = windows.join(low, "window").where("id > low")
    span = F.struct((F.col("start") - 1).cast("long").alias("start"), (F.col("start") - 1 + width).cast("long").alias("end"))
    return hit.groupBy("m", "d").agg(F.collect_list(span).alias("spans"))  # at most a piece's windows


def repeated_spans(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, th, spans (of words, [start, end), may overlap) of what goes; rows: from keyed()."""
    all_ = cut_up(rows, width)
    shared = all_.groupBy("m").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("m")
    some = cut(all_.join(shared, "m", "left_semi"))
    kinds = cut(some.groupBy("m", "d").agg(F.min(F.struct("id", "th", "start", "n")).alias("x"), F.max("id").alias("high")))
    counts = kinds.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(counts, "m").select("x.*", "m", "d", (F.col("kinds") > BUCKET).alias("many"))
    pieces_ = packed(rows, wanted, width)
    found = in_buckets(pieces_, width)
    if not counts.where(F.col("kinds") > BUCKET).isEmpty():
        found = found.unionByName(one_by_one(pieces_, width))
    first = kinds.select("m", "d", F.col("x.id").alias("first"), "high").join(found, ["m", "d"], "left").where("high > first or spans is not null")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("n") + width - 1).alias("end")))
    gone = some.join(first, ["m", "d"]).select("id", "th", F.col("start").alias("at"), F.explode(F.when(F.col("id") > F.col("first"), whole).otherwise(F.col("spans"))).alias("s"))
    span = F.struct((F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"))
    return gone.groupBy("id", "th").agg(F.collect_set(span).alias("spans"))  # at most a document's windows, also where rows repeat


def without(text: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """How many words a text has, how many go, and those that stay, joined by single blanks."""
    data, n, gone, kept = np.frombuffer(text, np.uint8), 0, 0, []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    for a, b in slices(data):
        words = text[a:b].split()
        drop = np.zeros(len(words), bool)
        # Spans that reach into this part; those that end before it were dealt with.
        near = spans[(spans[:, 0] < n + len(words)) & (spans[:, 1] > n)] if len(spans) else spans
        for x, y in near.tolist():
            drop[max(0, x - n) : y - n] = True
        n, gone = n + len(words), gone + int(drop.sum())
        kept.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if len(near) else words))
    return n, gone, b" ".join(k for k in kept if k)


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`row` (each row of docs as a struct), n_words, n_removed, spans (of removed words, may overlap) and kept (the words left, joined
    by single blanks)."""
    rows = keyed(docs)
    out = rows.join(repeated_spans(rows, width), ["id", "th"], "left").select("row", "text", "spans")
    schema = T.StructType([out.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", out.schema["spans"].dataType), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch["text"])
            for a, b in blocks(offsets, 8 * BLOCK):
                made = []
                for k in range(a, b):
                    s = batch["spans"][k].as_py() or []
                    made.append(without(data[offsets[k] : offsets[k + 1]].tobytes(), np.array([(x["start"], x["end"]) for x in s], np.int64).reshape(-1, 2)))
                n, gone, kept = zip(*made, strict=True)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), part["spans"], pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    return out.mapInArrow(light(run), schema)


def dedup_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    sha: Column = F.sha2(F.col("kept").cast("binary"), 256)
    return deduplicated(docs.select("doc_id", "text"), width).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", sha.alias("kept_sha256"))

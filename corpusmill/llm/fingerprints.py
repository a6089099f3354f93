"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, modulo two primes, the sums of code point times power of a base. Two entries
give the hash of any span, so any two spans are compared in constant time, and the longest common extension of
two positions is found by binary search over its length.

A fingerprint keeps of this array what comparing needs: the length, the hash of the whole text, the hashes of
the prefixes and suffixes whose lengths lie on a grid that all texts share (a quarter octave apart), and the lengths
and hashes of the pieces that the whole text is cut into. A cut is where the hash of the next WINDOW code points is less
than at the REACH places before and at no later one of the REACH after, so it depends on the code points around it only:
an edit changes the pieces it is in or next to, and those further on are the same again, wherever they have moved to.
Stretches without such a place (a short period) are cut every LONGEST. A piece has 17 code points on average.

Equality of prefixes is monotone in the length, so the longest common prefix (and suffix) on the grid is again
found by binary search. The likeness of two fingerprints is this prefix and suffix and the pieces between them that
both texts have (each as often as in both), as a share of the longer text (1 for equal texts). So it is a lower bound of
what the texts share (but for equal 31-bit hashes of different pieces); an edit costs about two pieces.

A null text counts as empty. The empty text's fingerprint is that of length 0; two empty texts are alike (1). Rows with a
null doc_id come first in the order, repeated ids follow each other, and repeated rows come out as often; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bounds_below, bounds_json, light, own_partition

#: Two primes below 2**31, and a base for each.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749)
#: Lengths of prefixes and suffixes that a fingerprint has, as far as the text is as long.
GRID = sorted({round(2 ** (k / 4)) for k in range(4 * 40)})
#: Code points whose hash decides on a cut, places on each side that it is held against (a power of two), longest piece.
WINDOW, REACH, LONGEST = 6, 8, 64
#: Cells that the order of all documents is cut into, at most.
MOST_CELLS = 100_000
#: A piece in a fingerprint.
PIECE = np.dtype([("length", "u1"), ("hash", ">u4")])


class Powers:
    """Powers of the bases, as far as a text has needed them."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]

    def get(self, n: int) -> list[np.ndarray]:
        while len(self.up[0]) < n:
            for k, p in enumerate(PRIMES):
                step = np.uint64(pow(BASES[k], len(self.up[k]), p))
                self.up[k] = np.concatenate([self.up[k], self.up[k] * step % np.uint64(p)])
        return self.up


POWERS = Powers()


class PrefixHashes:
    """The modular prefix arrays of a text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.length = len(codes)
        up = POWERS.get(self.length + 1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.length + 1, np.uint64)
            np.cumsum(codes * up[k][: self.length] % np.uint64(p), out=sums[1:])
            sums %= np.uint64(p)
            self.sums.append(sums)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The hash of text[a:b], whatever its place."""
        return tuple((int(s[b]) - int(s[a])) * pow(BASES[k], -a, PRIMES[k]) % PRIMES[k] for k, s in enumerate(self.sums))

    def equal(self, a: int, other: PrefixHashes, b: int, length: int) -> bool:
        """Whether text[a:a+length] is the other's [b:b+length]."""
        up = POWERS.get(max(a, b) + 1)
        return all((int(s[a + length]) - int(s[a])) * int(up[k][b]) % PRIMES[k] == (int(o[b + length]) - int(o[b])) * int(up[k][a]) % PRIMES[k] for k, (s, o) in enumerate(zip(self.sums, other.sums, strict=True)))

    def common_extension(self, a: int, other: PrefixHashes, b: int) -> int:
        """How far text[a:] and the other's [b:] agree."""
        low, high = 0, min(self.length - a, other.length - b)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(a, other, b, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hashes, by the first prime, of text[a:b] for each a and b."""
        p, s = np.uint64(PRIMES[0]), self.sums[0]
        return (s[b] + p - s[a]) % p * _inverse(a) % p

    def cuts(self) -> np.ndarray:
        """Where the pieces of the text begin, and its end."""
        n, none = self.length, np.zeros(0, np.int64)
        at = none
        if n > WINDOW:
            begins = np.arange(n - WINDOW + 1)
            h = np.concatenate([np.full(REACH, 1 << 32, np.uint64), self.spans(begins, begins + WINDOW), np.full(REACH, 1 << 32, np.uint64)])
            least, k = h, 1
            while k < REACH:
                least, k = np.minimum(least[:-k], least[k:]), 2 * k
            own = h[REACH:-REACH]
            at = np.flatnonzero((own < least[: len(own)]) & (own <= least[REACH + 1 :]))
        at = np.concatenate([[0], at[at > 0], [n]]).astype(np.int64) if n else none
        if len(at) and (at[1:] - at[:-1]).max() > LONGEST:
            at = np.append(np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]), n)
        return at

    def fingerprint(self) -> str:
        """Length, hash of the whole, prefix hashes and suffix hashes on the grid, length and hash of each piece; in hex."""
        n = self.length
        grid = GRID[: bisect_right(GRID, n)]
        ends = np.array([*grid, n], np.int64)
        heads = [s[ends] for s in self.sums]
        whole = (int(heads[0][-1]) << 32) | int(heads[1][-1])
        tails = self.spans(n - ends[:-1], np.full(len(grid), n))
        cuts = self.cuts()
        pieces = np.zeros(max(len(cuts) - 1, 0), PIECE)
        pieces["length"], pieces["hash"] = np.diff(cuts), self.spans(cuts[:-1], cuts[1:])
        return f"{n:x}.{whole:016x}.{heads[0][:-1].astype('>u4').tobytes().hex()}.{tails.astype('>u4').tobytes().hex()}.{pieces.tobytes().hex()}"


_down = [np.ones(1, np.uint64)]


def _inverse(at: np.ndarray) -> np.ndarray:
    """Inverse powers of the first base."""
    while len(at) and len(_down[0]) <= int(at.max()):
        step = np.uint64(pow(BASES[0], -len(_down[0]), PRIMES[0]))
        _down[0] = np.concatenate([_down[0], _down[0] * step % np.uint64(PRIMES[0])])
    return _down[0][at]


def likeness(a: str, b: str) -> float:
    """0 to 1: how much of the longer text the common prefix, suffix and pieces are, as far as two fingerprints tell."""
    if a == b:
        return 1.0
    (n, _, heads, tails, pieces), (m, _, other_heads, other_tails, other_pieces) = a.split("."), b.split(".")
    n, m = int(n, 16), int(m, 16)

    def common(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y)) // 8
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[8 * mid - 8 : 8 * mid] == y[8 * mid - 8 : 8 * mid] else (low, mid - 1)
        return GRID[low - 1] if low else 0

    head, tail = common(heads, other_heads), common(tails, other_tails)
    between = inner_pieces(pieces, head, n - tail) & inner_pieces(other_pieces, head, m - tail)
    return min(head + tail + sum(x[0] * k for x, k in between.items()), n, m) / max(n, m)


def inner_pieces(pieces: str, begin: int, end: int) -> Counter:
    """How often each piece (length, hash) is within text[begin:end]."""
    x = np.frombuffer(bytes.fromhex(pieces), PIECE)
    ends = np.cumsum(x["length"], dtype=np.int64)
    x = x[(ends - x["length"] >= begin) & (ends <= end)]
    return Counter(zip(x["length"].tolist(), x["hash"].tolist(), strict=True))


def in_order(docs: DataFrame, rows_a_cell: int = 1_000) -> DataFrame:
    """doc_id, text, `cell` and `extra`, in order of doc_id in cells, each wholly in one partition of its own; the first row
    of each cell also ends the cell before it, and the first of all ends the last. So in a cell each row but the last, which
    is such a copy (`extra`), has its successor next. Rows with a null doc_id come first; equal ids are in order of a hash of
    their text, then of the text. Cells are cut by a range shuffle of ids and hashes, so that a repeated id (or null) may
    span many; there are at most MOST_CELLS. The driver sees one key a cell."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h"))
    rows = docs.select(key.alias("key"), text.alias("text"))
    n = rows.count()
    wanted = max(1, min(n // rows_a_cell, MOST_CELLS))
    keys = rows.select("key")
    firsts = keys.repartitionByRange(wanted, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    bounds = sorted({tuple(r["key"]) for r in firsts.collect()})
    if not bounds:
        return rows.select(F.col("key.id").alias("doc_id"), "text", F.lit(0).alias("cell"), F.lit(False).alias("extra"), "key")
    cell = bounds_below(F.col("key"), bounds, "known boolean, id long, h long", inclusive=True) - 1
    placed = rows.select("key", "text", cell.alias("cell"), F.lit(False).alias("extra"))
    # The copies: of each cell's first key, one row (the least text).
    first_ids = list({b[1] for b in bounds if b[0]})
    some = docs.where(F.col("doc_id").isin(first_ids) | F.col("doc_id").isNull()) if not all(b[0] for b in bounds) else docs.where(F.col("doc_id").isin(first_ids))
    heads = some.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text")).groupBy("key").agg(F.min("text").alias("text")).select("key", "text", cell.alias("cell"))
    # Of what these ids hold, the rows that are a cell's first.
    first_of = F.get(F.from_json(F.lit(bounds_json(bounds, ["known", "id", "h"])), "array<struct<known:boolean,id:long,h:long>>"), F.col("cell"))
    heads = heads.where(first_of == F.col("key"))
    copies = heads.select("key", "text", F.pmod(F.col("cell") - 1, F.lit(len(bounds))).cast("int").alias("cell"), F.lit(True).alias("extra"))
    at = own_partition(spark, len(bounds), F.col("cell"))
    both = placed.unionByName(copies).withColumn("at", at).repartition(len(bounds), "at").sortWithinPartitions("cell", "extra", "key", F.coalesce("text", F.lit("")))
    return both.select(F.when(F.col("key.known"), F.col("key.id")).alias("doc_id"), "text", "cell", "extra")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row. The edited
    text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's. One
    shuffle of the whole texts."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row that waits for its successor
        for batch in batches:
            rows: list[tuple] = []
            for id_, text, cell, extra in zip(batch["doc_id"].to_pylist(), batch["text"], batch["cell"].to_pylist(), batch["extra"].to_pylist(), strict=True):
                text = text.as_py() or ""
                mark = PrefixHashes(text).fingerprint()
                if last is not None and last[2] == cell:
                    before, old, _, old_mark = last
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    edited_mark = PrefixHashes(edited).fingerprint()
                    rows.append((before, len(old), hashlib.sha256(edited.encode()).hexdigest(), old_mark, edited_mark, likeness(old_mark, edited_mark), likeness(old_mark, mark)))
                last = None if extra else (id_, text, cell, mark)
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return in_order(docs).select("doc_id", "text", "cell", "extra").mapInArrow(light(run), schema)

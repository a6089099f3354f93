"""Byte-level BPE encoding and decoding by monoid tree reduction.

The tokens of a byte string form a monoid element: the string is halved down to single tokens, and two
neighbouring results are joined. A join re-encodes a window around the seam; the window grows, a token to a
side and then in doubled steps, until the token pairs at both of its edges are stable. Two neighbouring tokens are stable if encoding
their concatenation gives back these two. A sequence whose neighbouring pairs are all stable is the encoding of
its bytes: merges inside a token depend on nothing outside, and no merge across an edge ever gets its turn,
since the same candidate would have won in the pair alone. Tokens outside the window were already stable with
each other, so the checks at the two edges prove the whole join. Decoding concatenates bytes up the same tree.

Results for odd input: null and empty texts have no tokens; texts of any length are encoded whole, match by match, in memory for the
text and its ids; rows that repeat an id, and equal texts, each come out; an empty table gives no rows. There are no ties: ids are
those of the ranks. Further columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import light
from corpusmill.llm.split import splitter

#: Distinct pieces that a worker remembers before it starts afresh; bounds memory, never changes results.
REMEMBERED = 200_000
NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """The encodings of pieces, made as they are asked for; short ones are remembered."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(piece.encode())).tobytes()
        if len(piece) < 256:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class TreeCodec:
    """Encoder and decoder over one vocabulary and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split = splitter(pattern)
        self._pieces = Pieces(self.encode_bytes)
        self._parts: dict[bytes, list[int]] = {}
        self._windows: dict[bytes, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The plain definition, for windows: merge the lowest-ranked leftmost pair until none is left."""
        if len(data) > 48:
            return self._merge_long(data)
        known = self._windows.get(data)
        if known is not None:
            return known
        ranks = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while costs and (best := min(costs)) != NONE:
            at = costs.index(best)
            parts[at : at + 2] = [new := parts[at] + parts[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = ranks(new + parts[at + 1], NONE)
            if at:
                costs[at - 1] = ranks(parts[at - 1] + new, NONE)
        out = [self.ranks[p] for p in parts]
        if len(self._windows) >= REMEMBERED:
            self._windows.clear()
        self._windows[data] = out
        return out

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of candidate pairs over a linked list, for long windows."""
        n, ranks = len(data), self.ranks
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or (j := after[i]) >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            gone[j], end[i], after[i] = 1, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[data[i : end[i]]] for i in range(n) if not gone[i]]

    def stable(self, a: int, b: int) -> bool:
        """Whether a followed by b is the encoding of their bytes."""
        known = self._pairs.get((a, b))
        if known is None:
            known = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            self._pairs[a, b] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' concatenation."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j, grow = len(left) - 1, 1, 1  # the window is left[i:] + right[:j]
        while True:
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            left_ok = i == 0 or self.stable(left[i - 1], window[0])
            right_ok = j == len(right) or self.stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[:i] + window + right[j:]
            i = max(0, i - grow * (not left_ok))
            j = min(len(right), j + grow * (not right_ok))
            grow *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        """Tokens of one piece, by halving down to what is a token, and so its own encoding (a byte always is)."""
        if (own := self.ranks.get(data)) is not None:
            return [own]
        known = self._parts.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:])) if data else []
            if len(data) <= 9:
                if len(self._parts) >= REMEMBERED:
                    self._parts.clear()
                self._parts[data] = known
        return known

    def encode(self, text: str) -> bytes:
        """Tokens of a text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._pieces.__getitem__, self.split(text)))

    def forget(self) -> None:
        """Drop what grows with the texts; workers live on after a task, and other operators need the memory."""
        for known in (self._pieces, self._parts, self._windows, self._pairs):
            if known is self._pieces or len(known) > REMEMBERED // 8:
                known.clear()

    def decode(self, ids: array | list[int]) -> bytes:
        """Bytes of tokens, concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[tuple[str, str], TreeCodec] = {}


def codec(path: str, pattern: str) -> TreeCodec:
    """The worker's codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TreeCodec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def bpe(docs: DataFrame, path: str, pattern: str, tokens: bool = False) -> DataFrame:
    """Encode and decode the text of each row: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip.

    With `tokens`, also the ids (binary, unsigned 32-bit little-endian) and the decoded text's bytes.
    A row gives a row: nothing is shuffled, and a lost task is only run again. `path` must exist on each worker.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    schema += ", ids binary, decoded binary" * tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = c.encode(text)
                back = c.decode(array("I", ids))
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode())
                out.append((*row, ids, back) if tokens else row)
            cols = list(zip(*out, strict=True)) if out else [()] * (len(names) - 1)
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.binary()]
            arrays = [pa.array(x, t) for x, t in zip(cols, types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], names)
        c.forget()

    return docs.select("doc_id", "text").mapInArrow(light(run), schema)

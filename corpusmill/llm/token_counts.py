"""Token counts by greedy longest match, with a linear automaton.

The trie of the vocabulary gets failure links: where the walk from the root can't go on, the longest token on
the path is popped, and the walk resumes at the node that spells the rest. `links` holds, for each node, that
node and how many tokens are popped on the way. So counting takes each byte once and builds no pieces.

Texts are first split by the vocabulary's pattern, and each match is counted by itself. All single bytes must
be tokens; then each byte string has a count. Null and empty texts have 0 tokens. A long text is held whole, its matches are counted one
by one. Rows that repeat an id each come out, an empty table gives no rows, and further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.bpe import REMEMBERED, load_ranks
from corpusmill.llm.common import light
from corpusmill.llm.split import splitter


class LongestMatch:
    """Counts greedy longest-match tokens in one pass."""

    def __init__(self, vocabulary: set[bytes], pattern: str | None = None):
        if missing := [b for b in range(256) if bytes([b]) not in vocabulary]:
            raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
        self.next: list[dict[int, int]] = [{}]
        ends, text = [False], [b""]
        for token in sorted(vocabulary):
            node = 0
            for b in token:
                to = self.next[node].get(b)
                if to is None:
                    to = self.next[node][b] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                    text.append(text[node] + bytes([b]))
                node = to
            ends[node] = bool(token)
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        for node in sorted(range(1, len(self.next)), key=lambda v: len(text[v])):
            if ends[node]:  # the whole path is one token
                self.fail[node], self.popped[node] = 0, 1
                continue
            # The parent pops its longest token; what it keeps, and this byte, go on from there.
            parent, byte = self._parent(text[node]), text[node][-1]
            at, count = self.fail[parent], self.popped[parent]
            while byte not in self.next[at]:
                count += self.popped[at]
                at = self.fail[at]
            self.fail[node], self.popped[node] = self.next[at][byte], count
        self.known: dict[str, int] = {}
        if pattern is not None:
            self.split = splitter(pattern)

    def _parent(self, path: bytes) -> int:
        node = 0
        for b in path[:-1]:
            node = self.next[node][b]
        return node

    def count(self, data: bytes) -> int:
        """Greedy longest-match tokens in data."""
        step, fail, popped = self.next, self.fail, self.popped
        at = total = 0
        for b in data:
            while (to := step[at].get(b)) is None:
                total += popped[at]
                at = fail[at]
            at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total

    def count_text(self, text: str) -> int:
        """Sum over the pattern's matches; counts of short ones are remembered."""
        known, total = self.known, 0
        for piece in self.split(text):
            n = known.get(piece)
            if n is None:
                n = self.count(piece.encode())
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) < 256:
                    known[piece] = n
            total += n
        return total


_automata: dict[tuple[str, str], LongestMatch] = {}


def automaton(path: str, pattern: str) -> LongestMatch:
    """The worker's automaton for a rank file."""
    if (path, pattern) not in _automata:
        _automata[path, pattern] = LongestMatch(set(load_ranks(path)), pattern)
    return _automata[path, pattern]


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens (greedy longest match), n_bytes of each row's whole text; a row gives a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path, pattern)
        count = machine.count_text
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            cols = [batch.column(0).cast(pa.int64()), pa.array([count(x) for x in texts], pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_bytes"])
        machine.known.clear()  # workers live on

    return docs.select("doc_id", "text").mapInArrow(light(run), "doc_id long, n_tokens long, n_bytes long")

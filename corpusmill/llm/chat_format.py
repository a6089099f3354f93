"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>` role newline text `<|im_end|>` newline. Inside roles and texts control strings are
escaped: in each `<`, any number of `!`, `|` one more `!` goes in after the `<`. So no text holds `<|`, and taking
one `!` away gives the text back. In roles, `%` and line ends are written %25, %0A and %0D.

Assembly is columnar: the lengths of all pieces (start, role, newline, text, end) of a batch give cumulative
offsets, these give the place of each byte, and headers and contents are scattered into one buffer, which is the
data of an Arrow array. Turns are sorted within a conversation by turn, then role and text. A conversation's turns
pass through a task as a stream, so a very long one needs no more memory than a batch.

Null texts and roles count as empty; rows with a null conv_id form one conversation with that id; repeated rows are
repeated turns; a batch without rows gives none. A long text needs memory for a few copies of itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import blocks, raw

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Bytes of roles and texts that are assembled at a time (a longer turn alone).
ASSEMBLED = 16 << 20
#: Bytes that indices are made for, and that are unescaped, at a time.
PART = 1 << 18


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows' bytes with control strings escaped, and the rows' new offsets."""
    bars = np.flatnonzero(data == 124)
    if len(bars):
        other = np.flatnonzero(data != 33)
        before = np.searchsorted(other, bars) - 1  # the last byte before the bar that is no `!`
        at = other[np.maximum(before, 0)]
        row_start = offsets[np.searchsorted(offsets, bars, "right") - 1]
        at = at[(before >= 0) & (at >= row_start) & (data[at] == 60)]
    else:
        at = bars
    if not len(at):
        return data, offsets
    return np.insert(data, at + 1, 33), offsets + np.searchsorted(at, offsets, "left")


def unescape(data: bytes) -> bytes:
    """The text of an escaped one."""
    if b"<!" not in data:
        return data
    out, at = [], 0
    while at < len(data):  # an escape ends with its bar, so parts that end with one can be taken by themselves
        end = data.find(b"|", at + PART) + 1 or len(data)
        out.append(re.sub(rb"<!(!*\|)", rb"<\1", data[at:end]))
        at = end
    return b"".join(out)


def assemble(roles: pa.Array, texts: pa.Array) -> pa.Array:
    """The formatted turns, as one binary array over one buffer."""
    roles = pa.array([(x.as_py() or "").replace("%", "%25").replace("\n", "%0A").replace("\r", "%0D") for x in roles], pa.string())
    role, role_at = escape(*raw(roles))
    text, text_at = escape(*raw(texts))
    n = len(role_at) - 1
    lengths = np.zeros((n, 5), np.int64)
    lengths[:] = len(START), 0, 1, 0, len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, piece in ((0, START), (2, b"\n"), (4, END)):
        out[begins[:, k, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    for k, data, at in ((1, role, role_at), (3, text, text_at)):
        for a, b in blocks(at, PART):
            here = data[at[a] : at[b]]
            if b - a == 1:
                out[begins[a, k] : begins[a, k] + len(here)] = here
            else:
                out[np.repeat(begins[a:b, k] - at[a:b], np.diff(at[a : b + 1])) + np.arange(at[a], at[b])] = here
    offsets = np.concatenate([[0], ends[:, -1]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def read_back(data: bytes) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """Role, text and the span of the (escaped) text of each formatted turn."""
    end = 0
    while end < len(data):
        # No text holds the two bytes that the marks begin with, so the next ones are this turn's end.
        begin = data.find(b"\n", end) + 1
        stop = data.find(START[:2], begin)
        if not data.startswith(START, end) or not begin or not data.startswith(END, max(stop, 0)):
            raise ValueError("not a formatted conversation")
        role = unescape(data[end + len(START) : begin - 1]).decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        yield role, unescape(data[begin:stop]).decode(), (begin, stop)
        end = stop + len(END)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Each conversation's turns in one task, one after the other."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted (binary; a conversation's is their concatenation), loss_start, loss_end (the
    bytes of it under the loss mask: an assistant's text, else both 0). Sorted by conv_id and turn in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, a, b in ((x, a, b) for x in batches for a, b in blocks(raw(x["role"])[1] + raw(x["text"])[1], ASSEMBLED)):
            batch = whole.slice(a, b - a)
            done = assemble(batch["role"], batch["text"])
            length = np.diff(np.frombuffer(done.buffers()[1], np.int64))
            role = np.array([x.as_py() == "assistant" for x in batch["role"]], bool)
            head = len(START) + len(b"assistant\n")
            start, end = np.where(role, head, 0), np.where(role, length - len(END), 0)
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], batch["role"], done.cast(pa.binary()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    return ordered_turns(conversations).mapInArrow(run, "conv_id long, turn long, role string, formatted binary, loss_start long, loss_end long")


def formatted_digests(turns: DataFrame) -> DataFrame:
    """Reads formatted_turns back: conv_id, n_turns, turns_sha256 (of role, newline, text, newline for each turn),
    loss_chars, loss_sha256 (of all text under the loss mask, unescaped), formatted_chars."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: list | None = None

        def emit() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], [x.split()[0] for x in schema.split(", ")])

        def close() -> None:
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for conv, data, start, end in zip(batch["conv_id"].to_pylist(), batch["formatted"], batch["loss_start"].to_pylist(), batch["loss_end"].to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = data.as_py()
                for role, text, _ in read_back(data):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(data[start:end])
                now[3] += len(loss.decode())
                now[4].update(loss)
                now[5] += len(data.decode())
            if rows:
                yield emit()
        if now is not None:
            close()
            yield emit()

    return turns.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)

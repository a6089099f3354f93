"""Passes that depend on order (token budgets, chunks of rows) over groups of any size, spread over all tasks.

A group's rows are sorted over many partitions, and written once. What a pass does in a partition depends on what came before by one number
only (the tokens in the open chunk, or the tokens taken), so each partition first tells what it makes of that number:

- chunks: where a chunk that begins at a row ends is found for all rows by prefix sums and binary search, and where the chain of chunks
  from a row leads by pointer doubling. Only the rows before the partition's first chunk end depend on the number, so the answer is a table
  of as many entries as fit in one chunk.
- budgets: a partition whose sum still fits is taken whole, one whose least row doesn't is left whole. Any other is folded when its turn
  comes; each takes at least one row that fits, after which fewer fit.

The driver follows the numbers from partition to partition (a few for each), and a last pass marks all rows at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources import folders


def taken(tokens: np.ndarray, room: int) -> np.ndarray:
    """Which rows a budget takes, in order: one that doesn't fit is left out, and later ones may still fit."""
    out = np.zeros(len(tokens), bool)
    left = np.flatnonzero(tokens <= room)
    while len(left):
        sums = np.cumsum(tokens[left])
        n = int(np.searchsorted(sums, room, "right"))
        out[left[:n]] = True
        room -= int(sums[n - 1]) if n else 0
        left = left[n + 1 :]
        left = left[tokens[left] <= room]
    return out


def next_starts(sums: np.ndarray, limit: int) -> np.ndarray:
    """For each row, where the chunk after the one that begins there begins (the number of rows: nowhere); one more entry for the end."""
    base = np.append(0, sums[:-1])
    over = np.searchsorted(sums, base + limit, "right")
    some = np.searchsorted(sums, base, "right") + 1  # a chunk ends only after a row with tokens
    return np.append(np.minimum(np.maximum(over, some), len(sums)), len(sums))


def chains(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the last chunk start that the chain from it reaches, and how many steps that is: by pointer doubling."""
    n = len(starts) - 1
    jump, last = starts.copy(), np.where(starts < n, starts, np.arange(n + 1))
    steps = (starts < n).astype(np.int64)
    while (jump < n).any():
        on = np.flatnonzero(jump < n)
        steps[on] += steps[jump[on]]
        last[on] = last[jump[on]]
        jump = jump[jump]
    return last, steps


def first_start(sums: np.ndarray, limit: int, total: int) -> int:
    """Where the first new chunk begins, if the open one has `total` tokens."""
    if total:
        return int(np.searchsorted(sums, limit - total, "right")) if total <= limit else 0
    return int(next_starts(sums, limit)[0]) if len(sums) else 0


def numbered(tokens: np.ndarray, limit: int, total: int, number: int) -> tuple[np.ndarray, int]:
    """Each row's chunk, and the tokens in the open one at the end."""
    sums = np.cumsum(tokens)
    starts, at, found = next_starts(sums, limit), first_start(sums, limit, total), []
    while at < len(tokens):
        found.append(at)
        at = int(starts[at])
    marks = np.zeros(len(tokens), np.int64)
    marks[found] = 1
    end = int(sums[-1] - (sums[found[-1] - 1] if found and found[-1] else 0)) + (0 if found else total)
    return number + np.cumsum(marks), end


def segments(groups: pa.ChunkedArray) -> list[tuple[str | None, int, int]]:
    """Runs of equal groups: (group, from, to)."""
    names = groups.to_pylist()
    cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
    return [(names[a], a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def summary(tokens: np.ndarray, limit: int, budget: bool) -> dict:
    """What a run of rows makes of the number that comes in."""
    sums = np.cumsum(tokens)
    if budget:
        some = tokens[tokens > 0]
        return {"sum": int(sums[-1]), "least": int(some.min()) if len(some) else None}
    last, steps = chains(next_starts(sums, limit))
    reach = int(np.searchsorted(sums, limit, "right")) + 1  # rows at which the first new chunk may begin
    at = np.arange(min(reach, len(tokens)))
    open_ = sums[-1] - np.where(last[at] > 0, sums[last[at] - 1], 0)
    whole = first_start(sums, limit, 0)
    return {"sum": int(sums[-1]), "sums": sums[:reach].tolist(), "open": open_.tolist(), "steps": (steps[at] + 1).tolist(), "none": numbered(tokens, limit, 0, 0)[1], "none_steps": int(steps[0]) if whole < len(tokens) else 0}


def after(run: dict, limit: int, total: int, number: int) -> tuple[int, int]:
    """(total, number) after a run of rows that comes with these."""
    if not total:
        return run["none"], number + run["none_steps"]
    at = int(np.searchsorted(run["sums"], limit - total, "right")) if total <= limit else 0
    return (total + run["sum"], number) if at >= len(run["open"]) else (run["open"][at], number + run["steps"][at])


def spread(rows: DataFrame, limit: int, budget: bool) -> DataFrame:
    """rows (g, o, tokens) with taken (of a budget) or chunk, by group in order."""
    spark = rows.sparkSession
    folders.shared(spark)
    placed = rows.repartitionByRange("g", "o").sortWithinPartitions("g", "o").withColumn("part", F.spark_partition_id()).checkpoint(eager=True)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        whole = pa.Table.from_batches(held)
        tokens, runs = whole["tokens"].to_numpy(), segments(whole["g"])
        (first, _, b), (last, a, _) = runs[0], runs[-1]
        end = None
        if len(runs) > 1:
            own = tokens[a:]
            end = [int(own[taken(own, limit)].sum()), 0] if budget else (lambda c: [c[1], int(c[0][-1])])(numbered(own, limit, 0, 0))
        told = json.dumps({"first": first, "last": last, "run": summary(tokens[:b], limit, budget), "end": end})
        yield pa.RecordBatch.from_arrays([pa.array([whole["part"][0].as_py()], pa.int32()), pa.array([told])], ["part", "told"])

    states = followed(spark, placed, sorted(tuple(r) for r in placed.mapInArrow(tell, "part int, told string").collect()), limit, budget)
    kind = "taken boolean" if budget else "chunk long"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        whole = pa.Table.from_batches(held)
        tokens, out = whole["tokens"].to_numpy(), []
        state = states.get(whole["part"][0].as_py(), (0, 0))
        for _, a, b in segments(whole["g"]):
            out.append(taken(tokens[a:b], limit - state[0]) if budget else numbered(tokens[a:b], limit, *state)[0])
            state = (0, 0)
        marks = pa.chunked_array([pa.array(np.concatenate(out))])
        yield from whole.select(["g", "o", "tokens"]).append_column(kind.split()[0], marks).combine_chunks().to_batches(10_000)

    return placed.mapInArrow(mark, f"g string, o {dict(rows.dtypes)['o']}, tokens long, {kind}")


def followed(spark: SparkSession, placed: DataFrame, told: list[tuple[int, str]], limit: int, budget: bool) -> dict[int, tuple[int, int]]:
    """The numbers that come into each partition whose first group goes on from the one before."""
    states: dict[int, tuple[int, int]] = {}
    before, state = object(), (0, 0)
    for part, text in told:
        x = json.loads(text)
        state = state if x["first"] == before else (0, 0)
        if state != (0, 0):
            states[part] = state
        run = x["run"]
        if x["end"] is not None:
            state = tuple(x["end"])
        elif not budget:
            state = after(run, limit, *state)
        elif state[0] + run["sum"] <= limit:
            state = state[0] + run["sum"], 0
        elif run["least"] is not None and state[0] + run["least"] <= limit:
            state = folded(placed, part, limit, state[0]), 0
        before = x["last"]
    return states


def folded(placed: DataFrame, part: int, limit: int, total: int) -> int:
    """The tokens taken after a partition of one group, in which some rows fit and some don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([np.zeros(0, np.int64), *(b["tokens"].to_numpy() for b in batches)])
        if len(tokens):
            yield pa.RecordBatch.from_arrays([pa.array([int(tokens[taken(tokens, limit - total)].sum())])], ["n"])

    return total + sum(r["n"] for r in placed.where(F.col("part") == part).select("tokens").mapInArrow(run, "n long").collect())

"""Sharding by histogram sort, from DataFrame functions only.

Rows are ordered by a 60-bit key of their text (so equal texts lie side by side), then by id. A shard is a run
of that order with an equal part of all bytes: a row is in shard floor(bytes before it * shards / all bytes).
Where shards begin is found without sorting: each round counts exact bytes below candidate keys in all
partitions, keeps for each wanted boundary the interval that holds it, and probes inside that interval; inside
a single key (a group of copies of any size) it probes ids. Where a boundary falls inside repeated rows (equal text and
id), these get random numbers, written once to the shared folder, and a third level probes those. It ends when each
interval has one row. This works on sizes, keys and ids. Then the whole rows, with text and all other columns, are read
again and dealt out by one exchange: each shard in pieces of about PIECE_BYTES, a task for each piece. The rows of
each piece are counted before, so a slot is the number of rows in the pieces before plus the place in the piece. The
driver sees a few hundred sums a round and a count a piece, never rows.

Law: `bytes`. Sizes differ by at most the size of the rows at the two ends. A null text has no bytes, and counts
as the empty text. An empty table gives no rows. Equal rows that a boundary does not part are in order of their
other columns (if these have an order: a map has none).
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import bounds_below, cut, own_partition

#: Keys, and the numbers of repeated rows, are below this.
KEYS = 1 << 60
#: Bytes of a piece of a shard, and how many pieces there are at most.
PIECE_BYTES, MOST_PIECES = 64 << 20, 20_000


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def size(text: Column) -> Column:
    """The bytes that a row counts for."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """Each row of docs as the struct `row`, and its sort key (k, id, nth). A null id comes first; nth is 0."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(row, text_key(F.col("text")).alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("id"), F.lit(0).cast("long").alias("nth"))


def splitters(rows: DataFrame, shards: int, probes: int = 64) -> list[tuple[int, int, int, bool]]:
    """For each shard but the last, the (key, id, nth) of its last row: the first at which the bytes reach its part; and whether
    that is several rows.

    Each round counts the bytes in the cells of the intervals that hold a boundary, and goes on in the cell that
    does. A cell is a range of keys or, once it has one key only, of that key's ids, or of one id's nths. A round narrows an
    interval to one of `probes` parts (of the whole, `shards` times as many), so there are few rounds at any size.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return []
    wanted = [-(-i * total // shards) for i in range(1, shards)]
    found: dict[int, tuple[int, int, int, bool]] = {}
    # Of each open boundary: the values that are fixed, the interval of the next, and the bytes below it.
    open_: dict[int, tuple[tuple[int, ...], int, int, int]] = {i: ((), 0, KEYS - 1, 0) for i in range(len(wanted))}
    names = ["k", "id", "nth"]
    while open_:
        cells = sorted({x[:3] for x in open_.values()})
        parts = probes * shards if len(cells) == 1 else probes
        cell, part = F.lit(None).cast("int"), F.lit(None).cast("long")
        for n, (fixed, a, b) in enumerate(cells):
            name, step = names[len(fixed)], max(1, -(-(b - a + 1) // parts))
            here = F.col(name).between(a, b)
            for c, v in zip(names, fixed, strict=False):
                here = here & (F.col(c) == v)
            cell, part = F.when(here, n).otherwise(cell), F.when(here, F.expr(f"({name} - {a}L) div {step}L")).otherwise(part)
        counted = rows.select("k", "id", "nth", "size", cell.alias("cell"), part.alias("part")).where("cell is not null").groupBy("cell", "part")
        sums = sorted(tuple(r) for r in counted.agg(F.sum("size"), F.count("*"), *[f(c) for c in names for f in (F.min, F.max)]).collect())
        for i, state in list(open_.items()):
            below = state[3]
            for n, _, bytes_, count, *ends in sums:
                if cells[n] != state[:3]:
                    continue
                if below + bytes_ >= wanted[i]:
                    for at in range(3):
                        if ends[2 * at] < ends[2 * at + 1]:
                            open_[i] = (tuple(ends[: 2 * at : 2]), ends[2 * at], ends[2 * at + 1], below)
                            break
                    else:
                        found[i] = (*ends[::2], count > 1)
                        del open_[i]
                    break
                below += bytes_
    return [found[i] for i in range(len(wanted))]


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """`row` (each row of docs as a struct), shard (0 to shards - 1) and slot (gapless from 0 within the shard, in key
    order). A piece's rows come out in one partition, in the order of their slots."""
    rows = keyed(docs)
    measured = lambda x: cut(x.select("k", "id", "nth", size(F.col("row.text")).alias("size")))
    keys = measured(rows)
    ends = splitters(keys, shards)
    if any(several for *_, several in ends):
        split = F.lit(False)
        for k, i in {(k, i) for k, i, _, several in ends if several}:
            split = split | ((F.col("k") == k) & (F.col("id") == i))
        numbered = cut(rows.where(split).withColumn("nth", F.floor(F.rand() * KEYS).cast("long")))
        rows = rows.where(~split).unionByName(numbered)
        keys = keys.where(~split).unionByName(measured(numbered))
        ends = splitters(keys, shards)
    last = [e[:3] for e in ends]
    total, key = keys.agg(F.sum("size")).first()[0] or 0, F.struct("k", "id", "nth")
    # Pieces are cut at the ends of the partitions of a range shuffle of the keys, and at the ends of shards.
    wanted = min(-(-total // PIECE_BYTES), MOST_PIECES)
    more = [] if wanted <= shards else [tuple(r["key"]) for r in keys.select(key.alias("key")).repartitionByRange(wanted, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("key")).collect()]
    cuts = sorted({*last, *more})
    piece = bounds_below(key, cuts, "k long, id long, nth long")
    counts = {r["piece"]: r["count"] for r in keys.groupBy(piece.alias("piece")).count().collect()}
    last.sort()
    shard_of = [0, *(bisect_left(last, c) + last.count(c) for c in cuts)]
    before, slots = [0] * shards, []
    for p, s in enumerate(shard_of):
        slots.append(before[s])
        before[s] += counts.get(p, 0)
    of = lambda values, kind: F.get(F.from_json(F.lit(str(values)), f"array<{kind}>"), F.col("piece"))
    rows = rows.withColumn("piece", piece)
    rows = rows.withColumn("at", own_partition(docs.sparkSession, len(shard_of), F.col("piece"))).repartition(len(shard_of), "at")
    # The order by whole rows also takes them through the exchange with all columns, whatever is selected later.
    order = ["k", "id", "nth"] if re.search(r"\bmap<|\bvariant\b", rows.schema["row"].dataType.simpleString()) else ["k", "id", "nth", "row"]
    slot = F.row_number().over(Window.partitionBy("at").orderBy(*order)) - 1
    return rows.select("row", of(shard_of, "int").alias("shard"), (slot + of(slots, "bigint")).cast("long").alias("slot"))


def histogram_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Of each row that comes out in a shard: doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null:
    this law has none)."""
    text = F.col("row.text")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    return sharded(docs, shards).select(F.col("row.doc_id").cast("long").alias("doc_id"), size(text).alias("size"), crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

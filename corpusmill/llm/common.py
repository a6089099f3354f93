"""What several operators of this package share: tables, checkpoints, Arrow text, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that the vectorised loops take at a time (a longer text is taken alone).
BLOCK = 1 << 18
#: Each byte with A-Z lower-cased, and masks of the first 0 to 8 bytes of a lane.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A session's setting: a plan's shuffle files go when it has run, not when the driver's garbage collector finds them.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the folder may be in a store that only Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Where none is set, a folder below the warehouse, if all runs on one machine;
    else this is an error, as executors could not read what others have written."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Plans that are made and run herein leave no shuffle files."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute df now and keep it in the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_checkpoints(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, run once


def bounds_json(bounds: list[tuple], names: list[str]) -> str:
    return json.dumps([dict(zip(names, b, strict=True)) for b in bounds])


def bounds_below(key: Column, bounds: list[tuple], fields: str, inclusive: bool = False) -> Column:
    """How many of the sorted bounds are less than key, a struct with these fields (inclusive: or equal), by binary search in
    a constant."""
    names = [x.split()[0] for x in fields.split(", ")]
    all_ = F.from_json(F.lit(bounds_json(bounds, names)), f"array<struct<{fields}>>")

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        bound = F.get(all_, middle)
        up = (bound <= key) if inclusive else (bound < key)
        return F.when(s["lo"] >= s["hi"], s).when(up, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    if not bounds:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step, lambda s: s["lo"])


def own_partition(spark: SparkSession, n: int, number: Column) -> Column:
    """A key for each number from 0 to n - 1, such that repartition(n, key) has a partition for each."""
    keys: dict[int, int] = {}
    size = 8 * n + 64
    while len(keys) < n:
        keys = {r["p"]: r["id"] for r in spark.range(size).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()}
        size *= 2
    return F.get(F.from_json(F.lit(json.dumps([keys[k] for k in range(n)])), "array<bigint>"), number)


def give_back() -> None:
    """Return free memory to the system: a Python worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def light(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives memory back after each batch and at its end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(each(batches))
        give_back()

    return task


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' offsets in them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return whole[first:last], offsets - first


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most `limit` bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHasher:
    """64-bit hashes of words in a block of bytes: eight bytes at a time are mixed in, the words in step; words longer than
    LONG bytes are hashed one by one.

    `letter` maps each byte to True inside words; `fold` maps bytes that count as equal to one (A-Z to a-z). Whoever needs
    certainty compares the words themselves (`edges` tells where they are).
    """

    LONG = 64

    def __init__(self, letter: np.ndarray, salt: int = 1, fold: np.ndarray = LOWER):
        self.letter, self.salt, self.fold = letter, salt, fold
        self.start = U64(int(np.random.default_rng(20_000 + salt).integers(1 << 62, 1 << 63)))

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end (offsets begin at 0; no word goes from one row into the next)."""
        n = len(data)
        inside = self.letter[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and for each row where its words begin among them."""
        starts, ends = self.edges(data, offsets)
        return self.hashes(data, starts, ends), np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each data[start:end]."""
        low = np.zeros(len(data) + 8, np.uint8)
        low[:-8] = self.fold[data]
        lanes = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))
        left = ends - starts
        with np.errstate(over="ignore"):
            out = mixed(self.start + left.astype(np.uint64))
            out = mixed(out ^ (lanes[starts] & LANE[np.minimum(left, 8)]))
            some = np.flatnonzero((left > 8) & (left <= self.LONG))
            at = starts[some]
            while len(some):
                at = at + 8
                rest = ends[some] - at
                out[some] = mixed(out[some] * U64(0x9E3779B97F4A7C15) ^ (lanes[at] & LANE[np.minimum(rest, 8)]))
                more = rest > 8
                some, at = some[more], at[more]
        for k in np.flatnonzero(left > self.LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]], digest_size=8, salt=bytes([self.salt])).digest(), "little")
        return out


def spans(hashes: np.ndarray, width: int, salt: int = 7) -> np.ndarray:
    """Hashes of all runs of `width` words (also across rows; callers leave those out)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(salt * 1000 + width).integers(1, 1 << 63, width, dtype=np.uint64) * U64(2) + U64(1)
    with np.errstate(over="ignore"):
        out = hashes[:n] * factors[0]
        for k in range(1, width):
            out += mixed(hashes[k : k + n] * factors[k]) if k % 2 else hashes[k : k + n] * factors[k]
        return mixed(out)


class Written:
    """A table written to the shared checkpoint folder; drop() deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame):
        shared_checkpoints(df.sparkSession)
        self.spark, self.path = df.sparkSession, f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
        with tidy(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)

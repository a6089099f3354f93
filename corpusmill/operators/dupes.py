"""Duplicate blocks: windows of lines that occur more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import lines, one_spaced


def windows(files: DataFrame, size: int, sliding: bool = False) -> DataFrame:
    """path, signature, start, end of each window of `size` lines, blank ones left out; lines are numbered from 1. Windows
    follow each other without overlap, unless sliding; a shorter rest is no window. All within the file's row."""
    numbered = F.transform(lines(F.col("content")), lambda x, i: F.struct((i + 1).cast("long").alias("n"), one_spaced(x).alias("line")))
    kept = files.select("path", F.filter(numbered, lambda x: x["line"] != "").alias("kept"))
    step = 1 if sliding else size
    count = F.floor((F.size("kept") - size) / step) + 1
    at = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    # `kept` is a column of its own here, so that it is not made again for each window.
    cut = lambda k: F.slice("kept", (k * step + 1).cast("int"), size)
    made = F.transform(at, lambda k: F.struct(F.array_join(F.transform(cut(k), lambda x: x["line"]), "\n").alias("text"), F.get("kept", (k * step).cast("int"))["n"].alias("start"), F.get("kept", (k * step + size - 1).cast("int"))["n"].alias("end")))
    rows = kept.select("path", F.explode(made).alias("w"))
    return rows.select("path", F.sha1(F.col("w.text").cast("binary")).alias("signature"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def duplicate_blocks(files: DataFrame, size: int, sliding: bool = False) -> DataFrame:
    """One row for each block that occurs several times, in one file or in several: signature, lines, occurrences, and the
    first place. Counts are summed before the shuffle; block_places() has all places."""
    first = F.min(F.struct("path", "start", "end"))
    groups = windows(files, size, sliding).groupBy("signature").agg(F.count("*").alias("occurrences"), first.alias("at"))
    return groups.where("occurrences > 1").select("signature", F.lit(size).cast("long").alias("lines"), "occurrences", F.col("at.path").alias("first_path"), F.col("at.start").alias("first_start"), F.col("at.end").alias("first_end"))


def block_places(files: DataFrame, size: int, sliding: bool = False) -> DataFrame:
    """A row for each place of each duplicate block."""
    rows = windows(files, size, sliding)
    return rows.join(duplicate_blocks(files, size, sliding).select("signature"), "signature", "left_semi")


def blocks_in(files: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """Places in files of blocks that the known texts (path, content) have: path, start, known_path. One row a place and
    known text."""
    blocks = windows(known, size).select("signature", F.col("path").alias("known_path")).distinct()
    return windows(files, size).join(blocks, "signature").select("path", "start", "end", "known_path")


def most_repeated(files: DataFrame, size: int, top: int) -> DataFrame:
    """The duplicate blocks that occur most often."""
    return duplicate_blocks(files, size).orderBy(F.desc("occurrences"), "first_path", "first_start").limit(top)

"""What has changed: paths that went, changed or are new, and an index that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_paths(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed paths that are no more."""
    return indexed.join(current, "path", "left_anti").select("path")


def changed_paths(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Current paths (path, mark) that the index does not have with this mark."""
    return current.join(indexed, ["path", "mark"], "left_anti").select("path")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status (added, removed, changed) between two fingerprints (path, mark)."""
    both = before.select("path", F.col("mark").alias("old"), F.lit(True).alias("was")).join(after.select("path", F.col("mark").alias("new"), F.lit(True).alias("is")), "path", "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def is_fresh(before: DataFrame, after: DataFrame) -> bool:
    return differences(before, after).isEmpty()


def merged_index(index: DataFrame, current: DataFrame) -> DataFrame:
    """The index after an update: kept rows whose path and mark are current, and new ones for the rest. Both have path,
    mark and the same further columns; whatever depends on all documents is computed when asked."""
    kept = index.join(current.select("path", "mark"), ["path", "mark"], "left_semi")
    new = current.join(index.select("path", "mark"), ["path", "mark"], "left_anti")
    return kept.unionByName(new)


def upsert(store: DataFrame, rows: DataFrame, key: str = "name") -> DataFrame:
    """Replace rows by key, or add them."""
    return store.join(rows, key, "left_anti").unionByName(rows)

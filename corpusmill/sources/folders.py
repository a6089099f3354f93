"""Small files and folders in whatever store Spark reaches: read, written whole, listed, removed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints. Where none is set, one below the warehouse if all runs on one machine; else an
    error, as executors could not read what others have written."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what made it is run once."""
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all in it; whether there was one."""
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where it isn't there."""
    p, fs = _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def mark(spark: SparkSession, path: str) -> str:
    """What tells a file or folder from a later version: names, sizes and times of the files in it."""
    p, fs = _path(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*")) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]
    return ";".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in found))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file: readers see all of it or none."""
    p, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    data = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    finally:
        data.close()

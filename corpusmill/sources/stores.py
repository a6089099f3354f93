"""JSON stores and logs."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources import folders

HISTORY = "ts string, cmd string, project string, duration_ms long, exit_code int"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A run log of JSON lines; blank and corrupt ones go."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_store(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A store {name: record} as rows: name and the record's fields (`value`: a struct's fields)."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("name", "v"))
    return rows.select("name", "v.*")


def snippets_with(store: DataFrame, words: str) -> DataFrame:
    """Snippets (name, language, content, tags) that hold the words, by name."""
    held = F.lower(F.concat_ws(" ", "name", "language", "content", F.array_join("tags", " ")))
    return store.where(F.contains(held, F.lit(words.lower()))).orderBy("name")


def read_settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Settings from a TOML file over the defaults, table by table; without the file, the defaults. A file that is no TOML is an
    error (ValueError) that names it."""
    if not folders.exists(spark, path):
        return json.loads(json.dumps(defaults))
    try:
        found = tomllib.loads(folders.read_text(spark, path))
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    return over(defaults, found)


def over(defaults: dict, given: dict) -> dict:
    """The defaults with what is given in their place, table by table."""
    both = {k: over(v, given[k]) if isinstance(v, dict) and isinstance(given.get(k), dict) else v for k, v in defaults.items()}
    return both | {k: v for k, v in given.items() if not (isinstance(v, dict) and isinstance(defaults.get(k), dict))}

"""Python's parser as a table function for SQL: register(spark), then

    SELECT path, f.* FROM files, LATERAL python_facts(content) AS f

gives what code.told() does, from one parse of the file. A text that is no Python, or null, gives no rows. Rows come one at a time, and a worker
keeps the names that it has met (code.apart); code.facts() gives the same for many files in bounded memory.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusmill.operators.code import told

FACTS = "kind string, name string, detail string, line bigint, value bigint"


@udtf(returnType=FACTS)  # by Arrow, each row would be a batch of its own
class PythonFacts:
    """See the module."""

    def eval(self, content: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(content or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        yield from told(tree)


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("python_facts", PythonFacts)

"""Parsing of many small files: in bounded memory, once a file, spread over all tasks."""

import ast
import sys

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import parsers
from corpusmill.operators import code
from corpusmill.plans import projects
from tests.conftest import DATA


def test_parser_names_do_not_stay():
    """The worker's own table of names grows with each file that it parses itself."""
    held = sys.getunicodeinternedsize
    made = lambda tag: [len(ast.parse(f"{tag}{k} = other_{tag}{k}").body) for k in range(3000)]
    before = held()
    assert sum(code.apart(lambda: made("apart"))) == 3000 and held() - before < 500
    made("here")
    assert held() - before > 5000
    with pytest.raises(ZeroDivisionError):
        code.apart(lambda: 1 // 0)


def test_sources_and_manifests_are_spread(spark):
    """A table of keys is one small file, which one task read."""
    for made in (projects.sources, projects.manifests):
        used = made(spark, str(DATA)).select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= spark.sparkContext.defaultParallelism


def test_import_graph_parses_once(spark):
    nodes, edges = code.import_graph(projects.sources(spark, str(DATA)))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (nodes, edges, code.fan_in(nodes, edges))]
    assert not any("MapInArrow" in p for p in plans) and edges.count() > nodes.count() > 0


def test_facts_are_those_of_sql(spark):
    files = spark.createDataFrame([("a.py", "import x\nif 1:\n    from . import y\nelse:\n    try:\n        pass\n    except E:\n        import z\ndef f(a=lambda: [b for b in c if b and 1]):\n    match a:\n        case 1:\n            import q\n"), ("b.py", "def ("), ("c.py", None)], "path string, content string")
    parsers.register(spark)
    sql = spark.sql("SELECT path, f.* FROM {files}, LATERAL python_facts(content) AS f", files=files)
    rows = code.facts(files).select(*sql.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, sql.collect()))
    assert sorted(r["name"] for r in rows.where("kind = 'import'").collect()) == ["q", "x", "y", "z"]
    assert rows.where("kind = 'function'").first()["value"] == 3

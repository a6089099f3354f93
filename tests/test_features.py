"""Bundles, gates, templates, times, table functions, settings, renderings: the cases that the survey names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import parsers
from corpusmill.functions import text as T
from corpusmill.operators import code, collect, commits, gates, hygiene, render
from corpusmill.sources import stores


def test_bundle_ranks_drops_tests_and_counts_imports(spark):
    rows = [
        ("p", 0, "src/util.py", "import helper\n" + "x = 1\n" * 5), ("p", 1, "src/helper.py", "from src.util import a\nimport util\n"), ("p", 2, "README.md", "# p\n"), ("p", 3, "src/main.py", "import helper\nimport util\n"),
        ("p", 4, "tests/test_util.py", "import util\n"), ("p", 5, "src/same.py", "y\n"), ("p", 6, "src/alike.py", "y\n"), ("p", 7, "big.txt", "word " * 5_000),
    ]
    files = spark.createDataFrame(rows, "project string, met long, path string, content string")
    got = {r["path"]: r for r in collect.bundled(files, "project", "met", 2_000).collect()}
    assert {p: r["priority"] for p, r in got.items()} == {"README.md": 100, "src/main.py": 50, "src/util.py": 20, "src/helper.py": 10, "src/same.py": 0, "src/alike.py": 0, "big.txt": 0}
    assert [p for p, r in got.items() if not r["taken"]] == ["big.txt"]
    with_tests = collect.bundled(files, "project", "met", 10**6, include_tests=True)
    assert with_tests.where("path = 'tests/test_util.py' and taken").count() == 1
    # Files of equal rank go in the order they were met, not by name.
    few = collect.bundled(files.where("path like '%same.py' or path like '%alike.py'"), "project", "met", 1)
    assert [r["path"] for r in few.where("taken").collect()] == ["src/same.py"]


def test_gates_and_exit_codes(spark):
    findings = lambda *s: spark.createDataFrame([(x,) for x in s], "severity string")
    none, functions = spark.createDataFrame([], "x long"), spark.createDataFrame([(3,), (10,), (None,)], "complexity long")
    parts = spark.createDataFrame([(20,), (49,)], "score long")
    made = gates.gates(findings("warning"), findings("error", "info"), functions, none, none, none, parts)
    assert {r["gate"]: (r["broken"], r["failed"]) for r in made.collect()} == {"doctor": (0, False), "lint": (1, True), "complexity": (1, True), "dupes": (0, False), "deadcode": (0, False), "commit-lint": (0, False), "health": (1, True)}
    assert gates.exit_code(made) == 5 and gates.exit_code(made.where("not failed")) == 0


def test_phase_shares(spark):
    rows = spark.createDataFrame([("scan", 1.0), ("render", 3.0), ("read", 0.0)], "phase string, seconds double")
    assert [tuple(r) for r in gates.phase_shares(rows).orderBy("place").collect()] == [(1, "render", "3.000", "75.0%"), (2, "scan", "1.000", "25.0%"), (3, "read", "0.000", "0.0%")]
    assert gates.phase_shares(rows.where("phase = 'read'")).first()["pct"] == "0.0%" and gates.phase_shares(rows.limit(0)).count() == 0


def test_templates(spark):
    row = spark.createDataFrame([("Explain {name} in {{x}} {{{name}}} {n}.", {"name": "a {n} b", "n": "1"})], "t string, v map<string,string>")
    assert row.select(T.filled_in(F.col("t"), F.col("v"))).first()[0] == "Explain a {n} b in {x} {a {n} b} 1."
    with pytest.raises(Exception, match="needs a value for missing"):
        row.select(T.filled_in(F.lit("{missing}"), F.col("v"))).collect()
    assert row.select(T.filled_in(F.lit("plain"), F.col("v"))).first()[0] == "plain"


def test_times(spark):
    now = F.lit(dt.datetime(2024, 3, 2, 1, 30, 5, tzinfo=dt.UTC))
    r = spark.range(1).select(T.utc_iso(now).alias("iso"), T.utc_now().alias("now"), T.utc_iso(T.cutoff(F.lit("2d"), now)).alias("cut"), T.cutoff(F.lit("soon"), now).alias("none")).first()
    assert r["iso"] == "2024-03-02T01:30:05Z" and r["cut"] == "2024-02-29T01:30:05Z" and r["none"] is None
    assert abs(dt.datetime.fromisoformat(r["now"]) - dt.datetime.now(dt.UTC)) < dt.timedelta(minutes=5)


def test_table_function_in_sql(spark):
    parsers.register(spark)
    rows = [("a.py", "import os\nfrom . import b\n\ndef f(x):\n    return 1 if x else 2\n\nclass C:\n    def g(self):\n        pass\n"), ("bad.py", "def ("), ("none.py", None), ("empty.py", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    got = spark.sql("SELECT path, f.* FROM {files}, LATERAL python_facts(content) AS f", files=files).collect()
    assert {(r["path"], r["kind"], r["name"], r["detail"], r["value"]) for r in got} == {
        ("a.py", "import", "os", None, 0), ("a.py", "import", "b", None, 1), ("a.py", "function", "f", "f", 2), ("a.py", "function", "C.g", "g", 1), ("a.py", "definition", "f", "function", None), ("a.py", "definition", "C", "class", None),
    }


def test_top_functions_and_modules(spark):
    functions = spark.createDataFrame([("b", 1, 5), ("a", 9, 5), ("a", 2, 7), ("c", 1, 1)], "path string, lineno long, complexity long")
    assert [(r["path"], r["lineno"]) for r in code.most_complex(functions, 3).collect()] == [("a", 2), ("a", 9), ("b", 1)]
    assert [r["module"] for r in code.most_imported(spark.createDataFrame([("x", 0), ("y", 2), ("z", 2)], "module string, fan_in long"), 5).collect()] == ["y", "z"]


def test_issues_in_the_order_they_are_first_seen(spark):
    log = spark.createDataFrame([(2, "h2", "fix #7, AB-1"), (1, "h1", "see #9 and #7"), (3, "h3", "AB-1 closes #1")], "met long, hash string, message string")
    assert [tuple(r) for r in commits.first_seen(log).collect()] == [("9", "h1", 1), ("7", "h1", 2), ("AB-1", "h2", 2), ("1", "h3", 1)]


def test_clean_total(spark):
    files = spark.createDataFrame([("a/__pycache__/x.pyc", 3, 1.0), ("a/__pycache__/y.pyc", 4, 2.0), ("src/a.py", 9, 1.0)], "path string, size long, mtime double")
    assert tuple(hygiene.clean_total(hygiene.clean_candidates(files)).first()) == (1, 2, 7)


def test_settings(spark, tmp_path):
    defaults = {"scan": {"max_size": "5MB", "ignored": ["x"]}, "theme": "dark"}
    path = f"file://{tmp_path}/settings.toml"
    assert stores.read_settings(spark, path, defaults) == defaults
    (tmp_path / "settings.toml").write_text('theme = "light"\nnew = 1\n[scan]\nignored = ["y"]\n')
    assert stores.read_settings(spark, path, defaults) == {"scan": {"max_size": "5MB", "ignored": ["y"]}, "theme": "light", "new": 1}
    (tmp_path / "settings.toml").write_text("theme = \n")
    with pytest.raises(ValueError, match="settings.toml"):
        stores.read_settings(spark, path, defaults)


def test_renderings():
    assert render.as_json([{"a": 1, "b": "ü"}]) == '[\n  {\n    "a": 1,\n    "b": "ü"\n  }\n]' and render.as_json([]) == "[]"
    nodes = [{"path": "b.py", "parent": "", "is_dir": False, "name": "b.py"}, {"path": "s", "parent": "", "is_dir": True, "name": "s"}, {"path": "s/<x>", "parent": "s", "is_dir": False, "name": "<x>"}]
    page = render.tree_html(nodes, "p & q")
    assert "<ul><li><strong>s/</strong><ul><li>&lt;x&gt;</li></ul></li><li>b.py</li></ul>" in page and "<h1>p &amp; q</h1>" in page

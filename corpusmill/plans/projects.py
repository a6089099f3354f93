"""Projects derived from the data folder's tables, row by row: manifests, Python sources, diffs and reports of linters.

What a row gives depends on its key only, so SQL can tell what must be found in it, and all of it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.corpus import table


def fmt(form: str, *args: Column | str) -> Column:
    """form with each {} replaced by an argument."""
    parts = form.split("{}")
    return F.concat(*[x for part, arg in zip(parts, [*args, None], strict=True) for x in ([F.lit(part)] + ([] if arg is None else [(F.col(arg) if isinstance(arg, str) else arg).cast("string")]))])


def files_of(rows: DataFrame, *named: tuple[Column, Column]) -> DataFrame:
    """path, content: one file for each pair."""
    return rows.select(F.explode(F.array(*[F.struct(p.alias("path"), c.alias("content")) for p, c in named])).alias("f")).select("f.*")


def spread(rows: DataFrame) -> DataFrame:
    """Keys (k), dealt out to a few tasks for each core: a small file of keys is read by a few tasks only, and what is made of each key is
    much larger."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "k")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: of each part, a manifest of each kind, a text that is none, and a broken one."""
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s")))
    texts = {
        "pyproject.toml": fmt('[project]\ndependencies = ["a{}>=0.{}", "b{}"]\n[project.optional-dependencies]\ndev = ["c{}>=8"]\n[tool.poetry.dependencies]\npython = "^3.9"\nd{} = "^{}"\n', "k", "s", "k", "k", "k", "s"),
        "requirements.txt": fmt("# tools of {}\ne{}[extra]>={}.0\n-r other.txt\n\nf{}\ng{} =={} ; python_version > '3.8'\n", "k", "k", "s", "k", "k", "s"),
        "package.json": fmt('{"name":"x{}","dependencies":{"h{}":"^{}"},"devDependencies":{"@org/i{}":"29"},"scripts":{"build":"b"}}', "k", "k", "s", "k"),
        "Cargo.toml": fmt('[dependencies]\nj{} = { version = "1.{}" }\n[dev-dependencies]\nl{} = "0.5"\n', "k", "s", "k"),
        "go.mod": fmt("module m\nrequire github.com/m/m{} v1.{}.0\nrequire (\n\tgithub.com/n/n{} v0.1.0\n\tgithub.com/o/o{} v2.0.0 // indirect\n)\n", "k", "s", "k", "k"),
        "pom.xml": fmt("<dependencies><dependency>\n<groupId>org.p{}</groupId>\n<artifactId>q</artifactId>\n<version>{}</version></dependency></dependencies>", "k", "s"),
        "build.gradle": fmt("implementation 'org.r{}:r:2.{}'\ntestImplementation(\"junit:test-s{}:4\")\n", "k", "s", "k"),
        "pubspec.yaml": fmt("name: app\ndependencies:\n  flutter:\n    sdk: flutter\n  t{}: ^{}\ndev_dependencies:\n  u{}: 2.0\n", "k", "s", "k"),
        "notes/readme.md": fmt("e{}", "k"),
        "broken/package.json": F.lit("{"),
    }
    return files_of(rows, *((fmt("{}/" + name, "k"), text) for name, text in texts.items()))


#: What manifests() must give for a part k of size s, as SQL.
DEPENDENCIES_SQL = """(SELECT p_partkey AS k, p_size AS s FROM part) AS p, LATERAL (VALUES
  ('python', 'a' || k, '>=0.' || s, 0), ('python', 'b' || k, NULL, 0), ('python', 'c' || k, '>=8', 1), ('python', 'd' || k, '^' || s, 0),
  ('python', 'e' || k, '>=' || s || '.0', 0), ('python', 'f' || k, NULL, 0), ('python', 'g' || k, '==' || s || ' ; python_version > ''3.8''', 0),
  ('node', 'h' || k, '^' || s, 0), ('node', '@org/i' || k, '29', 1), ('rust', 'j' || k, '1.' || s, 0), ('rust', 'l' || k, '0.5', 1),
  ('go', 'github.com/m/m' || k, 'v1.' || s || '.0', 0), ('go', 'github.com/n/n' || k, 'v0.1.0', 0), ('go', 'github.com/o/o' || k, 'v2.0.0', 0),
  ('java', 'org.p' || k || ':q', s::varchar, 0), ('java', 'org.r' || k || ':r', '2.' || s, 0), ('java', 'junit:test-s' || k, '4', 1),
  ('flutter', 't' || k, '^' || s, 0), ('flutter', 'u' || k, '2.0', 1)) AS d(ecosystem, name, version, dev)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a Python module for each customer k, in the package of k's last digit. It imports the next one, the tenth from it by
    a relative import, the package three on, and two modules of which it uses one if k is even. Its function has k % 4 branches, k % 3
    loops and an `and` if k is odd; it calls the next one's helper if k is divisible by 3. A broken module for every customer besides."""
    k = F.col("c_custkey")
    n = F.col("k")
    rows = spread(table(spark, sf_dir, "customer").select(k.alias("k"))).select("k", (n % 10).alias("p"), (n + 1).alias("a"), ((n + 1) % 10).alias("q"), (n + 10).alias("b"), ((n + 3) % 10).alias("r"))
    body = F.concat(F.repeat(F.lit("    if x:\n        pass\n"), (n % 4).cast("int")), F.repeat(F.lit("    for i in x:\n        pass\n"), (n % 3).cast("int")), F.when(n % 2 == 1, "    y = x and 1\n").otherwise("    y = x\n"))
    text = F.concat(
        fmt("import json{}\nimport sys{} as system{}\nfrom p{}.c{} import run{}, helper{}\nfrom . import c{}\nimport p{}\n\n", "k", "k", "k", "q", "a", "a", "a", "b", "r"),
        F.when(n % 2 == 0, fmt("json{}.dump\n\n", "k")).otherwise(""),
        fmt("def run{}(x):\n", "k"), body, F.when(n % 3 == 0, fmt("    helper{}()\n", "a")).otherwise(""),
        fmt("    return run{}, c{}, p{}, y\n\n\ndef helper{}():\n    class Box:\n        def get(self):\n            return [z for z in self if z]\n    return Box\n", "a", "b", "r", "k"),
    )
    return files_of(rows, (fmt("src/p{}/c{}.py", "p", "k"), text), (fmt("broken{}.py", "k"), F.lit("def (")))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diff, n, line: for each order, a change of two files in three hunks."""
    k, start = F.col("o_orderkey"), F.col("o_orderkey") % 50 + 1
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), start.alias("s"))
    text = fmt(
        "diff --git a/app{}.py b/app{}.py\n--- a/app{}.py\n+++ b/app{}.py\n@@ -1,3 +{},5 @@\n import os\n+password = 'abcdefgh{}'\n-eval(x)\n x = 1\n+eval(data)\n y = 2\n@@ -20,2 +{},3 @@\n a\n+run(cmd, shell=True)\n b\n--- a/n.js\n+++ b/n.js\n@@ -5 +5,2 @@\n-token = \"abcdefghijk\"\n+eval(q)\n+ok()",
        "k", "k", "k", "k", "s", "k", F.col("s") + 100,
    )
    return rows.select(F.col("k").alias("diff"), F.posexplode(F.split(text, "\n")).alias("n", "line"))


def reports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """json by linter: a report for each order, with its key in names and lines."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    forms = {
        "ruff": ('[{"filename":"a{}.py","location":{"row":{}},"code":"E501","message":"long"},{"filename":"b.py","location":null,"code":"F401","message":"unused"}]', 2),
        "eslint": ('[{"filePath":"x{}.js","messages":[{"line":{},"ruleId":"no-var","severity":2,"message":"m"},{"line":8,"ruleId":null,"severity":1,"message":"n"}]}]', 2),
        "cargo-clippy": ('{"reason":"compiler-message","message":{"message":"m","level":"error","code":{"code":"E1"},"spans":[{"file_name":"l.rs","line_start":4,"is_primary":false},{"file_name":"m{}.rs","line_start":{},"is_primary":true}]}}', 2),
        "golangci-lint": ('{"Issues":[{"Pos":{"Filename":"m{}.go","Line":{}},"FromLinter":"vet","Text":"t"}]}', 2),
        "dart-analyze": ('{"diagnostics":[{"location":{"file":"d{}.dart","range":{"start":{"line":{}}}},"code":"c","severity":"INFO","problemMessage":"p"}]}', 2),
    }
    return {name: rows.select(fmt(form, *["k"] * n).alias("json")) for name, (form, n) in forms.items()}


REPORTS_SQL = """(SELECT o_orderkey AS k FROM orders) AS o, LATERAL (VALUES ('ruff', 'a' || k || '.py', k, 'E501', 'error'), ('ruff', 'b.py', NULL, 'F401', 'warning'), ('eslint', 'x' || k || '.js', k, 'no-var', 'error'),
  ('eslint', 'x' || k || '.js', 8, NULL, 'warning'), ('cargo-clippy', 'm' || k || '.rs', k, 'E1', 'error'), ('golangci-lint', 'm' || k || '.go', k, 'vet', 'warning'), ('dart-analyze', 'd' || k || '.dart', k, 'c', 'info')) AS r(source, file, line, rule, severity)"""

#: Names that pages' files take in turn, by page id.
PAGE_FILES = ["main.py", "README.md", "pyproject.toml", "util.py", "test_main.py", "spec/app.js", "Dockerfile", "config.yaml"]

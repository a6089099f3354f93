"""Small fixed inputs of the queries that the data folder has no table for, with what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUBJECTS = [
    ("x1", "feat(auth): add login"), ("x2", "fix: crash on start"), ("x3", "did stuff"), ("x4", "bogus: Fixed the thing."), ("x5", "Merge branch 'main' into x"), ("x6", "feat!: drop old API"),
    ("x7", "Docs(readme): Explain setup"), ("x8", ""), ("x9", "fix(core): closes #12 and PROJ-34, see #12"), ("x10", "chore: " + "x" * 120), ("x11", "perf:fast"), ("x12", "resolve AB-1 with abc#7"),
]
DIFFS = [("one", "diff --git a/app.py b/app.py\n--- a/app.py\n+++ b/app.py\n@@ -1,3 +1,5 @@\n import os\n+password = 'abcdefgh12345'\n-eval(x)\n x = 1\n+eval(data)\n y = 2\n@@ -20,2 +22,3 @@\n a\n+run(cmd, shell=True)\n b"), ("two", "--- a/n.js\n+++ b/n.js\n@@ -5 +5,2 @@\n-token = \"abcdefghijk\"\n+eval(q)\n+ok()")]
DIFF_FINDINGS = [("one", "app.py", 2, "hardcoded-secret"), ("one", "app.py", 4, "python-eval-exec"), ("one", "app.py", 23, "shell-true"), ("two", "n.js", 5, "js-eval")]
REQUIREMENTS = "# tools\nrequests[socks]>=2.0\n-r other.txt\n\nnumpy\nflask ==3.0 ; python_version > '3.8'\n"
REQUIREMENTS_FOUND = [("requests", ">=2.0"), ("numpy", None), ("flask", "==3.0 ; python_version > '3.8'")]
MANIFESTS = [
    ("pyproject.toml", '[project]\ndependencies = ["typer>=0.9", "rich"]\n[project.optional-dependencies]\ndev = ["pytest>=8"]\n[tool.poetry.dependencies]\npython = "^3.9"\nhttpx = "^0.27"\n'),
    ("requirements.txt", REQUIREMENTS),
    ("package.json", '{"name":"x","dependencies":{"react":"^18"},"devDependencies":{"jest":"29"},"scripts":{"build":"b"}}'),
    ("Cargo.toml", '[dependencies]\nserde = { version = "1.0" }\n[dev-dependencies]\ncriterion = "0.5"\n'),
    ("go.mod", "module m\nrequire github.com/a/b v1.2.3\nrequire (\n\tgithub.com/c/d v0.1.0\n\tgithub.com/e/f v2.0.0 // indirect\n)\n"),
    ("pom.xml", "<dependencies><dependency>\n<groupId>org.a</groupId>\n<artifactId>b</artifactId>\n<version>1</version></dependency></dependencies>"),
    ("build.gradle", "implementation 'org.x:y:2.0'\ntestImplementation(\"junit:junit-test:4\")\n"),
    ("pubspec.yaml", "name: app\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.0\ndev_dependencies:\n  lints: 2.0\n"),
    ("notes/readme.md", "requests"),
    ("broken/package.json", "{"),
]
DEPENDENCIES = [
    ("python", "typer", ">=0.9", 0), ("python", "rich", None, 0), ("python", "pytest", ">=8", 1), ("python", "httpx", "^0.27", 0),
    ("python", "requests", ">=2.0", 0), ("python", "numpy", None, 0), ("python", "flask", "==3.0 ; python_version > '3.8'", 0),
    ("node", "react", "^18", 0), ("node", "jest", "29", 1), ("rust", "serde", "1.0", 0), ("rust", "criterion", "0.5", 1),
    ("go", "github.com/a/b", "v1.2.3", 0), ("go", "github.com/c/d", "v0.1.0", 0), ("go", "github.com/e/f", "v2.0.0", 0),
    ("java", "org.a:b", "1", 0), ("java", "org.x:y", "2.0", 0), ("java", "junit:junit-test", "4", 1),
    ("flutter", "http", "^1.0", 0), ("flutter", "lints", "2.0", 1),
]
SOURCES = [
    ("src/pkg/__init__.py", ""),
    ("src/pkg/a.py", "import os\nimport sys as system\nfrom pkg import b\nfrom . import c\n\ndef used(x):\n    if x and x > 1 or x < 0:\n        return [y for y in x if y]\n    return 1 if x else 2\n\ndef alone():\n    pass\n"),
    ("src/pkg/b.py", "from __future__ import annotations\nfrom pkg.a import used\nfrom .c import helper as h\n__all__ = ['h']\n\nclass Box:\n    def get(self):\n        for i in used(1):\n            while i:\n                try:\n                    assert i\n                except ValueError:\n                    pass\n        def inner():\n            with open('x'):\n                return 1\n        return inner\n"),
    ("src/pkg/c.py", "import json\nimport pkg.b\n\n@decorated\ndef shown():\n    return Box\n\ndef helper():\n    return json.dumps({})\n\ndef test_it():\n    pass\n"),
    ("bad.py", "def ("),
]
MODULES = ["pkg", "pkg.a", "pkg.b", "pkg.c"]
EDGES = [("pkg.a", "pkg"), ("pkg.a", "pkg.c"), ("pkg.b", "pkg.a"), ("pkg.b", "pkg.c"), ("pkg.c", "pkg.b")]
COMPLEXITY = [("src/pkg/a.py", "used", 6), ("src/pkg/a.py", "alone", 1), ("src/pkg/b.py", "Box.get", 6), ("src/pkg/b.py", "Box.get.inner", 2), ("src/pkg/c.py", "shown", 1), ("src/pkg/c.py", "helper", 1), ("src/pkg/c.py", "test_it", 1)]
UNUSED_IMPORTS = [("src/pkg/a.py", "os"), ("src/pkg/a.py", "system"), ("src/pkg/a.py", "b"), ("src/pkg/a.py", "c"), ("src/pkg/c.py", "pkg")]
UNUSED_DEFINITIONS = [("src/pkg/a.py", "function", "alone")]
REPORTS = {
    "ruff": ['[{"filename":"a.py","location":{"row":3},"code":"E501","message":"long"},{"filename":"b.py","location":null,"code":"F401","message":"unused"}]'],
    "eslint": ['[{"filePath":"x.js","messages":[{"line":7,"ruleId":"no-var","severity":2,"message":"m"},{"line":8,"ruleId":null,"severity":1,"message":"n"}]}]'],
    "cargo-clippy": ['{"reason":"compiler-message","message":{"message":"m","level":"error","code":{"code":"E1"},"spans":[{"file_name":"l.rs","line_start":4,"is_primary":false},{"file_name":"m.rs","line_start":5,"is_primary":true}]}}', '{"reason":"build-finished"}', "not json"],
    "golangci-lint": ['{"Issues":[{"Pos":{"Filename":"m.go","Line":9},"FromLinter":"vet","Text":"t"}]}'],
    "dart-analyze": ['{"diagnostics":[{"location":{"file":"d.dart","range":{"start":{"line":2}}},"code":"c","severity":"INFO","problemMessage":"p"}]}'],
}
REPORT_FINDINGS = [
    ("ruff", "a.py", 3, "E501", "error"), ("ruff", "b.py", None, "F401", "warning"), ("eslint", "x.js", 7, "no-var", "error"), ("eslint", "x.js", 8, None, "warning"),
    ("cargo-clippy", "m.rs", 5, "E1", "error"), ("golangci-lint", "m.go", 9, "vet", "warning"), ("dart-analyze", "d.dart", 2, "c", "info"),
]


def sources(spark: SparkSession) -> DataFrame:
    """The Python files."""
    return spark.createDataFrame(SOURCES, "path string, content string")

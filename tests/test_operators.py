"""Operators on small inputs."""

import subprocess

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import code, collect, commits, deps, dupes, findings, hygiene, incremental, search
from tests import samples
from corpusmill.sources.git import GitHistory
from corpusmill.sources.ignore import IgnoreRules
from corpusmill.sources.repo_files import RepoFiles
from corpusmill.sources.stores import append_history, read_history, read_store, snippets_with
from corpusmill.streaming.watch import counted, on_change


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string").withColumns({"language": F.lit("python"), "directory": F.lit("d")})


def test_blocks_that_are_shifted_are_missed_unless_sliding(spark):
    block = "a\nb\n\nc\nd"
    df = files(spark, ("x", block), ("y", "  a \nb\nc\nd"), ("z", "new\n" + block))
    assert [(r["occurrences"], r["first_path"], r["first_start"], r["first_end"]) for r in dupes.duplicate_blocks(df, 2).orderBy("first_start").collect()] == [(2, "x", 1, 2), (2, "x", 4, 5)]
    assert dupes.duplicate_blocks(df, 4, sliding=True).first()["occurrences"] == 3


def test_chunks_cover_each_line_once(spark):
    text = "\n".join(["w1 w2 w3"] * 20)
    rows = search.chunks(files(spark, ("x", text), ("y", ""), ("z", "aa " * 9)), 5).orderBy("path", "chunk_index").collect()
    spans = [(r["start_line"], r["end_line"]) for r in rows if r["path"] == "x"]
    assert [k for a, b in spans for k in range(a, b + 1)] == list(range(1, 21))
    assert [(r["start_line"], r["end_line"]) for r in rows if r["path"] == "z"] == [(1, 1)] and not [r for r in rows if r["path"] == "y"]


def test_query_terms():
    assert "auth" in search.expanded("authentication") and "authentication" in search.expanded("auth")
    assert search.expanded("how does auth work")[0] == "auth" and search.expanded("kubernetes") == ["kubernetes"]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("g", 3, 40), ("h", 1, 200)], "directory string, path int, tokens long")
    assert [(r["directory"], r["path"], r["taken"]) for r in collect.within_budget(df, "directory", "path", 100).orderBy("directory", "path").collect()] == [("g", 1, True), ("g", 2, False), ("g", 3, True), ("h", 1, False)]
    assert [r["chunk"] for r in collect.chunked(df, "directory", "path", 100).orderBy("directory", "path").collect()] == [0, 1, 1, 0]


def test_markdown_comes_back(spark):
    rows = [{"path": "a.py", "language": "python", "content": "x\n```\ninner\n```\ny\n", "tokens": 1, "size": 9}, {"path": "b.txt", "language": "other", "content": "z", "tokens": 1, "size": 1}]
    text = collect.markdown(rows, "p", binary=["bin.dat"])
    got = collect.from_markdown(spark.createDataFrame([("p", text)], "name string, text string")).orderBy("path").collect()
    assert [(r["path"], r["language"], r["content"]) for r in got] == [("a.py", "python", "x\n```\ninner\n```\ny"), ("b.txt", "", "z")]


GOLDEN = "# sample_repo — collected source\n\n- Files: 1\n- Total tokens (approx.): 3\n- Total size: 8 bytes\n\n## `a.py`\n\n```python\nx = 1\n```\n"


def test_markdown_form():
    assert collect.markdown([{"path": "a.py", "language": "python", "content": "x = 1\n\n", "tokens": 3, "size": 8}], "sample_repo") == GOLDEN


def test_expanding_refuses_and_finds_conflicts(spark):
    new = files(spark, ("a", "1"), ("b", "2"), ("../c", "3"), ("d", "4"))
    old = files(spark, ("a", "1"), ("b", "x"))
    assert {r["path"]: r["action"] for r in collect.to_write(new, old).collect()} == {"a": "same", "b": "conflict", "../c": "refused", "d": "new"}


def test_sarif_comes_back(spark):
    rows = spark.createDataFrame([("a.py", 3, "R1", "error", "m", "t"), ("b.py", None, None, "info", "n", "t")], "file string, line long, rule string, severity string, message string, source string")
    back = findings.external(findings.sarif_log(rows)).orderBy("file").collect()
    assert [tuple(r) for r in back] == [("a.py", 3, "R1", "error", "m", "t"), ("b.py", 1, "unspecified", "info", "n", "t")]
    other = findings.external(spark.createDataFrame([('{"tool":"x","issues":[{"severity":"BAD","message":"q"}]}',), ("{}",)], "json string")).collect()
    assert [(r["severity"], r["source"]) for r in other] == [("warning", "x")]


def test_health_weights_and_bounds(spark):
    none = spark.createDataFrame([], "severity string")
    many = spark.createDataFrame([("error",)] * 50, "severity string")
    cx, blocks = spark.createDataFrame([(3,), (12,)], "complexity int"), spark.createDataFrame([], "lines long, occurrences long")
    assert {r["category"]: r["score"] for r in findings.health(none, none, cx, blocks).collect()} == {"doctor": 25, "lint": 35, "complexity": 10, "duplication": 20}
    rows = findings.health(many, many, cx, blocks, many).collect()
    assert sum(r["weight"] for r in rows) == 100 and all(0 <= r["score"] <= r["weight"] for r in rows)


def test_compliance_counts(spark):
    sev = spark.createDataFrame([("error",), ("info",)], "severity string")
    lic = spark.createDataFrame([("GPL",), ("unknown",), ("MIT",)], "licence string")
    assert tuple(findings.compliance(sev, lic, ["gpl"], spark.range(3)).first()) == (100 - 12 - 1 - 15 - 2 - 3, 1, 1, 3)


def test_owners_and_hotspots(spark):
    blame = spark.createDataFrame([("f", "ann", 5), ("f", "bob", 5), ("g", "bob", 1)], "path string, author string, lines int")
    assert sorted(tuple(r) for r in commits.owners(blame).collect()) == [("f", "ann", 5, 10, 0.5), ("g", "bob", 1, 1, 1.0)]
    f = spark.createDataFrame([("a", 10), ("b", 20), ("c", 5)], "path string, lines int")
    t = spark.createDataFrame([("a", 4), ("b", 1)], "path string, churn int")
    c = spark.createDataFrame([("a", 7)], "path string, complexity int")
    assert [tuple(r) for r in commits.hotspots(f, t, c, 5).collect()] == [("a", 4, 7, False, 28), ("b", 1, 20, True, 20)]


def test_differences(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", None)], "path string, mark int")
    b = spark.createDataFrame([("x", 2), ("w", 1), ("z", None)], "path string, mark int")
    assert {r["path"]: r["status"] for r in incremental.differences(a, b).collect()} == {"x": "changed", "y": "removed", "w": "added"}
    assert incremental.is_fresh(a, a) and not incremental.is_fresh(a, b)
    assert sorted(tuple(r) for r in incremental.upsert(a.withColumnRenamed("path", "name"), b.withColumnRenamed("path", "name")).collect()) == [("w", 1), ("x", 2), ("y", 1), ("z", None)]


def test_sbom_and_licences(spark):
    d = deps.dependencies(spark.createDataFrame(samples.MANIFESTS, "path string, content string"))
    assert d.count() == len(samples.DEPENDENCIES)
    with_licence = deps.licensed(d, spark.createDataFrame([("node", "react", "MIT")], "ecosystem string, name string, licence string"))
    assert {r["name"]: r["licence"] for r in with_licence.collect()}["react"] == "MIT"
    assert '"purl":"pkg:npm/react@^18"' in {r["name"]: r["json"] for r in deps.sbom_components(d).collect()}["react"]


def test_import_graph_prefix(spark):
    nodes, edges = code.import_graph(samples.sources(spark), "pkg.a")
    assert [r["module"] for r in nodes.collect()] == ["pkg.a"] and edges.isEmpty()


def test_bundle_ranks(spark):
    df = files(spark, ("src/main.py", "import util\nfrom pkg.util import x\n"), ("src/util.py", ""), ("README.md", ""), ("tests/test_x.py", "import util"), ("app.js", "require('./lib/util')"))
    counts = collect.import_counts(df)
    assert [tuple(r) for r in counts.collect()] == [("util", 4)]
    ranks = {p: spark.range(1).select(collect.priority(F.lit(p), F.lit(n))).first()[0] for p, n in (("src/main.py", 0), ("README.md", 0), ("src/util.py", 4), ("tests/test_x.py", 0), ("pyproject.toml", 0))}
    assert ranks == {"src/main.py": 50, "README.md": 100, "src/util.py": 20, "tests/test_x.py": -1000, "pyproject.toml": 80}


def test_drawn_graphs():
    assert code.dot(["a", "b"], [("a", "b")]) == 'digraph dependencies {\n    rankdir="LR";\n    "a";\n    "b";\n    "a" -> "b";\n}'
    assert code.mermaid(["a.b"], []) == 'graph LR\n    a_b["a.b"]' and code.mermaid([], [("a.b", "c")]) == 'graph LR\n    a_b["a.b"] --> c["c"]'


def test_clean_targets_and_tasks(spark):
    rows = spark.createDataFrame([("a/__pycache__/x.pyc", 3, 1.0), ("a/b.pyc", 2, 2.0), ("src/m.py", 9, 3.0), ("build/dist/y", 4, 4.0)], "path string, size long, mtime double")
    assert {r["target"]: r["size"] for r in hygiene.clean_candidates(rows).collect()} == {"a/__pycache__": 3, "a/b.pyc": 2, "build": 4}
    t = hygiene.tasks(files(spark, ("Makefile", "all: x\n.PHONY: all\nall: y\nv := 1\n"), ("package.json", '{"scripts":{"b":"c"}}'), ("justfile", "run arg:\n  x\n")))
    assert sorted(r["command"] for r in t.collect()) == ["just run", "make all", "npm run b"]


@pytest.mark.parametrize(("rules", "path", "is_dir", "want"), [
    (dict(gitignore="*.log\n!keep.log"), "a/x.log", False, True), (dict(gitignore="*.log\n!keep.log"), "a/keep.log", False, False), (dict(folders=["node_modules"]), "p/node_modules/i.js", False, True),
    (dict(gitignore="/top"), "sub/top", False, False), (dict(gitignore="/top"), "top", False, True), (dict(gitignore="d/"), "d", False, False), (dict(gitignore="a/**/z"), "a/b/c/z", False, True),
    (dict(excludes=["*.tmp"]), "q.tmp", False, True), (dict(), ".git/config", False, True), (dict(gitignore="# c\n\nf?o[0-9]"), "fxo3", False, True),
])
def test_ignore_rules(rules, path, is_dir, want):
    assert IgnoreRules(**rules).ignores(path, is_dir) is want


@pytest.fixture
def repo(tmp_path):
    for path, text in {"src/main.py": "def main():\n    pass\n", "src/__init__.py": "", "tests/test_a.py": "x = 1\n", ".gitignore": "*.log\n", "debug.log": "z", "node_modules/p/i.js": "1", "README.md": "# r\n"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_repo_files_lists_hidden_names_in_walk_order(spark, repo):
    spark.dataSource.register(RepoFiles)
    df = spark.read.format("repo_files").option("ignored", "node_modules").load(str(repo))
    assert [r["path"] for r in df.orderBy("walk_ord").collect()] == [".gitignore", "README.md", "tests/test_a.py", "src/__init__.py", "src/main.py"]
    only = spark.read.format("repo_files").option("languages", "py").option("ignored", "node_modules").load(str(repo))
    assert only.count() == 3 and bytes(only.where("path = 'src/main.py'").first()["content"]) == b"def main():\n    pass\n"
    assert {r["check"] for r in hygiene.checks(df.select("path", "size", F.lit(False).alias("is_binary"), F.sha2("content", 256).alias("hash"), "kind"), "*.log\n", []).collect()} == {"missing_license"}


def test_git_history(spark, repo):
    def git(*args):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=Test", "-c", "user.email=t@x", *args], check=True, capture_output=True)

    git("init", "-q")
    git("add", "src")
    git("commit", "-qm", "feat: one")
    (repo / "src/main.py").write_text("def main():\n    return 1\n")
    git("commit", "-qam", "fix(core): two")
    spark.dataSource.register(GitHistory)
    read = lambda relation, **o: spark.read.format("git_history").options(relation=relation, **o).load(str(repo))
    log = read("commits").collect()
    assert [r["subject"] for r in log] == ["fix(core): two", "feat: one"] and log[0]["author_email"] == "t@x"
    assert {r["path"]: r["churn"] for r in commits.churn(read("commit_files")).collect()} == {"src/main.py": 2, "src/__init__.py": 1}
    assert read("blame", files="src/main.py").first()["lines"] == 2 and read("branches").first()["is_current"]
    assert [r["path"] for r in read("changed", ref="HEAD~1").collect()] == ["src/main.py"]
    assert read("diff_lines", ref="HEAD~1").where("line like '+%'").count() == 2
    git("commit", "-qm", "chore: none", "--allow-empty")
    assert [tuple(r)[4:] for r in read("commit_totals").collect()] == [(0, 0, 0), (1, 1, 1), (2, 0, 2)]
    assert [tuple(r) for r in read("numstat", ref="HEAD~1").collect()] == [] and [tuple(r) for r in read("numstat", ref="HEAD~2", only="src/main.py;no").collect()] == [("src/main.py", 1, 1, False)]
    assert [r["line"] for r in read("patch", ref="HEAD~1", unified="0").orderBy("n").collect() if r["line"][:1] in "+-"][2:] == ["-    pass", "+    return 1"]


def test_collections_as_text_and_json(spark):
    rows = [("a.py", "x\n\ny"), ("b/c.txt", "")]
    text = collect.plain([{"path": p, "content": c} for p, c in rows])
    back = collect.from_text(spark.createDataFrame([("n", "before\n" + text), ("none", "no file")], "name string, text string"))
    assert sorted((r["path"], r["content"]) for r in back.collect()) == rows
    kept = files(spark, *rows).selectExpr("path", "language", "1L tokens", "2L size", "content")
    one = collect.document(kept, 4)
    assert sorted((r["path"], r["content"]) for r in collect.from_document(one.selectExpr("'n' name", "json text")).collect()) == rows
    with pytest.raises(ValueError):
        collect.document(kept, 3)
    assert collect.document(kept.limit(0), 0).first()["json"] == '{"file_count":0,"total_tokens":0,"files":[]}'
    forms = spark.createDataFrame([("a.MD", "{"), ("a.json", ""), ("x.txt", "## `a`"), ("x", "\n {"), ("x", "t\n## `a`"), ("x.y", "")], "name string, text string")
    assert [r[0] for r in forms.select(collect.form(F.col("name"), F.col("text"))).collect()] == ["markdown", "json", "text", "json", "markdown", "text"]


def test_history_log_and_stores(spark, tmp_path):
    path = str(tmp_path / "log")
    append_history(spark.createDataFrame([("t", "stats", "p", 5, 0)], "ts string, cmd string, project string, duration_ms long, exit_code int"), path)
    (tmp_path / "log" / "more.json").write_text('\n{"ts":"u","cmd":"grep","project":"p","duration_ms":1,"exit_code":1}\nbroken\n')
    assert sorted(r["cmd"] for r in read_history(spark, path).collect()) == ["grep", "stats"]
    (tmp_path / "s.json").write_text('{"b":{"language":"py","content":"Print x","tags":["t"]},"a":{"language":"js","content":"y","tags":["print"]}}')
    store = read_store(spark, str(tmp_path / "s.json"), "language:string,content:string,tags:array<string>")
    assert [r["name"] for r in snippets_with(store, "print").collect()] == ["a", "b"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:10:00", "a", 2.0), ("2024-01-01 02:00:00", "b", 3.0)], "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    run = lambda: on_change(spark, str(tmp_path / "in"), "ts timestamp, k string, value double", str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    run()
    run()
    assert sum(seen) == 3
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sum(seen) == 4
    assert sorted(r["n"] for r in counted(rows, "ts", "k", "1 hour", "10 minutes").collect()) == [1, 2]

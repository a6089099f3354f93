"""Sources and sinks of files: scans with pushed filters, changes as a stream, expansion into a folder."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringStartsWith

from corpusmill.operators import collect
from corpusmill.sources import repo_files
from corpusmill.sources.expansion import Expansion
from corpusmill.sources.repo_changes import RepoChanges, RepoChangesReader
from corpusmill.sources.repo_files import PushingReader, RepoFilesReader


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {"b.py": "x = 1\n", "a.md": "# a\n", "src/z.py": "z\n", "src/deep/m.py": "m = 2\n" * 10, "src/deep/n.js": "n\n", "lib/q.py": "q\n", "lib/bin.dat": "\0\1", ".hidden/h.py": "h\n", "node_modules/x.js": "x\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "empty").mkdir()
    return root


def scanned(reader):
    return sorted(r for p in reader.partitions() for b in reader.read(p) for r in zip(*(b[c].to_pylist() for c in ("walk_ord", "path", "content")), strict=True))


def test_scan_keeps_walk_order_however_it_is_dealt_out(tree, monkeypatch):
    want = [p for p, _ in repo_files.walk(str(tree), RepoFilesReader({"path": str(tree), "ignored": "node_modules"}).rules)]
    assert want[:2] == ["a.md", "b.py"] and "empty" in want
    for tasks, per in ((1, 256), (3, 1), (64, 2)):
        monkeypatch.setattr(repo_files, "TASKS", tasks)
        monkeypatch.setattr(repo_files, "PER_TASK", per)
        assert [r[1] for r in scanned(RepoFilesReader({"path": str(tree), "ignored": "node_modules"}))] == want


def test_filters_are_applied_before_files_are_opened(tree, monkeypatch):
    opened, listed = [], []
    read, list_ = Path.read_bytes, os.listdir
    monkeypatch.setattr(Path, "read_bytes", lambda self: opened.append(self.name) or read(self))
    monkeypatch.setattr(os, "listdir", lambda p: listed.append(os.path.relpath(p, tree)) or list_(p))
    reader = PushingReader({"path": str(tree)})
    left = list(reader.pushFilters([EqualTo(("language",), "python"), StringStartsWith(("path",), "src/"), GreaterThan(("size",), 10), StringContains(("path",), "m")]))
    assert left == [StringContains(("path",), "m")]
    assert [r[1] for r in scanned(reader)] == ["src/deep/m.py"] and opened == ["m.py"]
    assert set(listed) == {".", "src", "src/deep"}
    reader = PushingReader({"path": str(tree)})
    assert list(reader.pushFilters([In(("path",), ("lib/q.py", "a.md"))])) == []
    opened.clear()
    assert sorted(r[1] for r in scanned(reader)) == ["a.md", "lib/q.py"] and sorted(opened) == ["a.md", "q.py"]


def test_scan_in_spark(spark, tree):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = repo_files.scan(spark, str(tree), content="false")
        assert {r["path"]: r["is_binary"] for r in df.where("path like 'lib/%'").collect()} == {"lib/q.py": False, "lib/bin.dat": True}
        some = df.where((F.col("language") == "python") & F.col("path").startswith("src/"))
        assert sorted(r["path"] for r in some.collect()) == ["src/deep/m.py", "src/z.py"]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan  # none is left for Spark
        paths = spark.createDataFrame([("b.py",), ("src/z.py",), ("gone.py",)], "path string")
        got = repo_files.read_contents(repo_files.only(df, paths), str(tree))
        assert {r["path"]: bytes(r["content"]) for r in got.collect()} == {"b.py": b"x = 1\n", "src/z.py": b"z\n"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_changes_survive_a_restart(spark, tree, tmp_path):
    spark.dataSource.register(RepoChanges)
    seen = []

    def run():
        rows = spark.readStream.format("repo_changes").option("state", str(tmp_path / "state")).option("ignored", "node_modules").load(str(tree))
        q = rows.writeStream.foreachBatch(lambda df, n: seen.append(sorted((r["path"], r["status"]) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        found = [x for batch in seen for x in batch]
        seen.clear()
        return found

    assert run() == sorted((p, "added") for p in ("a.md", "b.py", ".hidden/h.py", "lib/bin.dat", "lib/q.py", "src/deep/m.py", "src/deep/n.js", "src/z.py"))
    assert run() == []  # a new query from the checkpoint replays nothing
    (tree / "b.py").write_text("x = 22\n")
    (tree / "lib/q.py").unlink()
    (tree / "new.py").write_text("")
    (tree / "node_modules/y.js").write_text("y")
    assert run() == [("b.py", "changed"), ("lib/q.py", "removed"), ("new.py", "added")]
    assert run() == []


def test_a_batch_that_is_run_again_has_the_same_rows(tree, tmp_path):
    reader = RepoChangesReader({"path": str(tree), "state": str(tmp_path / "state")})
    start, first = reader.initialOffset(), reader.latestOffset()
    (tree / "b.py").unlink()
    second = reader.latestOffset()
    assert reader.latestOffset() == second != first
    again = RepoChangesReader({"path": str(tree), "state": str(tmp_path / "state")})
    for a, b in ((start, first), (first, second)):
        assert [p.rows for p in reader.partitions(a, b)] == [p.rows for p in again.partitions(a, b)]
    assert again.partitions(first, second)[0].rows == [("b.py", "removed", None)]
    for k in range(20):
        (tree / "b.py").write_text("x" * k)
        reader.commit(reader.latestOffset())
    assert len(list((tmp_path / "state").glob("*.json"))) <= 9
    with pytest.raises(ValueError):
        RepoChangesReader({"path": str(tree)})


def expanded(spark, rows, target, **options):
    spark.dataSource.register(Expansion)
    spark.createDataFrame(rows, "path string, content string").repartition(3).write.format("expansion").options(**options).mode("append").save(str(target))


def leftovers(folder):
    return [p for p in folder.parent.iterdir() if ".expanding-" in p.name]


def test_expansion_writes_skips_and_forces(spark, tmp_path):
    target = tmp_path / "out"
    expanded(spark, [("src/nested/main.py", "print('hi')"), ("empty", None), ("./a/../b.txt", "b")], target)
    assert (target / "src/nested/main.py").read_text() == "print('hi')" and (target / "empty").read_text() == "" and (target / "b.txt").read_text() == "b"
    before = (target / "b.txt").stat().st_mtime_ns
    expanded(spark, [("b.txt", "b"), ("c.txt", "c")], target)
    assert (target / "b.txt").stat().st_mtime_ns == before and (target / "c.txt").exists()
    with pytest.raises(Exception, match="other contents"):
        expanded(spark, [("b.txt", "other"), ("d.txt", "d")], target)
    assert (target / "b.txt").read_text() == "b" and not (target / "d.txt").exists() and not leftovers(target)
    expanded(spark, [("b.txt", "other"), ("d.txt", "d")], target, force="true")
    assert (target / "b.txt").read_text() == "other" and (target / "d.txt").exists() and not leftovers(target)


def test_expansion_refuses_what_leaves_the_folder(spark, tmp_path):
    target = tmp_path / "out"
    (tmp_path / "else").mkdir()
    target.mkdir()
    (target / "link").symlink_to(tmp_path / "else")
    for path in ("../../etc/passwd", "/etc/passwd", "a/../../x", "link/x", "C:\\x", ""):
        with pytest.raises(Exception, match="outside the folder"):
            expanded(spark, [(path, "pwned"), ("fine", "x")], target, force="true")
    assert [p.name for p in target.iterdir()] == ["link"] and not list((tmp_path / "else").iterdir())
    with pytest.raises(Exception, match="other contents"):
        expanded(spark, [("x", "1"), ("x", "2")], target)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    target = tmp_path / "out"
    spark.dataSource.register(Expansion)
    rows = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string").alias("content"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("expansion").mode("append").save(str(target))
    assert not target.exists() and not leftovers(target)


def test_a_markdown_collection_expands(spark, tmp_path):
    text = collect.markdown([{"path": "src/main.py", "language": "python", "content": "print(1)\n", "tokens": 3, "size": 9}], "demo")
    files = collect.from_markdown(spark.createDataFrame([("dump.md", text)], "name string, text string"))
    spark.dataSource.register(Expansion)
    files.select("path", "content").write.format("expansion").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/src/main.py").read_text() == "print(1)"

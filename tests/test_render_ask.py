import zipfile

import pytest

from corpusmill.operators import ask, render
from corpusmill.plans.registry import extensions


def test_tables():
    rows = [{"a": 1, "b": "x|<y>"}, {"a": 2, "b": ""}]
    assert render.as_csv(rows).splitlines() == ["a,b", "1,x|<y>", "2,"] and render.as_csv([]) == ""
    with pytest.raises(ValueError):
        render.as_csv([*rows, {"c": 1}])
    assert render.as_markdown(rows).splitlines()[2] == "| 1 | x\\|<y> |" and "x|&lt;y&gt;" in render.as_html(rows, "t")


def test_tree_and_changelog():
    nodes = [{"path": "a", "parent": "", "is_dir": True, "name": "a"}, {"path": "a/x", "parent": "a", "is_dir": False, "name": "x"}, {"path": "0", "parent": "", "is_dir": False, "name": "0"}]
    assert render.tree_lines(nodes, "r") == ["r/", "├── a/", "│   └── x", "└── 0"]
    entries = [{"section": "Fixed", "scope": None, "description": "d", "breaking": True, "short_hash": "h", "author_name": "A"}, {"section": "Added", "scope": "s", "description": "e", "breaking": False, "short_hash": "g", "author_name": "B"}]
    assert render.changelog(entries, "v1", "HEAD") == "# Changelog\n\n_Range: `v1..HEAD`_\n\n## Added\n\n- **s:** e (g by B)\n\n## Fixed\n\n- d **BREAKING** (h by A)\n"
    assert "_No commits in range._" in render.changelog([], None, "HEAD")


def test_reports():
    files = [{"path": f"f{k}", "additions": k, "deletions": 1} for k in range(52)]
    text = render.pull_request(["feat: a"], files, ["#1"])
    assert "**52 file(s) changed, +1326 / -52**" in text and "and 2 more" in text and text.endswith("Issues: #1")
    text = render.compliance_report("p", 90, [{"category": "hygiene", "severity": "info", "message": "m"}])
    assert "- [info] m" in text and text.count("- none") == 2


def test_hits_put_together(spark):
    from corpusmill.operators import search

    q = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, score double")
    assert [tuple(r) for r in search.combined_hits(q, spark.createDataFrame([("a", 5.0), ("c", 9.0)], "path string, score double")).collect()] == [("a", 6.0), ("b", 2.0)]
    assert [r["path"] for r in search.left_over(q, q.where("path = 'a'"), q.where("false")).collect()] == ["b"]


def test_saved_outputs_and_zip(spark, tmp_path):
    path = render.save_output(str(tmp_path), "p", "stats", {"files": [{"x": 1}]})
    assert render.saved_table(path) == [{"x": 1}]
    df = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, content string")
    assert render.zipped(df, str(tmp_path / "z.zip")) == 2
    assert zipfile.ZipFile(tmp_path / "z.zip").read("MANIFEST.txt") == b"a\nb\n"
    with pytest.raises(ValueError):
        render.records(df, 1)


def test_questions(spark):
    docs = spark.createDataFrame([("auth.py", "def login user password check"), ("pay.py", "charge card invoice")], "path string, content string")
    said, found = ask.answer(docs, "login password", lambda prompt, system: prompt[-24:])
    assert found[0]["path"] == "auth.py" and said.endswith("login password")
    assert ask.answer(docs, "zebra") == (None, [])
    with pytest.raises(RuntimeError):
        ask.answer(docs, "login")
    parts = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two")], "path string, ord int, content string")
    assert ask.summary(parts, lambda p, s: p.upper()) == "ONE\n\nTWO" and ask.summary(parts.limit(1), lambda p, s: p[:1]) == "o"
    assert extensions() == ({}, {})

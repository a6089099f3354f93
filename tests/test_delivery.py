"""Webhooks, summaries by rounds, licences of installed packages, script extensions."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusmill.operators import ask, deps, hygiene, inquiry
from corpusmill.plans import registry
from corpusmill.sources import webhook


@pytest.fixture
def endpoint():
    """A server that counts what it takes; it fails each key's first try, and refuses bodies with "bad"."""
    taken, tries = Counter(), Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body, key = self.rfile.read(int(self.headers["content-length"])).decode(), self.headers["Idempotency-Key"]
            tries[key] += 1
            status = 400 if "bad" in body else 503 if tries[key] == 1 else 204
            taken[body] += status == 204
            self.send_response(status)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", taken
    server.shutdown()


def test_each_event_is_posted_once_over_restarts(spark, tmp_path, endpoint):
    url, taken = endpoint
    rows = [(str(k), json.dumps({"event": k if k != 3 else "bad"})) for k in range(12)]
    spark.createDataFrame(rows[:8], "id string, json string").repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda: webhook.follow(spark.readStream.schema("id string, json string").parquet(str(tmp_path / "in")), url, str(tmp_path / "cp"), str(tmp_path / "ledger"), wait=0.01).awaitTermination()
    run()
    run()
    spark.createDataFrame(rows[8:], "id string, json string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    # A batch that is run again, as after a driver that died before it could note the batch.
    some = spark.createDataFrame(rows[:8], "id string, json string").repartition(2)
    again = webhook.delivered(some, url, str(tmp_path / "ledger"), 0, wait=0.01).collect()
    assert [(r["id"], r["ok"]) for r in again] == [("3", False)]
    assert taken == Counter({body: 1 for k, (_, body) in enumerate(rows) if k != 3} | {rows[3][1]: 0})
    dead = spark.read.parquet(str(tmp_path / "ledger/dead")).collect()
    assert [(r["id"], r["status"], r["attempts"], r["batch"]) for r in dead] == [("3", 400, 1, 0)]


def test_a_dead_endpoint_is_tried_again_and_given_up(spark, tmp_path):
    rows = spark.createDataFrame([("a", "{}")], "id string, json string")
    (r,) = webhook.delivered(rows, "http://127.0.0.1:9/", str(tmp_path / "ledger"), 0, retries=2, wait=0.01).collect()
    assert (r["ok"], r["status"], r["attempts"]) == (False, None, 3) and r["error"]


def test_payloads_with_fields(spark):
    row = spark.createDataFrame([("compliance report", 'score "90"', {"score": "90", "who": None})], "e string, m string, f map<string,string>")
    made = lambda kind, fields=F.col("f"), **extra: json.loads(row.select(hygiene.payload(kind, F.col("e"), F.col("m"), fields, extra)).first()[0])  # noqa: B008, E731
    assert made("slack") == {"text": '*compliance report*\nscore "90"\n- *score*: 90\n- *who*: '}
    teams = made("teams")
    assert teams["@type"] == "MessageCard" and teams["sections"] == [{"facts": [{"name": "score", "value": "90"}, {"name": "who", "value": ""}]}]
    assert made("teams", None)["sections"] == []
    jira = made("jira", project_key="OPS", issue_type="Task")["fields"]
    assert jira["project"] == {"key": "OPS"} and jira["issuetype"] == {"name": "Task"} and jira["labels"][0] == "score:90" and jira["description"] == 'score "90"'
    assert set(made("jira", None)["fields"]) == {"summary", "description"}
    assert made("generic", None) == {"event": "compliance report", "message": 'score "90"', "fields": {}}


def test_summaries_are_reduced_in_rounds_each_call_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def client(prompt, system):
        with open(calls, "a") as f:
            f.write(f"{len(prompt)}\n")
        return "s" * 40 + prompt[:3]

    parts = spark.range(3_000).select(F.lit("p").alias("path"), F.col("id").alias("ord"), F.format_string("%05d text", "id").alias("content"))
    made = ask.summary(parts, client, limit=400)
    sizes = [int(x) for x in calls.read_text().split()]
    # 3,000 parts, then runs of about 400 tokens (some 35 summaries), and so on to one.
    assert made.startswith("s" * 40) and 3_000 < len(sizes) < 3_400 and max(sizes) < 400 * 8
    assert ask.summary(parts.limit(0), client) is None


def test_summaries_that_fill_a_prompt_each_still_end(spark):
    parts = spark.createDataFrame([("p", k, f"{k}") for k in range(5)], "path string, ord long, content string")
    assert ask.summary(parts, lambda p, s: f"({p})" + " long" * 50, limit=10).count("(") >= 5


def test_comments_of_a_review(spark):
    replies = [('x {"summary": "s", "comments": [{"file": "a.py", "line": 3, "comment": "c"}, 7, {"severity": "bug"}]} y',), ('{"summary": null}',)]
    got = inquiry.comments_in(spark.createDataFrame(replies, "reply string")).collect()
    assert [tuple(c) for c in got[0]["comments"]] == [("a.py", 3, "question", "c"), ("", None, "bug", "")] and got[1]["comments"] == []


def test_licences_of_installed_packages(spark, tmp_path):
    for path, text in {
        "package.json": json.dumps({"dependencies": {"lodash": "^4", "chalk": "^5", "@org/pkg": "1", "gone": "1"}}),
        "requirements.txt": "requests==2.31.0\nrich\nother\n",
        "sub/package.json": json.dumps({"dependencies": {"not-root": "1"}}),
        "node_modules/lodash/package.json": json.dumps({"name": "lodash", "license": "MIT"}),
        "node_modules/chalk/package.json": json.dumps({"licenses": [{"type": "BSD"}]}),
        "node_modules/@org/pkg/package.json": json.dumps({"license": {"type": "ISC"}}),
        "node_modules/lodash/node_modules/gone/package.json": json.dumps({"license": "nested"}),
        ".venv/lib/python3/site-packages/requests-2.31.0.dist-info/METADATA": "Name: requests\nLicense: Apache 2.0\n",
        "venv/lib/rich-13.0.dist-info/METADATA": "License: UNKNOWN\nClassifier: License :: OSI Approved :: MIT License\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r["name"]: r["licence"] for r in deps.licence_report(spark, str(tmp_path)).collect()}
    assert got == {"lodash": "MIT", "chalk": "BSD", "@org/pkg": "ISC", "gone": "unknown", "requests": "Apache 2.0", "rich": "MIT License", "other": "unknown"}


def test_scripts_register_queries_and_failures_stay_apart(spark, tmp_path, monkeypatch):
    (tmp_path / "good.py").write_text("def register(queries):\n    queries['five'] = lambda spark, folder: spark.range(5)\n")
    (tmp_path / "older.py").write_text("VERSION = 0\ndef register(queries):\n    queries['six'] = lambda spark, folder: spark.range(6)\n")
    (tmp_path / "broken.py").write_text("raise ValueError('no')\n")
    (tmp_path / "half.py").write_text("def register(queries):\n    queries['half'] = None\n    raise KeyError('x')\n")
    (tmp_path / "bare.py").write_text("x = 1\n")
    (tmp_path / "_part.py").write_text("raise ValueError('never read')\n")
    found, failed = registry.extensions(str(tmp_path))
    assert set(found) == {"five", "six"} and set(failed) == {"older", "broken", "half", "bare"} and "version 0" in failed["older"]
    monkeypatch.setenv(registry.SCRIPTS, str(tmp_path))
    assert __spark_entry__.queries()["five"](spark, "").count() == 5
    (tmp_path / "clash.py").write_text("def register(queries):\n    queries['stats_totals'] = None\n")
    assert __spark_entry__.queries()["stats_totals"] is not None  # own queries can't be replaced

"""The stored index: answers as a scan of the texts gives them, whatever its history."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ask, index, retrieval, search
from corpusmill.sources import folders
from corpusmill.streaming import watch

SCHEMA = "path string, mark string, content string"
WORDS = [f"term{i}" for i in range(60)]


def corpus(seed, n, mark="1", first=0):
    """Texts of Zipf-like words, a few empty."""
    r = random.Random(seed)
    text = lambda: "\n".join(" ".join(WORDS[min(59, int(r.paretovariate(0.6)) - 1)] for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12)))
    return {f"p{first + i:04}": (mark, text()) for i in range(n)}


def table(spark, docs):
    return spark.createDataFrame([(p, *x) for p, x in docs.items()], SCHEMA)


def answers(spark, base, terms, top=7):
    return [(r["path"], r["score"]) for r in index.ask(spark, base, terms, top).collect()]


def scanned(spark, docs, terms, top=7):
    return [(r["path"], r["score"]) for r in search.ranked(table(spark, docs), terms, top).collect()]


QUESTIONS = [["term3", "term9", "term9", "unknown"], ["term40", "term50", "term2"]]


def test_answers_follow_changes(spark, tmp_path):
    base, docs = f"{tmp_path}/index", corpus(1, 150) | {"none": ("1", ""), "null": ("1", None)}
    index.build(table(spark, docs), base)
    assert [answers(spark, base, q) for q in QUESTIONS] == [scanned(spark, docs, q) for q in QUESTIONS]
    assert answers(spark, base, ["unknown"]) == [] == answers(spark, base, [])
    # Replaced, new and removed paths; the answers use norms of several days.
    for new, gone in [(corpus(2, 20, "2", 100), ["p0001", "none"]), (corpus(4, 3, "4", 99), ["p0103"])]:
        index.change(base, table(spark, new), spark.createDataFrame([(p,) for p in gone], "path string"))
        docs = {p: x for p, x in docs.items() if p not in gone} | new
    assert [answers(spark, base, q) for q in QUESTIONS] == [scanned(spark, docs, q) for q in QUESTIONS]
    assert index.stats(spark, base)["units"] == len(docs) == index.stats(spark, base)["files"]
    assert len(index.latest(spark, base).segments) > 1 and any(s.low < 1 or s.high > 1 for s in index.latest(spark, base).segments)
    now = index.merge(spark, base, index.latest(spark, base))
    assert len(now.segments) == 1 and index.is_fresh(spark, base, table(spark, docs))
    assert answers(spark, base, QUESTIONS[1]) == scanned(spark, docs, QUESTIONS[1])
    index.change(base, table(spark, {"p0003": ("9", "term1")}))
    assert not index.is_fresh(spark, base, table(spark, docs))
    index.update(table(spark, docs), base)
    assert index.is_fresh(spark, base, table(spark, docs)) and answers(spark, base, QUESTIONS[0]) == scanned(spark, docs, QUESTIONS[0])
    assert {r["path"]: r["content"] for r in index.texts_of(spark, base, ["p0003", "p0100", "gone"]).collect()} == {p: docs[p][1] for p in ("p0003", "p0100")}
    assert index.delete(spark, base) and not index.delete(spark, base) and not index.is_fresh(spark, base, table(spark, docs))


def test_a_change_writes_its_own_documents_only_and_old_segments_go(spark, tmp_path):
    base = f"{tmp_path}/index"
    index.build(table(spark, corpus(1, 400)), base)
    first = index.latest(spark, base).segments[0].name
    for k in range(2):
        index.change(base, table(spark, corpus(k, 3, "2", 10 * k)))
    now = index.latest(spark, base)
    assert now.segments[0].name == first  # never written again
    written = [index.load(spark, base, s.name, "units").count() for s in now.segments[1:]]
    assert sum(written) == 6 and len(written) == 1  # small ones are merged
    kept = {s.name for s in now.segments}
    there = {x for x in folders.names(spark, base) if x.startswith("segment-")}
    assert kept <= there and len(there) <= len(kept) + index.KEPT * 2 and len(index.manifests(spark, base)) == index.KEPT


def test_blocks_are_skipped(spark, tmp_path):
    """Of many blocks, those that can't reach the k-th score aren't read."""
    base = f"{tmp_path}/index"
    docs = {f"p{i:05}": ("1", "rare " * (1 + 30 * (i // 128 == 7)) + "common filler " * 20) for i in range(128 * 60)}
    index.build(spark.createDataFrame([(p, *x) for p, x in docs.items()], SCHEMA).coalesce(1), base)
    now = index.latest(spark, base)
    q = index.question(spark, base, now, ["rare", "common"])
    all_, few = index.heads(spark, base, now, q).count(), index.within_reach(spark, base, now, q, 5, 6).count()
    assert all_ >= 60 and few <= 3
    assert [r["path"] for r in index.ask(spark, base, ["rare", "common"], 5).collect()] == [f"p{7 * 128 + i:05}" for i in range(5)]
    plan = index.rows(spark, base, now, "postings").where(F.col("term").isin(["rare"]) & F.col("block").isin([7]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,rare)" in plan and "EqualTo(block,7)" in plan
    heads = index.heads(spark, base, now, q)._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in heads.split("ReadSchema")[1].split("\n")[0]


def test_chunks_are_retrieved_and_texts_read_late(spark, tmp_path):
    base, docs = f"{tmp_path}/index", corpus(5, 60)
    # The reference's case: the terms of a question bring the file that has them.
    docs |= {"auth.py": ("1", "def login(user, password):\n    return authenticate(user, password)\n"), "payments.py": ("1", "def charge_card(amount, token):\n    invoice = create_invoice(amount)\n")}
    index.build(table(spark, docs), base, limit=20)
    chunks = search.chunks(table(spark, docs), 20)
    assert index.stats(spark, base) == {"files": sum(1 for _, t in docs.values() if t), "units": chunks.count(), "segments": 1}
    found = retrieval.chunk_texts(spark, base, "login authenticate password", 5).collect()
    assert found[0]["path"] == "auth.py" and found[0]["content"] == docs["auth.py"][1].rstrip("\n")
    for q in ("term3 term9", "term1 term30 login"):
        want = [tuple(r) for r in search.retrieve(table(spark, docs), q, 6, 20).collect()]
        assert [tuple(r)[:5] for r in retrieval.chunk_texts(spark, base, q).collect()] == want
    assert retrieval.chunk_texts(spark, f"{tmp_path}/none", "term1").count() == 0
    seen = []
    text, sources = ask.answer_from(spark, base, "login authenticate password", lambda prompt, system: seen.append(prompt) or "In auth.py.", 3)
    assert text == "In auth.py." and sources[0]["path"] == "auth.py" and "auth.py" in seen[0]
    with pytest.raises(LookupError):
        ask.answer_from(spark, f"{tmp_path}/none", "anything", ask.no_client)


def test_hits_have_terms_and_samples_or_fall_back(spark, tmp_path):
    docs = {"src/auth.py": ("1", "import jwt\n\ndef login(user):\n    SESSION = authenticate(user)\n    return login\n"), "src/pay.py": ("1", "invoice = 1\n"), "README.md": ("1", "A tool.\n")}
    base, rows = f"{tmp_path}/index", table(spark, docs)
    found, used = retrieval.semantic_hits(spark, base, "authentication", 5)
    assert not used and found.count() == 0
    found, used = retrieval.semantic_hits(spark, base, "authentication", 5, rows)
    assert not used and found.first()["path"] == "src/auth.py"
    index.build(rows, base)
    found, used = retrieval.semantic_hits(spark, base, "authentication", 5, rows)
    (hit,) = found.collect()
    assert used and hit["path"] == "src/auth.py" and len(hit["matched_terms"]) == 8
    assert hit["matched_terms"][:2] == ["authentication", "auth"]  # unknown words weigh most; equal weights stay in the question's order
    assert [tuple(s) for s in hit["samples"]] == [(4, "    SESSION = authenticate(user)"), (3, "def login(user):"), (5, "    return login")] or len(hit["samples"]) == 3
    assert retrieval.semantic_hits(spark, base, "kubernetes", 5, rows)[0].count() == 0


def test_index_follows_a_stream(spark, tmp_path):
    schema = "path string, mark long, content string, removed boolean"
    base = str(tmp_path / "index")
    arrive = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: watch.follow_index(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), base, str(tmp_path / "state")).awaitTermination()
    arrive([("a", 1, "red blue", False), ("b", 1, "green", False), ("d", 1, "red", False)])
    run()
    arrive([("a", 2, "green gold", False), ("c", 1, "red", False), ("c", 2, "red red", False), ("d", 2, None, True)])
    run()
    run()
    docs = {"a": ("2", "green gold"), "b": ("1", "green"), "c": ("2", "red red")}
    for q in (["green"], ["red", "gold"]):
        assert answers(spark, base, q) == scanned(spark, docs, q)
    version = index.latest(spark, base).version
    index.change(base, table(spark, docs), batch=index.latest(spark, base).batch)  # a batch that is run again
    assert index.latest(spark, base).version == version

import hashlib
import re

import numpy as np
import pyarrow as pa

from corpusmill.llm import decontamination as D
from corpusmill.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.conftest import ROWS, passage

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    held = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            held.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    lengths = {len(x) for x in held}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in held:
                    hit |= set(range(k, k + n))
                    found |= held[key]
        yield i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, passage(1, 25)), (2, passage(1, 40).upper()), (3, "one two"), (4, None), (5, ""), (6, "!!"), (10, passage(4, 13)), (3, "one two"), (7, "ñandú 日本語"), (8, passage(77, 12))]


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in df.collect()), key=str)


def test_odd_documents(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute(ROWS, ITEMS), key=str)
    assert got(D.contamination(docs, items)) == want
    assert D.contamination(no_docs, items).collect() == []
    assert all(x[2] == 0 and not x[4] for x in got(D.contamination(docs, items.where("false"))))
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(x[0]) for x in want if not x[4])


def test_benchmark_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(D.benchmark_blocks(items)) > 2
    assert got(D.contamination(docs, items)) == sorted(brute(ROWS, ITEMS), key=str)


def test_items_without_an_id_hit(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    given = [(None, passage(1, 25)), (None, passage(4, 13)), (None, None), (3, "one two")]
    want = {str(i): (n, h, x, c) for i, n, h, x, c in brute(ROWS, given)}
    rows = D.contamination(docs, spark.createDataFrame(given, "item_id long, text string")).select("*", D.items_digest(D.F.col("items")).alias("sha")).collect()
    for r in rows:
        n, h, x, c = want[str(r["doc_id"])]
        found = x.split(",") if x else []
        assert (r["n_words"], r["n_hit"], r["contaminated"]) == (n, h, c)
        assert r["n_items"] == len(found) and r["items"] == [i for i in found if i != "None"] + [None] * ("None" in found)
        assert r["sha"] == D.digest(r["items"]) == hashlib.sha256(",".join(i for i in found if i != "None").encode()).hexdigest()
    assert any(r["items"] == [None] and r["contaminated"] for r in rows)


def test_hit_spans(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, passage(1, 25)), (2, "one two"), (3, "no id here at all")], "item_id long, text string")
    for size in (D.BLOCK_BYTES, 60):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        rows = D.contamination(docs, items).collect()
        spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in rows}
        assert (spans[1], spans[4], spans[6], spans[10], spans[41], spans[None]) == ([], [(0, 2)], [(0, 25)], [], [(0, 2)], [(0, 5)])
        assert all(r["n_hit"] == sum(b - a for a, b in r["spans"]) for r in rows)


def test_query(spark):
    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{DATA}/{t}.parquet").collect()]
    want = {i: (n, h, hashlib.sha256(x.encode()).hexdigest(), c) for i, n, h, x, c in brute(read("documents", "doc_id"), read("benchmark", "item_id"))}
    rows = QUERIES["op7_decontamination"](spark, str(DATA)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in rows} == want
    assert any(r["n_hit"] for r in rows) and all((r["n_items"] > 0) == (r["n_hit"] > 0) for r in rows)


def test_words_that_collide_modulo_powers_of_two(spark):
    """Such words have one polynomial hash modulo 2**64, whatever its base."""
    words = ["".join(p[bin(k).count("1") % 2] for k in range(2048)) for p in ("ab", "ba")]
    docs = spark.createDataFrame([(k, f"one {w} two") for k, w in enumerate(words)], "doc_id long, text string")
    items = spark.createDataFrame([("i", words[0])], "item_id string, text string")
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in D.contamination(docs, items).collect()} == {0: (1, ["i"]), 1: (0, [])}


def test_equal_hashes_are_not_enough(monkeypatch):
    monkeypatch.setattr(D.HASHER, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    index = D.build([("i", "a b c"), ("j", "a b d"), ("k", "e")], {})
    found = list(D.batch_hits(index, pa.array(["x a B c", "a b", "a b d x e"])))
    assert [(n, s.tolist(), sorted(x)) for n, s, x in found] == [(4, [[1, 4]], ["i"]), (2, [], []), (5, [[0, 3], [4, 5]], ["j", "k"])]

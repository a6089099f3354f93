"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

from corpusmill.llm import importance as I
from tests.llm.conftest import ROWS

TARGET = [("a", "one two three"), ("b", "One, TWO w3 w10 ünïcode"), ("c", None), ("d", "")]


def grams(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute(rows, target, percent, least):
    s, t = (Counter(b for _, text in docs for b in grams(text)[1]) for docs in (rows, target))
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, text in rows:
        n, g = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, g))
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))
    for k, x in enumerate(enough[: percent * len(enough) // 100]):
        x[5] = k + 1
    return out


def drawn(docs, target, **how):
    return [[r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")] for r in I.resampled(docs, target, **how).collect()]


def plain(rows):
    return sorted([x[:5] for x in rows], key=str), sorted((x[5], x[0]) for x in rows if x[5])


def test_weights_and_draw(docs, spark):
    target = spark.createDataFrame([(i, t, 1) for i, t in TARGET], "item_id string, text string, bucket int")
    for percent, least in ((5, 20), (50, 3), (100, 0)):
        assert plain(drawn(docs, target, percent=percent, least_words=least)) == plain(brute(ROWS, TARGET, percent, least))


def test_pieces_join_seamlessly(docs, spark, monkeypatch):
    monkeypatch.setattr(I, "PIECE", 7)
    target = spark.createDataFrame(TARGET, "item_id string, text string")
    assert plain(drawn(docs, target, percent=30)) == plain(brute(ROWS, TARGET, 30, 20))


def test_empty_tables(docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert drawn(no_docs, none) == []
    assert plain(drawn(docs, none)) == plain(brute(ROWS, [], 5, 20))


def test_ranks_go_on_over_partitions(spark):
    """Equal scores and repeated ids: ranks are gapless, by score, then id."""
    rows = spark.createDataFrame([(k % 50, 30, 5, 0, k % 7) for k in range(500)], "doc_id long, n_words long, n_features long, weight long, score long").repartition(6)
    from pyspark.sql import functions as F

    got = I.numbered(rows, 400, [F.desc("score"), F.asc_nulls_first("doc_id")]).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 401)) and [(-r["score"], r["doc_id"]) for r in got] == sorted((-(k % 7), k % 50) for k in range(500))[:400]


def test_one_exchange_of_texts_serves_both_passes(docs, spark):
    rows = I.weighted(docs, spark.createDataFrame(TARGET, "item_id string, text string"))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0] and "BroadcastNestedLoopJoin" not in plan

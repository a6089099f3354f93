import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common
from corpusmill.llm import ngram_jaccard as N
from corpusmill.llm import signature_tree as S
from corpusmill.llm.components import components
from corpusmill.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.conftest import ROWS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """By id: set size and component."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_odd_documents(spark, docs):
    rows = N.jaccard_components(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got.pop(None) == (1, None)
    assert got == brute(ROWS)


def test_empty(spark, no_docs):
    assert N.jaccard_components(no_docs).collect() == [] and N.one_of_each(no_docs).collect() == []


def test_large_blocks_and_groups(spark, monkeypatch):
    """Near copies by the dozen around shared passages, with pieces of a few classes."""
    monkeypatch.setattr(N, "PIECE", 4)
    rng = random.Random(4)
    seed = [f"a{i}" for i in range(40)]
    rows = []
    for i in range(70):
        w = list(seed) if i % 2 else [f"b{rng.randrange(9)}" for _ in range(20)] + seed[:20]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(N.jaccard_components(df)) == brute(rows)


def test_query_is_exact(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert result(QUERIES["op1_ngram_jaccard"](spark, str(DATA))) == brute(rows)


def test_one_of_each_keeps_columns(docs):
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute(ROWS)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, (_, c) in want.items() if c == i)


def test_repeated_ids_with_other_texts_stay(spark):
    text = lambda x, n=20: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, text("a")), (1, text("b")), (1, text("b").upper()), (2, text("b") + " more"), (3, text("c")), (3, text("c")), (4, text("c") + " more"), (5, ""), (5, " "), (5, None), (5, text("d")), (6, text("a") + " more")]
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert kept == sorted([(1, text("a")), (1, text("b")), (3, text("c")), (5, ""), (5, " "), (5, ""), (5, text("d"))], key=str)


@pytest.mark.parametrize("size", [1, 5, 70])
def test_tree_loses_no_pair(size):
    rng = np.random.default_rng(size)
    sets = []
    for _ in range(size):
        base = rng.integers(0, 1 << 63, rng.integers(1, 80), dtype=np.uint64) if not sets or rng.random() < 0.4 else sets[rng.integers(len(sets))]
        sets.append(np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(0, 1 << 63, len(base), dtype=np.uint64), base)))
    bits, n = np.array([S.signature(s) for s in sets]), np.array([len(s) for s in sets])
    a, b = S.candidates(S.tree(bits, n, np.arange(size)), None, 4, 5)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    real = {(x, y) for x, y in combinations(range(size), 2) if 5 * len(np.intersect1d(sets[x], sets[y])) >= 4 * len(np.union1d(sets[x], sets[y]))}
    assert real <= found and len(found) == len(a)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 0), 200: 0, **dict.fromkeys(range(101, 130), 100), 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_group_of_near_copies_costs_about_a_pair_a_class(spark, monkeypatch):
    """Near copies that mostly link with one another, and hang together by chance only."""
    rng = random.Random(8)
    seed = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(500):
        w = list(seed)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"c{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    verified, counts = N.verified, []
    monkeypatch.setattr(N, "verified", lambda docs, pairs, *more: (counts.append(pairs.count()), verified(docs, pairs, *more))[1])
    got = result(N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))
    assert got == brute(rows)
    assert sum(counts) <= 4 * len(rows)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_collide_modulo_powers_of_two(spark):
    """Such words have one polynomial hash modulo 2**64, whatever its base."""
    rows = [(i, f"x y {w} z") for i, w in enumerate([thue_morse(n, *p) for n in (256, 2048) for p in ("ab", "ba")])] + [(9, "x y")]
    assert result(N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == {i: (1, i) for i, _ in rows}


def test_digests_that_begin_alike(spark, monkeypatch):
    digest = N.digest

    def half(words, other=frozenset()):
        _, check = digest(words)
        return (check if 7 in other else 7), check

    rows = [(i, BASE_TEXT + f" {k}") for i, k in enumerate([1, 1, 2, 3])] + [(9, "other text"), (10, "other text")]
    monkeypatch.setattr(N, "digest", half)
    assert result(N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))) == brute(rows)


BASE_TEXT = " ".join(f"v{k}" for k in range(30))


def test_long_words_and_hashes_of_lanes():
    texts = ["a" * n + x for n in (0, 7, 8, 9, 15, 16, 63, 64, 65, 300) for x in "bcB"]
    data, offsets = N.raw(N.pa.array(texts))
    words, at = N.HASHER.words(data, offsets)
    assert list(at) == list(range(len(texts) + 1))
    assert [words[k] == words[k + 2] for k in range(0, len(words), 3)] == [True] * (len(words) // 3)
    assert len(set(words.tolist())) == len(words) * 2 // 3


def test_forest_spans():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    some = N.forest(a, b)

    def parts(edges):
        root = list(range(60))
        for x, y in edges:
            root = [root[x] if r == root[y] else r for r in root]
        return [root.index(r) for r in root]

    assert len(some) < 60 * N.FORESTS and parts(zip(a, b)) == parts(zip(a[some], b[some]))


def test_steps_leave_no_shuffle_files(spark):
    """What a step has shuffled goes when the step ends; a run of many steps held all of it on disk."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    kept = common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    written = common.Written(kept.groupBy("count").agg(F.max("k").alias("k")))
    time.sleep(1)  # they are removed in the background
    assert files() <= before and kept.count() == 7
    assert written.df.count() == 2 and spark.conf.get(common.TIDY) == "false"
    written.drop()

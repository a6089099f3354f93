"""Anagram hashing against every pair of words."""

import random
import re
import zlib
from collections import Counter

from corpusmill.llm import spelling_variants as V
from tests.llm.conftest import ROWS


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= 10 * n else None, None, n, len(others), words[best] if best and words[best] >= 10 * n else None]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w][1] = end
    return sorted((w, *x) for w, x in out.items())


def found(docs):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in V.variants(docs).collect())


def test_groups_as_brute_force_does(spark):
    r = random.Random(5)
    base = ["information", "conformation", "reisende", "straßenbahn", "llamados", "aaaaaaaa", "abababab", "Économie", "économie", "tsalttss", "splattts"]
    alphabet = "abcdeinorst" + "ßéÿ×"

    def varied(w):
        k = r.randrange(len(w))
        return r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k:], w[:k] + r.choice(alphabet) + w[k + 1 :], w[::-1], w.upper()])

    words = [w for w in base for _ in range(150)] + [v for w in base for _ in range(12) for v in [varied(w)] for _ in range(r.randint(1, 15))] + [v for w in base for _ in range(30) for v in [varied(varied(w))] for _ in range(2)]
    words += ["marmalade"] * 600 + ["marmalada"] * 40 + ["marmelada"] * 2
    r.shuffle(words)
    rows = [(i % 37 if i % 41 else None, " ".join(words[k : k + 20])) for i, k in enumerate(range(0, len(words), 20))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows)
    assert any(w[1] and w[2] != w[1] for w in got if w[0] == "marmelada")  # ways of several steps


def test_odd_texts(docs, no_docs, spark):
    assert found(docs) == brute(ROWS)
    assert found(no_docs) == []
    long = "x" * 300_000 + "yz"
    rows = [(1, long), (2, long), (3, long[1:]), (4, long[1:]), (5, long[:-1] + "w"), (6, long[:-1] + "w")]
    got = {w: near for w, near in [(r["word"][-2:] + str(len(r["word"])), r["n_near"]) for r in V.variants(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()]}
    assert got == {"yz300002": 2, "yz300001": 1, "yw300002": 1}


def test_long_texts_and_full_tables_of_words(docs, monkeypatch):
    monkeypatch.setattr(V, "LONG", 10)
    monkeypatch.setattr(V, "WORDS_HELD", 3)
    assert found(docs) == brute(ROWS)


def test_long_words_are_verified_by_bisection(spark, monkeypatch):
    r = random.Random(2)
    pairs = []
    for _ in range(300):
        a = "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        k = r.randrange(len(a))
        b = r.choice([a, a[:k] + r.choice("ab") + a[k:], a[:k] + r.choice("abé") + a[k + 1 :], a[::-1], a + "bb"])
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    pairs = [(a, b) for a, b in pairs if len(b) - len(a) <= 1]
    rows = spark.createDataFrame(pairs, "a string, b string")
    monkeypatch.setattr(V, "LONG_WORD", 0)
    from pyspark.sql import functions as F

    assert [x[0] for x in rows.select(V.one_edit(F.col("a"), F.col("b"))).collect()] == [near(a, b) for a, b in pairs]


def test_words_have_few_entries(spark):
    """No anagrams are paired, and an entry for each letter of each half at most."""
    words = spark.createDataFrame([(k, w) for k, w in enumerate(["listens", "silents", "tinsels", "enlists", "listen"])], "id long, word string")
    rows = V.entries(words)
    assert rows.count() <= sum(2 + len(w) for w in ("listens", "silents", "tinsels", "enlists", "listen"))
    pairs = V.neighbours(words.selectExpr("*", "1L n")).select("a", "b").collect()
    assert sorted(map(tuple, pairs)) == [(0, 4), (4, 0)]

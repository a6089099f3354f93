"""Super-k-mers against every window compared with every other."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import substring_dedup as S
from tests.llm.conftest import ROWS


def brute(rows, width):
    """doc_id, words, removed words, kept text."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            least[x] = min(least.get(x, S.NO_ID), S.NO_ID if i is None else i)
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < (S.NO_ID if i is None else i) for p in range(k, k + width)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def removed(docs, width):
    rows = S.deduplicated(docs, width)
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows.select("row.doc_id", "n_words", "n_removed", "kept").collect()], key=str)


@pytest.mark.parametrize("width", [3, 8, 50])
def test_removes_what_brute_force_removes(docs, width):
    got = removed(docs, width)
    assert got == brute(ROWS, width)
    assert any(r[2] for r in got)


def test_shared_passages_in_any_places(spark, monkeypatch):
    """Passages in many contexts, overlapping, repeated inside a document, with repeated ids and buckets too large to gather."""
    monkeypatch.setattr(S, "BUCKET", 4)
    r = random.Random(3)
    passages = [" ".join(r.choice("abcdefg") for _ in range(r.randint(5, 40))) for _ in range(6)]
    rows = [(r.choice([None, *range(30)]), "\n".join(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 6)))) for _ in range(60)]
    rows += [(99, "a " * 400), (98, "a " * 399), (7, passages[0]), (7, passages[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width in (6, 10):
        assert removed(docs, width) == brute(rows, width)


def test_groups_of_copies_travel_once(spark):
    """Of equal pieces only one is packed, however many documents have it."""
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, text if i else text + " more of it") for i in range(200)], "doc_id long, text string").repartition(4)
    rows = S.keyed(docs)
    pieces = S.cut_up(rows, 50)
    assert pieces.select("m", "d").distinct().count() * 2 < pieces.count() / 50
    assert removed(docs, 50) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50)


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    words = [f"x{i % 9_973}" for i in range(200_000)]
    texts = pa.array([" ".join(words)])
    whole = [np.concatenate(x) for x in zip(*[p[1:] for p in S.all_pieces(texts, 50)], strict=True)]
    assert whole[1].sum() == len(words) - 49  # each window in one piece
    rows = [(1, " ".join(words[:150_000])), (2, " ".join(words[100:150_050])), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x[:3] for x in removed(docs, 50)] == [x[:3] for x in brute(rows, 50)]


def test_empty_tables_and_clashing_columns(no_docs, docs):
    assert S.dedup_digests(no_docs).count() == 0
    rows = S.deduplicated(docs.withColumn("spans", F.lit(1)).withColumn("id", F.lit("x"))).select("row.*", "kept")
    assert set(docs.columns) | {"spans", "id", "kept"} == set(rows.columns) and rows.count() == len(ROWS)


def test_digest_is_of_the_kept_words(docs):
    got = {r["doc_id"]: r["kept_sha256"] for r in S.dedup_digests(docs).collect()}
    assert got[1] == hashlib.sha256(b"").hexdigest() and got[4] == hashlib.sha256(b"one two").hexdigest()

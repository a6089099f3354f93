import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.bpe import TreeCodec, bpe, load_ranks
from corpusmill.llm.queries import QUERIES
from corpusmill.llm.split import splitter
from corpusmill.llm.token_counts import LongestMatch, token_counts
from tests.conftest import DATA
from tests.llm.conftest import ROWS

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = load_ranks(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC, COUNTER = TreeCodec(RANKS, P.PATTERN), LongestMatch(set(RANKS), P.PATTERN)
ALPHABET = "aaaabbeothing ñéß\n <|'sre…😀1²\x1c\xa0"


def greedy(data):
    n = i = 0
    while i < len(data):
        i = next(j for j in range(min(len(data), i + 130), i, -1) if data[i:j] in RANKS)
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=80))
def test_any_text(text):
    ids = array("I", CODEC.encode(text))
    assert list(ids) == TIKTOKEN.encode_ordinary(text) and CODEC.decode(ids) == text.encode()
    assert splitter(P.PATTERN)(text) == regex.findall(P.PATTERN, text)
    assert COUNTER.count(text.encode()) == greedy(text.encode())
    assert COUNTER.count_text(text) == sum(greedy(x.encode()) for x in regex.findall(P.PATTERN, text))


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2500, "aab" * 999, " " * 2000, "é" * 999, "lowerthan" * 300, "=" * 5000])
def test_long_pieces(text):
    assert list(array("I", CODEC.encode(text))) == TIKTOKEN.encode_ordinary(text)


def test_each_token_is_its_own_encoding():
    """What joins and shortcuts rely on."""
    rng = random.Random(1)
    assert all(CODEC.merge(t) == [r] for t, r in rng.sample(sorted(RANKS.items()), 5000))


def test_queries(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op6_bpe"](spark, str(DATA)).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = TIKTOKEN.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())
    rows = QUERIES["op9_token_counts"](spark, str(DATA)).collect()
    assert len(rows) == len(text)
    assert all(r["n_tokens"] == sum(greedy(x.encode()) for x in regex.findall(P.PATTERN, text[r["doc_id"]])) for r in rows)


def test_odd_documents(docs, no_docs):
    rows = bpe(docs, PATH, P.PATTERN, tokens=True).collect()
    assert len(rows) == len(ROWS)
    by = dict(ROWS)
    assert all(bytes(r["decoded"]) == (by[r["doc_id"]] or "").encode() and r["round_trip"] for r in rows)
    assert all(r["n_tokens"] == 0 for r in rows if not by[r["doc_id"]])
    assert bpe(no_docs, PATH, P.PATTERN).collect() == [] and token_counts(no_docs, PATH, P.PATTERN).collect() == []
    assert sorted(r["n_bytes"] for r in token_counts(docs, PATH, P.PATTERN).collect()) == sorted(len((t or "").encode()) for _, t in ROWS)

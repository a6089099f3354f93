import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest

from corpusmill.llm import chat_format as C
from corpusmill.llm.common import raw
from corpusmill.llm.queries import CONTROL_TEXT, QUERIES
from tests.conftest import DATA


def test_escaping_comes_back():
    rng = random.Random(7)
    texts = ["".join(rng.choice(["<", "|", "!", "a", "ñ", "<|im_end|>", ">", "\n", "<|im_start|>"]) for _ in range(rng.randrange(12))) for _ in range(800)]
    data, at = C.escape(*raw(pa.array(texts)))
    for k, t in enumerate(texts):
        out = data[at[k] : at[k + 1]].tobytes()
        assert b"<|" not in out and C.unescape(out) == t.encode()


def test_assembly():
    done = C.assemble(pa.array(["user", None, "a\n%<|"]), pa.array(["hi", "<|im_end|>", None]))
    assert [x.as_py() for x in done] == [b"<|im_start|>user\nhi<|im_end|>\n", b"<|im_start|>\n<!|im_end|><|im_end|>\n", b"<|im_start|>a%0A%25<!|\n<|im_end|>\n"]
    assert [x[:2] for x in C.read_back(b"".join(x.as_py() for x in done))] == [("user", "hi"), ("", "<|im_end|>"), ("a\n%<|", "")]
    assert len(C.assemble(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


def brute(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        o = out.setdefault(conv, [0, "", ""])
        o[0] += 1
        o[1] += f"{role or ''}\n{text or ''}\n"
        o[2] += (text or "") * (role == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {c: (n, sha(t), len(a), sha(a)) for c, (n, t, a) in out.items()}


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    df = QUERIES["op8_chat_format"](spark, str(DATA))
    assert got(df) == brute(rows)
    r = df.where("conv_id = -1").first()
    assert r["formatted_chars"] == 2 * (len(CONTROL_TEXT) + 2 + len("<|im_start|>\n<|im_end|>\n")) + len("userassistant")


def test_odd_conversations_over_small_batches(spark):
    rows = [(1, t, r, x) for t, r, x in [(2, "assistant", "b<|"), (1, "user", "a"), (3, None, None), (3, None, None), (4, "assistant", None), (5, "assistant", "ñ" * 50)]]
    rows += [(None, 1, "user", "q"), (2, 1, "assistant", ""), (3, 1, "system", "<!!|")] + [(9, k, "assistant", f"t{k}") for k in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert got(C.formatted_digests(C.formatted_turns(df))) == brute(rows)
        assert C.formatted_digests(C.formatted_turns(df.where("false"))).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_read_back_of_a_long_text_in_little_memory():
    text = "a<!|" * 5_000_000
    formatted = C.assemble(pa.array(["assistant"]), pa.array([text]))[0].as_py()
    tracemalloc.start()
    ((role, back, _),) = C.read_back(formatted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (role, back == text) == ("assistant", True) and peak < 8 * len(text)
    for bad in (b"<|im_start|>user", b"<|im_start|>user\nhi", b"x", b"<|im_start|>user\nhi<|im_start|>"):
        with pytest.raises(ValueError):
            list(C.read_back(bad))


def test_batches_are_assembled_in_parts(spark, monkeypatch):
    rows = [(k, 1, "assistant", "x" * k) for k in range(40)]
    whole = got(C.formatted_digests(C.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))))
    assert whole == brute(rows)
    assert [b - a for a, b in C.blocks(C.raw(pa.array(["x" * 9] * 7))[1], 20)] == [2, 2, 2, 1]

import hashlib
import zlib

import pytest

from corpusmill.llm import sharding as S
from corpusmill.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.conftest import ROWS


def brute(rows, shards):
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    rows = sorted(((key(t), -(1 << 62) if i is None else i, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: r[:2])
    total, before, out, slots = sum(r[3] for r in rows), 0, [], {}
    for k, at, i, size, crc in rows:
        shard = before * shards // total
        out.append((i, size, crc, "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r[c] for c in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")) for r in df.collect()], key=str)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(QUERIES["op10_sharding"](spark, str(DATA))) == brute(rows, 24)


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_hot_groups_are_split(spark, shards):
    rows = [(k, "same text") for k in range(100)] + [(100 + k, f"t{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(S.histogram_shards(df, shards)) == brute(rows, shards)


def test_odd_documents(docs, no_docs):
    rows = [r for k, r in enumerate(ROWS) if r[0] != 17] + [(17, ROWS[16][1])]
    assert got(S.histogram_shards(docs.dropDuplicates(["doc_id"]), 3)) == brute(rows, 3)
    made = S.histogram_shards(docs, 3).collect()
    assert len(made) == len(ROWS)
    for k in range(3):
        assert sorted(r["slot"] for r in made if r["shard"] == k) == list(range(sum(r["shard"] == k for r in made)))
    assert S.histogram_shards(no_docs, 24).collect() == []


def test_whole_rows_are_dealt_out(docs):
    rows = S.sharded(docs, 3).collect()
    assert sorted((tuple(r["row"]) for r in rows), key=str) == sorted((tuple(r) for r in docs.collect()), key=str)
    assert list(rows[0]["row"].asDict()) == docs.columns
    place = {(r["shard"], r["slot"]): (r["row"]["doc_id"], zlib.crc32((r["row"]["text"] or "").encode())) for r in rows}
    assert place == {(r["shard"], r["slot"]): (r["doc_id"], r["text_crc32"]) for r in S.histogram_shards(docs, 3).collect()}


def test_digests_come_after_the_exchange(spark):
    plan = QUERIES["op10_sharding"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("crc32") < plan.index("Exchange")
    assert all(c in plan[plan.index("Exchange") :] for c in ("text", "lang", "source", "n_chars"))


def test_plan_is_native(spark):
    plan = QUERIES["op10_sharding"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_are_parted(spark):
    rows = [(1, "same text")] * 240 + [(k + 2, f"text number {k}") for k in range(240)]
    made = S.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 24).collect()
    assert sorted((r["doc_id"], r["size"]) for r in made) == sorted((i, len(t) + 8) for i, t in rows)
    sizes = [sum(r["size"] for r in made if r["shard"] == k) for k in range(24)]
    assert max(sizes) - min(sizes) <= 2 * 23
    for k in range(24):
        assert sorted(r["slot"] for r in made if r["shard"] == k) == list(range(sum(r["shard"] == k for r in made)))


def test_pieces_do_not_change_slots(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = got(S.histogram_shards(docs, 3))
    monkeypatch.setattr(S, "PIECE_BYTES", 30_000)
    assert got(S.histogram_shards(docs, 3)) == want
    assert S.sharded(docs, 3).rdd.glom().filter(len).count() > 6

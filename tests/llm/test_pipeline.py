import hashlib

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_ngram_jaccard import brute as linked
from tests.llm.test_tokens import TIKTOKEN


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, str(DATA))
        if name == "bpe":
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(before)
            assert all(r["n_tokens"] == len(TIKTOKEN.encode_ordinary(before[r["doc_id"]])) and r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest() for r in rows)
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.items() <= before.items()
        seen[name] = len(before) - len(after)
        if name == "ngram_jaccard":
            assert set(after) == {i for i, (_, c) in linked(before.items()).items() if c == i}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(after) == {x[0] for x in contaminated(before.items(), items) if not x[4]}
    assert seen["language_id"] <= 0.01 * len(before) + 3


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, str(DATA))
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    assert 0 < rows.count() <= spark.read.parquet(f"{DATA}/documents.parquet").count() and rows.where("not round_trip").isEmpty()
    # Row by row what the stages give in turn.
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))


def test_odd_documents_pass_all_stages(spark, docs, no_docs, tmp_path):
    """Nulls, empty and repeated rows, further columns: rows without letters go, and one of each group stays."""
    clean = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = docs.unionByName(clean, allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(DATA))
        assert set(columns) == set(rows.columns)
        rows = spark.createDataFrame(rows.collect(), rows.schema)
    left = [r["doc_id"] for r in rows.where("row = 'x'").collect()]
    assert not set(left) & {1, 2, 3, 40} and left.count(17) <= 1
    out = corpus_pipeline.STAGES[-1][1](spark, rows, str(DATA))
    assert out.count() == rows.count() and out.where("not round_trip").isEmpty()
    rows = no_docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(DATA))
    assert rows.count() == 0

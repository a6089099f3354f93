"""What ranking and the stored index shuffle: rows for documents, not for each term of each."""

from pyspark.sql import functions as F

from corpusmill.operators import index, search
from corpusmill.plans.corpus import files
from tests.conftest import DATA


def test_strongest_terms_with_rare_ones_joined(spark, monkeypatch):
    docs = files(spark, str(DATA)).select("path", "content")
    w = search.tfidf(docs).orderBy("path", F.desc(F.round("weight", 9)), "term").collect()
    by = {}
    for r in w:
        by.setdefault(r["path"], []).append((r["term"], round(r["weight"], 6)))
    for common in (0, 50, 100_000):  # all joined, some, none
        monkeypatch.setattr(search, "COMMON", common)
        got = {(r["path"], r["place"]): (r["term"], r["weight"]) for r in search.strongest_terms(docs, 3).collect()}
        assert {k: v[0] for k, v in got.items()} == {(p, i + 1): x[0] for p, xs in by.items() for i, x in enumerate(xs[:3])}
    df = search.document_frequencies(docs).orderBy(F.desc("df")).collect()
    few = search.candidates(docs, {r["term"]: r["df"] for r in df}, docs.count(), 3).count()
    assert few < len(w) / 5


def test_norms_with_rare_terms_joined(spark, monkeypatch, tmp_path):
    docs = files(spark, str(DATA)).select(F.col("path").cast("string").alias("path"), F.lit("1").alias("mark"), "content")
    for common in (20, 200_000):
        monkeypatch.setattr(index, "COMMON", common)
        base = f"{tmp_path}/{common}"
        now = index.build(docs, base, 50)
        units, df = (index.rows(spark, base, now, t) for t in ("units", "terms"))
        plain = {r["doc"]: r["norm"] for r in index.norms(units, df, now.units, "doc").collect()}
        written = {r["doc"]: r["norm"] for r in index.rows(spark, base, now, "norms").collect()}
        assert plain.keys() == written.keys() and all(abs(plain[d] - written[d]) < 1e-12 for d in plain)
        held = index.rows(spark, base, now, "postings").select("term", F.explode("entries").alias("e")).select("term", "e.doc", "e.impact")
        want = {(r["term"], r["doc"]): r["share"] / plain[r["doc"]] for r in index.shares(units, "doc").collect()}
        got = held.collect()
        assert len(got) == len(want) and all(abs(want[r["term"], r["doc"]] - r["impact"]) < 1e-12 for r in got)
        assert index.rows(spark, base, now, "postings").groupBy("term", "block").count().where("count > 1").isEmpty()

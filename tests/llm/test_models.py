"""Language ID and toxicity: features by brute force, held-out accuracy, odd documents."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import language_id as L
from corpusmill.llm import toxicity as X
from corpusmill.llm.letters import letter_runs, letter_table
from corpusmill.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.conftest import ROWS

TEXTS = ["", "a", "Ab, cD!", "  x  ", "ñ\nÉ1é", "12", "one two three"]


def runs(text):
    table, out = letter_table(), [0]
    for c in text:
        x = int(table[ord(c)])
        if x or out[-1]:
            out.append(x)
    return out + [0] * (out[-1] != 0 and 1)


def test_letters():
    for t in TEXTS:
        codes, at = letter_runs([t])
        assert codes.tolist() in (runs(t), [*runs(t), 0]) and at.tolist() == [0, len(codes) - 1]
    codes, at = letter_runs(TEXTS)
    for k, t in enumerate(TEXTS):
        assert codes[at[k] : at[k + 1] + 1].tolist() == letter_runs([t])[0].tolist()


def test_gram_counts_do_not_depend_on_neighbours():
    together, letters = L.gram_counts(TEXTS)
    for k, t in enumerate(TEXTS):
        alone, n = L.gram_counts([t])
        assert (together[k] == alone[0]).all() and letters[k] == n[0] == sum(c.isalpha() for c in t)


def held(i, modulus, k):
    return zlib.crc32(str(i).encode()) % modulus == k


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, str(DATA)).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert np.mean([docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in test]) > 0.9


def test_language_odd_documents(spark, docs, no_docs):
    rows = L.identify(docs, L.crc(F.col("doc_id"), 4) != 2).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = {i: t for i, t in ROWS}[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert L.identify(no_docs, F.lit(True)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify(unlabelled, F.lit(True)).collect()} == {"und"}
    kept = L.keep_identified(docs, F.lit(True))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in ROWS if any(c.isalpha() for c in t or "")}


def test_far_texts_are_rejected():
    counts, _ = L.gram_counts(["the cat and the dog sat on the mat with the rat " * 3] * 3 + ["der hund und die katze sitzen auf der matte mit dem tier " * 3] * 3)
    model = L.learn(counts, ["en"] * 3 + ["de"] * 3)
    assert not model.predict(["the"])[0][2]
    texts = {"en": "the cat and the dog sat on the mat with the rat " * 3, "de": "der hund und die katze sitzen auf der matte mit dem tier " * 3}
    model = model.with_limits([(lang, *x) for lang, t in texts.items() for x in model.passage_cosines(t, lang)])
    got = model.predict(["the dog and the cat sat on the mat", "その本はとても面白かったのでもう一度読みたいと思います" * 3, "die katze und der hund"])
    assert [x[0] for x in (got[0], got[2])] == ["en", "de"] and got[1][2] and not got[0][2]


def corpus(n, seed):
    """Clean and toxic texts: a slur or a misspelling of it, somewhere."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 9))) for _ in range(600)]
    texts, toxic = [], rng.random(n) < 0.4
    for t in toxic:
        w = list(rng.choice(words, rng.integers(5, 150)))
        for _ in range(int(t) * rng.integers(1, 4)):
            w[rng.integers(len(w))] = rng.choice(["vexqobat", "hugzwark"]) + rng.choice(["", "s", "ed", "ling"])
        texts.append(" ".join(w))
    return texts, toxic.astype(int)


def test_toxicity_finds_slurs_and_misspellings():
    model = X.learn_texts(*corpus(400, 1))
    texts, toxic = corpus(300, 2)
    found = model.score(texts) >= X.LIMIT
    assert found[toxic == 1].mean() > 0.95 and found[toxic == 0].mean() < 0.03
    long_ = " ".join(texts[k] for k in np.flatnonzero(toxic == 0)[:60])
    assert model.score([long_ + " vexqobatz " + long_])[0] >= X.LIMIT > model.score([long_])[0]
    assert (model.score(["", "!!", "12"]) == 0).all()
    assert np.allclose(model.score(texts[:40]), [model.score([t])[0] for t in texts[:40]])


def test_toxicity_query(spark):
    rows = QUERIES["op5_toxicity"](spark, str(DATA)).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)


def test_toxicity_odd_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([(6, 0, 0), (6, 0, 0), (10, 1, 1), (12, None, None), (None, 1, 1), (99, 0, 1), (11, 0, 0)], "doc_id long, quality int, toxic int")
    rows = X.toxicity(docs, labels, F.lit(True)).collect()
    assert len(rows) == len(ROWS) and all(r["score"] == 0 for r in rows if not any(c.isalpha() for c in {i: t for i, t in ROWS}[r["doc_id"]] or ""))
    assert {r["score"] for r in X.toxicity(docs, labels.where("false"), F.lit(True)).collect()} == {0.0}
    assert X.toxicity(no_docs, labels, F.lit(True)).collect() == []
    assert X.keep_clean(docs, labels.where("false"), F.lit(True)).count() == len(ROWS)


FAR = ["Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και φεύγει μακριά στο δάσος", "Съешь же ещё этих мягких французских булок да выпей чаю вместе с друзьями у реки", "その本はとても面白かったのでもう一度読みたいと思います", "zxqj kvwpt xqzzk jjvqx wkxpq zzqvj xkqpw qqzjx vvkxz pqwxk jzxqv kkpqx zvxwq xjqkz"]


def test_far_documents_go_and_others_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(10_000_000 + k, x * n, None, "far", len(x) * n) for n in (1, 2, 30) for k, x in enumerate(FAR, 4 * n)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in L.keep_identified(both, L.crc(F.col("doc_id"), 4) != 2).collect()}
    assert not kept & {r[0] for r in rows}
    assert len(kept) >= 0.99 * docs.count()


def cosine_brute(model, text):
    """Language and cosine from n-grams counted one by one."""
    codes, _ = letter_runs([text])
    s, counts = codes.tolist(), np.zeros(L.DIMENSIONS)
    mask = (1 << 64) - 1
    for k in (1, 2, 3):
        for i in range(len(s) - k + 1):
            gram = s[i : i + k]
            if i >= len(s) - 1 or (k == 1 and not gram[0]) or (k > 1 and not (gram[0] or gram[1])):
                continue
            h = 0
            for n, c in enumerate(gram):
                h = (h * 0x10001 + c) & mask if n else c
            counts[((h + k) * 0x9E3779B97F4A7C15 & mask) >> 52] += 1
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
    near = model.centroids @ (x / max(np.sqrt((x * x).sum()), 1e-9))
    return model.languages[model.of[near.argmax()]], near.max()


def test_language_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = L.train(docs, L.crc(F.col("doc_id"), 4) != 2)
    got = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, str(DATA)).collect()}
    for r in docs.collect():
        lang, x = cosine_brute(model, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - x) < 1e-4


def toxic_brute(scorer, text):
    """The worst mean of two words that follow each other, word by word."""
    words = "".join(map(chr, letter_runs([text])[0])).split("\0")
    words = [w for w in words if w]
    mask, parts = (1 << 64) - 1, []
    for w in words:
        s, values = [0, *map(ord, w), 0], []
        for n in (3, 4, 5):
            for i in range(len(s) - n + 1):
                h = s[i]
                for c in s[i + 1 : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) & mask
                h ^= h >> 29
                values.append(float(scorer.table[(h * 0xBF58476D1CE4E5B9 & mask) >> 47]))
        parts.append(sum(values) / max(1, len(values)))
    top = max(((parts[i] + parts[i + 1]) / 2 if i + 1 < len(parts) else parts[i] for i in range(len(parts))), default=None)
    if top is None:
        return 0.0
    return 1 / (1 + np.exp(-np.clip(scorer.slope * (top + scorer.constant - scorer.middle) + np.log(X.LIMIT / (1 - X.LIMIT)), -60, 60)))


def test_toxicity_query_against_brute_force_and_held_out(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scorer = X.train(spark.read.parquet(f"{DATA}/documents.parquet"), labels, L.crc(F.col("doc_id"), 3) != 1)
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, str(DATA)).collect()}
    for i, text in list(docs.items()):
        assert abs(got[i]["score"] - toxic_brute(scorer, text)) < 1e-4


def test_toxicity_held_out(spark):
    """At the production limit, on the documents that nothing was learned from; sf0.01 has some 130 of them labelled."""
    folder = DATA.parent / "sf0.01"
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_toxicity"](spark, str(folder)).collect() if r["held_out"] and r["doc_id"] in marks]
    caught = [r["predicted"] for r in rows if marks[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in rows if marks[r["doc_id"]] == 0]
    print(len(caught), np.mean(caught), len(clean), np.mean(clean))
    assert np.mean(caught) >= 0.85 and np.mean(clean) <= 0.02


def test_repeated_ids_do_not_swell_the_sample(spark):
    texts, toxic = corpus(120, 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, f"another text {k}") for k in range(500)] + [(1, "x " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    scorer = X.train(docs, labels, F.lit(True))
    found = scorer.score(texts) >= X.LIMIT
    assert found[toxic == 1].mean() > 0.85 and found[toxic == 0].mean() < 0.1


def test_rows_of_one_id_are_sampled_like_others(spark):
    """Whatever the id, and however often a row repeats, each language is learned from about as many texts as its bound."""
    text = "The quick brown fox number {} jumps over the lazy dog and goes home through the wood."
    for doc_id in (0, 2):
        rows = [(doc_id, text.format(k), "en") for k in range(3 * L.SAMPLE)] + [(doc_id, "Der schnelle braune Fuchs springt über den faulen Hund.", "de")] * 2_000
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
        model = L.train(docs, F.lit(True))
        assert model.languages == ["de", "en"]
        assert [x[0] for x in model.predict(["The brown dog goes home", "Der faule Hund springt"])] == ["en", "de"]

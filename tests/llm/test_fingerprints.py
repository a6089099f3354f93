import hashlib
import random

from corpusmill.llm import fingerprints as P
from corpusmill.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.conftest import ROWS


def test_spans_and_extensions():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("abñ😀") for _ in range(rng.randrange(40))) for _ in range(2))
        x, y = P.PrefixHashes(a), P.PrefixHashes(b)
        for _ in range(20):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
            assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert x.common_extension(i, y, j) == k


def test_likeness_bounds_what_texts_share():
    mark = lambda t: P.PrefixHashes(t).fingerprint()
    assert P.likeness(mark(""), mark("")) == 1 and P.likeness(mark(""), mark("a")) == 0
    rng = random.Random(3)
    for n in (1, 10, 1000, 5000):
        a = "".join(rng.choice("abcdefgh") for _ in range(n))
        half = a[: n - n // 2] + "".join(rng.choice("ijklmn") for _ in range(n // 2))
        assert P.likeness(mark(a), mark(a)) == 1
        if n >= 10:
            assert 0.38 <= P.likeness(mark(a), mark(half)) <= 0.51
            assert P.likeness(mark(a), mark("z" + a[::-1] + "y")) < 0.05
            assert 0.7 < P.likeness(mark(a), mark(a[: n // 3] + "Q" + a[n // 3 + 1 :])) < 1


def test_likeness_of_scattered_edits():
    mark = lambda t: P.PrefixHashes(t).fingerprint()
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    for n in (40, 300, 4000):
        a = [rng.choice(words) for _ in range(n)]
        b = ["X", *a[1:-1], "Y"]
        assert 0.6 < P.likeness(mark(" ".join(a)), mark(" ".join(b))) < 1
        for k in range(0, n, 40):
            b[k] = "Q"
        b[n // 2 : n // 2] = ["put", "in"]
        assert 0.6 < P.likeness(mark(" ".join(a)), mark(" ".join(b))) < 1
        moved = a[n // 2 :] + a[: n // 2]
        assert 0.7 < P.likeness(mark(" ".join(a)), mark(" ".join(moved))) < 1
        assert P.likeness(mark(" ".join(a)), mark("Z".join(rng.choice(words)[::-1] for _ in range(n)))) < 0.05
    for unit in ("a", "ab", "the same line of text, again\n"):
        a = unit * (3000 // len(unit))
        assert 0.7 < P.likeness(mark(a), mark("X" + a[1:1500] + "X" + a[1501:-1] + "X")) < 1
        assert P.likeness(mark(a), mark(a * 2)) <= 0.5


def test_pieces_tile_the_text():
    for text in ("", "a", "ab" * 200, "".join(random.Random(6).choice("abñ😀 ") for _ in range(999))):
        x, cuts = P.PrefixHashes(text), P.PrefixHashes(text).cuts().tolist()
        assert cuts == sorted(set(cuts)) and (not text or (cuts[0], cuts[-1]) == (0, len(text))) and all(b - a <= P.LONGEST for a, b in zip(cuts, cuts[1:], strict=False))
        pieces = x.fingerprint().split(".")[-1]
        assert pieces == "".join(f"{b - a:02x}{x.span(a, b)[0]:08x}" for a, b in zip(cuts, cuts[1:], strict=False))


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    return sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows], key=str), rows


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    mine, full = got(QUERIES["op2_fingerprints"](spark, str(DATA)))
    assert mine == edited(rows)
    text, by = dict(rows), {}
    for r in full:
        assert by.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(by.values())) == len(by)


def test_odd_documents_and_cells(spark, docs, no_docs, monkeypatch):
    assert got(P.fingerprint_documents(docs))[0] == edited(ROWS)
    assert P.fingerprint_documents(no_docs).collect() == []
    original = P.in_order
    monkeypatch.setattr(P, "in_order", lambda d: original(d, 4))
    assert got(P.fingerprint_documents(docs))[0] == edited(ROWS)


def test_any_id_and_hot_ids(spark, monkeypatch):
    rows = [(-4611686018427387904, "least of some"), (0, "zero"), (-(1 << 63), "least of all"), ((1 << 63) - 1, None)] + [(None, f"no id {k}") for k in range(60)] + [(5, "repeated row")] * 30
    original = P.in_order
    monkeypatch.setattr(P, "in_order", lambda d: original(d, 8))
    full = P.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_chars"]) for r in full), key=str) == sorted(((i, len(t or "")) for i, t in rows), key=str)
    cells = original(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).where("not extra").groupBy("cell").count().collect()
    assert len(cells) > 6 and max(r["count"] for r in cells) <= 40


def test_each_cell_has_its_partition(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text")
    parts = P.in_order(rows, 500).rdd.map(lambda r: r["cell"]).glom().map(set).collect()
    assert all(len(p) == 1 for p in parts) and len(parts) >= 8

"""Language identification by nearest centroid.

A text becomes counts of its letter n-grams (1 to 3, with word ends, hashed into DIMENSIONS), damped (1 + ln),
weighted by inverse document frequency and scaled to length 1. Each language has several centroids, found by
spherical k-means. A text has the language of the centroid with the largest cosine (of equal ones the first). It is
rejected if that cosine is below the language's limit: then the text is far from everything learned. Cosines grow with
the length, so the limit does: it is a share of the lowest cosines that passages of the training texts with as many
letters have, measured at LENGTHS and interpolated between them;
longer texts are held to the last, as their cosines only grow.

Learning takes a sample of at most about SAMPLE texts for each language, picked by a hash of id and text (repeated rows
count once, and each language has a text at least); all other work is one pass over whole texts, long ones by themselves. Texts that
are null or without a letter are `und`, score 0 and rejected, and so is all where nothing was learned (no labelled rows).
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, light
from corpusmill.llm.letters import letter_runs, text_blocks

DIMENSIONS = 4096
#: The bound of the training sample: about so many texts of each language.
SAMPLE = 500
CENTROIDS = 4
#: The share of the lowest cosines (the quantile LOW) of passages at which a language rejects.
FAR, LOW = 0.5, 0.01
#: Numbers of letters for which limits are measured.
LENGTHS = [2**k for k in range(1, 10)]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (a row for each text), and the texts' numbers of letters."""
    codes, at = letter_runs(texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(at))  # of each position but the last
    c = codes.astype(np.uint64)
    out = np.zeros(n * DIMENSIONS, np.int64)
    grams = c.copy()
    letters = np.bincount(row[codes[:-1] > 0], minlength=n)
    for k in (1, 2, 3):
        if k > 1:
            grams = grams[:-1] * np.uint64(0x10001) + c[k - 1 :]
        size = min(len(grams), len(row))
        ok = np.ones(size, bool)
        if k == 1:
            ok = codes[:size] > 0
        else:  # not from one text into the next
            ok[:] = row[:size] == np.append(row, n)[k - 2 : k - 2 + size]
            ok &= (codes[:size] > 0) | (codes[1 : size + 1] > 0)
        hashed = (grams[:size] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
        out += np.bincount((row[:size] * DIMENSIONS + hashed.astype(np.int64))[ok], minlength=n * DIMENSIONS)
    return out.reshape(n, DIMENSIONS), letters


@dataclass
class Centroids:
    """A model: languages, their centroids (rows), each centroid's language, weights, limits (languages by LENGTHS)."""

    languages: list[str]
    centroids: np.ndarray
    of: np.ndarray
    idf: np.ndarray
    limits: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return weighted(counts, self.idf)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, cosine, rejected."""
        out: list[tuple[str, float, bool]] = []
        for block in text_blocks(texts):
            for k in range(0, len(block), 64):
                counts, letters = gram_counts(block[k : k + 64])
                if not self.languages:
                    out += [("und", 0.0, True)] * len(counts)
                    continue
                near = self.vectors(counts) @ self.centroids.T
                best = near.argmax(1)
                for i, b in enumerate(best):
                    x, lang = float(near[i, b]), int(self.of[b])
                    out.append((self.languages[lang], min(max(x, 0.0), 1.0), x < self.limit(lang, int(letters[i]))) if letters[i] else ("und", 0.0, True))
        return out

    def limit(self, lang: int, letters: int) -> float:
        return float(np.interp(np.log2(letters), np.log2(LENGTHS), self.limits[lang]))

    def passage_cosines(self, text: str, lang: str) -> list[tuple[int, float]]:
        """Of a passage with each of LENGTHS letters, as far as the text has as many, and of the whole text, which counts for the
        next length: the place in LENGTHS and the cosine with the language's nearest centroid."""
        at = [i for i, c in enumerate(text) if c.isalpha()]
        if not at:
            return []
        fit = [k for k, n in enumerate(LENGTHS) if n <= len(at)]
        starts = [zlib.crc32(f"{k} {len(at)}".encode()) % (len(at) - LENGTHS[k] + 1) for k in fit]
        passages = [text[at[s] : at[s + LENGTHS[k] - 1] + 1] for k, s in zip(fit, starts, strict=True)] + [text]
        own = self.centroids[self.of == self.languages.index(lang)]
        cosines = [float((self.vectors(gram_counts([p])[0]) @ own.T).max()) for p in passages]
        return list(zip([*fit, min(len(fit), len(LENGTHS) - 1)], cosines, strict=True))

    def with_limits(self, cosines: list[tuple[str, int, float]]) -> Centroids:
        """The model with limits from passages' language, place in LENGTHS and cosine. A length that no passage has takes the
        limit of the one before."""
        limits = np.zeros((len(self.languages), len(LENGTHS)))
        for j, lang in enumerate(self.languages):
            for k in range(len(LENGTHS)):
                x = [c for name, place, c in cosines if place == k and name == lang]
                limits[j, k] = FAR * float(np.quantile(x, LOW)) if x else limits[j, k - 1] if k else 0.0
        return replace(self, limits=limits)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    np.log(x, out=x, where=x > 0)
    x = np.where(counts > 0, x + 1, 0) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def learn(counts: np.ndarray, langs: list[str]) -> Centroids:
    """Centroids of labelled counts, without limits."""
    languages = sorted(set(langs))
    label = np.array([languages.index(x) for x in langs], int)
    idf = (np.log((1 + len(langs)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = weighted(counts, idf)
    rows, of = [], []
    for k in range(len(languages)):
        own = x[label == k]
        rng = np.random.default_rng(k)
        c = own[rng.permutation(len(own))[: min(CENTROIDS, len(own))]]
        for _ in range(10):
            to = (own @ c.T).argmax(1)
            c = np.array([own[to == j].mean(0) if (to == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)
        rows.append(c)
        of += [k] * len(c)
    return Centroids(languages, np.concatenate(rows) if rows else np.zeros((0, DIMENSIONS), np.float32), np.array(of, int), idf, np.zeros((len(languages), len(LENGTHS))))


def crc(id_: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(id_.cast("string").cast("binary")) % modulus


def train(docs: DataFrame, usable: Column) -> Centroids:
    """Learn from text and lang of the usable rows; a sample bounded for each language. Texts become counts on the
    executors, so a sampled row costs the driver the same however long its text is; then passages become cosines there."""
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return learn(np.zeros((0, DIMENSIONS), np.int64), [])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 30, (SAMPLE << 30) // n))])
    # By id and text, so that rows of one id are sampled like others; repeated rows count once, and each language has a text at least.
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    first = rows.groupBy("lang").agg(F.min_by(F.col("text"), F.struct(chance, F.xxhash64("text"))).alias("text"))
    picked = cut(rows.where(chance < share[F.col("lang")]).select("lang", "text").unionByName(first).distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            counts = [c.astype("<u4") for block in text_blocks(texts) for k in range(0, len(block), 64) for c in gram_counts(block[k : k + 64])[0]]
            if texts:
                yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([c.tobytes() for c in counts], pa.binary())], ["lang", "counts"])

    got = sorted((r["lang"], bytes(r["counts"])) for r in picked.mapInArrow(light(count), "lang string, counts binary").collect())
    counts = np.frombuffer(b"".join(c for _, c in got), "<u4").reshape(-1, DIMENSIONS)
    model = learn(counts, [x for x, _ in got])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, *x) for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) for x in sent.value.passage_cosines(text, lang)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["lang", "place", "cosine"])

    return model.with_limits([tuple(r) for r in picked.mapInArrow(light(measure), "lang string, place int, cosine double").collect()])


def predictor(docs: DataFrame, model: Centroids) -> Callable[[list[str | None]], list[tuple[str, float, bool]]]:
    """A function for executors; the model (a few hundred KB at most for each language) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: sent.value.predict([x or "" for x in texts])


def identify(docs: DataFrame, usable: Column) -> DataFrame:
    """doc_id, held_out (not usable for learning), lang_pred, score (cosine), rejected of each row."""
    predict = predictor(docs, train(docs, usable))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = predict(batch["text"].to_pylist())
            cols = [pa.array([x[k] for x in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *cols], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(usable, F.lit(False))).alias("held_out"), "text")
    return rows.mapInArrow(light(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, usable: Column) -> DataFrame:
    """The rows whose text is not rejected, with all their columns."""
    predict = predictor(docs, train(docs, usable))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x[2] for x in predict(batch["text"].to_pylist())], pa.bool_()))

    return docs.mapInArrow(light(run), docs.schema)

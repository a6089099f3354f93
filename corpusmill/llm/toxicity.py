"""Toxicity by a bag of subwords in a linear softmax.

Each word (letters only, lower-cased) is the mean of the vectors of its character n-grams (3 to 5, with word ends,
hashed into BUCKETS); a passage of WIDTH words is the mean of its words; a linear softmax turns it into two
classes. Vectors and softmax are trained together, in numpy. Misspellings share most n-grams with what they
misspell, and so their vectors. A document is as toxic as its most toxic passage, so one slur in a long text counts.
As only documents are labelled, training first takes each word by the documents it is in, then, in rounds, the
passages that the model finds worst: those of toxic documents as toxic, those of clean ones as clean. The score
is the worst passage's probability, on a scale fitted so that the training documents' classes part at 0.7.

Since the softmax is linear in means, scoring needs one number for each bucket. Learning takes at most about SAMPLE
labelled texts of each class, picked by a hash of the id (of rows that repeat an id, the least text; an id that is
labelled both ways counts as toxic); the sample alone bounds its words. The texts stay on the executors, written to the shared folder: the driver sees words with two counts and, in each round, a passage of WIDTH
words a text. Scoring is one pass over whole texts; a long one is taken by itself. Null and empty texts, and all
texts where nothing could be learned, score 0; repeated rows come out as often, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, light
from corpusmill.llm.letters import letter_runs, text_blocks

BUCKETS, VECTOR, WIDTH = 1 << 17, 8, 2
#: The bound of the training sample: about so many texts of each class.
SAMPLE = 1500
#: The tasks that the sample is kept in.
SLICES = 8
#: Score at and above which a document is toxic.
LIMIT = 0.7


def word_grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams in words, and the number of the word (counted by the 0 before it) that each is in."""
    zeros = np.flatnonzero(codes == 0)
    word = np.cumsum(codes == 0) - 1
    end = np.append(zeros, len(codes))[word + 1]  # the next 0
    c = codes.astype(np.uint64)
    buckets, words = [], []
    h = c
    place = np.arange(len(codes))
    for n in range(2, 6):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        if n > 2:
            ok = np.flatnonzero(place[: len(h)] + n - 1 <= end[: len(h)])
            x = h[ok]
            x ^= x >> np.uint64(29)
            buckets.append((x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 17)).astype(np.int32))
            words.append(word[ok].astype(np.int32))
    return np.concatenate(buckets), np.concatenate(words)


class Softmax:
    """The model in training."""

    def __init__(self) -> None:
        rng = np.random.default_rng(5)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, VECTOR)).astype(np.float32)
        self.weights = rng.normal(0, 0.5, (VECTOR, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = np.full(BUCKETS, 1e-4, np.float32)

    def fit(self, grams: np.ndarray, bag: np.ndarray, share: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int, batch: int = 2048, rate: float = 0.5) -> None:
        """Bags of grams (sorted by bag; share: each gram's part of its bag), the toxic part of each bag's target, and
        the bags' weights; Adagrad over mini-batches."""
        starts = np.searchsorted(bag, np.arange(len(target) + 1))
        order = np.random.default_rng(len(target)).permutation(-(-len(target) // batch))
        for _ in range(epochs):
            for b in order:
                lo, hi = b * batch, min((b + 1) * batch, len(target))
                g, w = grams[starts[lo] : starts[hi]], share[starts[lo] : starts[hi]]
                own = bag[starts[lo] : starts[hi]] - lo
                x = np.stack([np.bincount(own, self.vectors[g, d] * w, hi - lo) for d in range(VECTOR)], 1)
                z = x @ self.weights + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                error = (p - np.stack([1 - target[lo:hi], target[lo:hi]], 1)) * weight[lo:hi, None]
                back = (error @ self.weights.T).astype(np.float32)
                scale = 1 / max(1.0, float(weight[lo:hi].sum()))
                self.weights -= rate * scale * (x.T @ error).astype(np.float32)
                self.bias -= rate * scale * error.sum(0).astype(np.float32)
                size = np.bincount(g, (np.abs(back).mean(1)[own] * w) ** 2, BUCKETS).astype(np.float32)
                self.seen += size
                step = rate / np.sqrt(self.seen)
                for d in range(VECTOR):
                    self.vectors[:, d] -= 0.2 * step * np.bincount(g, back[own, d] * w, BUCKETS).astype(np.float32)

    def table(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the logit of the toxic class, and the constant."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


class Scorer:
    """A trained model as executors need it: logits by bucket, constant, and scale of the score."""

    def __init__(self, table: np.ndarray, constant: float, middle: float = 0.0, slope: float = 1.0, empty: bool = False):
        self.table, self.constant, self.middle, self.slope, self.empty = table, constant, middle, slope, empty

    def words(self, codes: np.ndarray) -> np.ndarray:
        """A logit part for each 0 in codes: of the word after it (0.0 where none is)."""
        grams, word = word_grams(codes)
        n = int((codes == 0).sum())
        count = np.bincount(word, minlength=n)
        return np.bincount(word, self.table[grams], n) / np.maximum(count, 1)

    def worst(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's largest passage logit, and the number (in the block) of the word where it begins."""
        codes, at = letter_runs(texts)
        score = self.words(codes)
        zeros = np.flatnonzero(codes == 0)
        first = np.searchsorted(zeros, at)  # of each text's words; the last entry is the block's end
        last = np.zeros(len(score), bool)
        last[first[1:] - 1] = True
        passage = score.copy()
        count = np.ones(len(score))
        for k in range(1, WIDTH):  # words k further on, while in the same text
            row = np.searchsorted(first, np.arange(len(score) - k), "right") == np.searchsorted(first, np.arange(k, len(score)), "right")
            real = row & (codes[np.minimum(zeros[k:] + 1, len(codes) - 1)] > 0)
            passage[:-k] += np.where(real, score[k:], 0)
            count[:-k] += real
        passage = passage / count + self.constant
        empty = np.append(codes[1:], 0)[zeros] == 0
        passage[empty] = -np.inf
        top = np.maximum.reduceat(passage, first[:-1])
        where = np.array([a + int(passage[a:b].argmax()) for a, b in zip(first[:-1], first[1:], strict=True)])
        return top, where

    def score(self, texts: list[str]) -> np.ndarray:
        if self.empty:
            return np.zeros(len(texts))
        tops = [self.worst(block)[0] for block in text_blocks(texts)]
        x = np.concatenate(tops) if tops else np.zeros(0)
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(self.slope * (x - self.middle) + np.log(LIMIT / (1 - LIMIT)), -60, 60))))


def words_in(text: str) -> set[str]:
    """The words of a text."""
    return set("".join(map(chr, letter_runs([text])[0])).split("\0")) - {""}


def worst_passages(scorer: Scorer, texts: list[str]) -> list[tuple[str, float]]:
    """Each text's worst passage and its logit; '' and minus infinity where a text has no word."""
    out: list[tuple[str, float]] = []
    for block in text_blocks(texts):
        top, where = scorer.worst(block)
        codes, first = letter_runs(block)
        zeros, begins = np.append(np.flatnonzero(codes == 0), len(codes)), set(first.tolist())
        for x, at in zip(top.tolist(), where.tolist(), strict=True):
            parts: list[str] = []
            for j in range(at, min(at + WIDTH, len(zeros) - 1)):
                part = "".join(map(chr, codes[zeros[j] + 1 : zeros[j + 1]]))
                if not part or (parts and int(zeros[j]) in begins):
                    break
                parts.append(part)
            out.append((" ".join(parts), x))
    return out


def bags(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of items of one or more words, with each gram's part in the item's mean of means."""
    codes = np.frombuffer(("\0" + "\0".join(x.replace(" ", "\0") for x in items) + "\0").encode("utf-32-le"), np.uint32)
    grams, word = word_grams(codes)
    sizes = np.array([x.count(" ") + 1 for x in items])
    item = np.repeat(np.arange(len(items)), sizes)
    per_word = np.bincount(word, minlength=len(item) + 1)
    order = np.argsort(item[word], kind="stable")
    grams, word = grams[order], word[order]
    own = item[word]
    return grams, own, (1 / (per_word[word] * sizes[own])).astype(np.float32)


def learn(vocabulary: list[tuple[str, int, int]], sizes: tuple[int, int], worst: Callable[[Scorer], list[tuple[str, float, int]]], rounds: int = 6) -> Scorer:
    """A scorer from words with the numbers of clean and of toxic texts that have them, the numbers of all such texts, and a
    function that gives each text's worst passage, its logit and the text's label. Where a class is missing, all scores are 0."""
    none = Scorer(np.zeros(BUCKETS, np.float32), 0.0, empty=True)
    if not min(sizes) or not vocabulary:
        return none
    model = Softmax()
    words = [w for w, *_ in vocabulary]
    seen = np.array([c for _, *c in vocabulary], np.float64) / np.array(sizes)
    weight = seen.sum(1)
    target = seen[:, 1] ** 2 / (seen[:, 1] ** 2 + 9 * seen[:, 0] ** 2 + 1e-12)
    weight = np.clip(weight / weight.mean(), 0.2, 20).astype(np.float32)
    model.fit(*bags(words), target.astype(np.float32), weight, epochs=4, batch=8192)
    kept: set[tuple[str, int]] = set()
    for _ in range(rounds):
        kept |= {(passage, t) for passage, _, t in worst(Scorer(*model.table())) if passage}
        items = sorted(kept)
        if not items:
            return none
        y = np.array([t for _, t in items], np.float32)
        w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        model.fit(*bags([x for x, _ in items]), y, w.astype(np.float32), epochs=12, batch=1024)
    # The scale: the classes of the training texts part at LIMIT.
    scorer = Scorer(*model.table())
    last = worst(scorer)
    clean, bad = (np.array([x for p, x, t in last if p and t == label]) for label in (0, 1))
    if not len(clean) or not len(bad):
        return none
    low, high = float(np.quantile(clean, 0.999)), float(np.quantile(bad, 0.02))
    scorer.middle = low + 0.35 * (high - low) if high > low else float(np.quantile(clean, 0.998))
    scorer.slope = 4 / max(1e-3, float(np.quantile(bad, 0.5)) - scorer.middle)
    return scorer


def learn_texts(texts: list[str], toxic: np.ndarray) -> Scorer:
    """The same from texts at hand, labelled 0 or 1."""
    counts: dict[str, list[int]] = {}
    for text, t in zip(texts, toxic, strict=True):
        for w in words_in(text):
            counts.setdefault(w, [0, 0])[int(t)] += 1
    sizes = int((toxic == 0).sum()), int((toxic == 1).sum())
    return learn(sorted((w, *c) for w, c in counts.items()), sizes, lambda scorer: [(p, x, int(t)) for (p, x), t in zip(worst_passages(scorer, texts), toxic, strict=True)])


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Scorer:
    """Learn from the usable documents that are labelled; a sample bounded for each class."""
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(usable)
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return learn([], (0, 0), lambda _: [])
    share = F.when(F.col("toxic") == 1, min(1 << 30, (SAMPLE << 30) // sizes[1])).otherwise(min(1 << 30, (SAMPLE << 30) // sizes[0]))
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # A few thousand ids at any size of the input.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    sample = cut(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").repartition(SLICES))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, t in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = sorted(words_in(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([t] * len(found), pa.int32())], ["word", "toxic"])

    def worst(scorer: Scorer) -> list[tuple[str, float, int]]:
        sent = docs.sparkSession.sparkContext.broadcast(scorer)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = worst_passages(sent.value, batch["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), batch["toxic"]], ["passage", "logit", "toxic"])

        return sorted(tuple(r) for r in sample.mapInArrow(light(run), "passage string, logit double, toxic int").collect())

    counted = sample.mapInArrow(light(words), "word string, toxic int").groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("bad"))
    vocabulary = sorted(tuple(r) for r in counted.collect())  # all words of the sample, which alone bounds them
    of = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    return learn(vocabulary, (of.get(0, 0), of.get(1, 0)), worst)


def scoring(docs: DataFrame, scorer: Scorer) -> Callable[[list[str | None]], np.ndarray]:
    """A function for executors; the model (half a MB) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    return lambda texts: sent.value.score([x or "" for x in texts])


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, held_out (not usable for learning), score, predicted (1 at LIMIT or more) of each row."""
    score = scoring(docs, train(docs, labels, usable))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = score(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(x, pa.float64()), pa.array((x >= LIMIT).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(usable, F.lit(False))).alias("held_out"), "text")
    return rows.mapInArrow(light(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    score = scoring(docs, train(docs, labels, usable))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch["text"].to_pylist()) < LIMIT, pa.bool_()))

    return docs.mapInArrow(light(run), docs.schema)

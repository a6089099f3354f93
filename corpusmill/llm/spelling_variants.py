"""Grouping of spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers (each letter of the alphabet has a number from 1), so it doesn't depend
on their order, and taking letter c away lowers it by c's power. Two words that differ by one added or removed letter have
keys that differ by a power; by one exchanged letter, keys from which different powers are taken to the same rest. So each
word is filed under its own key, and under its key less each of its letters, and those are joined that meet, unless they meet
for the same letter (they are anagrams then). An edit lies in one half of a word, so the order of the letters in the other half is part
of what is joined: that splits up keys that very many words share, and finds each pair once. The order of all letters is then
verified (edit distance of just one). Of the pairs that are joined, the two halves leave few that fail.

A word has at most two entries for each of its letters, and at most about 90 neighbours for each place in it, so neither
grows with the number of words. The vocabulary, entries and pairs are tables; neighbours are counted and compared before a shuffle.
A word's form is its most frequent neighbour, if that is at least `ratio` times as frequent; forms are followed to their end by doubling,
in as many rounds as the longest way takes in bits (ways are short: each step multiplies the frequency).

Words: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Texts are read whole; a run may be as long as its text. A null
text has no words, a null doc_id counts as an empty one for `noisy`, repeated rows count as often as they come, ties go to the
word that is first in code-point order, and an empty table gives no rows. Further columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LOWER, cut, light, raw

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: A-Z only are lower-cased, so these are all letters of words.
ALPHABET = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]
POWER = 5
#: Different words that a task counts before it sends them on, and bytes of a text whose words aren't listed all at once.
WORDS_HELD, LONG = 200_000, 1 << 22
#: Letters of a word whose edit distance is computed.
LONG_WORD = 64

FOLD = LOWER.tobytes()
NUMBER = np.zeros(256, np.int64)
NUMBER[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)

#: (text of the id, run) -> what the run counts as
Noise = Callable[[str, str], str]


def noisy(doc_id: str, run: str, every: int = 31) -> str:
    """The run, without one letter where the CRC-32 of `<doc_id>:<run>` is divisible by `every`."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def counted_words(docs: DataFrame, noise: Noise | None = None, least: int = LEAST_LETTERS) -> DataFrame:
    """word, n of all documents' words of at least `least` letters."""
    find = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            data, offsets = raw(batch["text"])
            for k, name in enumerate(batch["id"].to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes().translate(FOLD).decode("utf-8", "replace")
                own = Counter(find.findall(text) if len(text) < LONG else (m[0] for m in find.finditer(text)))
                for word, n in own.items():
                    word = noise(name or "", word) if noise else word
                    if len(word) >= least:
                        total[word] += n
                if len(total) > WORDS_HELD:
                    yield send()
        yield send()

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(light(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def keys(words: DataFrame) -> DataFrame:
    """id, word, key, left and right (the numbers of the letters in each half) of words (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch["word"])
            letter = data != 0xC3  # letters beyond ASCII are this byte and another, 64 below the code point
            ends = np.append(0, np.cumsum(letter))[offsets]
            codes = data[letter]
            numbers = NUMBER[np.where(codes < 0x80, codes, codes + 0x40)]
            size = np.diff(ends)
            sums = np.append(0, np.cumsum(numbers**POWER))
            key = sums[ends[1:]] - sums[ends[:-1]]
            row = np.repeat(np.arange(len(size)), size)
            right = np.arange(len(numbers)) - ends[row] >= size[row] // 2
            there = np.zeros((2 * len(size), len(ALPHABET) + 1), bool)
            there[2 * row + right, numbers] = True
            half, number = np.nonzero(there)
            at = np.searchsorted(half, np.arange(2 * len(size) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(number, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["word"], pa.array(key), lists.take(pa.array(np.arange(0, 2 * len(size), 2))), lists.take(pa.array(np.arange(1, 2 * len(size), 2)))], ["id", "word", "key", "left", "right"])

    return words.select("id", "word").mapInArrow(light(run), "id long, word string, key long, left array<long>, right array<long>")


def entries(words: DataFrame) -> DataFrame:
    """key, part, letter, id: a word (letter 0) or a word less a letter; part tells which half is as it is, what it is, and the
    length of the longer of two words that meet."""
    size = F.length("word")

    def entry(key: Column, length: Column, left: bool, letter: Column) -> Column:
        half = F.floor(length / 2).cast("int")
        kept = F.substring("word", F.lit(1), half) if left else F.right("word", length - half)
        return F.struct(key.alias("key"), F.xxhash64(kept, F.lit(left), length).alias("part"), letter.alias("letter"))

    none = F.lit(0).cast("long")
    less = lambda letters, left: F.transform(letters, lambda x: entry(F.col("key") - x * x * x * x * x, size, left, x))
    all_ = F.concat(F.array(*[entry(F.col("key"), size + 1, left, none) for left in (True, False)]), less(F.col("right"), True), less(F.col("left"), False))
    return keys(words).select("id", F.explode(all_).alias("e")).select("e.*", "id")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words, of which b is as long or one longer, differ by one edit. Of long words the common beginning is found by
    bisection, as the time of an edit distance grows with the square of the length."""
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.left(a, middle(s)) == F.left(b, middle(s)), F.struct(middle(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (middle(s) - 1).alias("hi")))
    middle = lambda s: F.shiftright(s["lo"] + s["hi"] + 1, 1)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), F.length(a).alias("hi")), step, lambda s: s["lo"])
    rest = lambda word, start: F.substring(word, start, F.length(word))
    long = (a != b) & (rest(a, same + 1 + F.length(a) - F.length(b) + 1) == rest(b, same + 2))
    return F.when(F.length(b) <= LONG_WORD, F.levenshtein(a, b, 1) == 1).otherwise(long)


def neighbours(words: DataFrame) -> DataFrame:
    """a, b (ids), each pair of words (id, word, n) that are one edit apart, both ways, with b's word and n."""
    all_ = entries(words)
    a, b = all_.alias("a"), all_.alias("b")
    meet = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.letter") < F.col("b.letter")))
    # A removed letter that both halves have may be found in either: counts once.
    meet = meet.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    of = lambda side: words.select(F.col("id").alias(side), F.struct("word", "n").alias(f"{side}_"))
    a, b = F.col("a_.word"), F.col("b_.word")
    longer = F.length(a) > F.length(b)
    pairs = meet.join(of("a"), "a").join(of("b"), "b").where(one_edit(F.when(longer, b).otherwise(a), F.when(longer, a).otherwise(b)))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_").alias("a_"), F.col("a_").alias("b_"))).select("a", "b", F.col("b_.word").alias("word"), F.col("b_.n").alias("n"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root (a struct as `to`): where forms (id, to: struct of id and word) lead in the end. They must not go round."""
    now = cut(forms)
    while True:
        nxt = now.select(F.col("id").alias("at"), F.col("to").alias("further"))
        made = cut(now.join(nxt, F.col("to.id") == F.col("at"), "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if made.where("moved").isEmpty():
            return made.select("id", F.col("to").alias("root"))
        now = made.select("id", "to")


def variants(docs: DataFrame, noise: Noise | None = noisy, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of at least LEAST_LETTERS letters that come LEAST_COUNT times or more."""
    words = cut(counted_words(docs, noise).where(F.col("n") >= LEAST_COUNT).withColumn("id", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("n")).alias("less"), "word", F.col("b").alias("id"))).alias("best")
    near = neighbours(words).groupBy("a").agg(F.count("*").alias("n_near"), best).withColumnRenamed("a", "id")
    rows = cut(words.join(near, "id", "left").withColumn("to", F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct("best.id", "best.word"))))
    ends = roots(rows.where("to is not null").select("id", "to"))
    out = rows.join(ends, "id", "left")
    return out.select("word", F.col("to.word").alias("form"), F.coalesce("root.word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("to").isNotNull(), -F.col("best.less")).alias("form_n"))

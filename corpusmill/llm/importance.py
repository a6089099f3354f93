"""Importance resampling towards a target distribution, from hashed n-grams.

Each text's words are set out with their places (posexplode), and lead() over a document's places puts the one and two words
that follow beside each, so that concatenation gives all n-grams of up to ORDERS words. A CRC-32 of each gives its bucket; counts by
bucket of the corpus and of the target give a bucket's gain, and a document's weight is the sum of its n-grams' gains.

Texts are cut into pieces of PIECE words (each with the first words of the next) before their one exchange, so that a window
is over a piece, and a very long text is spread out; both passes (counts, then gains) read that exchange. Counts are summed
in each task before they move, and the BUCKETS gains, a table of fixed size, are broadcast. Drawn are the documents of highest
score: these are sorted by a range exchange, counted by partition, and numbered in each partition from the count before
it; the driver sees one count a partition.

Words are runs of digits, a-z and what is beyond ASCII, A-Z lower-cased. A null or empty text has no words and weight 0. Rows that
repeat a doc_id are documents of their own. Ties go to the smaller doc_id (null first), then to either. A null doc_id draws
as an empty one. An empty table gives no rows, an empty target counts 0 everywhere. Further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut

ORDERS, BUCKETS = 3, 10_000
#: Words of a piece of a text.
PIECE = 4_096
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def lowered(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    letters = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, letters, letters.lower()))


def pieces(docs: DataFrame, ids: list[str]) -> DataFrame:
    """key (a number for each row), the ids, piece (number), words (joined by blanks, with the first of the next piece). Dealt by all
    but the words, so that whoever reads them needs the same exchange."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), *ids, F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    rows = rows.select("key", *ids, "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - 1) / PIECE).cast("int")))).alias("piece"))
    text = F.array_join(F.transform(F.slice("w", F.col("piece") * PIECE + 1, PIECE + ORDERS - 1), lowered), " ")
    return rows.select("key", *ids, "piece", text.alias("words")).repartition("key", *ids, "piece")


def features(parts: DataFrame, ids: list[str]) -> DataFrame:
    """key, the ids, more (words beyond the first), bucket: a row for each n-gram; where there is none (at a text's end, or beyond a
    piece's own words, or without any word) the bucket is null."""
    along = Window.partitionBy("key", *ids, "piece").orderBy("at")
    rows = parts.select("key", *ids, "piece", F.posexplode(F.split("words", " ")).alias("at", "word"))
    after = [F.lead("word", k).over(along).alias(f"word{k}") for k in range(1, ORDERS)]
    rows = rows.select("key", *ids, "at", "word", *after)
    own, grams = (F.col("at") < PIECE) & (F.col("word") != ""), [F.col("word")]
    for k in range(1, ORDERS):
        grams.append(F.concat(grams[-1], F.lit(" "), F.col(f"word{k}")))
    buckets = F.array(*[F.when(own, (F.crc32(g.cast("binary")) % BUCKETS).cast("int")) for g in grams])
    return rows.select("key", *ids, F.posexplode(buckets).alias("more", "bucket"))


def bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain of all buckets; from the features of both."""
    all_ = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = all_.join(bucket_counts(corpus, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))  # BUCKETS rows
    corpus_size, target_size = (F.sum(c).over(whole).cast("double") for c in ("s", "t"))
    ratio = (F.col("t") + 1.0) * (corpus_size + float(BUCKETS)) / ((F.col("s") + 1.0) * (target_size + float(BUCKETS)))
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weighted(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = features(pieces(rows, ["doc_id"]), ["doc_id"])
    gain = F.broadcast(gains(own, features(pieces(target.select("text"), []), [])))  # BUCKETS rows
    sums = own.join(gain, "bucket", "left").groupBy("key", "doc_id")
    return sums.agg(F.count_if((F.col("more") == 0) & F.col("bucket").isNotNull()).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")).drop("key")


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variable, from a hash of seed and id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, count: int, order: list[Column]) -> DataFrame:
    """rows with rank 1 to `count` in this order, null beyond."""
    if count <= 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    placed = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    before, seen = {}, 0
    for part in sorted(sizes):
        before[part], seen = seen, seen + sizes[part]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part"))
    rank = (start + F.row_number().over(Window.partitionBy("part").orderBy(*order))).cast("long")
    return placed.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= count, F.col("rank"))).drop("part")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row: the `percent` of documents of at least `least_words` words that
    have the highest scores have a rank from 1, the others none."""
    rows = cut(weighted(docs, target).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    enough = F.col("n_words") >= least_words
    count = percent * rows.where(enough).count() // 100
    drawn = numbered(rows.where(enough), count, [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features")])
    return drawn.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resampled_rows(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The drawn rows' ids, in the order of their ranks."""
    return resampled(docs, target, **how).where("rank is not null").orderBy("rank").select("doc_id", "rank")

"""A stored TF-IDF index that grows by segments, and is asked for the nearest documents or chunks without reading any text.

A unit is a document, or a chunk of one. An index is a folder of segments, each written once and never changed, and of manifests, one
a change, which name the segments that count. A segment has
  texts      path, mark, content, by path, so that a few texts are found by the files' statistics;
  units      path, mark, lines, and the unit's terms with their counts, in the order of the texts;
  norms      the length of a unit's vector;
  postings   by term: blocks of units with neighbouring numbers, with the largest impact (share of the unit's tokens over its norm) in each;
  terms      term, df: by how many units having the term the segment changed the index (less what it took away);
  gone       units of earlier segments that it took away: their path was removed or came again.
So a change of k documents writes rows for k documents. Small segments at the end are merged from time to time (`settle`), from their
units, without their texts being tokenised again; folders that no manifest in use names are removed.

Inverse document frequencies, and so norms, depend on all units. A segment's norms are those of the day it was written. The manifest holds
for each segment how far any term's weight has moved since (`low`, `high`: least and largest ratio), so a norm is known within bounds;
a question computes exact norms, from the terms in `units`, only for what the bounds leave. Answers equal those of an index built at once.

A question reads the heads of its terms' blocks (no postings), then the postings of the most promising blocks, which give a score that
the k-th answer reaches, then those blocks that may reach it too. Nothing is dropped: a block is skipped if its largest
impacts can't reach that score.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.vectors import vectors
from corpusmill.operators import incremental
from corpusmill.sources import folders

#: Units in a block (a power of two, in bits), blocks that a question reads first, blocks that it lists in a pushed filter (beyond, it joins
#: them), and manifests that are kept for readers.
BLOCK_BITS, FIRST, LISTED, KEPT = 7, 32, 2_000, 2
#: Terms of most documents whose frequencies are broadcast when norms are computed (those of other terms are joined).
COMMON = 200_000
#: Bounds are widened by this, as sums may differ in the last digits.
SLACK = 1e-9
TABLES = ("texts", "units", "norms", "postings", "terms", "gone")


@dataclass
class Segment:
    name: str
    units: int  # live units of the whole index when it was written
    own: int  # units in it
    low: float = 1.0
    high: float = 1.0


@dataclass
class Manifest:
    version: int = -1
    limit: int | None = None  # identifiers in a chunk; None: whole documents
    batch: int = -1  # the last batch of a stream that it has
    units: int = 0
    paths: int = 0
    segments: list[Segment] = field(default_factory=list)


def manifests(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(x.removesuffix(".json")) for x in folders.names(spark, f"{base}/manifests") if x.removesuffix(".json").isdigit())


def latest(spark: SparkSession, base: str) -> Manifest | None:
    """The index as it is now; None where there is none."""
    found = manifests(spark, base)
    if not found:
        return None
    read = json.loads(folders.read_text(spark, f"{base}/manifests/{found[-1]}.json"))
    return Manifest(**read | {"segments": [Segment(**s) for s in read["segments"]]})


def load(spark: SparkSession, base: str, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}/{table}")


def rows(spark: SparkSession, base: str, now: Manifest, table: str) -> DataFrame:
    """A table of all segments, with the segment's place as `seg`."""
    out = None
    for k, s in enumerate(now.segments):
        part = load(spark, base, s.name, table).withColumn("seg", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def named(units: DataFrame, now: Manifest) -> DataFrame:
    """With the segment's name, which tells a unit in later versions too."""
    return units.withColumn("name", F.get(F.array(*[F.lit(s.name) for s in now.segments]), F.col("seg")))


def live(spark: SparkSession, base: str, now: Manifest) -> DataFrame:
    """The units that count."""
    return named(rows(spark, base, now, "units"), now).join(rows(spark, base, now, "gone").select("name", "doc"), ["name", "doc"], "left_anti")


def idf(df: Column, units: int | Column) -> Column:
    return F.log((F.lit(units) + 1.0) / (df + 1)) + 1


def shares(units: DataFrame, *keep: str) -> DataFrame:
    """A row for each term of each unit: the columns to keep, term, share."""
    out = units.select(*keep, "total", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return out.select(*keep, F.col("x.terms").alias("term"), (F.col("x.counts") / F.col("total")).alias("share"))


def norms(units: DataFrame, df: DataFrame, count: int, *key: str) -> DataFrame:
    """key, norm of units with any term, by these document frequencies."""
    weight = F.col("share") * idf(F.col("df"), count)
    return shares(units, *key).join(df, "term").groupBy(*key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def norms_of_all(units: DataFrame, df: DataFrame, count: int) -> DataFrame:
    """doc, norm of units with any term. A unit's common terms are summed where the unit is; only its rare terms are shuffled."""
    square = F.sum((F.col("share") * idf(F.col("df"), count)) ** 2).alias("square")
    common = F.broadcast(df.orderBy(F.desc("df"), "term").limit(COMMON))
    near = shares(units, "doc").join(common, "term").groupBy("doc").agg(square)
    rare = shares(units, "doc").join(common, "term", "left_anti").join(df, "term").groupBy("doc").agg(square)
    return near.unionByName(rare).groupBy("doc").agg(F.sqrt(F.sum("square")).alias("norm"))


def blocks(units: DataFrame, norms: DataFrame) -> DataFrame:
    """term, block, places (of units in the block), impacts. A block's units meet their norms in one place, whole, before they are
    taken apart by term."""

    def run(units: pa.Table, norms: pa.Table) -> pa.Table:
        doc, known = units["doc"].to_numpy(), norms["doc"].to_numpy()
        order = np.argsort(known)
        terms, counts = units["terms"].combine_chunks(), units["counts"].combine_chunks().flatten().to_numpy()
        of = np.repeat(np.arange(len(doc)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        norm = norms["norm"].to_numpy()[order[np.searchsorted(known[order], doc[of])]] if len(of) else np.zeros(0)
        impact = counts / units["total"].to_numpy()[of] / norm
        coded = terms.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        by = np.lexsort((doc[of], code))
        first = np.flatnonzero(np.diff(code[by], prepend=-1))
        at = pa.array(np.append(first, len(by)).astype(np.int32))
        columns = {
            "term": coded.dictionary.take(pa.array(code[by][first])),
            "block": pa.array(np.full(len(first), doc[0] >> BLOCK_BITS if len(doc) else 0, np.int64)),
            "places": pa.ListArray.from_arrays(at, pa.array((doc[of][by] & (1 << BLOCK_BITS) - 1).astype(np.int8))),
            "impacts": pa.ListArray.from_arrays(at, pa.array(impact[by])),
        }
        return pa.table(columns)

    block = F.shiftright("doc", BLOCK_BITS).alias("block")
    return units.select("doc", block, "total", "terms", "counts").groupBy("block").cogroup(norms.select("doc", block, "norm").groupBy("block")).applyInArrow(run, "term string, block long, places array<tinyint>, impacts array<double>")


def frequencies(spark: SparkSession, base: str, now: Manifest) -> DataFrame:
    """term, df over all segments."""
    return rows(spark, base, now, "terms").groupBy("term").agg(F.sum("df").alias("df"))


def moved(spark: SparkSession, base: str, now: Manifest) -> None:
    """Set each segment's bounds: how far its terms' weights have moved since it was written. One pass over the terms."""
    last = len(now.segments) - 1
    if last >= 0:
        now.segments[last].low = now.segments[last].high = 1.0
    if last <= 0:
        return
    upto = [F.sum(F.when(F.col("seg") <= k, F.col("df")).otherwise(0)).alias(f"df{k}") for k in range(last + 1)]
    counted = rows(spark, base, now, "terms").groupBy("term").agg(*upto)
    found = []
    for k, s in enumerate(now.segments[:last]):
        ratio = F.when(F.col(f"df{k}") > 0, idf(F.greatest(F.col(f"df{last}"), F.lit(0)), now.units) / idf(F.col(f"df{k}"), s.units))
        found += [F.min(ratio), F.max(ratio)]
    bounds = counted.agg(F.count("*"), *found).first()
    for k, s in enumerate(now.segments[:last]):
        s.low, s.high = (bounds[2 * k + 1] or 1.0) * (1 - SLACK), (bounds[2 * k + 2] or 1.0) * (1 + SLACK)


def packed(rows: DataFrame) -> DataFrameWriter:
    return rows.write.option("compression", "zstd")


def write_segment(spark: SparkSession, base: str, texts: DataFrame, units: DataFrame | None, gone: DataFrame | None, taken: DataFrame | None, before: int, after: Manifest) -> None:
    """Write a segment of texts (path, mark, content), that takes away `gone` (name, doc) with the units `taken`, and set what `after` counts; the
    texts' units are made here, if they aren't given. before: live units without this segment's."""
    name = f"segment-{uuid.uuid4().hex}"
    at = f"{base}/{name}"
    packed(texts.select("path", "mark", "content").repartitionByRange("path").sortWithinPartitions("path")).parquet(f"{at}/texts")
    (spark.range(0).selectExpr("cast(id AS string) AS name", "id AS doc") if gone is None else gone.select("name", "doc")).write.parquet(f"{at}/gone")
    made = vectors(load(spark, base, name, "texts"), after.limit) if units is None else units.repartitionByRange("path", "chunk_index").sortWithinPartitions("path", "chunk_index")
    packed(made.withColumn("doc", F.monotonically_increasing_id())).parquet(f"{at}/units")
    units = load(spark, base, name, "units")
    deltas = units.select(F.explode("terms").alias("term"), F.lit(1).alias("df"))
    if taken is not None:
        deltas = deltas.unionByName(taken.select(F.explode("terms").alias("term"), F.lit(-1).alias("df")))
    summed = deltas.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    summed.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
    own = units.count()
    after.units = before + own
    after.segments.append(Segment(name, after.units, own))
    norms_of_all(units, frequencies(spark, base, after), after.units).sortWithinPartitions("doc").write.parquet(f"{at}/norms")
    made = blocks(units, load(spark, base, name, "norms")).repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    entry = F.zip_with("places", "impacts", lambda k, x: F.struct((F.shiftleft("block", BLOCK_BITS) + k).alias("doc"), x.alias("impact")))
    packed(made.select("term", "block", F.array_max("impacts").alias("most"), entry.alias("entries"))).parquet(f"{at}/postings")


def commit(spark: SparkSession, base: str, now: Manifest) -> Manifest:
    """Make a manifest count, and remove what only manifests older than KEPT name."""
    moved(spark, base, now)
    now.version += 1
    now.paths = live(spark, base, now).select("path").distinct().count() if now.limit is not None else now.units
    folders.write_text(spark, f"{base}/manifests/{now.version}.json", json.dumps(now, default=lambda x: x.__dict__))
    kept = manifests(spark, base)[-KEPT:]
    named = {s["name"] for v in kept for s in json.loads(folders.read_text(spark, f"{base}/manifests/{v}.json"))["segments"]}
    for v in manifests(spark, base)[:-KEPT]:
        folders.remove(spark, f"{base}/manifests/{v}.json")
    for name in folders.names(spark, base):
        if name.startswith("segment-") and name not in named:
            folders.remove(spark, f"{base}/{name}")
    return now


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("path").cast("string").alias("path"), F.col("mark").cast("string").alias("mark"), "content")


def build(docs: DataFrame, base: str, limit: int | None = None) -> Manifest:
    """Write the index of documents (path, mark, content) to an empty folder: of whole documents, or of chunks of at most
    `limit` identifiers. A path is expected once."""
    now = Manifest(limit=limit)
    write_segment(docs.sparkSession, base, plain(docs), None, None, None, 0, now)
    return commit(docs.sparkSession, base, now)


def change(base: str, docs: DataFrame, removed: DataFrame | None = None, batch: int = -1) -> Manifest:
    """Put documents (path, mark, content) in, in place of those of the same paths, and take removed paths (path) out. What is
    written grows with these documents, not with the index. A batch number that the index has already changes nothing."""
    spark = docs.sparkSession
    before = latest(spark, base)
    if 0 <= batch <= before.batch:
        return before
    after = Manifest(before.version, before.limit, max(batch, before.batch), before.units, before.paths, list(before.segments))
    paths = plain(docs).select("path")
    if removed is not None:
        paths = paths.unionByName(removed.select(F.col("path").cast("string").alias("path")))
    taken = live(spark, base, before).join(paths, "path", "left_semi")
    write_segment(spark, base, plain(docs), None, taken, taken, before.units - taken.count(), after)
    return settle(spark, base, commit(spark, base, after))


def settle(spark: SparkSession, base: str, now: Manifest) -> Manifest:
    """Merge segments at the end, while the last is not much smaller than the one before, so that their number stays a logarithm."""
    sizes = [s.own for s in now.segments]
    first = len(sizes) - 1
    while first > 0 and sizes[first - 1] <= 2 * sum(sizes[first:]):
        first -= 1
    return now if first == len(sizes) - 1 else merge(spark, base, now, first)


def merge(spark: SparkSession, base: str, now: Manifest, first: int = 0) -> Manifest:
    """Write the segments from this one on as one, from their units."""
    old, part = [s.name for s in now.segments[first:]], Manifest(segments=now.segments[first:])
    units = live(spark, base, now).where(F.col("seg") >= first)
    texts = rows(spark, base, part, "texts").withColumn("seg", F.col("seg") + first).join(units.select("path", "seg").distinct(), ["path", "seg"], "left_semi")
    after = Manifest(now.version, now.limit, now.batch, now.units, now.paths, list(now.segments[:first]))
    earlier = rows(spark, base, part, "gone").where(~F.col("name").isin(old)).select("name", "doc")
    taken = named(rows(spark, base, after, "units"), after).join(earlier, ["name", "doc"], "left_semi") if first else None
    write_segment(spark, base, texts, units.drop("doc", "name", "seg"), earlier, taken, now.units - units.count(), after)
    return commit(spark, base, after)


@dataclass
class Question:
    """A question's terms: strongest first, with their weight, and the factor of a share in a score."""

    terms: list[str]
    factors: dict[str, float]


def question(spark: SparkSession, base: str, now: Manifest, terms: list[str]) -> Question:
    """Reads the document frequencies of these terms only."""
    counts = {t: terms.count(t) for t in dict.fromkeys(terms)}
    known = {r["term"]: r["df"] for r in frequencies_of(spark, base, now, list(counts)).collect()}  # as many as the question has
    idfs = {t: math.log((now.units + 1) / (max(known.get(t, 0), 0) + 1)) + 1 for t in counts}
    weights = {t: c / len(terms) * idfs[t] for t, c in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    order = sorted(counts, key=lambda t: -weights[t])
    return Question(order, {t: weights[t] * idfs[t] / norm for t in order if known.get(t, 0) > 0})


def frequencies_of(spark: SparkSession, base: str, now: Manifest, terms: list[str]) -> DataFrame:
    return rows(spark, base, now, "terms").where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df"))


def heads(spark: SparkSession, base: str, now: Manifest, q: Question) -> DataFrame:
    """seg, block, bound: what no unit of the block can exceed, without reading postings."""
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in q.factors.items() for x in pair]), F.col("term"))
    low = F.get(F.array(*[F.lit(s.low) for s in now.segments]), F.col("seg"))
    found = rows(spark, base, now, "postings").where(F.col("term").isin(list(q.factors)))
    return found.groupBy("seg", "block").agg((F.sum(factor * F.col("most")) / F.first(low) * (1 + SLACK)).alias("bound"))


def scored(spark: SparkSession, base: str, now: Manifest, q: Question, blocks: DataFrame) -> DataFrame:
    """seg, doc, plain (the score by the norms as written), least and most (the bounds of the score) of the live units in the blocks."""
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in q.factors.items() for x in pair]), F.col("term"))
    found = rows(spark, base, now, "postings").where(F.col("term").isin(list(q.factors)))
    some = blocks.limit(LISTED + 1).collect()
    if len(some) <= LISTED:  # the filter reaches the files' statistics
        found = found.where(F.col("block").isin(sorted({r["block"] for r in some})))
    found = found.join(blocks, ["seg", "block"], "left_semi")
    summed = found.select("seg", factor.alias("f"), F.explode("entries").alias("e")).groupBy("seg", F.col("e.doc").alias("doc")).agg(F.sum(F.col("f") * F.col("e.impact")).alias("plain"))
    bound = lambda side: F.get(F.array(*[F.lit(getattr(s, side)) for s in now.segments]), F.col("seg"))
    out = named(summed, now).join(rows(spark, base, now, "gone").select("name", "doc"), ["name", "doc"], "left_anti")
    return out.select("seg", "doc", "plain", (F.col("plain") / bound("high")).alias("least"), (F.col("plain") / bound("low")).alias("most"))


def within_reach(spark: SparkSession, base: str, now: Manifest, q: Question, top: int, digits: int) -> DataFrame:
    """The blocks that may hold one of the `top` answers: seg, block."""
    all_ = heads(spark, base, now, q)
    first = all_.orderBy(F.desc("bound"), "seg", "block").limit(max(FIRST, top >> BLOCK_BITS))
    return all_.where(F.col("bound") >= reached(scored(spark, base, now, q, first), top, digits)).select("seg", "block")


def reached(units: DataFrame, top: int, digits: int) -> float:
    """A score that `top` of these units reach, less what rounding may hide; 0 where there are fewer."""
    best = units.orderBy(F.desc("least")).limit(top).agg(F.count("*"), F.min("least")).first()
    return max(0.0, best[1] - 1.01 * 10.0**-digits) if best[0] == top else 0.0


def ask(spark: SparkSession, base: str, terms: list[str], top: int, digits: int = 6) -> DataFrame:
    """path, chunk_index, start_line, end_line, score of the `top` units nearest to the terms by cosine, best first; equal scores (rounded) by path
    and place. No text and no other term's postings are read. Empty where there is no index."""
    now, schema = latest(spark, base), "path string, chunk_index long, start_line long, end_line long, score double"
    q = question(spark, base, now, [t.lower() for t in terms]) if now and terms else None
    if q is None or not q.factors:
        return spark.createDataFrame([], schema)
    units = scored(spark, base, now, q, within_reach(spark, base, now, q, top, digits))
    best = units.where(F.col("most") >= reached(units, top, digits))
    found = best.join(rows(spark, base, now, "units"), ["seg", "doc"])
    if any((s.low, s.high) != (1.0, 1.0) for s in now.segments):  # exact norms of what is left
        need = found.select("seg", "doc", "terms", "counts", "total")
        some = rows(spark, base, now, "terms").join(need.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        exact = norms(need, some, now.units, "seg", "doc").withColumnRenamed("norm", "exact")
        found = found.join(exact, ["seg", "doc"]).join(rows(spark, base, now, "norms"), ["seg", "doc"]).withColumn("plain", F.col("plain") * F.col("norm") / F.col("exact"))
    answers = found.select("path", "chunk_index", "start_line", "end_line", F.round("plain", digits).alias("score")).where("score > 0")
    return answers.orderBy(F.desc("score"), "path", "chunk_index").limit(top)


def texts_of(spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
    """path, content of a few paths: the files that hold other paths are left out by their statistics."""
    now = latest(spark, base)
    current = live(spark, base, now).where(F.col("path").isin(paths)).select("path", "seg").distinct()
    return rows(spark, base, now, "texts").where(F.col("path").isin(paths)).join(current, ["path", "seg"]).select("path", "content")


def update(docs: DataFrame, base: str) -> Manifest:
    """Make the index that of just these documents (path, mark, content): those whose mark it has are left alone."""
    spark = docs.sparkSession
    marks = docs.select(F.col("path").cast("string").alias("path"), F.col("mark").cast("string").alias("mark"))
    known = known_marks(spark, base)
    fresh = incremental.changed_paths(known, marks)
    new = docs.withColumn("path", F.col("path").cast("string")).join(fresh, "path", "left_semi")
    return change(base, new, incremental.stale_paths(known, marks))


def known_marks(spark: SparkSession, base: str) -> DataFrame:
    """path, mark of the documents in the index (of those that have a chunk, in an index of chunks)."""
    return live(spark, base, latest(spark, base)).select("path", "mark").distinct()


def is_fresh(spark: SparkSession, base: str, current: DataFrame) -> bool:
    """Whether there is an index of just these documents (path, mark)."""
    marks = current.select(F.col("path").cast("string").alias("path"), F.col("mark").cast("string").alias("mark"))
    return latest(spark, base) is not None and incremental.is_fresh(known_marks(spark, base), marks)


def stats(spark: SparkSession, base: str) -> dict[str, int]:
    """Files, units and segments; zeros where there is no index."""
    now = latest(spark, base) or Manifest()
    return {"files": now.paths, "units": now.units, "segments": len(now.segments)}


def delete(spark: SparkSession, base: str) -> bool:
    """Remove an index; whether there was one."""
    return folders.remove(spark, base)

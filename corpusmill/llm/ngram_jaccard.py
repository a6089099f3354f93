"""N-gram Jaccard join: near duplicates by exact similarity of word shingles, with signature trees.

A text's set has its distinct shingles of five words (A-Z lower-cased, split at ASCII white space); a text with fewer
words has all of them as one shingle; one without words has none and is linked with nothing. Two texts link where
intersection / union >= 0.8. Candidates are found by 64-bit hashes of shingles, links are verified on the words.

1. One pass makes each text's set; texts of the same words are one class from here on, known by a digest of the words
   (`sid`), with its least doc_id (`rep`). So rows that repeat an id with different texts are in different classes. The
   pass also counts shingles in a sketch of fixed size.
2. Shingles are ordered, the rarest by their sketch cell first, then by hash. Similar sets share one of the first
   |set| - ceil(0.8 |set|) + 1 in any common order, so these are joined. A shingle in one class only joins nothing and is
   dropped; most are.
3. Of a shingle's classes of like sizes, one picked at random is the hub, and each class is compared with one hub. These
   are no more pairs than classes, and most of a group of near copies of any size becomes one component here.
4. What is left to compare is between components. A shingle whose classes are all in one component is done; of those
   with the same classes, one is kept. The others are blocks. In a block, a signature tree's dual traversal gives
   the pairs between components that the bounds leave. A large block is split in pieces of about PIECE classes, and
   each pair of pieces is a task's. In a first round, a task sends on FORESTS spanning forests of its pairs only, so n
   classes give less than n pairs each; what these join need not be compared any more. The last round takes all pairs that
   are left.
   Pairs of sets too large for a signature are held to the same bound on longer ones.
5. Pairs are verified on the texts' words, which are read again for the classes in them only.
6. Components over all links.

No link is lost at any step: the bounds are exact, and pairs that are not compared are in one component already.
Rows with a null doc_id have an n_shingles and a null component_id, and link nothing. Repeated rows come out as often.
An empty table gives no rows. Where two classes' digests begin with the same 64 bits (3 cases among 10**10 texts), those
are known by the other half.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WordHasher, Written, blocks, cut, light, raw, spans
from corpusmill.llm.components import components
from corpusmill.llm.signature_tree import WORDS, candidates, signature, tree

SHINGLE = 5
#: Similarity, as a fraction.
NUM, DEN = 4, 5
#: Cells of the shingle sketch (fixed size: a byte each is broadcast), and the parts in which it is summed.
SKETCH_BITS, PARTS = 22, 16
#: Spanning forests that a block sends on before all that is left.
FORESTS = 3
#: Classes of a block that a tree takes, and of the blocks a class is in, how many go with it.
PIECE, LISTED = 1024, 64
#: Bits of the filter that tells which documents are in pairs: fixed size, a part for each of PARTS tasks.
FILTER_BITS = 26
#: A column that one_of_each adds for itself.
MARK = "__text_mark"

SPACE = np.ones(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
HASHER = WordHasher(SPACE, 3)


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = raw(texts)
    for a, b in blocks(offsets):
        words, at = HASHER.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        all_ = spans(words, SHINGLE)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo >= SHINGLE:
                yield np.unique(all_[lo : hi - SHINGLE + 1])
            else:
                yield spans(words[lo:hi], hi - lo, salt=8) if hi > lo else np.zeros(0, np.uint64)


def plain_words(texts: pa.Array) -> Iterator[bytes]:
    """Each text's words, lower-cased, with one blank between."""
    for x in texts:
        yield b" ".join(x.as_buffer().to_pybytes().lower().split()) if x.is_valid else b""


def digest(words: bytes, other: frozenset[int] = frozenset()) -> tuple[int, int]:
    """128 bits of a text's words, as two signed 64-bit integers; the second one in place of the first if that is in `other`."""
    x = hashlib.blake2b(words, digest_size=16).digest()
    sid, check = int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)
    return (check if sid in other else sid), check


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def long_signature(hashes: np.ndarray) -> bytes | None:
    """A bitmap of at least four bits a shingle, for sets that have too many for the trees' signature; else null."""
    width = (4 * len(hashes) - 1).bit_length()
    if 1 << width <= 64 * WORDS:
        return None
    bits = np.zeros(1 << width, np.uint8)
    bits[(hashes >> np.uint64(64 - width)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def first_pass(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, mark (as given), n (size of its set), sid and check (digest), bits and long (signatures). And from
    each task rows with part and sketch: its counts of shingles by cell (up to 255), compressed."""
    schema = "doc_id long, mark long, n long, sid long, check long, bits binary, long binary, part int, sketch binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            rows = []
            for id_, mark, words, s in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), plain_words(batch["text"]), sets(batch["text"]), strict=True):
                np.add.at(counts, cell(s), 1)
                rows.append((id_, mark, len(s), *(digest(words) if len(s) else (None, None)), signature(s).tobytes(), long_signature(s), None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        small = np.minimum(counts, 255).astype(np.uint8).reshape(PARTS, -1)
        rows = [(None, None, None, None, None, None, None, k, zlib.compress(small[k].tobytes(), 1)) for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.mapInArrow(light(run), schema)


def frequencies(sketches: DataFrame) -> np.ndarray:
    """For each cell a class of its count: in steps of the counts' spread around the mean, far above it in octaves. Each part is
    summed as a stream by one task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["sketch"], strict=True):
                x = np.frombuffer(zlib.decompress(data.as_py()), np.uint8)
                totals[part] = totals.get(part, np.zeros(len(x), np.uint64)) + x
        for part, x in totals.items():
            mean = max(float(x.mean()), 0.5)
            z = (x - mean) / np.sqrt(mean)
            level = np.where(z < 10, 80 + 12 * z, 200 + 4 * np.log2(np.maximum(z, 10) / 10)).clip(0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "level"])

    out = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint8)
    for r in sketches.select("part", "sketch").repartition(PARTS, "part").mapInArrow(light(add), "part int, level binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["level"]), np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, level: np.ndarray, other: frozenset[int]) -> DataFrame:
    """(token, sid): the shingles of each set's prefix; of equal texts in a task, one speaks for all."""
    sent = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, sids, sizes = [], [], []
            for words, s in zip(plain_words(batch["text"]), sets(batch["text"]), strict=True):
                if len(s) and (sid := digest(words, other)[0]) not in seen:
                    seen.add(sid)
                    n = len(s) - -(-NUM * len(s) // DEN) + 1
                    tokens.append(s[np.lexsort((s, sent.value[cell(s)]))[:n]])
                    sids.append(sid)
                    sizes.append(n)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), sizes))], ["token", "sid"])

    return docs.mapInArrow(light(run), "token long, sid long")


def bits_of(short: bytes, long: bytes | None, width: int) -> np.ndarray:
    """A signature's bits, neighbours put together until there are `width`."""
    return np.unpackbits(np.frombuffer(long, np.uint8) if long else np.frombuffer(short, np.uint64).view(np.uint8)).reshape(width, -1).max(1)


def may_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes (sid) whose sizes and longest common signature leave them possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, *four in zip(*[batch[c].to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b", "long_a", "long_b")], strict=True):
                width = 8 * min(len(four[2] or four[0]), len(four[3] or four[1]))
                x, y = bits_of(four[0], four[2], width), bits_of(four[1], four[3], width)
                bound = int((x & y).sum(dtype=np.int64)) + min(n - int(x.sum(dtype=np.int64)), m - int(y.sum(dtype=np.int64)))
                ok.append((NUM + DEN) * bound >= NUM * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: classes.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"), F.col("long").alias(f"long_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)")
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b", "long_a", "long_b").mapInArrow(light(run), "a long, b long")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges (a, b) that make FORESTS spanning forests, each of the edges that join what those before them, in a
    random order, have not."""
    out = []
    for salt in range(FORESTS):
        root: dict[int, int] = {}
        for k in np.random.default_rng(salt).permutation(len(a)).tolist():
            x, y = int(a[k]), int(b[k])
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            while (up := root.setdefault(y, y)) != y:
                root[y] = y = root[up]
            if x != y:
                root[x] = y
                out.append(k)
    return np.unique(np.array(out, np.int64))


def block_pairs(rows: DataFrame, some: bool) -> DataFrame:
    """Candidate pairs (a, b) in blocks, each pair in the least block that both are in (in each, where the lists do not tell).
    With `some`, of each block (or pair of pieces) spanning forests between components instead of all.
    rows: block, left and right piece (equal: within one), mine (the row's piece), sid, n, bits, component, blocks (the
    class's least ones); sorted by block, left, right in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key: tuple, group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            group.sort(key=lambda r: (r[2], r[3]))  # alike sizes and signatures side by side

            def made(rows_: list[tuple]) -> tuple[list, np.ndarray]:
                bits = np.frombuffer(b"".join(r[3] for r in rows_), np.uint64).reshape(-1, WORDS)
                return tree(bits, np.array([r[2] for r in rows_], np.int64), np.array([r[4] for r in rows_], np.int64)), np.array([r[1] for r in rows_], np.int64)

            def least(rows_a: list[tuple], rows_b: list[tuple], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                in_a, in_b = {k: set(rows_a[k][5].tolist()) for k in set(a.tolist())}, {k: set(rows_b[k][5].tolist()) for k in set(b.tolist())}
                # The lists have the least blocks, so if they meet at all, their least is the least of all.
                first = [min(in_a[x] & in_b[y], default=key[0]) == key[0] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                return a[first], b[first]

            def fewer(rows_a: list[tuple], rows_b: list[tuple], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = forest(np.array([r[4] for r in rows_a])[a], np.array([r[4] for r in rows_b])[b]) if some else slice(None)
                return a[at], b[at]

            if key[1] == key[2]:
                x, ids = made(group)
                a, b = fewer(group, group, *least(group, group, *candidates(x, None, NUM, DEN)))
                return ids[a], ids[b]
            left, right = ([r for r in group if r[0] == k] for k in key[1:])
            if not left or not right:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            (x, ids_x), (y, ids_y) = made(left), made(right)
            a, b = fewer(left, right, *least(left, right, *candidates(x, y, NUM, DEN)))
            return ids_x[a], ids_y[b]

        now, group, out = None, [], []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64))], ["a", "b"])

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("block", "left", "right", "mine", "sid", "n", "bits", "component")]
            of, at = batch["blocks"].values.to_numpy(), batch["blocks"].offsets.to_numpy()
            cols.append([of[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
            for block, lo, hi, *rest in zip(*cols, strict=True):
                if (block, lo, hi) != now:
                    if len(group) > 1:
                        out.append(pairs(now, group))
                    now, group = (block, lo, hi), []
                group.append(tuple(rest))
            if out:
                yield flush()
        if len(group) > 1:
            out.append(pairs(now, group))
        if out:
            yield flush()

    return rows.mapInArrow(light(run), "a long, b long")


def member_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS that has the hash of each id. Each task makes a part of it, so nothing is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch["h"].to_numpy()
            for part in np.unique(h >> (FILTER_BITS - 4)).tolist():
                own = h[h >> (FILTER_BITS - 4) == part] & ((1 << FILTER_BITS - 4) - 1)
                parts.setdefault(part, np.zeros(1 << FILTER_BITS - 4, bool))[own] = True
        for part, x in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1)], pa.binary())], ["part", "x"])

    h = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    rows = ids.select(h.alias("h")).withColumn("part", F.shiftright("h", FILTER_BITS - 4)).repartition(PARTS, "part").select("h")
    out = np.zeros((PARTS, 1 << FILTER_BITS - 7), np.uint8)
    for r in rows.mapInArrow(light(run), "part long, x binary").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["x"])), np.uint8)
    return out.ravel()


def shingle_set(words: bytes) -> set[tuple[bytes, ...]]:
    """The shingles of a text's words, as words."""
    w = words.split()
    return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, other: frozenset[int]) -> DataFrame:
    """Those pairs (a, b) of classes (sid) whose shingles, word by word, are similar; cut."""
    pairs = cut(pairs)
    members = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    keep = docs.sparkSession.sparkContext.broadcast(member_filter(members.join(classes.select("sid", F.col("rep").alias("id")), "sid").select("id")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["h"].to_numpy()
            batch = batch.filter(pa.array((keep.value[h >> 3] >> (7 - (h & 7)).astype(np.uint8) & 1).astype(bool)))
            if batch.num_rows:
                words = list(plain_words(batch["text"]))
                yield pa.RecordBatch.from_arrays([pa.array([digest(w, other)[0] for w in words], pa.int64()), pa.array(words, pa.binary())], ["sid", "words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, set] = (b"", set())  # pairs of one hub follow each other
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = x.as_py(), y.as_py()
                if y != last[0]:
                    last = (y, shingle_set(y))
                x, y = shingle_set(x), last[1]
                common = len(x & y)
                ok.append(common > 0 and DEN * common >= NUM * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    rows = docs.where("doc_id is not null").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))
    made = rows.select("text", "h").mapInArrow(light(make), "sid long, words binary").dropDuplicates(["sid"])
    side = lambda x, name: made.select(F.col("sid").alias(x), F.col("words").alias(name))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(light(compare), "a long, b long"))


def open_entries(held: DataFrame, found: DataFrame) -> DataFrame:
    """(token, sid, n, component) of the shingles whose classes are in several components; cut. found: (node, component)."""
    known = held.join(found, held["sid"] == found["node"], "left").select("token", "sid", "n", F.coalesce("component", "sid").alias("component"))
    some = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    return cut(known.join(some, "token"))


def hub_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): each class in entries (token, sid, n), where it can, with a hub. Of the classes of a shingle that are of like
    sizes, that with the least hash is their hub; a class is held against the one with which it has most shingles. Hubs'
    hashes are less, so no chain of pairs comes back."""
    entries = entries.withColumn("bucket", F.floor(F.log("n") / math.log(DEN / NUM)).cast("int"))
    hubs = entries.groupBy("token", "bucket").agg(F.min(F.struct(F.xxhash64("sid").alias("rank"), F.col("sid").alias("b"))).alias("hub"))
    met = entries.join(hubs, ["token", "bucket"]).where("sid != hub.b")
    met = met.groupBy(F.col("sid").alias("a"), F.col("hub.b").alias("b")).agg(F.count("*").alias("common"))
    return met.groupBy("a").agg(F.max(F.struct("common", "b")).alias("hub")).select("a", F.col("hub.b").alias("b"))


def followed(links: DataFrame, steps: int = 3) -> DataFrame:
    """(node, component) from links (a, b) of which each a has one, without cycles: the b that 2**steps links lead to, or where
    they end before. Equal components are connected, though connected nodes may still have several."""
    out = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(steps):
        on = out.select(F.col("node").alias("component"), F.col("component").alias("next"))
        out = cut(out.join(on, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
    return out


def block_members(known: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows that block_pairs takes. Blocks are shingles with several components; of those with the same classes, one."""
    mixed = known.groupBy("token").agg(F.count("*").alias("size"), F.sum(F.xxhash64("sid") % (1 << 40)).alias("s1"), F.bit_xor(F.xxhash64("sid", "component")).alias("s2"))
    mixed = mixed.groupBy("size", "s1", "s2").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"))
    members = cut(known.drop("n").join(mixed, "token"))
    lists = members.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list("token")), 1, LISTED).alias("blocks"))
    members = members.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("pieces").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    members = members.select("token", "sid", "component", "mine", other).select(F.col("token").alias("block"), F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), "mine", "sid", "component")
    return members.join(lists, "sid").join(classes.select("sid", "n", "bits"), "sid").repartition("block", "left", "right").sortWithinPartitions("block", "left", "right")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n, sid, rep (least doc_id with the same words), head (rep and sid of the component's first class) of each
    row of doc_id, text, mark. Rows without a set or an id have no rep and no head."""
    base = cut(first_pass(docs))
    rows = base.where("part is null").drop("part", "sketch")
    told = rows.where("sid is not null").groupBy("sid").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).where("c0 != c1")
    other = frozenset(r["sid"] for r in told.select("sid").collect())  # n * n / 2**65 among n classes
    if other:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(list(other)), F.col("check")).otherwise(F.col("sid")))
    classes = cut(rows.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("long").alias("long")))
    written = Written(prefixes(docs, frequencies(base.where("part is not null")), other))
    shared = written.df.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("token")
    # A class is in a shingle once for each task that has met it, so it is made to count once.
    held = cut(written.df.join(shared, "token").join(classes.select("sid", "n"), "sid").select("token", "sid", "n").distinct())
    written.drop()
    links = verified(docs, may_link(hub_pairs(held), classes), classes, other)
    found = followed(links)
    for some in (True, False):
        known = open_entries(held, found)
        pairs = cut(may_link(block_pairs(block_members(known, classes), some).distinct(), classes))
        if pairs.isEmpty() and not some:
            break
        links = cut(links.unionByName(verified(docs, pairs, classes, other)))
        found = components(links)
    ids = classes.select("sid", "rep")
    ids = ids.join(found, ids["sid"] == found["node"], "left").select("sid", "rep", F.coalesce("component", "sid").alias("component"))
    heads = ids.groupBy("component").agg(F.min(F.struct("rep", "sid")).alias("head"))
    ids = ids.join(heads, "component").select("sid", "rep", "head")
    return rows.where("doc_id is not null and sid is not null").join(ids, "sid", "left").select("doc_id", "mark", "n", "sid", "rep", "head").unionByName(rows.where("doc_id is null or sid is null").select("doc_id", "mark", "n", "sid"), True)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and mark (a hash of the text) of each row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, rep (least doc_id with the same words) and component_id (least doc_id reachable) of each row."""
    return grouped(marked(docs)).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("head.rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the least id, and of rows that repeat it, one (of the least
    set digest and text hash). Texts without words are linked with nothing, so only rows with equal id and text are one. Rows
    with a null id all stay."""
    rows = grouped(marked(docs)).where("doc_id is not null")
    first = rows.where("doc_id = head.rep and sid = head.sid").groupBy("sid", "doc_id").agg(F.min("mark").alias("mark"))
    keep = cut(first.select("doc_id", "mark").unionByName(rows.where("sid is null").select("doc_id", "mark").distinct()))
    kept = docs.where("doc_id is not null").withColumn(MARK, F.xxhash64(F.col("text").cast("string")))
    keep = keep.withColumnRenamed("mark", MARK)
    kept = kept.join(keep, ["doc_id", MARK], "left_semi").dropDuplicates(["doc_id", MARK]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))

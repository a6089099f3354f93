"""Collections of files: token budgets, chunks of files, priorities, and the formats they are written in and read from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import approximate_tokens, base_name, byte_size, lines
from corpusmill.operators.sequences import spread

#: Rows of a group up to which one task goes through it.
LARGE = 1_000_000

# Names that make a file important in a bundle, readmes, and configuration files.
IMPORTANT_STEMS = ["main", "app", "index", "settings", "config", "server", "cli", "__init__"]
README_NAMES = ["readme.md", "readme", "readme.rst", "readme.txt"]
CONFIG_NAMES = ["pyproject.toml", "package.json", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "pubspec.yaml", "tsconfig.json", "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".env.example"]
# Imports in Python and in JavaScript.
IMPORTS = r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))|^\s*(?:import|require)\s*\(?['\"]([./\w-]+)['\"]"


def with_sizes(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """Adds size, tokens and status (ok, too_large)."""
    size = byte_size(F.col("content"))
    status = F.lit("ok") if max_size is None else F.when(size > max_size, "too_large").otherwise("ok")
    return files.withColumns({"size": size, "tokens": approximate_tokens(F.col("content")), "status": status})


def _fold(sized: DataFrame, group: str, order: str, limit: int, budget: bool) -> DataFrame:
    """A sequential pass over each group in order; the groups' rows come sorted through a task as a stream. Only group, order and
    tokens move. Groups of more than LARGE rows are spread over many tasks instead (see sequences)."""
    all_ = sized.select(F.col(group).cast("string").alias("g"), F.col(order).alias("o"), "tokens")
    large = [r["g"] for r in all_.groupBy("g").count().where(F.col("count") > LARGE).collect()]  # at most a LARGE-th of the rows
    is_large = F.coalesce(F.col("g").isin([g for g in large if g is not None]), F.lit(None in large))
    kind = "taken boolean" if budget else "chunk long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, number = object(), 0, 0
        for batch in batches:
            out = []
            for g, n in zip(batch["g"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                if g != now:
                    now, total, number = g, 0, 0
                if budget:
                    fits = total + n <= limit
                    total += n if fits else 0
                    out.append(fits)
                else:
                    if total and total + n > limit:
                        number, total = number + 1, 0
                    total += n
                    out.append(number)
            yield pa.RecordBatch.from_arrays([batch["g"], batch["o"], batch["tokens"], pa.array(out, pa.bool_() if budget else pa.int64())], ["g", "o", "tokens", kind.split()[0]])

    rows = (all_.where(~is_large) if large else all_).repartition("g").sortWithinPartitions("g", "o")
    kinds = dict(sized.dtypes)
    out = rows.mapInArrow(run, f"g string, o {kinds[order]}, tokens long, {kind}")
    if large:
        out = out.unionByName(spread(all_.where(is_large), limit, budget))
    return out.withColumnsRenamed({"g": group, "o": order})


def within_budget(sized: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    """Which files a token budget takes, in order: one that does not fit is left out, and later ones may still fit."""
    return _fold(sized, group, order, budget, True)


def chunked(sized: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Files in chunks of at most `limit` tokens, in order; files are not split, and a larger one is a chunk by itself."""
    return _fold(sized, group, order, limit, False)


def import_counts(files: DataFrame) -> DataFrame:
    """How often files' last import parts name a file's stem: stem, inbound."""
    names = F.concat(*[F.regexp_extract_all("content", F.lit(IMPORTS), F.lit(k)) for k in (1, 2, 3)])
    leaves = files.select(F.explode(F.filter(names, lambda x: x != "")).alias("target")).select(F.substring_index(F.substring_index("target", ".", -1), "/", -1).alias("stem"))
    stems = files.select(F.regexp_replace(base_name(F.col("path")), r"(?<=.)\.[^.]*$", "").alias("stem")).distinct()
    return leaves.join(stems, "stem", "left_semi").groupBy("stem").agg(F.count("*").alias("inbound"))


def priority(path: Column, inbound: Column, include_tests: bool = False) -> Column:
    """A file's rank in a bundle."""
    name, low = F.lower(base_name(path)), F.lower(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    tests = F.lit(0) if include_tests else F.when(F.contains(low, F.lit("test")) | F.contains(low, F.lit("spec")), -1000).otherwise(0)
    score = F.when(stem.isin(IMPORTANT_STEMS), 50).otherwise(0) + F.when(name.isin(README_NAMES), 100).otherwise(0) + F.when(name.isin(CONFIG_NAMES), 80).otherwise(0)
    return (score + tests + F.coalesce(inbound, F.lit(0)) * 5).cast("long")


def bundled(files: DataFrame, group: str, order: str, budget: int, include_tests: bool = False) -> DataFrame:
    """group, path, priority, tokens, taken: which of the files (group, path, content, and the order they were met in) a bundle takes within its
    budget, the most important first, equal ones in order. Tests are no candidates unless wanted. What is not taken is to be named
    as left out."""
    stem = F.regexp_replace(base_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    sized = files.select(group, "path", F.col(order).alias("met"), approximate_tokens(F.coalesce("content", F.lit(""))).alias("tokens"), stem.alias("stem"))
    ranked = sized.join(import_counts(files), "stem", "left").withColumn("priority", priority(F.col("path"), F.col("inbound"), include_tests)).where("priority > -1000")
    placed = ranked.select(group, "tokens", F.struct((-F.col("priority")).alias("rank"), "met", "path").alias("place"))
    return within_budget(placed, group, "place", budget).select(group, "place.path", (-F.col("place.rank")).alias("priority"), "tokens", "taken")


def markdown(collected: list[dict], project: str, title: str | None = None, truncated: bool = False, binary: list[str] = (), too_large: list[str] = ()) -> str:
    """A collection as Markdown; collected: rows of path, language, content, tokens, size, in order (driver side: a
    collection is one document for a reader)."""
    out = [f"# {title or f'{project} — collected source'}", "", f"- Files: {len(collected)}", f"- Total tokens (approx.): {sum(r['tokens'] for r in collected)}", f"- Total size: {sum(r['size'] for r in collected)} bytes"]
    out += ["- **Truncated:** token budget exceeded, some files omitted"] * truncated + [""]
    for r in collected:
        out += [f"## `{r['path']}`", "", f"```{'' if r['language'] == 'other' else r['language']}", r["content"].rstrip("\n"), "```", ""]
    for name, paths in (("binary", binary), ("too large", too_large)):
        if paths:
            out += [f"## Skipped ({name})", *(f"- {p}" for p in paths), ""]
    return "\n".join(out)


def plain(collected: list[dict]) -> str:
    """A collection as text."""
    return "\n".join(x for r in collected for x in (f"----- {r['path']} -----", r["content"]))


def manifest(files: DataFrame) -> DataFrame:
    """A collection as JSON lines, one object a file, for any size: path, json."""
    body = F.to_json(F.struct(F.col("path").cast("string").alias("path"), "language", "tokens", "size", "content"))
    return files.select("path", body.alias("json"))


def from_manifest(rows: DataFrame) -> DataFrame:
    """The files in JSON lines."""
    return rows.select(F.from_json("json", "path string, language string, tokens long, size long, content string").alias("f")).select("f.*")


def from_markdown(documents: DataFrame) -> DataFrame:
    """The files in Markdown collections (name, text): name, path, language, content. A file's block goes from its first
    fence to the last bare one before the next file's heading, so fences inside survive; other sections have no files.
    A document's lines stay in its row."""
    all_ = F.transform(lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    heads = F.filter(all_, lambda r: r["x"].rlike(r"^## `.+`$"))
    ends = F.concat(F.transform(F.filter(all_, lambda r: r["x"].rlike(r"^## (?:`.+`|Skipped \(.+\))$")), lambda r: r["i"]), F.array(F.size(all_)))
    rows = documents.select("name", all_.alias("all"), ends.alias("ends"), F.explode(heads).alias("h"))
    end = F.array_min(F.filter("ends", lambda e: e > F.col("h.i")))
    body = F.filter("all", lambda r: (r["i"] > F.col("h.i")) & (r["i"] < F.col("end")))
    rows = rows.withColumn("end", end).withColumn("body", body)
    first = F.array_min(F.transform(F.filter("body", lambda r: r["x"].startswith("```")), lambda r: r["i"]))
    rows = rows.withColumn("first", first)
    last = F.array_max(F.transform(F.filter("body", lambda r: (r["x"] == "```") & (r["i"] > F.col("first"))), lambda r: r["i"]))
    inside = F.filter("body", lambda r: (r["i"] > F.col("first")) & (r["i"] < F.col("last")))
    opening = F.element_at(F.filter("body", lambda r: r["i"] == F.col("first")), 1)["x"]
    rows = rows.withColumn("last", last).where("first is not null and last is not null")
    return rows.select("name", F.regexp_extract("h.x", "^## `(.+)`$", 1).alias("path"), F.regexp_extract(opening, "(?s)^```(.*)", 1).alias("language"), F.array_join(F.transform(inside, lambda r: r["x"]), "\n").alias("content"))


#: How a collection's form is told by its name, else by its first characters.
FORMS = {"md": "markdown", "markdown": "markdown", "json": "json", "txt": "text"}


def form(name: Column, text: Column) -> Column:
    """markdown, json or text."""
    known = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    guess = F.when(F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith("{"), "json").when(text.rlike("(?m)^## `"), "markdown").otherwise("text")
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))), guess)


def from_text(documents: DataFrame) -> DataFrame:
    """The files in plain collections (name, text): name, path, content. A file begins at a line `----- path -----` and goes on to
    the next; what comes before the first is no file's. A document's lines stay in its row."""
    all_ = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    heads = F.filter("all", lambda r: r["x"].rlike("^----- .+ -----$"))
    rows = documents.select("name", all_.alias("all")).withColumn("at", F.transform(heads, lambda r: r["i"])).select("name", "all", "at", F.posexplode("at").alias("k", "i"))
    end = F.coalesce(F.get("at", F.col("k") + 1), F.size("all"))
    body = F.transform(F.slice("all", F.col("i") + 2, end - F.col("i") - 1), lambda r: r["x"])
    return rows.select("name", F.regexp_extract(F.get("all", "i")["x"], "^----- (.+) -----$", 1).alias("path"), F.array_join(body, "\n").alias("content"))


def document(files: DataFrame, budget: int) -> DataFrame:
    """One JSON document of the files (path, language, tokens, size, content) that a collection has kept, by path. A document is one value,
    so the files' bytes are held to `budget`: beyond it this raises, and manifest() writes a line a file instead."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    if total > budget:
        raise ValueError(f"{total} bytes are too many for one document; write a manifest")
    file = F.struct(F.col("path").cast("string").alias("path"), "language", "tokens", "size", "content")
    all_ = files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.array_sort(F.collect_list(file)).alias("files"))
    return all_.select(F.to_json(F.struct("file_count", "total_tokens", "files")).alias("json"))


def from_document(documents: DataFrame) -> DataFrame:
    """The files in JSON documents (name, text): name, path, language, content."""
    parsed = F.from_json("text", "files array<struct<path string, language string, content string>>")
    return documents.select("name", F.explode(parsed["files"]).alias("f")).select("name", "f.*")


def to_write(files: DataFrame, existing: DataFrame) -> DataFrame:
    """What expanding files (path, content) over existing ones (path, content) does: path, action: new, same, conflict, or
    refused (a path that leaves the folder). Nothing is written before conflicts are known."""
    unsafe = F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "[/\\\\]"), "..")
    old = existing.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("old"))
    rows = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("new"), unsafe.alias("unsafe")).join(old, "path", "left")
    return rows.select("path", F.when(F.col("unsafe"), "refused").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("new"), "same").otherwise("conflict").alias("action"))

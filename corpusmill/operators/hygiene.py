"""Checks of a repository, clean-up candidates, trees, tasks and payloads. `files`: path, size, language, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import base_name, lines

# Names that the checks look for.
READMES = ["readme.md", "readme", "readme.rst", "readme.txt"]
LICENCES = ["license", "license.md", "license.txt", "copying"]
TEST_FOLDERS = ["tests", "test", "__tests__", "spec"]
LARGE_BINARY = 5 * 1024 * 1024
CLEAN_FOLDERS = ["__pycache__", "node_modules", "build", "dist", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "htmlcov", ".eggs", ".next", ".nuxt", ".turbo", "target"]
CLEAN_SUFFIXES = [".pyc", ".pyo"]
NOT_SOURCE = ["other", "markdown", "text", "json", "yaml", "toml", "ini", "xml", "csv", "lock"]


def checks(files: DataFrame, gitignore: str | None, ignored: list[str]) -> DataFrame:
    """check, severity, message, path. files: path, size, is_binary, hash, kind (file, broken_link, empty_dir)."""
    name, low = F.lower(base_name(F.col("path"))), F.lower("path")
    top = ~F.contains("path", F.lit("/"))
    is_test = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(x) for x in TEST_FOLDERS])) | name.startswith("test_") | name.endswith("_test.py") | F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec."))
    plain = files.where("kind = 'file'")
    facts = plain.agg(F.count_if(top & name.isin(READMES)).alias("readme"), F.count_if(top & name.isin(LICENCES)).alias("licence"), F.count_if(is_test).alias("tests"))
    found = lambda n, severity, message, path=None: F.struct(F.lit(n).alias("check"), F.lit(severity).alias("severity"), message.alias("message"), (F.lit(None).cast("string") if path is None else path).alias("path"))
    missing = facts.select(F.explode(F.filter(F.array(
        F.when(F.col("readme") == 0, found("missing_readme", "warning", F.lit("The top folder has no readme."))),
        F.when(F.col("licence") == 0, found("missing_license", "info", F.lit("The top folder has no licence."))),
        F.when(F.col("tests") == 0, found("missing_tests", "warning", F.lit("Nothing here looks like a test."))),
    ), lambda x: x.isNotNull())).alias("i")).select("i.*")
    large = plain.where(F.col("is_binary") & (F.col("size") > LARGE_BINARY)).select(found("large_binary", "warning", F.concat(F.lit("A large binary: "), F.col("path")), F.col("path")).alias("i")).select("i.*")
    links = files.where("kind = 'broken_link'").select(found("broken_symlink", "error", F.concat(F.lit("A link to nothing: "), F.col("path")), F.col("path")).alias("i")).select("i.*")
    empty = files.where("kind = 'empty_dir'").select(found("empty_directory", "info", F.concat(F.lit("Nothing in "), F.col("path")), F.col("path")).alias("i")).select("i.*")
    copies = plain.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")
    copied = copies.select(found("duplicate_files", "info", F.concat(F.col("n").cast("string"), F.lit(" identical files, first "), F.col("path")), F.col("path")).alias("i")).select("i.*")
    out = missing.unionByName(large).unionByName(links).unionByName(empty).unionByName(copied)
    absent = [x for x in ignored if gitignore is not None and x not in gitignore]
    if gitignore is None or absent:
        text = "There are no ignore patterns." if gitignore is None else f"Not among the ignore patterns: {', '.join(absent)}"
        row = files.sparkSession.range(1).select(found("gitignore", "warning", F.lit(text)).alias("i")).select("i.*")
        out = out.unionByName(row)
    return out


def clean_target(path: Column) -> Column:
    """The shallowest folder on a path that may be cleaned, else the file if it may; null if neither."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hits = F.filter(F.transform(folders, lambda x, i: F.when(x.isin(CLEAN_FOLDERS), i + 1)), lambda i: i.isNotNull())
    folder = F.array_join(F.slice(parts, F.lit(1), F.array_min(hits)), "/")
    junk = F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(CLEAN_SUFFIXES)
    return F.when(F.size(hits) > 0, folder).when(junk, path)


def clean_candidates(files: DataFrame, older_than: Column | None = None) -> DataFrame:
    """target, files, size, mtime (latest) of what may be cleaned; with older_than, only what was last changed before."""
    rows = files.withColumn("target", clean_target(F.col("path"))).where("target is not null")
    out = rows.groupBy("target").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.max("mtime").alias("mtime"))
    return out if older_than is None else out.where(F.col("mtime") < older_than)


def clean_total(candidates: DataFrame) -> DataFrame:
    """targets, files, size of all that may be cleaned; one row."""
    return candidates.agg(F.count("*").alias("targets"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def tree(files: DataFrame, depth: int | None = None, source_only: bool = False) -> DataFrame:
    """Adjacency rows: path, parent, depth, is_dir, name of all files and of the folders above them."""
    if source_only:
        files = files.where(~F.col("language").isin(NOT_SOURCE))
    parts = F.split("path", "/")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), k - 1), "/").alias("parent"), k.alias("depth"), (k < F.size(parts)).alias("is_dir"), F.element_at(parts, k).alias("name")))
    out = files.select(F.explode(nodes).alias("n")).select("n.*").distinct()
    return out if depth is None else out.where(F.col("depth") <= depth)


def tasks(files: DataFrame) -> DataFrame:
    """name, source, command of targets in Makefiles, scripts in package.json, recipes in justfiles."""
    make = files.where(base_name(F.col("path")).isin("Makefile", "makefile")).select("path", F.explode(lines(F.col("content"))).alias("x")).where(~F.col("x").rlike("^[\t#]"))
    make = make.select(F.regexp_extract("x", r"^([a-zA-Z0-9][a-zA-Z0-9_.\-]*)\s*:(?!=)", 1).alias("name")).where("name != ''").distinct().select("name", F.lit("make").alias("source"), F.concat(F.lit("make "), F.col("name")).alias("command"))
    npm = files.where(base_name(F.col("path")) == "package.json").select(F.explode(F.map_keys(F.from_json("content", "scripts map<string,string>")["scripts"])).alias("name")).select("name", F.lit("npm").alias("source"), F.concat(F.lit("npm run "), F.col("name")).alias("command"))
    just = files.where(base_name(F.col("path")).isin("justfile", "Justfile")).select(F.explode(lines(F.col("content"))).alias("x")).where(~F.col("x").rlike("^[ \t#@]"))
    just = just.select(F.regexp_extract("x", r"^([a-zA-Z0-9_\-]+)(?:\s+[^:]*)?:(?!=)", 1).alias("name")).where("name != ''").select("name", F.lit("just").alias("source"), F.concat(F.lit("just "), F.col("name")).alias("command"))
    return make.unionByName(npm).unionByName(just)


def payload(kind: str, event: Column, message: Column, fields: Column | None = None, extra: dict[str, str] | None = None) -> Column:
    """The JSON body that a webhook of a kind takes, with named fields (a map of strings; null counts as none). extra: a Jira
    target's project_key and issue_type."""
    none = F.create_map().cast("map<string,string>")
    named = none if fields is None else F.coalesce(fields, none)
    pairs = F.map_entries(named)
    some = F.size(pairs) > 0
    if kind == "slack":
        lines = F.array_join(F.transform(pairs, lambda x: F.concat(F.lit("\n- *"), x["key"], F.lit("*: "), F.coalesce(x["value"], F.lit("")))), "")
        return F.to_json(F.struct(F.concat(F.lit("*"), event, F.lit("*\n"), message, lines).alias("text")))
    if kind == "teams":
        facts = F.transform(pairs, lambda x: F.struct(x["key"].alias("name"), F.coalesce(x["value"], F.lit("")).alias("value")))
        sections = F.when(some, F.array(F.struct(facts.alias("facts")))).otherwise(F.array().cast("array<struct<facts:array<struct<name:string,value:string>>>>"))
        return F.to_json(F.struct(F.lit("MessageCard").alias("@type"), F.lit("http://schema.org/extensions").alias("@context"), event.alias("summary"), event.alias("title"), message.alias("text"), sections.alias("sections")))
    if kind == "jira":
        given = [(name, key, extra[x]) for name, key, x in (("project", "key", "project_key"), ("issuetype", "name", "issue_type")) if x in (extra or {})]
        labels = F.when(some, F.transform(pairs, lambda x: F.concat_ws(":", x["key"], x["value"])))  # null is left out
        about = [F.substring(F.concat(F.lit("["), event, F.lit("] "), message), 1, 255).alias("summary"), message.alias("description")]
        return F.to_json(F.struct(F.struct(*about, *[F.struct(F.lit(v).alias(key)).alias(name) for name, key, v in given], labels.alias("labels")).alias("fields")))
    return F.to_json(F.struct(event.alias("event"), message.alias("message"), named.alias("fields")))

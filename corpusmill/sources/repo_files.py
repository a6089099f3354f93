"""A data source for the files of a repository: spark.read.format("repo_files").load(root).

Spark's own file sources leave out names that begin with a dot or an underscore. This one lists them, prunes ignored
folders, and keeps the order of a walk (`walk_ord` rises along it): a folder's files by name, then its folders, the last name first.
Options: `ignored` and `excludes` (separated by ;), `gitignore` (true), `languages` (separated by ;), `content` (true), `sniff` (true:
is_binary is told from a file's first 8 KiB; else it is null, unless the content is read).

The driver lists the uppermost folders, until there are TASKS subtrees; tasks walk these, and files of one folder that the driver has
listed are dealt out PER_TASK at a time. With the option `pushdown` (which scan() sets where spark.sql.python.filterPushdown.enabled is
true; Spark refuses it elsewhere), conditions on path, language, size and kind are applied before a file is opened, and those on the
path's beginning before a folder is listed. The folder must be one that all machines see.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from corpusmill.functions.text import LANGUAGE_ALIASES, LANGUAGES
from corpusmill.sources.ignore import IgnoreRules

PER_TASK, TASKS = 256, 64
#: Bytes that tell a binary file.
HEAD = 8192
SCHEMA = "walk_ord long, path string, size long, mtime double, language string, kind string, is_binary boolean, content binary"
PRINTABLE = bytes([*range(32, 127), *b"\n\r\t\b\f"])


def language(path: str) -> str:
    """Language by name."""
    name = path.rsplit("/", 1)[-1]
    return "docker" if name.lower() == "dockerfile" else LANGUAGES.get(Path(name).suffix.lower().lstrip("."), "other")


def binary(head: bytes) -> bool:
    """As text.looks_binary."""
    return bool(head) and (b"\0" in head or len(head.translate(None, PRINTABLE)) / len(head) > 0.30)


def listed(root: str, folder: str, rules: IgnoreRules) -> tuple[list[tuple[str, str]], list[str]]:
    """(path, kind) of a folder's files and links, and its folders, in walk order; an empty folder is one entry."""
    try:
        names = sorted(os.listdir(os.path.join(root, folder)))
    except OSError:
        return [], []
    if not names and folder:
        return [(folder, "empty_dir")], []
    files, inner = [], []
    for name in names:
        path = f"{folder}/{name}" if folder else name
        full = os.path.join(root, path)
        is_dir = os.path.isdir(full)
        if not rules.ignores(path, is_dir):
            (inner if is_dir else files).append(path if is_dir else (path, "file" if os.path.exists(full) else "broken_link"))
    return files, inner[::-1]


def walk(root: str, rules: IgnoreRules, folder: str = "", wanted: Callable[[str], bool] = lambda _: True) -> Iterator[tuple[str, str]]:
    """(path, kind) of what is not ignored: file, broken_link or empty_dir; folders that aren't wanted are not listed."""
    stack = [folder]
    while stack:
        files, inner = listed(root, stack.pop(), rules)
        yield from files
        stack += [x for x in reversed(inner) if wanted(x)]


class RepoFiles(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown", "false") == "true" else RepoFilesReader)(self.options)


class Part(InputPartition):
    """Listed files, or a subtree to walk; `number` is its place in the walk."""

    def __init__(self, number: int, rows: list[tuple[str, str]], folder: str | None = None):
        self.number, self.rows, self.folder = number, rows, folder


class RepoFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        split = lambda key: [x for x in options.get(key, "").split(";") if x]
        ignore = Path(self.root, ".gitignore")
        text = ignore.read_text(errors="ignore") if options.get("gitignore", "true") == "true" and ignore.is_file() else ""
        self.rules = IgnoreRules(folders=split("ignored"), gitignore=text, excludes=split("excludes"))
        self.languages = {LANGUAGE_ALIASES.get(x.strip().lower(), x.strip().lower()) for x in split("languages")}
        self.content, self.sniff = options.get("content", "true") == "true", options.get("sniff", "true") == "true"
        self.filters: list[Filter] = []

    def takes(self, column: str, value: object) -> bool:
        """Whether a value of a column passes the conditions on it."""
        tests = {EqualTo: lambda f: value == f.value, In: lambda f: value in f.value, StringStartsWith: lambda f: value.startswith(f.value), LessThan: lambda f: value < f.value, LessThanOrEqual: lambda f: value <= f.value, GreaterThan: lambda f: value > f.value, GreaterThanOrEqual: lambda f: value >= f.value, IsNotNull: lambda f: value is not None}
        return all(tests[type(f)](f) for f in self.filters if f.attribute == (column,))

    def reaches(self, folder: str) -> bool:
        """Whether a folder may hold a path that passes."""
        inside = folder + "/"
        on_path = [f for f in self.filters if f.attribute == ("path",) and not isinstance(f, IsNotNull)]
        may = lambda f, x: x == folder or x.startswith(inside) or (isinstance(f, StringStartsWith) and inside.startswith(x))
        return all(any(may(f, x) for x in (f.value if isinstance(f, In) else [f.value])) for f in on_path)

    def partitions(self) -> list[Part]:
        # In walk order: a list of files, or a folder that is not listed yet. The uppermost are listed first.
        places: list[list[tuple[str, str]] | str] = [""]
        while (at := next((k for k in sorted((k for k, x in enumerate(places) if isinstance(x, str)), key=lambda k: places[k].count("/"))), None)) is not None and sum(isinstance(x, str) for x in places) < TASKS:
            files, inner = listed(self.root, places[at], self.rules)
            places[at : at + 1] = [files, *[x for x in inner if self.reaches(x)]]
        parts: list[Part] = []
        for x in places:
            if isinstance(x, str):
                parts.append(Part(len(parts), [], x))
                continue
            for k in range(0, len(x), PER_TASK):
                if parts and parts[-1].folder is None and len(parts[-1].rows) + len(x[k : k + PER_TASK]) <= PER_TASK:
                    parts[-1].rows += x[k : k + PER_TASK]
                else:
                    parts.append(Part(len(parts), x[k : k + PER_TASK]))
        return parts or [Part(0, [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        found = partition.rows if partition.folder is None else walk(self.root, self.rules, partition.folder, self.reaches)
        rows: list[tuple] = []
        held = 0
        for k, (path, kind) in enumerate(found):
            name = language(path)
            if (self.languages and name not in self.languages) or not (self.takes("path", path) and self.takes("language", name) and self.takes("kind", kind)):
                continue
            full = os.path.join(self.root, path)
            try:
                stat = os.stat(full) if kind == "file" else None
                size = stat.st_size if stat else 0
                if not self.takes("size", size):
                    continue
                data = Path(full).read_bytes() if stat and self.content else None
                head = data[:HEAD] if data is not None else first_bytes(full) if stat and self.sniff else None
            except OSError:
                continue
            rows.append(((partition.number << 40) + k, path, size, stat.st_mtime if stat else 0.0, name, kind, None if head is None else binary(head), data))
            held += len(data or b"") + 200
            if held > 32 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        yield batch_of(rows)


class PushingReader(RepoFilesReader):
    """With conditions that Spark pushes down."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        """Keeps those on path, language, kind and size, and gives back the others."""
        known = {"path": (EqualTo, In, StringStartsWith), "language": (EqualTo, In), "kind": (EqualTo, In), "size": (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column in known and isinstance(f, (*known[column], IsNotNull)):
                self.filters.append(f)
            else:
                yield f


def first_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read(HEAD)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def scan(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The files of a folder, with pushed conditions where Spark lets Python sources have them."""
    spark.dataSource.register(RepoFiles)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("repo_files").options(pushdown=pushed, **options).load(root)


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """files (path and more, without content) with their content: whatever was left out before, by a join with given paths or any
    condition, is never opened. A file that is gone has null."""
    schema = files.withColumn("content", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                data = []
                for path in part["path"].to_pylist():
                    try:
                        data.append(Path(root, path).read_bytes())
                    except OSError:
                        data.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, "content"])

    return files.mapInArrow(run, schema)


def only(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The scanned files (without content) among these paths (path)."""
    return files.drop("content").join(paths.select("path").distinct(), "path", "left_semi").where("kind = 'file'")

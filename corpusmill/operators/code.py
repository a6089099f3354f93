"""Python sources: complexity, imports, definitions; the import graph and dead code."""

from __future__ import annotations

import ast
import multiprocessing
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import module_name
from corpusmill.sources import folders

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension, ast.IfExp)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def apart(make: Callable[[], object]) -> object:
    """What make() returns, from a process that ends with it: Python's parser keeps each name that it has met as long as its process
    lives, so a worker that parsed all files of its tasks itself would grow with the input."""
    context = multiprocessing.get_context("fork")
    here, there = context.Pipe(duplex=False)

    def run() -> None:
        try:
            there.send((make(), None))
        except Exception as x:  # noqa: BLE001 - raised again by the parent
            there.send((None, x))

    child = context.Process(target=run)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)  # the child uses none of what other threads may hold
        child.start()
    there.close()
    with here:
        made, failed = here.recv()
    child.join()
    if failed is not None:
        raise failed
    return made


def _parsed(files: DataFrame, rows_of: Callable[[ast.Module, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows from each file's syntax tree; a file that is no Python gives none. The one place where a parser is needed."""
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]

    def parse(paths: list[str], texts: list[str | None]) -> list[tuple]:
        out = []
        for path, text in zip(paths, texts, strict=True):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError):
                continue
            out += [(path, *row) for row in rows_of(tree, path)]
        return list(zip(*out, strict=True)) if out else [()] * len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch["path"].to_pylist(), batch["content"].to_pylist()
            cols = apart(lambda: parse(paths, texts))  # noqa: B023 - run before the next batch
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, schema)


def under(node: ast.AST) -> list[ast.AST]:
    """The nodes right under a node that have parts or say something (contexts of names and operators don't)."""
    out = []
    for name in node._fields:
        x = getattr(node, name, None)
        if isinstance(x, list):
            out += [y for y in x if isinstance(y, ast.AST)]
        elif isinstance(x, ast.AST) and x._fields:
            out.append(x)
    return out


def statements(tree: ast.Module) -> list[ast.AST]:
    """All statements at any depth (and handlers and cases, which hold some), without a look at expressions."""
    out: list[ast.AST] = [tree]
    for x in out:  # grows
        for name in ("body", "orelse", "handlers", "finalbody", "cases"):
            if isinstance(inner := getattr(x, name, None), list):
                out += inner
    return out


def branch_points(node: ast.AST) -> int:
    """Branches under a node, not into functions or classes inside."""
    total, stack = 0, under(node)
    while stack:
        x = stack.pop()
        if isinstance(x, SCOPES):
            continue
        total += isinstance(x, BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
        stack += under(x)
    return total


def measured(tree: ast.Module, _: str = "") -> Iterator[tuple]:
    """Name, qualified name, line and complexity of the functions in the bodies of modules, classes and functions."""
    waiting: list[tuple[tuple[str, ...], ast.AST]] = [((), tree)]
    for names, owner in waiting:  # grows as scopes are met
        inner = [((*names, x.name), x) for x in owner.body if isinstance(x, SCOPES)]
        waiting += inner
        yield from ((q[-1], ".".join(q), x.lineno, branch_points(x) + 1) for q, x in inner if not isinstance(x, ast.ClassDef))


def complexity(files: DataFrame) -> DataFrame:
    """path, name, qualname, lineno, complexity of each function. Functions are found in modules, classes and functions,
    not under other statements."""
    return _parsed(files, measured, "path string, name string, qualname string, lineno long, complexity long")


def most_complex(functions: DataFrame, top: int) -> DataFrame:
    """The functions of highest complexity."""
    return functions.orderBy(F.desc("complexity"), "path", "lineno").limit(top)


def most_imported(fan_in: DataFrame, top: int) -> DataFrame:
    """The modules that most others import, of those that any does."""
    return fan_in.where("fan_in > 0").orderBy(F.desc("fan_in"), "module").limit(top)


def file_complexity(functions: DataFrame) -> DataFrame:
    return functions.groupBy("path").agg(F.sum("complexity").alias("complexity"), F.max("complexity").alias("worst"), F.count("*").alias("functions"))


def named(tree: ast.Module, _: str = "") -> Iterator[tuple]:
    """What import statements name, and from how many folders up (0: from the top)."""
    for x in statements(tree):
        if not isinstance(x, ast.Import | ast.ImportFrom):
            continue
        module, level = getattr(x, "module", None), getattr(x, "level", 0) or 0
        if isinstance(x, ast.ImportFrom) and module:
            yield module, level
        else:
            yield from ((a.name, level) for a in x.names)


def imports(files: DataFrame) -> DataFrame:
    """path, target: what each file imports; `from p import a` targets p. A relative import starts at the file's package, less a
    part for each dot after the first, or at the top where there are not as many."""
    return targets(_parsed(files, named, "path string, name string, level long"))


def targets(rows: DataFrame) -> DataFrame:
    """The same from what named() gives for each file (path, name, level)."""
    parts = F.split(F.regexp_replace("path", "^src/", ""), "/")
    left = F.greatest(F.lit(0).cast("long"), F.size(parts) - F.col("level"))
    target = F.when(F.col("level") == 0, F.col("name")).otherwise(F.array_join(F.concat(F.slice(parts, F.lit(1), left.cast("int")), F.array("name")), "."))
    return rows.select("path", target.alias("target"))


def modules(paths: DataFrame) -> DataFrame:
    """The modules of files (path)."""
    return paths.select(module_name(F.col("path")).alias("module")).distinct()


def with_itself(tree: ast.Module, _: str = "") -> Iterator[tuple]:
    """What named() gives, after a row without a name, which tells that the file parses."""
    yield None, None
    yield from named(tree)


def import_graph(files: DataFrame, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (module) and edges (source, target): imports of known modules, or of packages above them. With a prefix, what
    lies under it. Files are parsed once, and what that gives is written."""
    parsed = folders.written(_parsed(files, with_itself, "path string, name string, level long"))
    nodes = modules(parsed.where("name is null"))
    parts = F.split("module", r"\.")
    known = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("target")).distinct()
    edges = targets(parsed.where("name is not null")).select(module_name(F.col("path")).alias("source"), "target").where("source != target").join(known, "target", "left_semi").select("source", "target").distinct()
    if prefix is not None:
        inside = lambda c: (F.col(c) == prefix) | F.startswith(c, F.lit(prefix + "."))
        nodes = nodes.where(inside("module"))
        edges = edges.join(nodes.withColumnRenamed("module", "source"), "source", "left_semi").join(nodes.withColumnRenamed("module", "target"), "target", "left_semi")
    return nodes, edges


def fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """module, fan_in: edges to each node."""
    counts = edges.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("n"))
    return nodes.join(counts, "module", "left").select("module", F.coalesce("n", F.lit(0).cast("long")).alias("fan_in"))


def dot(nodes: list[str], edges: list[tuple[str, str]]) -> str:
    """A drawn graph (driver side: for people)."""
    return "\n".join(["digraph dependencies {", '    rankdir="LR";', *(f'    "{x}";' for x in nodes), *(f'    "{a}" -> "{b}";' for a, b in edges), "}"])


def mermaid(nodes: list[str], edges: list[tuple[str, str]]) -> str:
    """The same for Mermaid; nodes are listed only where there are no edges."""
    name = lambda x: x.translate(str.maketrans("./-", "___"))
    shown = lambda x: f'{name(x)}["{x}"]'
    body = [f"    {shown(a)} --> {shown(b)}" for a, b in edges] or [f"    {shown(x)}" for x in nodes]
    return "\n".join(["graph LR", *body])


def _exports(tree: ast.Module) -> set[str]:
    """The strings in the first list, tuple or set that a module gives to __all__."""
    given = [(t, x.value) for x in tree.body if isinstance(x, ast.Assign) for t in x.targets]
    lists = [v.elts for t, v in given if isinstance(t, ast.Name) and t.id == "__all__" and hasattr(v, "elts")]
    return {c for e in (lists or [[]])[0] if isinstance(c := getattr(e, "value", None), str)}


def _dunder(name: str) -> bool:
    return len(name) > 4 and name.startswith("__") and name.endswith("__")


def _unused(tree: ast.Module, _: str) -> Iterator[tuple]:
    given = [x for x in statements(tree) if isinstance(x, ast.Import) or (isinstance(x, ast.ImportFrom) and x.module != "__future__")]
    if not given:
        return
    used, stack = _exports(tree), [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, ast.Name):
            used.add(x.id)
        else:
            stack += under(x)
    for x in given:
        for a in x.names:
            bound = a.asname or (a.name.split(".")[0] if isinstance(x, ast.Import) else a.name)
            if bound != "*" and bound not in used and not _dunder(bound):
                yield x.lineno, bound


def unused_imports(files: DataFrame) -> DataFrame:
    """path, lineno, name of imports that the file neither uses nor exports."""
    return _parsed(files, _unused, "path string, lineno long, name string")


def defined(tree: ast.Module, decorated: bool = False, tests: bool = False) -> Iterator[tuple]:
    """Line, kind and name of top-level functions and classes; by default not decorated ones, tests or dunders."""
    for x in tree.body:
        if isinstance(x, SCOPES) and (decorated or not x.decorator_list):
            is_class = isinstance(x, ast.ClassDef)
            if is_class or not (_dunder(x.name) or (x.name.startswith("test_") and not tests)):
                yield x.lineno, "class" if is_class else "function", x.name


def definitions(files: DataFrame, decorated: bool = False, tests: bool = False) -> DataFrame:
    """path, lineno, kind, name of what defined() gives for each file."""
    return _parsed(files, lambda tree, _: defined(tree, decorated, tests), "path string, lineno long, kind string, name string")


def told(tree: ast.Module, _: str = "") -> Iterator[tuple]:
    """kind, name, detail, line, value of a file's functions (value: complexity), imports (value: dots before the name) and top-level
    definitions (detail: kind)."""
    yield from (("function", qualified, name, line, value) for name, qualified, line, value in measured(tree))
    yield from (("import", name, None, None, level) for name, level in named(tree))
    yield from (("definition", name, kind, line, None) for line, kind, name in defined(tree))


def facts(files: DataFrame) -> DataFrame:
    """path and what told() gives, from one parse of each file."""
    return _parsed(files, told, "path string, kind string, name string, detail string, line long, value long")


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """name, path, n: how often each name (name) stands as a word in each text (path, content). Texts become words, summed in
    each, which join the names; no text meets every name."""
    words = texts.select(F.col("path").cast("string").alias("path"), F.explode(F.regexp_extract_all("content", F.lit(r"(?U)\w+"), F.lit(0))).alias("name"))
    return words.join(names.select("name").distinct(), "name", "left_semi").groupBy("name", "path").agg(F.count("*").alias("n"))


def unused_definitions(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Definitions whose name is nowhere else in all texts. The definition itself counts once less in its file."""
    defs = definitions(files)
    seen = occurrences(texts, defs)
    per = defs.join(seen.withColumnRenamed("path", "where"), "name", "left")
    here = F.coalesce("n", F.lit(0)) - (F.col("where") == F.col("path")).cast("int")
    return per.groupBy("path", "lineno", "kind", "name").agg(F.sum(F.greatest(F.coalesce(here, F.lit(0)), F.lit(0))).alias("uses")).where("uses <= 0").drop("uses")

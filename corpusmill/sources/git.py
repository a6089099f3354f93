"""A data source for a repository's history: spark.read.format("git_history").option("relation", ...).load(root).

Relations: commits, commit_files (a commit's files with added and deleted lines), branches, blame (option `files`), changed
(files changed since `ref`), diff_lines (the lines of the diff from `ref`), numstat (lines added and deleted since `ref`, by
file; option `only`), commit_totals (a row for each commit, with the sums of its files; zeros where it touches none), patch
(the lines of the patch of the commit `ref`; option `unified`). Options `since`, `until`. Each is one git call in one task,
but for blame, which is a task a file; rows are passed on as git prints them.
"""

from __future__ import annotations

import subprocess
from collections import Counter
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "hash string, short_hash string, author_name string, author_email string, date string, subject string, body string",
    "commit_files": "hash string, author_name string, author_email string, date string, path string, additions long, deletions long, is_binary boolean",
    "branches": "name string, last_commit_date string, author string, subject string, merged boolean, is_current boolean",
    "blame": "path string, author string, lines long",
    "changed": "path string",
    "diff_lines": "diff string, n long, line string",
    "numstat": "path string, additions long, deletions long, is_binary boolean",
    "commit_totals": "hash string, author_name string, author_email string, date string, additions long, deletions long, files_changed long",
    "patch": "hash string, n long, line string",
}
FIELD, RECORD = "\x1f", "\x1e"
TIMEOUT = 30


def git(root: str, *args: str) -> str:
    """What git prints; raises where it fails."""
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=True, timeout=TIMEOUT).stdout


def span(options: dict) -> list[str]:
    since, until = options.get("since"), options.get("until", "HEAD")
    return [f"{since}..{until}" if since else until]


def commits(root: str, options: dict) -> Iterator[tuple]:
    form = FIELD.join(["%H", "%h", "%an", "%ae", "%aI", "%s", "%b"]) + RECORD
    for record in git(root, "log", *span(options), f"--pretty=format:{form}").split(RECORD):
        fields = record.lstrip("\n").split(FIELD)
        if len(fields) >= 7:
            yield (*fields[:6], fields[6].strip())


def stat(line: str) -> tuple[str, int, int, bool]:
    """path, additions, deletions, is_binary of a numstat line; a binary file has no lines."""
    added, deleted, path = line.split("\t", 2)
    return (path, 0, 0, True) if added == "-" else (path, int(added), int(deleted), False)


def stats(root: str, options: dict) -> Iterator[tuple[list[str], list[tuple]]]:
    """Each commit's hash, author's name and email, date; and the stats of its files."""
    form = RECORD + FIELD.join(["%H", "%an", "%ae", "%aI"])
    extra = [f"--since={options['after']}"] if options.get("after") else []
    for record in git(root, "log", *span(options), *extra, "--numstat", f"--pretty=format:{form}").split(RECORD)[1:]:
        head, _, rest = record.partition("\n")
        yield head.split(FIELD), [stat(x) for x in rest.split("\n") if x.count("\t") >= 2]


def commit_files(root: str, options: dict) -> Iterator[tuple]:
    yield from ((*head, *row) for head, rows in stats(root, options) for row in rows)


def commit_totals(root: str, options: dict) -> Iterator[tuple]:
    yield from ((*head, sum(r[1] for r in rows), sum(r[2] for r in rows), len(rows)) for head, rows in stats(root, options))


def numstat(root: str, options: dict) -> Iterator[tuple]:
    paths = [p for p in options.get("only", "").split(";") if p]
    yield from (stat(x) for x in git(root, "diff", "--numstat", options["ref"], "--", *paths).splitlines() if x.count("\t") >= 2)


def patch(root: str, options: dict) -> Iterator[tuple]:
    sha = git(root, "rev-parse", "--verify", f"{options['ref']}^{{commit}}").strip()
    text = git(root, "show", "--format=", f"--unified={int(options.get('unified', 3))}", sha)
    yield from ((sha, k, x) for k, x in enumerate(text.splitlines()))


def branches(root: str, options: dict) -> Iterator[tuple]:
    where = "refs/remotes" if options.get("remote") == "true" else "refs/heads"
    merged = set(git(root, "for-each-ref", "--merged", "HEAD", "--format=%(refname:short)", where).split())
    form = "%1f".join(["%(refname:short)", "%(committerdate:iso-strict)", "%(authorname)", "%(subject)", "%(HEAD)"])
    for line in git(root, "for-each-ref", f"--format={form}", where).splitlines():
        name, date, author, subject, head = line.split(FIELD)
        yield name, date, author, subject, name in merged, head == "*"


def blame(root: str, options: dict) -> Iterator[tuple]:
    path = options["one"]
    try:
        counts = Counter(x[7:] for x in git(root, "blame", "--line-porcelain", "--", path).splitlines() if x.startswith("author "))
    except subprocess.CalledProcessError:
        return
    yield from ((path, author, n) for author, n in counts.items())


def changed(root: str, options: dict) -> Iterator[tuple]:
    yield from ((x,) for x in git(root, "diff", "--name-only", "--diff-filter=ACMR", options["ref"]).splitlines() if x)


def diff_lines(root: str, options: dict) -> Iterator[tuple]:
    yield from ((options["ref"], k, x) for k, x in enumerate(git(root, "diff", "-U3", options["ref"]).splitlines()))


RELATIONS = {"commits": commits, "commit_files": commit_files, "branches": branches, "blame": blame, "changed": changed, "diff_lines": diff_lines, "numstat": numstat, "commit_totals": commit_totals, "patch": patch}


class GitHistory(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMAS[self.options["relation"]]

    def reader(self, schema: object) -> DataSourceReader:
        return GitReader(dict(self.options))


class One(InputPartition):
    def __init__(self, path: str | None):
        self.path = path


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[One]:
        if self.options["relation"] == "blame":
            return [One(p) for p in self.options.get("files", "").split(";") if p] or [One(None)]
        return [One("")]

    def read(self, partition: One) -> Iterator[tuple]:
        if partition.path is not None:
            yield from RELATIONS[self.options["relation"]](self.options["path"], {**self.options, "one": partition.path})


def is_repository(root: str) -> bool:
    try:
        return git(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (subprocess.CalledProcessError, OSError):
        return False


def current_branch(root: str) -> str:
    return git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()


def latest_tag(root: str) -> str | None:
    try:
        return git(root, "describe", "--tags", "--abbrev=0").strip()
    except subprocess.CalledProcessError:
        return None


def is_clean(root: str) -> bool:
    return not git(root, "status", "--porcelain").strip()

"""A stream of what changes in a folder: spark.readStream.format("repo_changes").option("state", folder).load(root).

Each batch has the paths that were added, changed or removed since the one before (path, status, mark). An offset names a snapshot: the digest
of all paths with their times and sizes; the snapshots are files in `state`, a folder that outlives the driver. So a query that
starts again from its checkpoint compares with what it has seen last: it misses no change and sends none again. A batch that is run again has
the same rows. `ignored`, `excludes` and `gitignore` are as in repo_files. The driver lists the folder at each trigger; the rows of a
batch come from tasks, PER_TASK paths each.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpusmill.sources.repo_files import RepoFilesReader, walk

SCHEMA = "path string, status string, mark string"
PER_TASK, KEPT = 10_000, 8


class RepoChanges(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "repo_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return RepoChangesReader(self.options)


class Rows(InputPartition):
    def __init__(self, rows: list[tuple[str, str, str | None]]):
        self.rows = rows


class RepoChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "state" not in options:
            raise ValueError("repo_changes needs the option state: a folder for its snapshots")
        self.files, self.state = RepoFilesReader(options), options["state"]

    def fingerprint(self) -> dict[str, str]:
        """The mark of each path: its time and size."""
        found = {}
        for path, kind in walk(self.files.root, self.files.rules):
            with contextlib.suppress(OSError):
                if kind == "file":
                    stat = os.stat(os.path.join(self.files.root, path))
                    found[path] = f"{stat.st_mtime_ns}:{stat.st_size}"
        return found

    def snapshot(self, digest: str) -> dict[str, str]:
        return json.loads(Path(self.state, f"{digest}.json").read_text()) if digest else {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        text = json.dumps(self.fingerprint(), sort_keys=True)
        if text == "{}" and not Path(self.state).exists():
            return {"snapshot": ""}
        digest = hashlib.sha256(text.encode()).hexdigest()
        os.makedirs(self.state, exist_ok=True)
        part = Path(self.state, f"{uuid.uuid4().hex}.tmp")
        part.write_text(text)
        os.replace(part, Path(self.state, f"{digest}.json"))  # also makes it the newest
        return {"snapshot": digest}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        old, new = self.snapshot(start["snapshot"]), self.snapshot(end["snapshot"])
        rows = [(p, "changed" if p in old else "added", m) for p, m in new.items() if old.get(p) != m] + [(p, "removed", None) for p in old if p not in new]
        rows.sort()
        return [Rows(rows[k : k + PER_TASK]) for k in range(0, len(rows), PER_TASK)] or [Rows([])]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        cols = list(zip(*partition.rows, strict=True)) if partition.rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "status", "mark"])

    def commit(self, end: dict) -> None:
        """Snapshots older than the KEPT newest go, but not the one that the next batch starts from."""
        found = sorted(Path(self.state).glob("*.json"), key=lambda p: p.stat().st_mtime_ns)
        for p in found[:-KEPT]:
            if p.stem != end["snapshot"]:
                p.unlink(missing_ok=True)

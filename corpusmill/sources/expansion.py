"""A sink that expands files into a folder: files.write.format("expansion").mode("append").save(target); files: path, content.

Tasks write what is new to a hidden folder beside its target and compare with what is there. Only when all have done so, the driver moves the
staged files to their places, so a conflict, an unsafe path or a failed task leaves the target as it was. Options: `force` (true: files with
other contents are replaced). Files with the same contents are left alone; a path that leaves the folder, or comes twice with different
contents, is an error. A null content is an empty file. The folder must be one that all machines see.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PATHS_NAMED = 5


class UnsafePathError(ValueError):
    """A path that leads out of the folder."""


@dataclass
class Staged(WriterCommitMessage):
    """Of a task: (path, digest, name in the staging folder, or None where the target has it), conflicts, and unsafe paths."""

    files: list[tuple[str, str, str | None]]
    conflicts: list[str]
    unsafe: list[str]


def inside(path: str) -> str | None:
    """The plain form of a path below a folder; None if it isn't one."""
    plain = posixpath.normpath(path.replace("\\", "/"))
    absolute = plain.startswith("/") or (len(plain) > 1 and plain[1] == ":")
    return None if absolute or plain in ("", ".") or plain.split("/")[0] == ".." else plain


class Expansion(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "expansion"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return ExpansionWriter(self.options["path"], overwrite or self.options.get("force", "false") == "true")


class ExpansionWriter(DataSourceArrowWriter):
    def __init__(self, target: str, force: bool):
        self.target, self.force = target.rstrip("/"), force
        self.staging = f"{self.target}.expanding-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        out = Staged([], [], [])
        os.makedirs(self.staging, exist_ok=True)
        for batch in iterator:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                plain = inside(path or "")
                there = plain and Path(self.target, plain)
                if plain is None or not there.resolve().is_relative_to(Path(self.target).resolve()):  # also by a link in the folder
                    out.unsafe.append(path)
                    continue
                data = content if isinstance(content, bytes) else (content or "").encode()
                digest, name = hashlib.sha256(data).hexdigest(), None
                same = there.is_file() and there.read_bytes() == data
                if there.exists() and not same and (not self.force or there.is_dir()):
                    out.conflicts.append(plain)
                    continue
                if not same:
                    name = uuid.uuid4().hex
                    Path(self.staging, name).write_bytes(data)
                out.files.append((plain, digest, name))
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        unsafe, conflicts = [p for m in done for p in m.unsafe], [p for m in done for p in m.conflicts]
        digests: dict[str, str] = {}
        for path, digest, _ in (f for m in done for f in m.files):
            if digests.setdefault(path, digest) != digest:
                conflicts.append(path)
        shown = lambda paths: ", ".join(sorted(set(map(str, paths)))[:PATHS_NAMED]) + f" ({len(set(paths))} in all)"
        try:
            if unsafe:
                raise UnsafePathError(f"outside the folder: {shown(unsafe)}")
            if conflicts:
                raise FileExistsError(f"there with other contents: {shown(conflicts)}")
            for path, _, name in (f for m in done for f in m.files):
                if name is not None:
                    to = Path(self.target, path)
                    to.parent.mkdir(parents=True, exist_ok=True)
                    os.replace(Path(self.staging, name), to)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)

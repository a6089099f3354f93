"""Small results for readers: tables, trees, changelogs, reports. Rows are collected; what has no bound is written by Spark."""

from __future__ import annotations

import csv
import html
import io
import json
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from corpusmill.functions.history import SECTION_ORDER


def records(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """Rows as dictionaries; more than the limit is an error, not cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write the table instead")
    return [r.asDict(recursive=True) for r in rows]


def as_csv(rows: list[dict]) -> str:
    """The first row gives the header; a later row with another key is an error."""
    if not rows:
        return ""
    out = io.StringIO()
    writer = csv.DictWriter(out, fieldnames=list(rows[0]))
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def as_markdown(rows: list[dict]) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *(line(r.get(n, "") for n in names) for r in rows)])


def as_html(rows: list[dict], title: str) -> str:
    names = list(rows[0]) if rows else []
    cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    body = cells(names, "th") + "".join(cells((r.get(n, "") for n in names), "td") for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{body}</table></body></html>"


def as_json(rows: list[dict]) -> str:
    """A table as JSON, one object a row."""
    return json.dumps(rows, indent=2, default=str, ensure_ascii=False)


def tree_html(nodes: Iterable[dict], title: str) -> str:
    """Adjacency rows (path, parent, is_dir, name) as nested lists, folders first."""
    under: dict[str, list[dict]] = {}
    for n in nodes:
        under.setdefault(n["parent"], []).append(n)

    def items(parent: str) -> str:
        own = sorted(under.get(parent, []), key=lambda n: (not n["is_dir"], n["name"]))
        return "".join(f"<li><strong>{html.escape(n['name'])}/</strong><ul>{items(n['path'])}</ul></li>" if n["is_dir"] else f"<li>{html.escape(n['name'])}</li>" for n in own)

    head = f"<meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif;margin:2rem}}ul{{list-style-type:none}}</style>"
    return f"<!DOCTYPE html><html><head>{head}</head><body><h1>{html.escape(title)}</h1><ul>{items('')}</ul></body></html>"


def tree_lines(nodes: Iterable[dict], root: str) -> list[str]:
    """Adjacency rows (path, parent, is_dir, name) as a drawn tree, folders first."""
    under: dict[str, list[dict]] = {}
    for n in nodes:
        under.setdefault(n["parent"], []).append(n)

    def draw(parent: str, prefix: str) -> Iterator[str]:
        own = sorted(under.get(parent, []), key=lambda n: (not n["is_dir"], n["name"]))
        for k, n in enumerate(own):
            last = k == len(own) - 1
            yield f"{prefix}{'└── ' if last else '├── '}{n['name']}{'/' * n['is_dir']}"
            yield from draw(n["path"], prefix + ("    " if last else "│   "))

    return [f"{root}/", *draw("", "")]


def changelog(entries: list[dict], since: str | None, until: str, title: str = "Changelog") -> str:
    """Entries (section, scope, description, breaking, short_hash, author_name) by section, in order; those of no known type
    are left out."""
    out = [f"# {title}", "", f"_Range: `{f'{since}..' if since else ''}{until}`_", ""]
    for section in SECTION_ORDER[:-1]:
        own = [e for e in entries if e["section"] == section]
        if own:
            out += [f"## {section}", ""]
            out += [f"- {'**' + e['scope'] + ':** ' if e['scope'] else ''}{e['description']}{' **BREAKING**' * bool(e['breaking'])} ({e['short_hash']} by {e['author_name']})" for e in own]
            out.append("")
    if len(out) == 4:
        out += ["_No commits in range._", ""]
    return "\n".join(out)


def zipped(files: DataFrame, path: str) -> int:
    """Files (path, content) into a zip archive with a manifest, one at a time; how many."""
    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.select("path", "content").orderBy("path").toLocalIterator():
            z.writestr(str(r["path"]), r["content"])
            names.append(str(r["path"]))
        z.writestr("MANIFEST.txt", "\n".join(names) + "\n")
    return len(names)


def save_output(folder: str, project: str, command: str, data: object) -> Path:
    """Keep a command's last output."""
    out = Path(folder, f"{project}__{command}.json")
    out.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=out.parent, delete=False) as f:
        json.dump(data, f, default=str)
    os.replace(f.name, out)
    return out


#: Where a saved output has its table, in order of preference.
TABLE_KEYS = ["files", "findings", "issues", "dependencies", "entries", "groups", "results", "items"]


def saved_table(path: Path) -> list[dict]:
    """The rows in a saved output: itself if a list, else the first known key's."""
    data = json.loads(Path(path).read_text())
    if isinstance(data, list):
        return data
    return next((data[k] for k in TABLE_KEYS if isinstance(data.get(k), list)), [data])


def pull_request(subjects: list[str], files: list[dict], issues: list[str], shown: int = 50) -> str:
    """A description of a branch: commits, issues, changed lines, and the first files (path, additions, deletions)."""
    added, deleted = sum(f["additions"] for f in files), sum(f["deletions"] for f in files)
    out = ["## Summary", "", *(f"- {s}" for s in subjects), "", f"**{len(files)} file(s) changed, +{added} / -{deleted}**", ""]
    out += [f"- `{f['path']}` (+{f['additions']} / -{f['deletions']})" for f in files[:shown]]
    out += [f"- … and {len(files) - shown} more"] * (len(files) > shown)
    return "\n".join([*out, *(["", "Issues: " + ", ".join(issues)] if issues else [])])


def compliance_report(project: str, score: int, findings: list[dict]) -> str:
    """A compliance report: findings have category, severity, message."""
    out = [f"# Compliance report: {project}", "", f"Score: **{score}/100**", ""]
    for category in ("hygiene", "licensing", "maintainability"):
        own = [f for f in findings if f["category"] == category]
        out += [f"## {category.capitalize()}", "", *(f"- [{f['severity']}] {f['message']}" for f in own), *(["- none"] * (not own)), ""]
    return "\n".join(out)

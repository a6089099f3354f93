"""Ignore patterns as .gitignore has them, translated to regular expressions."""

from __future__ import annotations

import re


def translated(pattern: str) -> tuple[str, bool, bool] | None:
    """Regular expression over a path from the root, whether it negates, and whether it fits folders only. None for blank
    lines and comments."""
    p = pattern.rstrip("\n")
    p = re.sub(r"(?<!\\) +$", "", p)
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[1:] if negated else p
    p = p[1:] if p.startswith(("\\#", "\\!")) else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p[i] == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            out += "[^/]*"
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out, negated, folder


def as_folder(name: str) -> str:
    """The pattern of an ignored folder's name: anywhere, unless it has a slash."""
    name = name.strip().strip("/")
    return name and (f"{name}/" if "/" in name else f"**/{name}/")


class IgnoreRules:
    """Patterns in order of rising precedence: ignored folders, file patterns, the repository's .gitignore, the project's
    folders, excludes; .git always. The last that fits decides; what lies in an ignored folder is ignored."""

    def __init__(self, folders: list[str] = (), patterns: list[str] = (), gitignore: str = "", project: list[str] = (), excludes: list[str] = ()):
        own = [x for x in gitignore.splitlines() if x.strip() and not x.strip().startswith("#")]
        every = [*map(as_folder, folders), *patterns, *own, *map(as_folder, project), *excludes, ".git/"]
        self.rules = [(re.compile(t[0]), t[1], t[2]) for p in every if (t := translated(p))]

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        """Whether a path (relative, with /) is ignored, by itself or by a folder above."""
        parts = path.strip("/").split("/")
        return any(self._fits("/".join(parts[:k]), is_dir or k < len(parts)) for k in range(1, len(parts) + 1))

    def _fits(self, path: str, is_dir: bool) -> bool:
        found = False
        for regex, negated, folder in self.rules:
            if (is_dir or not folder) and regex.fullmatch(path):
                found = not negated
        return found

"""Further queries: from other packages (entry points of the group `corpusmill.queries`) and from scripts in a folder.

An entry point, or a script's function `register`, is called with a dictionary to which it adds queries by name.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points
from pathlib import Path

VERSION = 1
#: The environment variable that names the folder of scripts.
SCRIPTS = "CORPUSMILL_SCRIPTS"


def from_script(path: Path) -> Callable[[dict], None]:
    spec = importlib.util.spec_from_file_location(f"corpusmill_script_{path.stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, "register", None)):
        raise AttributeError("there is no function register")
    module.register.version = getattr(module, "VERSION", VERSION)
    return module.register


def found_extensions(folder: str | None) -> Iterator[tuple[str, Callable[[], Callable[[dict], None]]]]:
    """Names, and how each is loaded: entry points, then scripts by name. Scripts whose name begins with _ are parts of others."""
    yield from ((p.name, p.load) for p in entry_points(group="corpusmill.queries"))
    if folder and Path(folder).is_dir():
        yield from ((p.stem, lambda p=p: from_script(p)) for p in sorted(Path(folder).glob("*.py")) if not p.name.startswith("_"))


def extensions(folder: str | None = None) -> tuple[dict, dict[str, str]]:
    """Queries that extensions register, and what went wrong with those that failed; one that fails harms no other, and leaves
    nothing behind. One that was made for another version is reported, and counts."""
    found: dict = {}
    failed: dict[str, str] = {}
    for name, load in found_extensions(folder or os.environ.get(SCRIPTS)):
        own: dict = {}
        try:
            register = load()
            register(own)
            if getattr(register, "version", VERSION) != VERSION:
                failed[name] = f"made for version {register.version}"
            found |= own
        except Exception as e:  # noqa: BLE001 - isolated, and reported
            failed[name] = repr(e)
    return found, failed

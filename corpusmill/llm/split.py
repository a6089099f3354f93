"""Splitting a text by a tokenizer's pattern."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Letters beyond ASCII of which most texts in Western European languages make do.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of a pattern with \\p{L} and \\p{N}.

    Where a text has only ASCII and LATIN, in which these classes are short, the standard library's faster
    matcher gives the same matches: \\s is ASCII white space there, and neither has other letters or digits.
    """
    import regex

    full = regex.compile(pattern).findall
    if set(re.findall(r"\\(?:[pP]\{\w+\}|.)", pattern)) - {r"\p{L}", r"\p{N}", r"\s", r"\S"} or "(?i" in pattern:
        return full
    short, depth = "", 0
    for part in re.split(r"(\\p\{[LN]\}|\\.|\[\^?|\])", pattern):
        depth += part.startswith("[") - (part == "]")
        members = {r"\p{L}": "A-Za-z" + LATIN, r"\p{N}": "0-9"}.get(part)
        short += part if members is None else members if depth else f"[{members}]"
    quick, other = re.compile(short, re.ASCII).findall, re.compile(f"[^\x00-\x7f{LATIN}]").search
    return lambda text: full(text) if not text.isascii() and other(text) else quick(text)

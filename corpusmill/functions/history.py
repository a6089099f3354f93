"""Column functions on commit messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import literal_map, stripped

# Commit types and the changelog sections they go to, in order.
SECTIONS = {"feat": "Added", "fix": "Fixed", "perf": "Performance", "refactor": "Changed", "docs": "Documentation", "test": "Tests", "build": "Build", "ci": "CI", "style": "Style", "revert": "Reverted", "chore": "Chores"}
SECTION_ORDER = [*SECTIONS.values(), "Other"]
KNOWN_TYPES = ", ".join(SECTIONS)
# The grammar of a subject, for changelogs and (stricter) for linting; merges; issue ids; closing words.
SUBJECT = r"^([a-zA-Z]+)(?:\(([^)]*)\))?(!)?:\s*(.+)$"
STRICT_SUBJECT = r"^([a-z]+)(?:\(([^)]*)\))?(!)?:\s(.+)$"
MERGE = r"^Merge (branch|pull request|remote-tracking branch)\b"
TRACKER_ID = r"(?U)\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
NUMBER_ID = r"(?U)(?<![A-Za-z0-9_])#(\d+)\b"
CLOSING = r"(?iU)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b"
LONGEST_SUBJECT = 100


def classify(subject: Column) -> dict[str, Column]:
    """Section, scope, description and breaking mark of a subject, blanks at its ends aside. An unknown type goes to Other,
    without its prefix."""
    subject = stripped(subject)
    part = lambda k: F.regexp_extract(subject, SUBJECT, k)
    matches = subject.rlike(SUBJECT)
    section = F.coalesce(F.try_element_at(literal_map(SECTIONS), F.lower(part(1))), F.lit("Other"))
    return {
        "section": F.when(matches, section).otherwise("Other"),
        "scope": F.when(matches, F.nullif(part(2), F.lit(""))),
        "description": F.when(matches, stripped(part(4))).otherwise(subject),
        "breaking": F.coalesce(matches & (part(3) == "!"), F.lit(False)),
    }


def lint_reasons(subject: Column) -> Column:
    """Why a subject is no good commit subject; empty if it is one. Merges are exempt."""
    s = stripped(subject)
    kind, text = F.regexp_extract(s, STRICT_SUBJECT, 1), F.regexp_extract(s, STRICT_SUBJECT, 4)
    first = F.substring(text, 1, 1)
    found = F.array(
        F.when(~kind.isin(list(SECTIONS)), F.concat(F.lit("unknown type '"), kind, F.lit(f"' (known types: {KNOWN_TYPES})"))),
        F.when((F.upper(first) == first) & (F.lower(first) != first), "description should start lowercase (Conventional Commits convention)"),
        F.when(F.endswith(text, F.lit(".")), "description should not end with a period"),
        F.when(F.length(s) > LONGEST_SUBJECT, F.concat(F.lit("subject is "), F.length(s).cast("string"), F.lit(f" chars, longer than {LONGEST_SUBJECT}"))),
    )
    none = F.array().cast("array<string>")
    return (
        F.when(s == "", F.array(F.lit("empty commit subject")))
        .when(s.rlike(MERGE), none)
        .when(~s.rlike(STRICT_SUBJECT), F.array(F.lit(f"does not match '<type>(<scope>)?: <description>' (known types: {KNOWN_TYPES})")))
        .otherwise(F.filter(found, lambda x: x.isNotNull()))
    )


def issue_ids(message: Column) -> Column:
    """Tracker ids, then #numbers, each once, in the order they appear."""
    return F.array_distinct(F.concat(F.regexp_extract_all(message, F.lit(TRACKER_ID), F.lit(1)), F.regexp_extract_all(message, F.lit(NUMBER_ID), F.lit(1))))


def closes(message: Column) -> Column:
    return message.rlike(CLOSING)


def issue_url(base: Column, issue: Column) -> Column:
    """Where an issue is; null without a base."""
    return F.when(F.coalesce(base, F.lit("")) != "", F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), issue))

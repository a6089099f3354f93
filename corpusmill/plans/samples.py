"""A few commit subjects that show the grammar; queries read them beside the table's."""

from __future__ import annotations

SUBJECTS = [
    ("x1", "feat(auth): add login"), ("x2", "fix: crash on start"), ("x3", "did stuff"), ("x4", "bogus: Fixed the thing."), ("x5", "Merge branch 'main' into x"), ("x6", "feat!: drop old API"),
    ("x7", "Docs(readme): Explain setup"), ("x8", ""), ("x9", "fix(core): closes #12 and PROJ-34, see #12"), ("x10", "chore: " + "x" * 120), ("x11", "perf:fast"), ("x12", "resolve AB-1 with abc#7"),
]

"""What a build may hang on: how often each rule of a gate is broken, and whether that fails it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The least score of a healthy project, and the complexity from which a function counts as broken.
MIN_SCORE, COMPLEX = 70, 10


def gate(rows: DataFrame, name: str, broken: str = "true") -> DataFrame:
    """gate, broken, failed: how many rows break it; one is enough to fail."""
    n = F.count_if(F.expr(broken))
    return rows.agg(F.lit(name).alias("gate"), n.alias("broken"), (n > 0).alias("failed"))


def health_gate(parts: DataFrame, least: int = MIN_SCORE) -> DataFrame:
    """Of the parts of a health score (score): broken is by how much it is below the least."""
    missing = F.greatest(F.lit(0), F.lit(least) - F.coalesce(F.sum("score"), F.lit(0))).cast("long")
    return parts.agg(F.lit("health").alias("gate"), missing.alias("broken"), (missing > 0).alias("failed"))


def gates(doctor: DataFrame, lint: DataFrame, functions: DataFrame, duplicates: DataFrame, dead: DataFrame, faulty_commits: DataFrame, health: DataFrame, threshold: int = COMPLEX, least: int = MIN_SCORE) -> DataFrame:
    """gate, broken, failed of all gates, a row each. doctor, lint: findings (severity); functions: complexity; duplicates, dead,
    faulty_commits: a row each; health: score of each part."""
    out = gate(doctor, "doctor", "severity = 'error'").unionByName(gate(lint, "lint", "severity = 'error'"))
    out = out.unionByName(gate(functions, "complexity", f"complexity >= {threshold}"))
    for rows, name in ((duplicates, "dupes"), (dead, "deadcode"), (faulty_commits, "commit-lint")):
        out = out.unionByName(gate(rows, name))
    return out.unionByName(health_gate(health, least))


def exit_code(made: DataFrame) -> int:
    """What a command ends with: 5 where any gate fails, else 0."""
    return 0 if made.where("failed").isEmpty() else 5


def phase_shares(timings: DataFrame) -> DataFrame:
    """place, phase, seconds, pct of the whole, slowest first; timings: phase, seconds, one row a phase (few)."""
    everything = Window.partitionBy(F.lit(0))  # phases of one command
    share = F.coalesce(F.try_divide("seconds", F.sum("seconds").over(everything)), F.lit(0.0)) * 100
    place = F.row_number().over(everything.orderBy(F.desc("seconds"), "phase"))
    return timings.select(place.alias("place"), "phase", F.format_string("%.3f", "seconds").alias("seconds"), F.format_string("%.1f%%", share).alias("pct"))

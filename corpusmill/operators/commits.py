"""History: changelogs, commit lint, issues, contributors, churn, hotspots, owners, branches, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import history as H


def first_line(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def classified(commits: DataFrame) -> DataFrame:
    """hash, section, scope, description, breaking of each commit (hash, subject)."""
    return commits.select("hash", *[c.alias(k) for k, c in H.classify(F.col("subject")).items()])


def sections(commits: DataFrame) -> DataFrame:
    """Entries by section, in the changelog's order: place, section, entries, breaking, latest (the largest hash)."""
    place = F.array_position(F.array(*[F.lit(x) for x in H.SECTION_ORDER]), F.col("section"))
    rows = classified(commits).groupBy("section").agg(F.count("*").alias("entries"), F.count_if("breaking").alias("breaking"), F.max("hash").alias("latest"))
    return rows.select(place.alias("place"), "section", "entries", "breaking", "latest").orderBy("place")


def linted(commits: DataFrame) -> DataFrame:
    """hash, subject, reasons of the commits with faults."""
    return commits.select("hash", "subject", H.lint_reasons(F.col("subject")).alias("reasons")).where(F.size("reasons") > 0)


def issues(commits: DataFrame) -> DataFrame:
    """hash, issue, closes: each issue that a commit (hash, message) names. `closes` is the commit's."""
    return commits.select("hash", F.explode(H.issue_ids(F.col("message"))).alias("issue"), H.closes(F.col("message")).alias("closes"))


def first_seen(commits: DataFrame) -> DataFrame:
    """issue, hash, commits: each issue once, in the order in which commits (met: their order, hash, message) first name it, with
    the first commit that does and how many do."""
    named = commits.select("met", "hash", F.posexplode(H.issue_ids(F.col("message"))).alias("at", "issue"))
    seen = named.groupBy("issue").agg(F.min(F.struct("met", "at", "hash")).alias("first"), F.count("*").alias("commits"))
    return seen.select("issue", "first", F.col("first.hash").alias("hash"), "commits").orderBy("first").select("issue", "hash", "commits")


def contributors(stats: DataFrame) -> DataFrame:
    """stats: email, name, additions, deletions, date (one row a commit). By email, or name without one: commits, sums, first
    and last date as instants, and the name of the latest commit."""
    key = F.coalesce(F.nullif("email", F.lit("")), F.col("name"))
    return stats.groupBy(key.alias("author")).agg(F.max_by("name", "date").alias("name"), F.count("*").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def most_active(stats: DataFrame, top: int) -> DataFrame:
    """The contributors with most commits."""
    return contributors(stats).orderBy(F.desc("commits"), "author").limit(top)


def churn(touches: DataFrame) -> DataFrame:
    """path, churn: commits that touched a file (touches: path, one row a commit and file)."""
    return touches.groupBy("path").agg(F.count("*").alias("churn"))


def hotspots(files: DataFrame, touched: DataFrame, complexity: DataFrame, top: int | None = None) -> DataFrame:
    """Files (path, lines) that were touched (path, churn), by churn times complexity (path, complexity; where unknown, the
    lines, marked as estimated; at least 1)."""
    rows = files.join(touched.where("churn > 0"), "path").join(complexity, "path", "left")
    measure = F.greatest(F.coalesce("complexity", "lines"), F.lit(1)).cast("long")
    out = rows.select("path", "churn", measure.alias("complexity"), F.col("complexity").isNull().alias("estimated"), (F.col("churn") * measure).alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "path").limit(top)


def owners(blame: DataFrame) -> DataFrame:
    """blame: path, author, lines. Each file's author of most lines (of equals, the least name), lines, share."""
    totals = blame.groupBy("path", "author").agg(F.sum("lines").alias("lines"))
    best = F.max(F.struct(F.col("lines"), (-F.col("author") if dict(blame.dtypes)["author"] != "string" else F.col("author")).alias("by")))
    if dict(blame.dtypes)["author"] == "string":
        first = totals.groupBy("path").agg(F.max("lines").alias("top_lines"), F.sum("lines").alias("total"))
        named = totals.join(first, "path").where("lines = top_lines").groupBy("path", "top_lines", "total").agg(F.min("author").alias("author"))
    else:
        named = totals.groupBy("path").agg(best.alias("b"), F.sum("lines").alias("total")).select("path", (-F.col("b.by")).alias("author"), F.col("b.lines").alias("top_lines"), "total")
    return named.select("path", "author", "top_lines", "total", F.round(F.col("top_lines") / F.col("total"), 4).alias("share"))


def weakest(owned: DataFrame, top: int, prefix: str = "") -> DataFrame:
    """The files (below a path, if one is given) of whose lines the first author has the least share."""
    rows = owned.where(F.col("path").cast("string").startswith(prefix)) if prefix else owned
    return rows.orderBy("share", "path").limit(top)


def owned_files(owned: DataFrame) -> DataFrame:
    """How many files each author owns, and the lines in them."""
    return owned.groupBy("author").agg(F.count("*").alias("files"), F.sum("top_lines").alias("lines"))


def age_days(then: Column, now: Column) -> Column:
    """Whole days between two instants."""
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000)).cast("long")


def stale(branches: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Branches (name, last, merged, is_current) that are not current and as old as that; without a date, none."""
    rows = branches.withColumn("age_days", age_days(F.col("last"), now))
    return rows.where((F.col("age_days") >= days) & ~F.col("is_current"))


def last_runs(log: DataFrame, group: str, n: int) -> DataFrame:
    """The last n rows of each group of a run log (ts, id), oldest first by place; 0 means all."""
    w = Window.partitionBy(group).orderBy(F.desc("ts"), F.desc("id"))
    rows = log.withColumn("place", F.row_number().over(w))
    return rows if not n else rows.where(F.col("place") <= n)


def by_command(log: DataFrame) -> DataFrame:
    """command, runs, failures (errors), mean value of a run log (command, failed, value)."""
    return log.groupBy("command").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures"), F.round(F.avg("value"), 6).alias("mean_value"))

"""Findings: linters' and scanners' reports in one form, SARIF in and out, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ["file", "line", "rule", "severity", "message", "source"]
# The weights of a health score, without and with an external report.
WEIGHTS = {"doctor": 25, "lint": 35, "complexity": 20, "duplication": 20}
WEIGHTS_WITH_EXTERNAL = {"doctor": 20, "lint": 30, "complexity": 15, "duplication": 15, "external": 20}
COMPLEX, DUPLICATED = 10, 500
# Schemas of the reports.
SARIF = "version string, runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>>>>>"
GENERIC = "tool string, issues array<struct<tool:string,rule:string,severity:string,file:string,line:bigint,message:string>>"
RUFF = "array<struct<filename:string,location:struct<row:bigint>,code:string,message:string>>"
ESLINT = "array<struct<filePath:string,messages:array<struct<line:bigint,ruleId:string,severity:int,message:string>>>>"
CLIPPY = "reason string, message struct<message:string,level:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:bigint,is_primary:boolean>>>"
GOLANGCI = "Issues array<struct<Pos:struct<Filename:string,Line:bigint>,FromLinter:string,Text:string>>"
DART = "diagnostics array<struct<location:struct<file:string,range:struct<start:struct<line:bigint>>>,code:string,severity:string,problemMessage:string>>"


def union(*findings: DataFrame) -> DataFrame:
    """All findings, in one form."""
    out = findings[0].select(*FINDING)
    for x in findings[1:]:
        out = out.unionByName(x.select(*FINDING))
    return out


def _rows(reports: DataFrame, schema: str, path: str) -> DataFrame:
    return reports.select(F.explode(F.from_json("json", schema)[path] if path else F.from_json("json", schema)).alias("x"))


def _finding(rows: DataFrame, file: Column, line: Column, rule: Column, severity: Column, message: Column, source: str) -> DataFrame:
    return rows.select(file.alias("file"), line.cast("long").alias("line"), rule.alias("rule"), severity.alias("severity"), F.coalesce(message, F.lit("")).alias("message"), F.lit(source).alias("source"))


def ruff(reports: DataFrame) -> DataFrame:
    """Findings in reports (json); codes that begin with E are errors."""
    x = F.col("x")
    return _finding(_rows(reports, RUFF, ""), x["filename"], x["location"]["row"], x["code"], F.when(F.startswith(x["code"], F.lit("E")), "error").otherwise("warning"), x["message"], "ruff")


def eslint(reports: DataFrame) -> DataFrame:
    rows = _rows(reports, ESLINT, "").select(F.col("x.filePath").alias("f"), F.explode("x.messages").alias("x"))
    x = F.col("x")
    return _finding(rows, F.col("f"), x["line"], x["ruleId"], F.when(x["severity"] == 2, "error").otherwise("warning"), x["message"], "eslint")


def clippy(reports: DataFrame) -> DataFrame:
    """Reports hold one message a line; those that are none, or no JSON, go. The primary span counts, else the first."""
    rows = reports.select(F.from_json("json", CLIPPY).alias("x")).where("x.reason = 'compiler-message'")
    spans = F.col("x.message.spans")
    span = F.coalesce(F.get(F.filter(spans, lambda s: s["is_primary"]), F.lit(0)), F.get(spans, F.lit(0)))
    m = F.col("x.message")
    return _finding(rows, F.coalesce(span["file_name"], F.lit("")), span["line_start"], m["code"]["code"], F.when(m["level"] == "error", "error").otherwise("warning"), m["message"], "cargo-clippy")


def golangci(reports: DataFrame) -> DataFrame:
    x = F.col("x")
    return _finding(_rows(reports, GOLANGCI, "Issues"), x["Pos"]["Filename"], x["Pos"]["Line"], x["FromLinter"], F.lit("warning"), x["Text"], "golangci-lint")


def dart(reports: DataFrame) -> DataFrame:
    x = F.col("x")
    return _finding(_rows(reports, DART, "diagnostics"), F.coalesce(x["location"]["file"], F.lit("")), x["location"]["range"]["start"]["line"], x["code"], F.lower(F.coalesce(x["severity"], F.lit("warning"))), x["problemMessage"], "dart-analyze")


ADAPTERS = {"ruff": ruff, "eslint": eslint, "cargo-clippy": clippy, "golangci-lint": golangci, "dart-analyze": dart}


def external(reports: DataFrame) -> DataFrame:
    """Findings in SARIF or generic reports (json). Levels note and none are info, unknown ones warning; of a result's
    locations the first counts. What has neither `runs` nor `issues` gives none."""
    level = lambda x: F.when(x.isin("error", "warning"), x).when(x.isin("note", "none"), "info").otherwise("warning")
    runs = reports.select(F.explode(F.from_json("json", SARIF)["runs"]).alias("r")).select(F.coalesce("r.tool.driver.name", F.lit("unknown")).alias("tool"), F.explode("r.results").alias("x"))
    place = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"]
    sarif = runs.select(place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"), F.col("x.ruleId").alias("rule"), level(F.col("x.level")).alias("severity"), F.coalesce("x.message.text", F.lit("")).alias("message"), F.col("tool").alias("source"))
    other = reports.where(F.get_json_object("json", "$.runs").isNull()).select(F.from_json("json", GENERIC).alias("g")).select("g.tool", F.explode("g.issues").alias("x"))
    kind = F.lower(F.coalesce("x.severity", F.lit("warning")))
    generic = other.select("x.file", "x.line", "x.rule", F.when(kind.isin("error", "warning", "info"), kind).otherwise("warning").alias("severity"), F.coalesce("x.message", F.lit("")).alias("message"), F.coalesce("x.tool", "tool", F.lit("external")).alias("source"))
    return sarif.unionByName(generic)


def _result() -> Column:
    level = F.when(F.col("severity") == "info", "note").when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise("warning")
    line = F.coalesce(F.nullif("line", F.lit(0).cast("long")), F.lit(1).cast("long"))
    place = F.struct(F.struct(F.coalesce("file", F.lit("")).alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region"))
    rule = F.coalesce(F.nullif("rule", F.lit("")), F.lit("unspecified"))
    return F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Each finding as a SARIF result: source, json. Unknown lines are 1, unknown rules `unspecified`, info is note."""
    return findings.select(F.coalesce("source", F.lit("unknown")).alias("source"), F.to_json(_result()).alias("json"))


def sarif_log(findings: DataFrame) -> DataFrame:
    """One SARIF log for each source, with its distinct rules and its results in order: source, json. A log is one
    document; for findings without bound, write sarif_results()."""
    rows = findings.select(F.coalesce("source", F.lit("unknown")).alias("source"), F.nullif("rule", F.lit("")).alias("id"), _result().alias("result"))
    logs = rows.groupBy("source").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_sort(F.collect_list("result")).alias("results"))
    driver = F.struct(F.col("source").alias("name"), F.transform("ids", lambda r: F.struct(r.alias("id"), r.alias("name"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))
    return logs.select("source", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))


def severities(findings: DataFrame) -> DataFrame:
    """errors, warnings, infos."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")])


def penalised(weight: int, penalty: Column) -> Column:
    return (F.lit(weight) - F.least(F.lit(weight).cast("long"), penalty.cast("long"))).cast("long")


def health(doctor: DataFrame, lint: DataFrame, functions: DataFrame, blocks: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """category, weight, score. doctor, lint, outside: findings (severity); functions: complexity; blocks: lines, occurrences.
    Each part is one row, summed where its rows are."""
    weights = WEIGHTS if outside is None else WEIGHTS_WITH_EXTERNAL
    e, w, i = F.col("errors"), F.col("warnings"), F.col("infos")
    row = lambda df, name, score: df.select(F.lit(name).alias("category"), F.lit(weights[name]).alias("weight"), score.cast("long").alias("score"))
    out = row(severities(doctor), "doctor", penalised(weights["doctor"], 6 * e + 3 * w + i))
    out = out.unionByName(row(severities(lint), "lint", penalised(weights["lint"], 2 * e + w)))
    flagged = functions.agg(F.count_if(F.col("complexity") >= COMPLEX).alias("flagged"), F.count("*").alias("n"))
    part = F.when(F.col("n") == 0, weights["complexity"]).otherwise(F.bround(weights["complexity"] * (1 - F.try_divide("flagged", "n")), 0))
    out = out.unionByName(row(flagged, "complexity", part))
    copied = blocks.agg(F.coalesce(F.sum(F.col("lines") * F.col("occurrences")), F.lit(0)).alias("copied"))
    out = out.unionByName(row(copied, "duplication", penalised(weights["duplication"], F.bround(weights["duplication"] * F.col("copied") / DUPLICATED, 0))))
    return out if outside is None else out.unionByName(row(severities(outside), "external", penalised(weights["external"], 4 * e + w)))


def compliance(hygiene: DataFrame, licences: DataFrame, deny: list[str], dead: DataFrame) -> DataFrame:
    """score, denied, unknown, dead. 100 less 12, 5 and 1 for errors, warnings and infos, 15 for a denied licence, 2 for an
    unknown one (ten at most), 1 for dead code (20 at most); 0 to 100. licences: licence; dead: one row each."""
    low = F.lower("licence")
    counted = licences.agg(F.count_if(low.isin([d.lower() for d in deny]) if deny else F.lit(False)).alias("denied"), F.count_if((F.col("licence") == "unknown") & (~low.isin([d.lower() for d in deny]) if deny else F.lit(True))).alias("unknown"))
    # Three one-row sums side by side.
    parts = severities(hygiene).withColumn("k", F.lit(1)).join(counted.withColumn("k", F.lit(1)), "k").join(dead.agg(F.count("*").alias("dead")).withColumn("k", F.lit(1)), "k")
    score = 100 - 12 * F.col("errors") - 5 * F.col("warnings") - F.col("infos") - 15 * F.col("denied") - 2 * F.least("unknown", F.lit(10)) - F.least("dead", F.lit(20))
    return parts.select(F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"), "denied", "unknown", "dead")

import duckdb
from pyspark.sql import functions as F

from corpusmill.llm import url_filters as U
from corpusmill.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA

CASES = {
    "http://Www.Example.COM/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "https://a.example.com/En/": ("a.example.com", "/En/", "com/", "allow"),
    "ftp://x.net/es/1#t": ("x.net", "/es/1", "net/es/", "block"),
    "x://netx/es/": ("netx", "/es/", None, None),
    "http://com": ("com", "", None, None),
    "http://b.com?q=/": ("b.com", "", None, None),
    "no scheme.com/en/": ("", "", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
    "http://x.org/a\nb?c": ("x.org", "/a\nb", None, None),
}


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*CASES, None, None])], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in U.filter_urls(pages).collect()}
    assert len(rows) == len(CASES) + 2 and all(r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1 for r in rows.values())
    for i, (_, want) in enumerate(CASES.items()):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == want[:3] and (want[3] is None or r["verdict"] == want[3])
    assert (rows[len(CASES)]["host"], rows[len(CASES)]["path"]) == ("", "")
    assert U.filter_urls(pages.where("false")).collect() == []


def test_reputation_shrinks_from_host_to_suffix(spark):
    rows = [(f"h{k}.bad.org", 50, 1) for k in range(20)] + [(f"h{k}.fine.org", 50, 49) for k in range(20)] + [("new.bad.org", 0, 0), ("new.fine.org", 0, 0), ("new.other.org", 0, 0), ("rare.bad.org", 1, 1)]
    got = {r["host"]: r for r in U.reputation(spark.createDataFrame(rows, "host string, n long, good long")).collect()}
    assert got["new.bad.org"]["mean"] < 0.1 < got["new.other.org"]["mean"] < 0.9 < got["new.fine.org"]["mean"]
    assert got["new.bad.org"]["mean"] < got["rare.bad.org"]["mean"] < 0.9
    assert got["new.other.org"]["deviation"] > got["h0.bad.org"]["deviation"]


def test_query_and_sql_agree(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    sql = con.sql(ORACLE_SQL["op3_url_filters"])
    df = QUERIES["op3_url_filters"](spark, str(DATA)).withColumn("score", F.round("score", 6))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(sql.columns) == sorted(df.columns)
    at = [sql.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[k] for k in at]) for r in sql.fetchall())


def test_plan_is_native(spark):
    plan = QUERIES["op3_url_filters"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "html" not in plan


def test_hot_hosts_are_not_joined(spark):
    pages = spark.createDataFrame([(k, f"http://{'hot.de' if k % 3 else f'h{k}.co.uk'}/{'x' * (k % 2)}") for k in range(900)] + [(None, None)], "page_id long, url string")
    rows = U.filter_urls(pages).collect()
    assert len(rows) == 901 and all(r["score"] is not None for r in rows)
    levels = {r["host"]: (r["domain"], r["suffix"]) for r in U.with_levels(spark.createDataFrame([("a.b.co.uk",), ("a.b.de",), ("co.uk",), ("",)], "host string")).collect()}
    assert levels == {"a.b.co.uk": ("b.co.uk", "co.uk"), "a.b.de": ("b.de", "de"), "co.uk": ("co.uk", "co.uk"), "": ("", "")}

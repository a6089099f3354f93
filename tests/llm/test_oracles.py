import duckdb
import pytest

from corpusmill.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op7_decontamination", "op8_chat_format", "op11_spelling_variants", "op12_substring_dedup", "op13_importance"])
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, sql = QUERIES[name](spark, str(DATA)), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    at = [sql.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[k] for k in at]) for r in sql.fetchall())


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]

"""The companions of operators that SQL can express in part, against DuckDB."""

import duckdb
import pytest

from corpusloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["secret_counts", "url_rules", "shard_places", "license_phrases"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    answer = con.execute(oracle_sql()[name])
    columns = sorted(df.columns)
    theirs = [d[0] for d in answer.description]
    assert sorted(theirs) == columns
    want = sorted(([r[theirs.index(c)] for c in columns] for r in answer.fetchall()), key=str)
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=str) == want and want

"""Redaction of every planted form over all documents, against its SQL."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def test_all_documents_are_redacted_and_checked(spark):
    if "residual_shapes" not in queries():
        pytest.fail("no query looks at all documents")
    got = sorted(map(tuple, queries()["residual_shapes"](spark, DATA).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    n, ya29 = con.execute("SELECT count(*), count(*) FILTER (doc_id % 7 = 6) FROM documents").fetchone()
    assert got == sorted(con.execute(oracle_sql()["residual_shapes"]).fetchall()) and len(got) == n and ya29

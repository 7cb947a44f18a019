"""Queries of the text operators against their SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(SQL[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = QUERIES[name](spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and got.equals(want[got.columns].astype(got.dtypes.to_dict()))

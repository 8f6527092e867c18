"""The queries that SQL can express against DuckDB, on the smallest tables and on odd rows."""

import duckdb
import pytest

from geolode.llm import registry

SQL = registry.oracle_sql()


def held(spark, folder, files, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    want = con.sql(SQL[name])
    got = registry.queries()[name](spark, folder)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.fillna(-1).collect()) == sorted(tuple(-1 if r[i] is None else r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_on_the_smallest_tables(spark, name):
    held(spark, "/root/testdata/sf0.001", "/root/testdata/sf0.001/documents.parquet", name)


@pytest.mark.parametrize("name", sorted(SQL))
def test_on_odd_rows(spark, unique, as_tables, name):
    own = [(1000, "All rights reserved. CC-BY; cc by all rights reserved", "en", None, None), (1001, "This work is licensed under the GNU General Public License, version 3.", "en", None, None)]
    own += [(1002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files", "en", None, None)]
    folder = as_tables(unique + own)
    held(spark, folder, f"{folder}/documents.parquet/*.parquet", name)

"""A query against its DuckDB SQL: equal rows, whatever their order."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 5) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


def assert_twin(spark, sf, query, sql):
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = connect(sf).execute(sql)
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, res.fetchall())
    assert len(got) == len(want)
    assert [x for x in zip(got, want) if x[0] != x[1]] == []

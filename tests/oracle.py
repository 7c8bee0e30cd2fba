"""Compares a query with its SQL on one folder of tables, column by column."""
import os

import duckdb

DATA = "/root/testdata/sf0.01"


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([repr(float(r[i])) if isinstance(r[i], float) else repr(r[i]) for i in order] for r in records))


def compare(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    df = query(spark, data)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want)
    assert rows(df.columns, got) == rows(names, want)

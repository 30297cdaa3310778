"""A query's rows against its DuckDB SQL's."""

import os

import duckdb


def rows(frame, cols):
    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return v.item() if hasattr(v, "item") else tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v

    return sorted(repr(tuple(map(plain, r))) for r in frame[cols].itertuples(index=False))


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    want = con.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)

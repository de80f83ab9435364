"""Compare a query with its SQL: same columns, same rows in any order."""

import math
import os

import duckdb


def _norm(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)

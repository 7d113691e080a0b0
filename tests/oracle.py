"""Compares a query with its SQL on DuckDB, row by row and without order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame = frame.assign(**{c: frame[c].round(6) + 0.0})
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))


def same(spark, sf, query, sql):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = query(spark, sf).toPandas(), connection.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got) == rows(want)

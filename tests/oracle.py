"""A query and its SQL side by side, as the driver compares them."""

import decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return round(value, 9)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf_dir):
    got = query(spark, sf_dir)
    db = connect(sf_dir)
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    left, right = normal(got.columns, [tuple(r) for r in got.collect()]), normal(names, want.fetchall())
    assert left[0] == right[0], (name, left[0], right[0])
    assert len(left[1]) == len(right[1]), (name, len(left[1]), len(right[1]))
    for a, b in zip(left[1], right[1], strict=True):
        assert a == b, (name, left[0], a, b)

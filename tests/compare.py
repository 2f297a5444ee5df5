"""Compare a Spark result with the SQL result of the same name: columns, row count, values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _sorted(rows, order):
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def differences(frame, connection, sql: str) -> str | None:
    """None when both results agree, else a short description."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = result.fetchall()
    got = [tuple(row) for row in frame.collect()]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    left = _sorted(got, [frame.columns.index(name) for name in sorted(names)])
    right = _sorted(expected, [names.index(name) for name in sorted(names)])
    for mine, theirs in zip(left, right):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            wrong = sum(a != b for a, b in zip(left, right))
            return f"{wrong} rows differ in {sorted(names)}, first {str(mine)[:300]} != {str(theirs)[:300]}"
    return None

"""Run one query and its DuckDB SQL on the same tables and compare them as the driver does: columns by name, rows as a bag."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf, **tables):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    ours = query(spark, sf)
    names, left = _bag(ours.columns, [tuple(r) for r in ours.collect()])
    cursor = con.execute(sql)
    theirs, right = _bag([d[0] for d in cursor.description], cursor.fetchall())
    assert names == theirs
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])
    return sum(left.values())

"""Rows of a query and of its SQL in a form that can be compared."""

from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "isoformat") or type(v).__name__ == "Decimal":
        return str(v)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(r[k]) for k in order]) for r in values)


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def agree(spark, folder, query, sql):
    df = query(spark, folder)
    con = connect(folder)
    con.execute(sql)
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, con.fetchall())

"""Running an oracle in DuckDB and comparing rows."""

from decimal import Decimal
from glob import glob
from pathlib import Path

import duckdb


def cell(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, Decimal):
        return str(x.normalize() + 0) if x else "0"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def same_rows(df, sql, folder):
    """Asserts that a DataFrame has the columns and rows of a DuckDB query over a folder's tables."""
    con = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in found.fetchall())
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    assert got == want

"""Rows of queries and of SQL, in an order that can be compared."""

from pathlib import Path

SF = "/root/testdata/sf0.001"


def duck(sql, sf_dir=SF):
    """Rows of ``sql`` over the tables, columns by name."""
    import duckdb

    c = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    cur = c.execute(f"select * from ({sql})")
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r)) for r in df.select(*names).collect())

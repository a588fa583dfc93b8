"""Runs a query and its SQL over the same tables and compares the rows as multisets."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")


def connect(sf: str):
    con = duckdb.connect()
    for p in sorted((DATA / sf).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    norm = lambda v: None if v is None else float(v) if hasattr(v, "__float__") else str(v)
    return sorted((tuple(norm(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


def compare(spark, con, query, sql: str, sf: str) -> str:
    """Empty if equal, else what differs."""
    got, want = query(spark, str(DATA / sf)).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only here {only_a}; only in SQL {only_b}"

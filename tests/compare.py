"""Compare registered queries with their SQL on DuckDB. Usage: python tests/compare.py FOLDER [query ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) or hasattr(value, "dtype") and value.dtype.kind == "f":
        return round(float(value), 6) + 0.0
    if hasattr(value, "item"):
        return value.item()
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    values = [tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(values, key=repr)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """Says how two results differ, or None if they hold the same rows."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = rows_of(left), rows_of(right)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    import __spark_entry__ as entry
    from tests.session import make_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            start = time.time()
            frame = run(spark, folder)
            got = frame.toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name:28} {len(got):8} {took:6.2f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            problem = difference(got, want)
            types = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in got.columns
                     if c in want.columns and str(got[c].dtype) != str(want[c].dtype)]
        except Exception as error:  # noqa: BLE001
            problem, types, took, got = f"{type(error).__name__}: {str(error)[:1500]}", [], 0, []
            if len(names) == 1:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok' if problem is None else 'BAD':5} {name:28} {len(got):8} {took:6.2f}s {problem or ''} {types or ''}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))

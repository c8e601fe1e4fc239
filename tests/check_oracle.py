"""Run registered queries against their SQL on one data folder.

    python tests/check_oracle.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def sql_rows(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con.execute(sql).fetchdf()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple("" if v is None or v is pd.NA or v != v else _text(v) for v in row))
    return sorted(rows)


def _text(value) -> str:
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    if hasattr(value, "date") and callable(value.date):
        return str(value.date())
    return str(value)


def difference(spark_rows: pd.DataFrame, oracle_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(oracle_rows.columns):
        return f"columns {sorted(spark_rows.columns)} vs {sorted(oracle_rows.columns)}"
    # whole numbers with nulls are doubles on one side
    floats = [c for c in spark_rows if (spark_rows[c].dtype == "float64") != (oracle_rows[c].dtype == "float64")]
    floats = {c: "float64" for c in floats if pd.api.types.is_numeric_dtype(oracle_rows[c]) and pd.api.types.is_numeric_dtype(spark_rows[c])}
    a, b = canonical(spark_rows.astype(floats)), canonical(oracle_rows.astype({c: "Float64" for c in floats}))
    if a == b:
        return None
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} vs {len(b)}; only spark {only_a}; only sql {only_b}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark = make_session()
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            rows = queries()[name](spark, folder).toPandas()
            took = time.time() - start
            sql = oracle_sql().get(name)
            problem = difference(rows, sql_rows(folder, sql)) if sql else None
            verdict = problem or ("same" if sql else "no SQL")
        except Exception as error:  # report and go on with the next query
            rows, took, verdict = [], time.time() - start, f"FAILED {str(error)[:600]}"
            problem = verdict
        bad += problem is not None
        print(f"{name:26s} {len(rows):8d} rows {took:7.2f}s  {verdict}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()

"""Runs queries beside their SQL in DuckDB: python tests/compare.py FOLDER [QUERY...]"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def views(folder: str):  # noqa: ANN201
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_float_dtype(out[c]):
            out[c] = out[c].map(lambda v: "null" if pd.isna(v) else repr(float(v)))
        elif pd.api.types.is_bool_dtype(out[c]) or pd.api.types.is_integer_dtype(out[c]):
            out[c] = out[c].map(lambda v: repr(v.item() if hasattr(v, "item") else v))
        else:
            out[c] = out[c].map(lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else str(v)[:10] if hasattr(v, "year") else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """What differs, or nothing."""
    a, b = normal(spark_df), normal(sql_df)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    wrong = (a != b).any(axis=1)
    return f"{int(wrong.sum())} of {len(a)} rows, as {a[wrong].head(2).to_dict('records')} and {b[wrong].head(2).to_dict('records')}" if wrong.any() else ""


def main(folder: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    cores = os.environ.get("COMPARE_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con, bad = e.queries(), e.oracle_sql(), views(folder), 0
    for n in names or [q for q in queries if q in sql]:
        t = time.time()
        try:
            got = queries[n](spark, folder).toPandas()
            why = difference(got, con.execute(sql[n]).df()) if n in sql else "no SQL" if n not in sql else ""
        except Exception as x:  # noqa: BLE001
            got, why = [], f"ERROR {str(x)[:1500]}"
        bad += bool(why) and why != "no SQL"
        print(f"{n}: {'same' if not why else why} ({len(got)} rows, {time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

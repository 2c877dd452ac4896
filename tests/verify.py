"""Runs queries beside their SQL: ``python tests/verify.py SF_DIR [NAME...]``."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as E  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(v) if v is not None else None)
    return df.sort_values(list(df.columns), ignore_index=True)


def main(sf: str, names: list[str]) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    sql = E.oracle_sql()
    for name, f in E.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            got = f(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print("ERROR", name, str(e)[:400])
            continue
        took = time.time() - t
        if name not in sql:
            print(f"rows  {name} {len(got)} {took:.1f}s\n{got.head(3).to_string() if names else ''}")
            continue
        try:
            want = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print("SQL ERROR", name, str(e)[:800])
            continue
        if sorted(got.columns) != sorted(want.columns):
            print("COLUMNS", name, sorted(got.columns), sorted(want.columns))
            continue
        a, b = canon(got), canon(want)
        try:
            pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-6)
            kinds = [f"{c}: {a[c].dtype}/{b[c].dtype}" for c in a if a[c].dtype != b[c].dtype]
            print(f"same  {name} {len(a)} {took:.1f}s {kinds or ''}")
        except AssertionError as e:
            print("DIFF ", name, len(a), len(b), str(e)[:600], "\n", a.head(4).to_string(), "\n", b.head(4).to_string())


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

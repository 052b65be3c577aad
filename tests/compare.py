"""Runs queries beside their SQL: python tests/compare.py FOLDER [NAME...]."""

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, query, sql: str) -> str:
    """Empty when both sides give the same rows."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    return f"rows {sum(got.values())} and {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config(map={
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    }).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(folder)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in oracles:
                said = compare(spark, con, folder, name, query, oracles[name]) or "same"
            else:
                said = f"{query(spark, folder).count()} rows, no SQL"
        except Exception as e:
            said = f"ERROR {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)

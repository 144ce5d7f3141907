"""Runs queries beside their SQL: python tests/oracle_check.py [folder] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(folder) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con, folder, name, query, sql):
    """None if rows and columns are equal, else what differs."""
    df = query(spark, folder)
    own = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    other = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} and {rel.columns}"
    if own != other:
        bad = [(a, b) for a, b in zip(own, other, strict=False) if a != b]
        return f"{len(own)} and {len(other)} rows; first difference {bad[:2]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, s = connect(folder), entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(s)
    bad = 0
    for n in names:
        t = time.time()
        try:
            said = compare(spark, con, folder, n, q[n], s[n]) if n in s else f"rows {q[n](spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        if said:
            bad += n in s
            print(n, said, flush=True)
    print(len(names), "queries,", bad, "differ")

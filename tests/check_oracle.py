"""Compare every registered query with its SQL: python tests/check_oracle.py SF_DIR [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as e  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def key(row):
    return tuple((x is None, str(type(x)), x) if not isinstance(x, float) else (False, "f", round(x, 6)) for x in row)


def compare(spark, con, name, sf):
    df = e.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}"
    want_df = con.sql(sql)
    if sorted(want_df.columns) != cols:
        return f"BAD columns {cols} / {sorted(want_df.columns)}"
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + " FROM want_df").fetchall()
    if len(got) != len(want):
        return f"BAD rows {len(got)} / {len(want)}"
    diff = 0
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for x, y in zip(a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9))
            if not same or type(x) is not type(y):
                diff += 1
                if diff <= 2:
                    print("   ", a, b)
                break
    return f"BAD values {diff} of {len(got)}" if diff else f"ok {len(got)}"


def main(sf, names):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in names or e.queries():
        t0 = time.time()
        try:
            result = compare(spark, con, name, sf)
        except Exception as err:  # noqa: BLE001
            result = "BAD " + str(err)[:400].replace("\n", " ")
        print(f"{name:26s} {time.time() - t0:6.1f}s {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

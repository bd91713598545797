"""Compare registered queries with their SQL twins: python tests/check_sql.py [sf] [name ...]"""

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from fluoroframe.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canon(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return 0.0 if v == 0 else v
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return tuple(cell(x) for x in v)
        return v

    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


def check(spark, con, name, sf_dir):
    t = time.time()
    got = entry.queries()[name](spark, sf_dir)
    got = got.toPandas()
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got)}", took
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(set(got.columns) ^ set(want.columns))}", took
    a, b = canon(got), canon(want)
    if a == b:
        return f"ok {len(a)}", took
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"DIFF {len(a)} {len(b)} {diff}", took


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for tb in TABLES:
        con.sql(f"CREATE VIEW {tb} AS SELECT * FROM '{sf_dir}/{tb}.parquet'")
    names = sys.argv[2:] or list(entry.queries())
    for n in names:
        try:
            res, took = check(spark, con, n, sf_dir)
        except Exception as err:  # report and go on
            res, took = "ERROR " + str(err).replace("\n", " ")[:400], 0.0
        print(f"{n:32s} {took:6.1f}s {res[:500]}", flush=True)

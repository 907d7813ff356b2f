"""Run queries against their SQL twins: ``python tests/compare.py SF_DIR [name ...]``."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or (isinstance(x, float) and pd.isna(x)):
            return "NULL"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float):
            return repr(round(x, 9) + 0.0)
        return str(x)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql):
    """None if both give the same columns and rows, else a short description."""
    start = time.time()
    got = canonical([tuple(r) for r in spark_df.collect()], spark_df.columns)
    print(f"  spark run {time.time() - start:.1f}s", end=" ")
    cursor = con.execute(sql)
    want = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    extra = sorted(set(got[1]) - set(want[1]))[:2]
    lacking = sorted(set(want[1]) - set(got[1]))[:2]
    return f"{len(got[1])} rows vs {len(want[1])}; columns {got[0]}; only spark {extra}; only sql {lacking}"


if __name__ == "__main__":
    import __spark_entry__ as driver
    from rosterwise.session import build_session

    spark = build_session(
        master="local[8]", shuffle_partitions=8, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, oracle = connect(folder), driver.oracle_sql()
    for name, query in driver.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            verdict = differences(df, con, oracle[name]) if name in oracle else f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {str(error)[:1500]}"
        print(f"{name}: {verdict or 'ok'} ({time.time() - start:.1f}s)", flush=True)

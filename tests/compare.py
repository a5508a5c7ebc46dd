"""Run registered queries and their SQL side by side. Usage: compare.py [sf] [name prefix ...]"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = sorted(columns)
    return named, sorted(tuple(str(_value(row[i])) for i in order) for row in rows)


def compare(spark_df, connection, sql: str) -> tuple[bool, str]:
    ours = _rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    result = connection.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        left, right = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
        return False, f"{len(ours[1])} rows vs {len(theirs[1])}; spark only {sorted(left)[:3]}; sql only {sorted(right)[:3]}"
    return True, f"{len(ours[1])} rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from threatloom.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    chosen = tuple(sys.argv[2:]) or ("",)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracle = tables(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if name.startswith(chosen):
            began = time.time()
            try:
                ok, note = compare(query(spark, sf_dir), connection, oracle[name])
            except Exception as error:  # report and go on with the next query
                ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
            print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {time.time() - began:6.2f}s {note}", flush=True)

"""Runs registered queries and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from accesslake.sources.tables import SCHEMAS


def connect(folder: str):
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def cell(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("float", repr(value))
    if isinstance(value, int):
        return ("int", value)
    return (type(value).__name__, str(value))


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    order = sorted(range(len(result.description)), key=lambda i: result.description[i][0])
    names = [result.description[i][0] for i in order]
    return names, sorted(tuple(cell(r[i]) for i in order) for r in result.fetchall())


def main(folder: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from accesslake.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    sqls = oracle_sql()
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            names, rows = spark_rows(build(spark, folder))
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(error)[:600]}")
            continue
        took = time.time() - started
        if name not in sqls:
            print(f"rows {name}: {len(rows)} rows, {took:.2f}s")
            continue
        try:
            other_names, other = sql_rows(con, sqls[name])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} (sql): {str(error)[:600]}")
            continue
        if names != other_names or rows != other:
            bad += 1
            print(f"DIFF {name}: {names} vs {other_names}; {len(rows)} vs {len(other)} rows")
            left, right = [r for r in rows if r not in set(other)][:3], [r for r in other if r not in set(rows)][:3]
            print("   spark", left, "\n   sql  ", right)
        else:
            print(f"ok   {name}: {len(rows)} rows, {took:.2f}s")
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

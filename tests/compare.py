"""Run registered queries beside their SQL twins and compare whole results.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows", len(got), ""
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return "COLUMNS", len(got), f"{got_cols} vs {want_cols}"
    if got != want:
        only_got = [r for r in got if r not in want][:3]
        only_want = [r for r in want if r not in got][:3]
        return "VALUES", len(got), f"{len(got)} vs {len(want)} {got_cols}\n    spark {only_got}\n    sql   {only_want}"
    sql_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    odd = [(c, s, sql_types[c]) for c, s in df.dtypes if TYPES.get(s, s) != sql_types[c]]
    return "ok", len(got), (f"types {odd}" if odd else "") + ("" if got else " EMPTY")


def main(argv):
    from pagerisk.plans import oracle_sql, queries
    from pagerisk.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark = build_session("compare", f"local[{os.environ.get('TEST_CORES', 8)}]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            status, n, note = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as e:  # report and go on to the next query
            status, n, note = "ERROR", -1, str(e)[:300].replace("\n", " ") + " ... " + str(e).strip()[-300:].replace("\n", " ")
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:40} rows={n:<7} {time.time() - start:5.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

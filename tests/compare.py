"""Run registered queries next to their check SQL in DuckDB and compare the rows.

    python tests/compare.py /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import decimal
import json
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in sorted(value.items())}
    if isinstance(value, bool) or value is None:
        return value
    return str(value) if not isinstance(value, int) else repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [json.dumps([plain(r[i]) for i in order], default=str) for r in rows]
    return [columns[i] for i in order], sorted(out)


def compare(spark, con, sf_dir, fn, sql):
    """Return (ok, message)."""
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows only: {len(mine[1])}"
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} != {theirs[0]}"
    if mine[1] != theirs[1]:
        a = sorted(set(mine[1]) - set(theirs[1]))[:3]
        b = sorted(set(theirs[1]) - set(mine[1]))[:3]
        return False, f"rows {len(mine[1])} vs {len(theirs[1])}\n   spark {str(a)[:900]}\n   sql   {str(b)[:900]}"
    return True, f"match: {len(mine[1])}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from assayline.session import local_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as exc:  # report and go on with the next query
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())

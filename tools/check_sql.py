"""Run registered queries and their SQL side by side and compare the results.

usage: python tools/check_sql.py FOLDER [NAME ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gapspark.plans.registry import load_all  # noqa: E402
from gapspark.session import build_session  # noqa: E402

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, folder: str) -> tuple[bool, str]:
    began = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - began
    note = f"{len(got)} rows, {spent:.1f} s"
    if query.sql is None:
        return bool(got), note + ", no SQL"
    began = time.time()
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    note += f", SQL {time.time() - began:.1f} s"
    if sorted(df.columns) != sorted(names):
        return False, f"{note}; columns {sorted(df.columns)} / {sorted(names)}"
    wrong = [
        f"{n}: {t} / {kinds[n]}" for n, t in df.dtypes if TYPES.get(t, t.upper()) != kinds[n]
    ]
    mine, theirs = rows_of(df.columns, got), rows_of(names, want)
    if mine != theirs:
        extra = sorted(set(mine) - set(theirs))[:3]
        missing = sorted(set(theirs) - set(mine))[:3]
        return False, f"{note}; {len(want)} in SQL; only Spark {extra}; only SQL {missing}; {wrong}"
    return not wrong, note + (f"; types {wrong}" if wrong else "")


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
         "spark.checkpoint.dir": tempfile.mkdtemp(prefix="gapspark-"),
         "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name, query in load_all().items():
        if wanted and name not in wanted:
            continue
        try:
            good, note = compare(spark, con, query, folder)
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print(("ok   " if good else "FAIL ") + name + ": " + note, flush=True)
        if not good:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())

"""Run queries beside their SQL in DuckDB and compare: ``python -m checks.compare sf_dir [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback
from collections import Counter

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from offerlake.session import local_session

TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(12,2)": "DECIMAL(12,2)",
}


def expected(sf_dir: str, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    return columns, types, cursor.fetchall()


def by_name(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(spark, sf_dir: str, name: str) -> str:
    frame = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    if name not in ORACLE:
        return f"rows only ({len(rows)})"
    columns, types, wanted = expected(sf_dir, ORACLE[name])
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    sql_types = dict(zip(columns, types))
    wrong = {
        c: (t, sql_types[c]) for c, t in frame.dtypes if TYPE_NAMES.get(t) != sql_types[c]
    }
    got, want = by_name(frame.columns, rows), by_name(columns, wanted)
    if got != want:
        extra, lacking = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"{len(rows)} rows against {len(wanted)}; only Spark {extra}; only SQL {lacking}"
    return f"types {wrong}" if wrong else ""


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, sf_dir, name)
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += bool(problem) and not problem.startswith("rows only")
        print(f"{name:24s} {time.time() - start:6.2f}s {problem[:1800] or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())

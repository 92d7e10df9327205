"""Run queries beside their SQL on the same parquet files and compare names, types and the multiset of rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _rows(rows, order) -> Counter:
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        return v

    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    theirs = result.fetchall()
    ours = spark_df.collect()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    mine = {n: TYPES.get(t, t) for n, t in spark_df.dtypes}
    wrong = {n: (mine[n], t) for n, t in zip(names, types) if mine[n] != t}
    if wrong:
        return f"types {wrong}"
    ordered = sorted(names)
    a = _rows(ours, [spark_df.columns.index(n) for n in ordered])
    b = _rows(theirs, [names.index(n) for n in ordered])
    if a != b:
        return f"rows {sum(a.values())} against {sum(b.values())}; only ours {list((a - b))[:2]}; only theirs {list((b - a))[:2]}"
    return None


def main(names: list[str], sf: str = "/root/testdata/sf0.01") -> int:
    import workload
    from adwatch.session import local_session

    workload.load_all()
    spark, con, failed = local_session(8), connect(sf), 0
    for name in names or list(workload.QUERIES):
        started = time.time()
        try:
            df = workload.QUERIES[name](spark, sf)
            note = difference(df, con, workload.SQL[name]) if name in workload.SQL else f"no SQL, {df.count()} rows"
            state = "ok" if note is None else ("--" if name not in workload.SQL else "BAD")
        except Exception as error:  # one broken query must not hide the others
            state, note = "ERR", f"{type(error).__name__}: {str(error)[:600]}"
        failed += state in ("BAD", "ERR")
        print(f"{state:4} {name:28} {time.time() - started:6.2f}s {note or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if arguments and arguments[0].startswith("/"):
        folder = arguments.pop(0)
    sys.exit(1 if main(arguments, folder) else 0)

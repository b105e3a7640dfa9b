"""Compare catalogue queries with DuckDB: ``python tests/compare.py [sf] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def difference(df, sql, con) -> str | None:
    """What differs, or None if names, types' families and every value agree."""
    left_names, left = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    right_names, right = rows_of([c[0] for c in cur.description], cur.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)}/{len(left)} rows differ: {bad[:2]}"
    return None


def main(argv):
    import __spark_entry__ as e
    from stayloom.session import get_session

    sf = argv[0] if argv else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    queries, oracle = e.queries(), e.oracle_sql()
    names = argv[1:] or list(queries)
    failed = []
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                problem = difference(df, oracle[name], con)
            else:
                problem = None if df.collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - t:6.2f}s {name} "
              f"{'' if name in oracle else '(rows only) '}{problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])

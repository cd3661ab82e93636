"""Run registered queries and their check SQL side by side.

``python tests/agreement.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from scholia.tables import BASE_TABLES

DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def compare(spark, con, sf_dir, run, sql):
    """Returns (ok, message)."""
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"rows only, {len(rows)} rows"
    relation = con.sql(sql)
    columns, types = list(relation.columns), [str(t) for t in relation.types]
    expected = relation.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} <> {sorted(columns)}"
    kinds = {c: DUCK_TYPES.get(t, t) for c, t in zip(columns, types)}
    wrong = {c: (t, kinds[c]) for c, t in df.dtypes if kinds[c] != t and kinds[c].islower()}
    wrong.update({c: (t, kinds[c]) for c, t in df.dtypes if not kinds[c].islower()})
    if wrong:
        return False, f"types {wrong}"
    got, want = _sorted(df.columns, rows), _sorted(columns, expected)
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} rows <> {len(want)} rows; got {only_got} want {only_want}"
    return True, f"{len(got)} rows"


def main(argv):
    from scholia.queries import all_queries, all_sql
    from scholia.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark, con = local_session(), connect(sf_dir)
    runs, sqls = all_queries(), all_sql()
    bad = []
    for name, run in runs.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as error:  # a report line per query, failures included
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])

"""Compare registered queries with their SQL counterparts run by DuckDB.

python tests/check.py [name-substring ...] [--sf 0.01]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return "dec" + str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value)


def compare(spark, con, sf_dir, name, fn, sql):
    """Empty string when equal, else the first differences."""
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    ours = [tuple(plain(v) for v in row) for row in df.select(*columns).collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = [tuple(plain(row[i]) for i in order) for row in res.fetchall()]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    if not ours:
        return "both empty"
    left, right = sorted(ours, key=repr), sorted(theirs, key=repr)
    if left == right:
        return ""
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    diff = [(c, x, y) for a, b in bad[:3] for c, x, y in zip(columns, a, b) if x != y]
    return f"{len(bad)} of {len(left)} rows differ: {diff[:6]}"


def main(argv):
    from tidemark.session import build_session
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(8)
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        began = time.time()
        try:
            if name in oracle:
                why = compare(spark, con, sf_dir, name, fn, oracle[name])
            else:
                rows = fn(spark, sf_dir).count()
                why = "" if rows else "no rows"
        except Exception as error:  # report and go on
            why = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - began
        print(("ok  " if not why else "BAD ") + f"{name} {took:.1f}s {'(rows only) ' if name not in oracle else ''}{why}", flush=True)
        if why:
            failed.append(name)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])

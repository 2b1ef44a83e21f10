"""Run registered queries next to their SQL: ``python tests/compare.py [-s sf] [-l] [name or module ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
    "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return "decimal:" + str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, q, sf_dir: str, seen=lambda df: None) -> str | None:
    """None when columns, types and values agree, else what differs; ``seen`` gets the frame that ran."""
    df = q.run(spark, sf_dir)
    seen(df)
    got = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return None if got else "no rows"
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    wrong = [(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema.fields
             if KINDS.get(f.dataType.simpleString()) != types[f.name]]
    if wrong:
        return f"types {wrong}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if not a:
        return "no rows"
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"{len(a)} rows vs {len(b)}; columns {sorted(cols)}\n   spark only {only_a}\n   sql only   {only_b}"
    return None


def main(args: list[str]) -> int:
    from panelcast.queries import QUERIES
    from panelcast.session import local_session

    sf = "0.01"
    if "-s" in args:
        i = args.index("-s")
        sf = args[i + 1]
        del args[i : i + 2]
    names = [n for n, q in QUERIES.items()
             if not args or n in args or q.run.__module__.rsplit(".", 1)[-1] in args]
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            d = difference(spark, con, QUERIES[n], sf_dir)
        except Exception as e:  # report and go on with the next query
            d = f"{type(e).__name__}: {str(e)[:700]}"
        bad += d is not None
        kind = "" if QUERIES[n].sql else " (no sql)"
        print(f"{'ok ' if d is None else 'BAD'} {n}{kind} {time.time() - t0:.1f}s {d or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

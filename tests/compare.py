"""Run registered queries in Spark and their SQL in the checking engine."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from stmtwarden.views import BASE_TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return "dec:" + str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_value(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def check(spark, con, build, sql, sf_dir):
    """None if equal, else what differs."""
    df = build(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a == b:
        return None if a else "EMPTY"
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"{len(a)} rows vs {len(b)}; cols {sorted(got_cols)}; only spark {only_a}; only sql {only_b}"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from tests.conftest import make_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pat = argv[2] if len(argv) > 2 else ""
    spark, con = make_session(), connect(sf)
    oracles, bad = e.oracle_sql(), 0
    for key, build in e.queries().items():
        if pat and not any(key.startswith(p) for p in pat.split(",")):
            continue
        t0 = time.time()
        try:
            if key in oracles:
                why = check(spark, con, build, oracles[key], sf)
            else:
                n = build(spark, sf).count()
                why = None if n else "EMPTY"
        except Exception as ex:  # report and go on
            why = f"{type(ex).__name__}: {str(ex)[:600]}"
        if why:
            bad += 1
        print(f"{'ok ' if not why else 'BAD'} {key} {time.time() - t0:.2f}s {'' if key in oracles else '(rows only)'} {why or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv)

"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, job, sql: str, folder: str):
    """Error text, or None when rows and column names agree."""
    df = job(spark, folder)
    ours = df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    kinds_a = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds_b = {d[0]: str(d[1]).lower() for d in found.description}
    alias = {"string": "varchar", "int": "integer"}
    odd = {n: (k, kinds_b[n]) for n, k in kinds_a.items() if alias.get(k, k) != kinds_b[n]}
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)}/{len(b)} only ours {sorted(sa - sb)[:2]} only theirs {sorted(sb - sa)[:2]} {sorted(names)}"
    return f"types {odd}" if odd else None


def main(folder: str, wanted: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from eventwarden.session import build_session

    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(folder), entry.oracle_sql(), 0
    for name, job in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                error = compare(spark, con, job, oracles[name], folder)
                kind = "same"
            else:
                rows = job(spark, folder).count()
                error, kind = None, f"{rows} rows, no SQL"
        except Exception as problem:
            error = f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += error is not None
        print(f"{'FAIL' if error else 'ok  '} {name} {time.time() - start:.1f}s {error or kind}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

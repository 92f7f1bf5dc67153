"""Compare registered queries with their SQL: python tests/oracle_check.py [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(repr(value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v) for v in r)
    )


def differences(spark, con, run, sql, folder):
    """None when equal, else a short description."""
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    kinds = lambda rows: [{type(r[i]).__name__ for r in rows} - {"NoneType"} for i in range(len(got[0]))]
    if got[1] and kinds(got[1]) != kinds(want[1]):
        return f"types {kinds(got[1])} vs {kinds(want[1])}"
    if got[1] != want[1]:
        have, wanted = set(got[1]), set(want[1])
        extra = [r for r in got[1] if r not in wanted][:3]
        missing = [r for r in want[1] if r not in have][:3]
        return f"rows {len(got[1])} vs {len(want[1])}; only spark {str(extra)[:900]}; only sql {str(missing)[:900]}"
    return None if got[1] else "no rows"


def main() -> int:
    from corpusframe.plans import catalog
    from corpusframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(catalog.QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session("oracle-check", 8), connect(folder)
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in catalog.ORACLES:
                outcome = differences(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], folder)
            else:
                outcome = f"rows only: {catalog.QUERIES[name](spark, folder).count()}"
        except Exception as error:
            outcome = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += outcome is not None and not outcome.startswith("rows only")
        print(f"{name:24s} {time.time() - began:6.2f}s  {outcome or 'equal'}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

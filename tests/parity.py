"""Compare named queries with the SQL an independent engine answers (DuckDB).

Run as a script: ``python tests/parity.py FOLDER [name ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def engine(folder: str):
    con = duckdb.connect()
    con.execute("set threads to 8")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    out = {}
    for name in frame.columns:
        col = frame[name]
        if pd.api.types.is_bool_dtype(col):
            out[name] = col.astype(str)
        elif pd.api.types.is_numeric_dtype(col):
            out[name] = col.astype("float64").round(9)
        else:
            out[name] = col.astype("object").where(col.notna(), None)
    out = pd.DataFrame(out)
    return out.sort_values(list(out.columns), kind="mergesort", na_position="first").reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    a, b = rows(ours), rows(theirs)
    for name in a.columns:
        x, y = a[name], b[name]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            at = same[~same].index[0]
            return (f"{(~same).sum()} of {len(a)} rows differ, first in {name}: {a.loc[at].to_dict()} "
                    f"against {b.loc[at].to_dict()}")
    return None


def check(spark, con, query, folder: str) -> tuple[str, float]:
    start = time.time()
    ours = query(spark, folder).toPandas()
    took = time.time() - start
    if query.sql is None:
        return f"rows-only ({len(ours)})", took
    result = con.execute(query.sql)
    theirs = result.df()
    problem = difference(ours, theirs)
    kinds = sorted((d[0], str(d[1])) for d in result.description)
    return (problem or f"ok ({len(ours)}) {kinds if '-v' in sys.argv else ''}"), took


def main(argv: list[str]) -> int:
    from leeward.plans.catalog import all_queries
    from leeward.session import local_session
    argv = [a for a in argv if a != "-v"]
    folder, names = argv[0], argv[1:]
    spark, con = local_session(8), engine(folder)
    failed = 0
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        try:
            verdict, took = check(spark, con, query, folder)
        except Exception as exc:  # noqa: BLE001
            verdict, took = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0
        failed += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:26s} {took:6.1f}s  {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

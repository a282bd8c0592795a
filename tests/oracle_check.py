"""Compare registered queries with their SQL oracles, cell by cell.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents"
          " embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _sorted_rows(rows):
    return sorted((tuple(_cell(v) for v in r) for r in rows),
                  key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0)
                                      for v in r))


def compare(df, con, sql: str) -> str:
    """'' when schema names, row count and all values agree."""
    cols = sorted(df.columns)
    got = _sorted_rows(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = _sorted_rows(tuple(r[i] for i in order) for r in res.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            bad = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
            n = sum(a != b for a, b in zip(got, want))
            return f"{n} rows differ, e.g. {bad[:4]}"
        kinds = [(c, type(a), type(b)) for c, a, b in zip(cols, g, w)
                 if a is not None and type(a) is not type(b)]
        if kinds:
            return f"types differ: {kinds[:3]}"
    return ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(args.sf), oracle_sql(), []
    for name, fn in queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            verdict = (compare(df, con, sqls[name]) if name in sqls
                       else f"rows only: {len(df.collect())}")
        except Exception as e:  # report and go on with the next query
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        bad = verdict and not verdict.startswith("rows only")
        failed += [name] if bad else []
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.1f}s {verdict}",
              flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())

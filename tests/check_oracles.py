"""Compare registered queries with their DuckDB oracle: ``python tests/check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from vacantis.session import local_session  # noqa: E402
from vacantis.sources.bindings import GIVEN_TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in GIVEN_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """``=rows`` when both sides agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"rows {sum(got.values())} vs {sum(want.values())}; only Spark {extra}; only DuckDB {missing}"
    return f"={sum(got.values())}"


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in entry.queries():
        if args[1:] and not any(name.startswith(a) for a in args[1:]):
            continue
        start = time.time()
        try:
            if name in entry.oracle_sql():
                note = compare(spark, con, sf_dir, name)
            else:
                note = f"no oracle, {entry.queries()[name](spark, sf_dir).count()} rows"
                print("    ", name, note, flush=True)
                continue
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error)[:600]}"
        failed = not note.startswith("=")
        bad += failed
        print("FAIL" if failed else "ok  ", name, f"{time.time() - start:.1f}s", note[:1500], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()

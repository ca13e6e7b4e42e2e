"""Run queries beside their DuckDB oracles and report any difference.

usage: python tools/check_oracles.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from taleloom.plans import ORACLES, QUERIES  # noqa: E402
from taleloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value) -> str:
    if isinstance(value, float) and math.copysign(1.0, value) < 0 and value == 0:
        return "-0.0"
    return repr(value)


def rows_of(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """``None`` when both engines agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if ours else "no rows"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if not theirs:
        return "oracle gives no rows"
    if ours == theirs:
        return None
    only_ours = sorted(set(ours) - set(theirs))[:2]
    only_theirs = sorted(set(theirs) - set(ours))[:2]
    return f"{len(ours)} and {len(theirs)} rows; ours only {str(only_ours)[:600]}; oracle only {str(only_theirs)[:600]}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as err:  # report and go on with the next query
            problem = f"{type(err).__name__}: {str(err)[:900]}"
        kind = "oracle" if name in ORACLES else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.1f}s {kind:6} {name} {problem or ''}", flush=True)
        bad += problem is not None
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

"""Run queries beside their SQL twins and compare names, types, row counts and values."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def compare(spark, con, query, sf: str) -> tuple[list[str], int]:
    """Differences found (empty when equal) and the number of rows."""
    frame = query.build(spark, sf)
    columns = sorted(frame.columns)
    got = [tuple(r) for r in frame.select(*columns).collect()]
    if query.sql is None:
        return [], len(got)
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    rows = cursor.fetchall()
    if sorted(names) != columns:
        return [f"columns {columns} vs {sorted(names)}"], len(got)
    problems = []
    for name, kind in frame.dtypes:
        if KINDS.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} vs {types[name]}")
    where = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in where) for r in rows]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    got, want = sorted(got, key=_key), sorted(want, key=_key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {str(bad[0][0])[:300]} vs {str(bad[0][1])[:300]}")
    return problems, len(got)


def main() -> None:
    from tonegap.plans import QUERIES
    from tonegap.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    failed = 0
    for name, query in QUERIES.items():
        if only and not any(o == name or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            problems, n = compare(spark, con, query, sf)
        except Exception as exc:
            problems, n = [f"{type(exc).__name__}: {str(exc)[:600]}", " | ".join(x for x in str(exc).split(chr(10)) if not x.strip().startswith("at "))[:2500]], -1
        state = "ok" if not problems else "BAD"
        failed += bool(problems)
        print(f"{state:4} {name:32} rows={n:6} {time.time() - start:6.2f}s {'' if query.sql else '(no sql)'}", flush=True)
        for p in problems:
            print("      ", p, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()

"""Run registered queries next to their SQL twins and report differences.

    python -m tests.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(df, sf_dir: str, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    columns, rows = oracle_rows(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    mine, theirs = canonical(df.columns, df.collect()), canonical(columns, rows)
    if len(mine) != len(theirs):
        extra = [r for r in mine[:2000] if r not in set(theirs)][:2]
        return f"rows {len(mine)} / {len(theirs)}; only here {extra}"
    if mine != theirs:
        pairs = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"{len(pairs)} of {len(mine)} rows differ, first {str(pairs[0])[:600]}"
    return None if mine else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from fieldspan.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    twins = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            df = query(spark, sf_dir)
            problem = difference(df, sf_dir, twins[name]) if name in twins else f"(no twin) {df.count()} rows"
        except Exception as error:  # the report goes on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()

"""Run registered queries next to their SQL counterparts: python -m tools.check FOLDER [names...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import types as T

from gradeloom.catalog import ORACLES, QUERIES
from gradeloom.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
PLAIN = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(),
         "BOOLEAN": T.BooleanType()}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> list[str]:
    """Differences between both sides; empty when they agree."""
    df = QUERIES[name](spark, folder)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return [] if got else ["no rows"]
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = table_of(names, rel.fetchall())
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    for field in df.schema.fields:
        if PLAIN.get(types.get(field.name)) != field.dataType:
            problems.append(f"type {field.name}: {field.dataType} != {types.get(field.name)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(bad)} of {len(got)} rows differ, first {str(bad[0])[:600]}")
    return problems


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(8), connect(folder), []
    for name in names:
        begin = time.time()
        try:
            problems = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        kind = "ok" if not problems else "FAIL"
        note = "" if name in ORACLES else " (rows only)"
        print(f"{kind:4} {name}{note} {time.time() - begin:.1f}s", *problems, flush=True)
        failed += [name] if problems else []
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

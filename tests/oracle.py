"""Compare a Spark result with DuckDB's: same columns, types and rows in any order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    return v


SPARK_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
               "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def compare(df, con, sql) -> tuple[int, list[str]]:
    problems = []
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    mine = {n: SPARK_TYPES.get(t, t) for n, t in df.dtypes}
    if mine != types:
        problems.append(f"schema {mine} != {types}")
    order = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    cols = {c: i for i, c in enumerate(rel.columns)}
    if sorted(cols) != order:
        return sum(got.values()), problems
    want = Counter(tuple(_plain(r[cols[c]]) for c in order) for r in rel.fetchall())
    if got != want:
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}; only spark {str(list((got - want).items())[:2])[:600]};"
            f" only sql {str(list((want - got).items())[:2])[:600]}"
        )
    return sum(got.values()), problems


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in entry.oracle_sql():
                n, problems = compare(fn(spark, sf), con, entry.oracle_sql()[name])
            else:
                n, problems = fn(spark, sf).count(), ["(rows only)"]
        except Exception as e:  # report every query
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name:34} {n:8} {time.time() - t:6.2f}s", *problems, flush=True)
    print("bad:", bad)

"""Compare catalogue queries with their SQL on DuckDB.

``python -m tests.oracle [--sf 0.01] [name or prefix ...]``
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
ROOT = "/root/testdata"
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


TIMES: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, dict):
        return str({k: canon(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return str(v)


def compare(df, con, sql):
    """A list of differences between a Spark result and a SQL result; empty when equal."""
    began = time.time()
    rows = df.collect()
    TIMES["spark"] = time.time() - began
    rel = con.sql(sql)
    problems = []
    spark_cols = sorted(df.columns)
    duck_cols = sorted(rel.columns)
    if spark_cols != duck_cols:
        return [f"columns {spark_cols} != {duck_cols}"], 0
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name, duck_type in zip(rel.columns, rel.types):
        want = SAME.get(types[name])
        if want is not None and want != str(duck_type):
            problems.append(f"type of {name}: {types[name]} vs {duck_type}")
    left = sorted(tuple(canon(r[c]) for c in spark_cols) for r in (row.asDict(True) for row in rows))
    pos = [rel.columns.index(c) for c in duck_cols]
    right = sorted(tuple(canon(r[i]) for i in pos) for r in rel.fetchall())
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        only_l, only_r = sorted(a - b), sorted(b - a)
        problems.append(f"{len(only_l)} only in spark, {len(only_r)} only in sql; columns {spark_cols}")
        problems += [f"  spark {x}" for x in only_l[:3]] + [f"  sql   {x}" for x in only_r[:3]]
    return problems, len(left)


def main(argv):
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--time", type=float, default=0.0, help="only list queries slower than this")
    args.add_argument("names", nargs="*")
    opts = args.parse_args(argv)
    from riskframe.plans import catalogue
    from riskframe.session import build_session

    spark = build_session("oracle", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{ROOT}/sf{opts.sf}"
    con = connect(sf_dir)
    bad = 0
    for name, fn in catalogue.QUERIES.items():
        if opts.names and not any(name.startswith(n) for n in opts.names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = catalogue.ORACLES.get(name)
            if sql is None:
                n, problems = df.count(), []
                spent = time.time() - start
                label = "rows"
            else:
                problems, n = compare(df, con, sql)
                spent = time.time() - start
                label = "sql"
        except Exception as e:  # noqa: BLE001
            problems, n, spent, label = [f"{type(e).__name__}: {str(e)[:900]}"], -1, time.time() - start, "error"
        bad += bool(problems)
        if problems or spent >= opts.time:
            print(f"{'FAIL' if problems else 'ok':5s}{name:42s}{label:6s}{n:8d} rows {spent:6.1f}s (spark {TIMES.get('spark', 0):.1f})", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

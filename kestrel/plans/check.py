"""Compare a registered Spark query with its DuckDB oracle.

Mirrors the external gate: row count, column names (sorted), coarse column
types, and an order-insensitive multiset of row values (exact repr).
"""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _norm(x)) for k, x in v.asDict().items())
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, rows


def duck_rows(con, q):
    rel = con.sql(q)
    names = rel.columns
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, rows


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


def type_diff(df, con, q) -> dict:
    """Columns whose Spark type and DuckDB type differ."""
    s = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    rel = con.sql(q)
    o = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (s.get(c), o.get(c)) for c in set(s) | set(o) if s.get(c) != o.get(c)}


def compare(df, con, q, show: int = 5) -> dict:
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, q)
    res = {"spark_rows": len(sr), "oracle_rows": len(dr), "cols_match": sc == dc}
    td = type_diff(df, con, q)
    if td:
        res["type_diff"] = td
    cs, cd = Counter(sr), Counter(dr)
    res["values_match"] = cs == cd and sc == dc and not td
    if not res["values_match"]:
        res["spark_cols"], res["oracle_cols"] = sc, dc
        res["only_spark"] = list((cs - cd).elements())[:show]
        res["only_oracle"] = list((cd - cs).elements())[:show]
    return res


def main(argv=None):
    import argparse
    import json
    import time

    from kestrel.plans.catalog import ORACLES, QUERIES
    from kestrel.session import get_spark

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args(argv)
    import tempfile

    spark = get_spark("local[8]", 8, extra={"spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='kestrel-check-')}"})
    con = duck(args.sf)
    names = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, args.sf)
            if n in ORACLES:
                res = compare(df, con, ORACLES[n])
            else:
                res = {"rows_only": df.count()}
        except Exception as e:  # report and continue
            res = {"error": f"{type(e).__name__}: {str(e)[:600]}"}
        ok = res.get("values_match", "rows_only" in res)
        bad += not ok
        res["sec"] = round(time.time() - t0, 2)
        print(("OK  " if ok else "BAD ") + n, json.dumps(res, default=str)[:1500], flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()

"""Compare registered queries with their DuckDB statements.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, build, sql: str | None):
    t0 = time.time()
    df = build(spark, sf_dir)
    t1 = time.time()
    got = rows_of(df.columns, df.collect())
    t2 = time.time()
    out = {"rows": len(got), "plan": round(t1 - t0, 2), "run": round(t2 - t1, 2)}
    if sql is None:
        return {**out, "ok": bool(got), "note": "no oracle"}
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    want = rows_of(columns, relation.fetchall())
    out["duck"] = round(time.time() - t2, 2)
    if sorted(columns) != sorted(df.columns):
        return {**out, "ok": False, "note": f"columns {sorted(df.columns)} != {sorted(columns)}"}
    if got != want:
        a, b = set(got), set(want)
        return {**out, "ok": False, "note": f"want {len(want)} rows; extra {sorted(a - b, key=repr)[:2]} missing {sorted(b - a, key=repr)[:2]}"}
    return {**out, "ok": True}


def main() -> None:
    from scriptorium.plans.registry import ORACLES, QUERIES
    from scriptorium.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    conf = {
        "spark.master": "local[8]",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("oracle-check", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    for name in names:
        try:
            result = compare(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as exc:  # report and go on with the other queries
            result = {"ok": False, "note": f"{type(exc).__name__}: {str(exc)[:700]}"}
        print("OK  " if result.pop("ok") else "FAIL", name, result, flush=True)


if __name__ == "__main__":
    main()

"""Run registered queries in Spark and their oracle SQL in DuckDB, compare the results.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Prints one line per query: row counts, column sets, exact multiset equality of rows and, on a
mismatch, the first differing rows.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", repr(v))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((str(k), _norm(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name: str, sf_dir: str, con, show: int = 5) -> dict:
    from tickflow.plans import load_all

    queries, oracles = load_all()
    t0 = time.time()
    sdf = queries[name](spark, sf_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    t_spark = time.time() - t0
    scols = sdf.columns
    res = {"name": name, "spark_rows": len(srows), "spark_s": round(t_spark, 2)}
    if name not in oracles:
        res["oracle"] = "none"
        return res
    t1 = time.time()
    cur = con.execute(oracles[name])
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    res["duck_rows"] = len(drows)
    res["duck_s"] = round(time.time() - t1, 2)
    res["cols_match"] = sorted(scols) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    spark_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    same = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE[]": "array<double>"}
    res["types_match"] = all(same.get(dtypes[c], dtypes[c]) == spark_types.get(c) for c in dcols)
    if not res["cols_match"]:
        res["spark_only"] = sorted(set(scols) - set(dcols))
        res["duck_only"] = sorted(set(dcols) - set(scols))
        return res
    cols = sorted(scols)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in srows)
    b = sorted(tuple(_norm(r[c]) for c in cols) for r in drows)
    res["match"] = a == b
    if not res["match"]:
        sa, sb = set(a), set(b)
        only_a = [x for x in a if x not in sb][:show]
        only_b = [x for x in b if x not in sa][:show]
        res["n_diff"] = (len([x for x in a if x not in sb]), len([x for x in b if x not in sa]))
        res["cols"] = cols
        res["spark_only_rows"] = only_a
        res["duck_only_rows"] = only_b
    return res


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tickflow.plans import load_all
    from tickflow.session import local_session

    spark = local_session(8)
    queries, _ = load_all()
    con = duck_connect(args.sf)
    names = args.names or sorted(queries)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, args.sf, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:800]}
        ok = r.get("match") or r.get("oracle") == "none"
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()

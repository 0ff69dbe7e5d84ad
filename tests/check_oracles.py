"""Compare registered queries with their SQL in DuckDB (names as arguments, default all).

Columns are sorted by name and rows compared as multisets.
"""

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return sum(got.values()), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", False
    index = [names.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in index) for r in cur.fetchall())
    if got != want:
        extra, lost = got - want, want - got
        return (f"rows {sum(got.values())} vs {sum(want.values())}; only here {list(extra.items())[:2]}; "
                f"only there {list(lost.items())[:2]}"), False
    return sum(got.values()), True


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from apidrift.session import session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    s = session("local[8]", "check", **{"spark__sql__shuffle__partitions": "8", "spark__driver__memory": "12g"})
    s.sparkContext.setLogLevel("ERROR")
    qs, sqls = queries(), oracle_sql()
    for n in sys.argv[1:] or qs:
        t = time.time()
        try:
            info, ok = compare(s, n, qs[n], sqls.get(n), sf)
        except Exception as e:  # report and go on with the next query
            info, ok = f"{type(e).__name__}: {str(e)[:700]}", False
        print(f"{'OK  ' if ok else 'ROWS' if ok is None else 'FAIL'} {n} {time.time() - t:.1f}s {info}", flush=True)

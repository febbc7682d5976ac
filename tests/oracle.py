"""Compare a query with its SQL on the same tables, the way the driver does."""

import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_norm, v))
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(str([_norm(r[c]) for c in cols]) for r in df.collect())


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(str([_norm(r[i]) for i in order]) for r in found.fetchall())

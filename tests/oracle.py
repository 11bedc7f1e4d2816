"""Compare registered queries with their SQL on the same tables."""

import duckdb

from postlake.plans.bridge import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, int):
        return v
    return str(v)


def compare(spark, con, query, sf_dir):
    """None if equal, else a text that tells how the two differ."""
    df = query.run(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(([norm(r[n]) for n in names] for r in df.collect()), key=repr)
    cur = con.execute(query.oracle)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    at = [cols.index(n) for n in names]
    want = sorted(([norm(r[i]) for i in at] for r in cur.fetchall()), key=repr)
    if got == want:
        return None
    left = [g for g in got if g not in want][:3] if len(got) < 20000 else []
    right = [w for w in want if w not in got][:3] if len(got) < 20000 else []
    return f"{len(got)} rows against {len(want)}; only here {left}; only there {right}; {names}"

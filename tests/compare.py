"""Rows of a query against DuckDB's rows of its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def tidy(frame, columns):
    out = frame[columns].copy()
    for c in columns:
        if out[c].dtype.kind in "iuf":
            out[c] = out[c].astype(float)
    out = out.astype(object).where(out.notna(), None).map(lambda v: "" if v is None else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v))
    return out.sort_values(columns).reset_index(drop=True)


def same(spark_frame, sql_frame):
    columns = sorted(spark_frame.columns)
    assert columns == sorted(sql_frame.columns)
    a, b = tidy(spark_frame, columns), tidy(sql_frame, columns)
    assert len(a) == len(b)
    differ = (a != b).any(axis=1)
    assert not differ.any(), f"{a[differ].head(3)}\n{b[differ].head(3)}"

"""Runs a query and its SQL over the same tables and compares rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        cur = c.execute(sql)
        return [d[0] for d in cur.description], cur.fetchall()


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def same(df, sql, sf_dir):
    names, got = rows(df)
    found, want = oracle(sql, sf_dir)
    assert sorted(found) == names
    order = [found.index(n) for n in names]
    assert got == sorted((tuple(r[i] for i in order) for r in want), key=repr)
    return len(got)

"""Comparison of a DataFrame with DuckDB SQL over the same tables."""

import os

import duckdb


def canonical(rows):
    def plain(x):
        if isinstance(x, float):
            return round(x, 9)
        return x

    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


def assert_same(spark, df, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    got = canonical(tuple(r[n] for n in names) for r in df.collect())
    exp = canonical(want.fetchall())
    assert len(got) == len(exp), (len(got), len(exp))
    bad = [(a, b) for a, b in zip(got, exp) if a != b]
    assert not bad, (len(bad), bad[:3])

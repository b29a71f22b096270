"""Rows of a Spark query beside those of its SQL."""

import decimal


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if v != v else float(v)
    return v


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    c = con.execute(sql)
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in c.fetchall()), key=repr)
    assert got == want

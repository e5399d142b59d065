"""Compare a DataFrame with a DuckDB query, columns by name and rows in any order."""


def _plain(v):
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


def same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want

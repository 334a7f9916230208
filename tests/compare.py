"""Rows of a DataFrame against rows of a SQL relation."""

SF_DIR = "/root/testdata/sf0.001"


def plain(v):
    import datetime
    import decimal

    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def same(df, relation):
    """Rows of both sides, columns by name, in one order."""
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)
    assert got == want

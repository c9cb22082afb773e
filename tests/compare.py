"""Order-free comparison of a Spark result with a DuckDB one."""

import math

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    cursor = con.execute(sql)
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())

"""Comparing Spark results with DuckDB's."""

import math


def canonical(rows, columns):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{float(x):.4f}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


def same(df, duck, sql):
    relation = duck.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    mine = canonical([r.asDict() for r in df.collect()], df.columns)
    theirs = canonical([dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()], df.columns)
    assert len(mine) == len(theirs)
    assert mine == theirs

"""Rows of a query and of its SQL, in one form."""

from __future__ import annotations

import datetime
import math


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def of_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows(names, cur.fetchall())

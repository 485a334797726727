"""Rows of both engines in one form."""

import datetime
import decimal


def plain(v):
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(r[c]) for c in cols]) for r in df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())

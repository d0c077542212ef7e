"""How results of Spark and DuckDB are held against each other: as sorted rows of canonical values."""

import math


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(canonical(r[c]) for c in names) for r in df.collect())


def rows_of_duck(con, sql):
    t = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).arrow()
    t = t.read_all() if hasattr(t, "read_all") else t
    names = sorted(t.column_names)
    return names, sorted(tuple(canonical(r[c]) for c in names) for r in t.to_pylist())

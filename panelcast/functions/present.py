"""Engine-neutral presentation of a result for side-by-side checks.

A spec is a list of ``(column, kind)``: ``"s"`` text, ``"i"`` BIGINT,
``"d"`` DATE shown as ``yyyy-MM-dd``, ``"t"`` TIMESTAMP shown as
``yyyy-MM-dd HH:mm:ss``, ``"b"`` boolean, ``"a"`` text array joined by ``"; "``, ``"f"`` DOUBLE unrounded
(only for values computed bit-identically by both engines), or an int ``n`` meaning DOUBLE
rounded to n decimals. The same spec renders the Spark DataFrame and the
SQL oracle, so both sides agree on names, types and rounding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Spec = Sequence[tuple[str, object]]


def present(df: DataFrame, spec: Spec) -> DataFrame:
    cols = []
    for name, kind in spec:
        c = F.col(f"`{name}`")
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "a":
            c = F.concat_ws("; ", c)
        elif kind == "f":
            c = c.cast("double")
        elif isinstance(kind, int):
            c = F.round(c.cast("double"), kind)
        else:
            raise ValueError(f"unknown kind {kind!r} for {name}")
        cols.append(c.alias(name))
    return df.select(*cols)


def present_sql(sql: str, spec: Spec) -> str:
    cols = []
    for name, kind in spec:
        q = f'"{name}"'
        if kind == "s":
            e = f"CAST({q} AS VARCHAR)"
        elif kind == "i":
            e = f"CAST({q} AS BIGINT)"
        elif kind == "d":
            e = f"strftime(CAST({q} AS DATE), '%Y-%m-%d')"
        elif kind == "t":
            e = f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
        elif kind == "b":
            e = f"CAST({q} AS BOOLEAN)"
        elif kind == "a":
            e = f"array_to_string({q}, '; ')"
        elif kind == "f":
            e = f"CAST({q} AS DOUBLE)"
        elif isinstance(kind, int):
            e = f"round(CAST({q} AS DOUBLE), {kind})"
        else:
            raise ValueError(f"unknown kind {kind!r} for {name}")
        cols.append(f"{e} AS {q}")
    return f"SELECT {', '.join(cols)}\nFROM (\n{sql}\n) AS q"

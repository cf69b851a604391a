"""Numbers as C's printf prints them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def printed(x: Column, form: str) -> Column:
    """x (double) by "%.Nf", "%.Ne" or "%.Ng" (N up to 15 for f, 13 for e, 1 to 14 for g) as C prints it, so not by Java's rules, which round the shortest text half up.

    Null stays null; nan, inf and -inf are texts; -0.0 keeps its sign. Python's own formatting, which is exact, over Arrow columns.
    """
    m = re.fullmatch(r"%\.(\d+)([efg])", form)
    if not m or int(m[1]) > {"f": 15, "e": 13, "g": 14}[m[2]] or m[2] == "g" and m[1] == "0":
        raise ValueError(f"no form {form}")

    def texts(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else form % v for v in values.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")(x)


def shortest(x: Column) -> Column:
    """x (double) by the fewest digits that tell it from its neighbours, with an exponent below 1e-4 and from 1e16 on."""

    def texts(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else repr(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(texts, "string")(x)

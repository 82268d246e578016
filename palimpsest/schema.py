"""Schemas written as text; parsed without a session, so that modules can be imported anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "array<long>": T.ArrayType(T.LongType()), "array<int>": T.ArrayType(T.IntegerType()), "array<float>": T.ArrayType(T.FloatType())}


def schema(text: str) -> T.StructType:
    fields = (field.split() for field in text.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])

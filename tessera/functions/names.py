"""Names of attributes in a schema, and their three kinds of type."""

from __future__ import annotations

from pyspark.sql import types as T

from tessera.errors import UnknownAttribute


def kind_of(type_: T.DataType) -> str:
    """int, double or string; dates and timestamps count as strings, being compared with string literals."""
    if isinstance(type_, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(type_, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    return "string"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(name: str, schema: T.StructType, *others: T.StructType) -> T.StructField:
    """The attribute of that exact name, else the only one whose name ends in it after an alias.

    Schemas are searched in their order; the first that has the name counts.
    """
    for s in (schema, *others):
        exact = [f for f in s.fields if f.name == name]
        found = exact or [f for f in s.fields if f.name.rpartition(".")[2] == name]
        if len(found) > 1:
            raise UnknownAttribute(f"{name} is ambiguous")
        if found:
            return found[0]
    raise UnknownAttribute(f"no attribute {name}")

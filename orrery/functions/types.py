"""Kinds of values that lowering tells apart, and declared types."""

from __future__ import annotations

from pyspark.sql import types as T

from ..errors import SqlError
from ..plans.syntax import TypeName

# Declared types by what they are stored as.
INTS = {"int": "INT", "integer": "INT", "smallint": "INT", "tinyint": "INT", "bigint": "BIGINT", "bit": "INT"}
STRINGS = {"varchar", "nvarchar", "char", "nchar", "text", "ntext", "sysname", "uniqueidentifier"}
TIMES = {"date", "datetime", "datetime2", "smalldatetime", "time", "datetimeoffset"}
MONEY = {"money": (19, 4), "smallmoney": (10, 4)}


def spark_type(t: TypeName) -> str:
    """The SQL name of the Spark type that a column or variable of a declared type has."""
    name = t.name
    if name in INTS:
        return INTS[name]
    if name in STRINGS:
        return "STRING"
    if name in TIMES:
        return "TIMESTAMP_NTZ"
    if name in MONEY:
        return "DECIMAL({},{})".format(*MONEY[name])
    if name in ("decimal", "numeric"):
        p, s = (*t.args, 18, 0)[:2] if len(t.args) != 1 else (t.args[0], 0)
        return f"DECIMAL({p},{s})"
    if name in ("float", "real"):
        return "DOUBLE"
    raise SqlError(f"Unsupported data type '{name}'.")


def physical(t: TypeName) -> str:
    """int, decimal, datetime or string."""
    if t.name in INTS:
        return "int"
    if t.name in STRINGS:
        return "string"
    if t.name in TIMES:
        return "datetime"
    spark_type(t)
    return "decimal"


def kind_of(t: T.DataType) -> str:
    """int, dec, dbl, str, ts, bool, null or any."""
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.DecimalType):
        return "dec"
    if isinstance(t, T.FractionalType):
        return "dbl"
    if isinstance(t, T.StringType | T.VarcharType | T.CharType):
        return "str"
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "ts"
    return "null" if isinstance(t, T.NullType) else "any"


def kind_of_declared(t: TypeName) -> str:
    if t.name == "bit":
        return "bool"
    name = spark_type(t)
    return {"INT": "int", "BIGINT": "int", "STRING": "str", "TIMESTAMP_NTZ": "ts", "DOUBLE": "dbl"}.get(name, "dec")


def wider(kinds: list[str]) -> str:
    """The kind of a value that may come from any of these."""
    known = [k for k in kinds if k != "null"]
    if not known:
        return "null"
    for k in ("str", "ts", "any", "dbl", "dec", "int", "bool"):
        if k in known:
            return k
    return "any"

"""Type names of the UDF surface and Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: The names that users give for argument and result types.
NAMES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "fp32": T.FloatType(),
    "fp64": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}


def spark_type(kind: str | T.DataType) -> T.DataType:
    """A Spark type from a short name, a DDL string or itself."""
    if isinstance(kind, T.DataType):
        return kind
    return NAMES.get(kind.lower()) or T.DataType.fromDDL(kind)


def struct_of(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere inside."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind

"""Type classes and the type names that catalog rows and `WHEN TYPE` use."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = {T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "BLOB"}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def type_name(kind: T.DataType) -> str:
    """The catalog's spelling of a type: BIGINT, DECIMAL(18,2), VARCHAR[], ..."""
    if isinstance(kind, T.DecimalType):
        return "HUGEINT" if (kind.precision, kind.scale) == (38, 0) else f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return type_name(kind.elementType) + "[]"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in kind.fields) + ")"
    if isinstance(kind, T.MapType):
        return f"MAP({type_name(kind.keyType)}, {type_name(kind.valueType)})"
    return _NAMES.get(type(kind), kind.simpleString().upper())


def base_type(name: str) -> str:
    """DECIMAL of DECIMAL(18,2), in upper case."""
    return name.split("(")[0].strip().upper()


def is_scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, NESTED)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS) or type_name(kind) == "HUGEINT"


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_measure(kind: T.DataType) -> bool:
    """Types that can't be a level of a hierarchy: fractions of any kind."""
    return isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) and not is_integer(kind)


def as_double(c, kind: T.DataType):
    """A number as double; a float by way of its text, so that 0.1 stays 0.1."""
    return c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c.cast("double")

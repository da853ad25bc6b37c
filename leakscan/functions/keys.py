"""Equality keys, missing-value tests and labels for feature and group columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from leakscan.settings import KEY_BYTES

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
REJECTED = (
    T.ArrayType,
    T.MapType,
    T.VariantType,
    T.DayTimeIntervalType,
    T.YearMonthIntervalType,
    T.CalendarIntervalType,
)


def is_mixed(dtype: T.DataType) -> bool:
    """True for ``struct<type:string,value:string>``, the form of a column that mixes types."""
    return (
        isinstance(dtype, T.StructType)
        and [f.name for f in dtype.fields] == ["type", "value"]
        and all(isinstance(f.dataType, T.StringType) for f in dtype.fields)
    )


def is_hashable(dtype: T.DataType) -> bool:
    return is_mixed(dtype) or not isinstance(dtype, (*REJECTED, T.StructType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def family(dtype: T.DataType) -> str:
    """Name of the set of types whose values may be equal to each other."""
    if isinstance(dtype, INTEGRAL):
        return "int"
    if isinstance(dtype, FLOATING):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "Decimal"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if is_mixed(dtype):
        return "mixed"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    return dtype.typeName()


def as_mixed(name: str, dtype: T.DataType) -> Column:
    """A typed column in the form of a mixed one, so the two can be compared."""
    column = F.col(f"`{name}`")
    if is_mixed(dtype):
        return column
    if isinstance(dtype, T.BooleanType):
        text = F.when(column, "True").when(~column, "False")
    else:
        text = column.cast("string")
    return F.when(~missing(name, dtype), F.struct(F.lit(family(dtype)).alias("type"), text.alias("value")))


def comparable(left: T.DataType, right: T.DataType) -> bool:
    """False when no value of one type can equal a value of the other; nothing is coerced."""
    return family(left) == family(right) or is_mixed(left) or is_mixed(right)


def missing_sql(name: str, dtype: T.DataType) -> str:
    column = f"`{name}`"
    if isinstance(dtype, FLOATING):
        return f"({column} IS NULL OR isnan({column}))"
    if is_mixed(dtype):
        return f"({column} IS NULL OR {column}.type IS NULL OR {column}.value IS NULL)"
    return f"({column} IS NULL)"


def missing(name: str, dtype: T.DataType) -> Column:
    return F.expr(missing_sql(name, dtype))


def nonfinite_sql(name: str) -> str:
    return f"(abs(CAST(`{name}` AS double)) = CAST('Infinity' AS double))"


def _bounded(text: Column, label: str) -> list[Column]:
    size = F.octet_length(text)
    return [
        F.when(size <= KEY_BYTES, text).otherwise(F.sha2(text, 256)).alias(label),
        size.alias(f"{label}l"),
    ]


def equality_key(name: str, dtype: T.DataType, label: str, mixed: bool = False) -> list[Column]:
    """Columns that are equal exactly when the values are, and stay small in a shuffle.

    Whole texts take part: beyond ``KEY_BYTES`` bytes a text is represented by its
    byte length and SHA-256. The length keeps a short text apart from any digest.
    """
    column = F.col(f"`{name}`")
    if mixed or is_mixed(dtype):
        column = as_mixed(name, dtype)
        return [column["type"].alias(f"{label}t"), *_bounded(column["value"], label)]
    if family(dtype) == "str":
        return _bounded(column.cast("string"), label)
    if isinstance(dtype, T.BinaryType):
        return _bounded(F.hex(column), label)
    return [column.alias(label)]


def group_key(name: str, dtype: T.DataType, mixed: bool = False) -> Column:
    """Group id in the widest type of its family, so int and bigint ids compare."""
    column = F.col(f"`{name}`")
    if mixed:
        return as_mixed(name, dtype)
    if isinstance(dtype, INTEGRAL):
        return column.cast("bigint")
    if isinstance(dtype, FLOATING):
        return column.cast("double")
    return column


def group_label(column: Column, dtype: T.DataType) -> Column:
    """Text shown for an id: strings as they are, other types with a type prefix."""
    if is_mixed(dtype):
        return F.when(column["type"] == "str", column["value"]).otherwise(
            F.concat(column["type"], F.lit(":"), column["value"])
        )
    kind = family(dtype)
    if kind == "str":
        return column.cast("string")
    if kind == "bool":
        text = F.when(column, "True").otherwise("False")
    else:
        text = column.cast("string")
    return F.concat(F.lit(f"{kind}:"), text)

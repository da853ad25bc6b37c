"""VARIANT columns, as JSON sources give them, in the form of a column that mixes types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from leakscan.settings import UNHASHABLE

#: The first whole number that is no 64-bit one. A JSON number without a fraction arrives as a decimal from here on.
FIRST_LONG = "9223372036854775808"


def typed_variant(column: Column) -> Column:
    """Type and text of a VARIANT value; null for null and for a JSON null.

    Numbers with a fraction or an exponent are floats, whole numbers are ints: ``7``, ``7.0`` and ``"7"`` are three values, ``7.5`` and
    ``7.50`` are one. The source keeps no zeros after the point, so beyond 64 bits ``1…0.0`` is an int. Objects and arrays stop the job.
    """
    kind = F.schema_of_variant(column)
    text = F.try_variant_get(column, "$", "string")
    number = F.try_variant_get(column, "$", "double")
    whole = kind.like("DECIMAL(%,0)") & (F.abs(F.try_variant_get(column, "$", "decimal(38,0)")) >= F.lit(FIRST_LONG).cast("decimal(38,0)"))

    def typed(name: Column, value: Column) -> Column:
        return F.struct(name.alias("type"), value.alias("value"))

    truth = F.when(F.try_variant_get(column, "$", "boolean"), "True").otherwise("False")
    return (
        F.when(column.isNull() | (kind == "VOID"), F.lit(None))
        .when(kind == "STRING", typed(F.lit("str"), text))
        .when((kind == "BIGINT") | whole, typed(F.lit("int"), text))
        .when(kind == "BOOLEAN", typed(F.lit("bool"), truth))
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.when(~F.isnan(number), typed(F.lit("float"), number.cast("string"))))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.raise_error(F.lit(UNHASHABLE)).cast("struct<type:string,value:string>"))
        .otherwise(typed(F.lower(kind), text))
    )


def typed_variants(table: DataFrame) -> DataFrame:
    """``table`` with each VARIANT column as ``struct<type:string,value:string>``; objects and arrays only stop jobs that read the column."""
    found = [field.name for field in table.schema.fields if isinstance(field.dataType, T.VariantType)]
    return table.withColumns({name: typed_variant(F.col(f"`{name}`")) for name in found}) if found else table

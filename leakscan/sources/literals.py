"""Column types from the literals that occur, by one grammar and over all files that are to be compared.

Each literal has one class, a column has the set of classes that occur in it as a bit mask, and masks of parts, files and
sides join with a bitwise or. So one aggregate finds the types of all columns of both sides, and both sides get the same ones.

The grammar, which a whole field must follow:

=========  ========================================================================  =============
class      literals                                                                  read as
=========  ========================================================================  =============
INTEGER    an optional sign and up to 9 digits                                       int
WIDE       an optional sign and 10 to 18 digits                                      bigint
REAL       decimal digits with a point or an exponent, ``inf``, ``infinity``         double
TRUTH      ``true``, ``True``, ``TRUE``, ``false``, ``False``, ``FALSE``             boolean
TIME       ``2024-01-05 10:00:00``: times of day that exist, in just this form       timestamp
TEXT       anything else: ``yes``, ``1D``, ``2024-01-05``, `` 7``, longer integers   string
=========  ========================================================================  =============

A column of numbers is read as the narrowest type for all of them, one of truth values only as boolean, one of times only as timestamp. It is
text as soon as it has a text or literals of two kinds, and without any literal. Dates and times in other forms stay text
unless a schema says otherwise, so equal values are equal texts in all columns but numbers, where ``1``, ``1.0`` and ``1e0`` are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

INTEGER, WIDE, REAL, TRUTH, TIME, TEXT = 1, 2, 4, 8, 16, 32

# The literals of each class.
INTEGERS = r"^[+-]?[0-9]{1,9}\z"
WIDER = r"^[+-]?[0-9]{10,18}\z"
TOO_WIDE = r"^[+-]?[0-9]{19,}\z"
REALS = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
INFINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
TIMES = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"
TRUTHS = ("true", "True", "TRUE", "false", "False", "FALSE")


def literal_class(text: Column) -> Column:
    """The bit of a field's class, 0 for a missing one. A number with more than 18 digits and no point or exponent is a text."""
    same_time = F.date_format(text.try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss") == text
    return (
        F.when(text.isNull(), F.lit(0))
        .when(text.rlike(INTEGERS), F.lit(INTEGER))
        .when(text.rlike(WIDER), F.lit(WIDE))
        .when((text.rlike(REALS) & ~text.rlike(TOO_WIDE)) | F.lower(text).isin(*INFINITE), F.lit(REAL))
        .when(text.isin(*TRUTHS), F.lit(TRUTH))
        .when(text.rlike(TIMES) & F.coalesce(same_time, F.lit(False)), F.lit(TIME))
        .otherwise(F.lit(TEXT))
    )


def column_type(classes: int) -> str:
    """The narrowest type that reads every literal of these classes as what it is."""
    if classes and not classes & ~(INTEGER | WIDE | REAL):
        return "double" if classes & REAL else "bigint" if classes & WIDE else "int"
    return {TRUTH: "boolean", TIME: "timestamp"}.get(classes, "string")


def literal_classes(tables: Sequence[DataFrame]) -> DataFrame:
    """One row: for each column of any of the tables, all of text, the classes of its literals in all of them."""
    names = list(dict.fromkeys(name for table in tables for name in table.columns))
    masks = None
    for table in tables:
        mask = table.select(*[
            (literal_class(F.col(f"`{name}`")) if name in table.columns else F.lit(0)).alias(f"_{i}") for i, name in enumerate(names)
        ])
        masks = mask if masks is None else masks.unionByName(mask)
    joined = [F.coalesce(F.bit_or(f"_{i}"), F.lit(0)).alias(name) for i, name in enumerate(names)]
    return masks.agg(*joined)


def as_typed(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """Tables of text with the types that their literals have in common."""
    if not any(table.columns for table in tables):
        return list(tables)
    classes = literal_classes(tables).first().asDict()
    return [table.select(*[_read(name, column_type(classes[name])) for name in table.columns]) for table in tables]


def _read(name: str, kind: str) -> Column:
    text = F.col(f"`{name}`")
    return (text if kind == "string" else text.cast(kind)).alias(name)

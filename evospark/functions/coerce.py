"""Lenient casts for upload cells: NULL instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cell texts that mean "no value".
NULL_WORDS = ["", "NULL", "null", "None"]
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]

# Number texts as the upload format defines them. Underscores may separate
# digits; Java suffixes such as 2.9D are not numbers here.
INT_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*$"
FLOAT_TEXT = (
    r"^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
)
FLOAT_LITERAL = r"^[+-]?([0-9]+\.[0-9]*|[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]+)$"


def stripped(col: Column) -> Column:
    """Trim every whitespace character, not only spaces."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def _plain(col: Column) -> Column:
    return F.replace(stripped(col), F.lit("_"), F.lit(""))


def int_or_null(col: Column, *, from_number: bool = False) -> Column:
    """Integer of a text cell. ``from_number`` is for cells that were JSON
    numbers: they truncate toward zero (3.7 -> 3), text cells do not."""
    text = col.cast("string")
    value = F.when(text.isin(NULL_WORDS), None).when(
        stripped(text).rlike(INT_TEXT), _plain(text).try_cast("bigint")
    )
    if from_number:
        value = value.when(text.rlike(FLOAT_LITERAL), text.try_cast("double").try_cast("bigint"))
    return value


def float_or_null(col: Column) -> Column:
    """Double of a text cell."""
    text = col.cast("string")
    return F.when(text.isin(NULL_WORDS), None).when(
        stripped(text).rlike(FLOAT_TEXT), _plain(text).try_cast("double")
    )


def bool_or_null(col: Column) -> Column:
    """Boolean of a text cell; texts outside the word lists are NULL."""
    text = col.cast("string")
    word = F.lower(stripped(text))
    return (
        F.when(text.isin(NULL_WORDS), None)
        .when(word.isin(TRUE_WORDS), True)
        .when(word.isin(FALSE_WORDS), False)
    )


def number_as_bool(col: Column) -> Column:
    """Truth of a numeric column: zero is false, all else true."""
    return F.when(col.isNotNull(), col != 0)


def _was_number(field: str) -> Column:
    return F.array_contains("number_fields", field)


def with_number_fields(records: DataFrame) -> DataFrame:
    """Records from elsewhere than JSON may lack the list of their number fields."""
    if "number_fields" in records.columns:
        return records
    return records.withColumn("number_fields", F.array().cast("array<string>"))


def record_int(field: str) -> Column:
    """Integer of an upload record's field; JSON numbers truncate."""
    return F.when(_was_number(field), int_or_null(F.col(field), from_number=True)).otherwise(int_or_null(F.col(field)))


def record_bool(field: str) -> Column:
    """Boolean of an upload record's field; JSON numbers count by being non-zero."""
    return F.when(_was_number(field), number_as_bool(float_or_null(F.col(field)))).otherwise(bool_or_null(F.col(field)))


def finite(col: Column) -> Column:
    """Double with NaN and infinities turned into NULL."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def not_nan(col: Column) -> Column:
    """Double with NaN turned into NULL (NaN sorts above all numbers in Spark)."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def canonical_index(col: Column) -> Column:
    """``3.0`` -> ``3``, blank -> NULL, other text trimmed."""
    text = stripped(col.cast("string"))
    number = float_or_null(text)
    whole = number.isNotNull() & (F.abs(number) < 9.0e18) & (number == F.floor(number))
    return (
        F.when((text == "") | (F.lower(text) == "nan"), None)
        .when(whole, number.try_cast("bigint").cast("string"))
        .otherwise(text)
    )


def index_number(col: Column) -> Column:
    """Numeric value of a text index, NULL when it is not a number."""
    return not_nan(float_or_null(col))

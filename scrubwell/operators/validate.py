"""Contact and range validation: failing cells become NULL, nothing is invented."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text, vocab
from .tables import col, row_to_rows


def valid_email(c: Column) -> Column:
    t = text.email(c)
    return F.when(text.is_valid_email(t), t)


def valid_phone(c: Column) -> Column:
    digits = text.phone(c)
    return F.when(text.is_valid_phone(digits), digits)


def validate_email(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, valid_email(col(column)))


def validate_phone(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, valid_phone(col(column)))


def validate_phone_ten(df: DataFrame, column: str) -> DataFrame:
    """Ten-digit rule: a leading 91 is dropped from twelve digits, other lengths are NULL."""
    return df.withColumn(column, text.phone_ten(col(column)))


def contact_counts(df: DataFrame, email: str | None = "Email", phone: str | None = "Phone") -> DataFrame:
    """(action, count): invalid e-mails and ten-digit phones found, and made missing, as
    :func:`validate_email` and :func:`validate_phone_ten` do. A column that the table does not have
    (names are compared exactly) is not listed. One aggregate."""
    found = {what: checked(col(c)).isNull() & col(c).isNotNull() for what, c, checked in (
        ("email", email, valid_email), ("phone", phone, text.phone_ten)) if c in df.columns}
    row = df.agg(F.count(F.lit(1)), *[F.count_if(bad).alias(what) for what, bad in found.items()])
    return row_to_rows(row, {"action": "string", "count": "long"}, [
        (F.lit(f"Invalid {what} values {ending}"), F.col(what)) for what in found for ending in ("detected", "converted to missing")])


def range_of(name: str) -> tuple | None:
    return vocab.SEMANTIC_RANGES.get(names.column_key(name))


def is_out_of_range(value: Column, bounds: tuple) -> Column:
    low, high = bounds
    out = value < low
    return out if high is None else out | (value > high)


def apply_semantic_ranges(df: DataFrame) -> DataFrame:
    """Values outside the range that the exact column name implies become NULL."""
    numeric = set(names.numeric_columns(df))
    def checked(c):
        bounds = range_of(c)
        if c not in numeric or bounds is None:
            return col(c)
        return F.when(~is_out_of_range(col(c), bounds), col(c)).alias(c)
    return df.select(*[checked(c) for c in df.columns])

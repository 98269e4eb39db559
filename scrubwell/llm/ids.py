"""Ids that operators carry as 64-bit integers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def long_id(df: DataFrame, name: str) -> Column:
    """The id column as a long. Any other type than an integer is refused here, before a task would fail on it."""
    kind = df.select(F.col(name)).schema[0].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} must be an integer column, not {kind.simpleString()}")
    return F.col(name).cast("long")

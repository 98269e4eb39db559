"""IQR outliers: detection, report, capping and row listing."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, vocab
from .profile import round_half_up
from .quantiles import exact_quantiles
from .tables import col, literal_table, nan_to_null, row_to_rows

_FENCE = 1.5  # fixed value


def iqr_bounds(df: DataFrame, columns: list[str], min_count: int, min_distinct: int = 0) -> dict[str, dict]:
    """Quartiles and fences of every column with enough values and a positive, finite IQR."""
    bounds = {}
    for c, q in exact_quantiles(df, columns, [0.25, 0.75]).items():
        q1, q3 = q["values"]
        iqr = q3 - q1
        if q["count"] >= min_count and math.isfinite(iqr) and iqr > 0:
            bounds[c] = {"q1": q1, "q3": q3, "iqr": iqr,
                         "lower": q1 - _FENCE * iqr, "upper": q3 + _FENCE * iqr}
    few = _fewer_values(df, list(bounds), min_distinct)
    return {c: b for c, b in bounds.items() if c not in few}


def _fewer_values(df: DataFrame, columns: list[str], least: int) -> set[str]:
    """Columns with fewer than ``least`` different values. Each round finds the next larger value
    of all columns by a minimum, so a few aggregates decide, whatever the number of values."""
    floor: dict[str, float | None] = {c: None for c in columns}
    few: set[str] = set()
    for _ in range(least if columns else 0):
        open_columns = [c for c in columns if c not in few]
        if not open_columns:
            break
        value = {c: col(c).cast("double") for c in open_columns}
        row = df.agg(*[F.min(value[c] if floor[c] is None else F.when(value[c] > floor[c], value[c])).alias(f"_{i}")
                       for i, c in enumerate(open_columns)]).first()
        for i, c in enumerate(open_columns):
            floor[c] = row[i]
            if row[i] is None:
                few.add(c)
    return few


def is_outside(c: str, bound: dict) -> Column:
    return (col(c) < bound["lower"]) | (col(c) > bound["upper"])


_EMPTY = {"column": "string", "outliers": "long", "lower": "double", "upper": "double"}


def outliers(df: DataFrame) -> DataFrame:
    """Outlier count and fences per numeric column (at least 8 values, 4 of them distinct)."""
    df = nan_to_null(df)
    return count_outside(df, iqr_bounds(df, names.numeric_columns(df), 8, 4))


def count_outside(df: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    if not bounds:
        return literal_table(df.sparkSession, _EMPTY, [])
    row = df.agg(*[F.count_if(is_outside(c, b)).alias(f"_{i}") for i, (c, b) in enumerate(bounds.items())])
    return row_to_rows(row, _EMPTY, [
        (F.lit(c), F.col(f"_{i}"), F.lit(b["lower"]), F.lit(b["upper"]))
        for i, (c, b) in enumerate(bounds.items())])


def outlier_report(df: DataFrame, substring_ids: bool = False) -> DataFrame:
    """Quartiles, fences (two decimals) and count for every measure column with 5 or more
    values, identifiers left out and columns without outliers listed."""
    df = nan_to_null(df)
    bounds = iqr_bounds(df, names.measure_columns(df, substring_ids), 5)
    schema = {"column": "string", "q1": "double", "q3": "double", "iqr": "double",
              "lower_bound": "double", "upper_bound": "double", "outliers": "long"}
    if not bounds:
        return literal_table(df.sparkSession, schema, [])
    row = df.agg(*[F.count_if(is_outside(c, b)).alias(f"_{i}") for i, (c, b) in enumerate(bounds.items())])
    rounded = lambda b, k: round_half_up(F.lit(b[k]), 2)
    return row_to_rows(row, schema, [
        (F.lit(c), *[rounded(b, k) for k in ("q1", "q3", "iqr", "lower", "upper")], F.col(f"_{i}"))
        for i, (c, b) in enumerate(bounds.items())])


def is_cappable(c: str) -> bool:
    return c not in vocab.NEVER_CAPPED and not any(part in c.lower() for part in vocab.FINANCIAL_PARTS)


def cap_outliers(df: DataFrame, substring_ids: bool = False) -> DataFrame:
    """Clip measure columns to their fences, as doubles. Bounded and financial columns keep
    their values; NULL stays NULL."""
    df = nan_to_null(df)
    return clipped(df, cap_bounds(df, substring_ids))


def cap_bounds(df: DataFrame, substring_ids: bool = False) -> dict[str, dict]:
    """Fences of the columns that :func:`cap_outliers` clips."""
    df = nan_to_null(df)
    return iqr_bounds(df, [c for c in names.measure_columns(df, substring_ids) if is_cappable(c)], 5)


def cap_counts(df: DataFrame, bounds: dict[str, dict] | None = None) -> DataFrame:
    """(column, outliers, lower, upper): the cells that clipping changes, per clipped column."""
    df = nan_to_null(df)
    return count_outside(df, cap_bounds(df) if bounds is None else bounds)


def clipped(df: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    """The table with the columns of ``bounds`` clipped to them."""
    clip = lambda c, b: F.when(col(c).isNotNull(), F.least(F.greatest(
        col(c).cast("double"), F.lit(b["lower"])), F.lit(b["upper"])))
    return df.select(*[clip(c, bounds[c]).alias(c) if c in bounds else col(c) for c in df.columns])


def outlier_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows that hold an outlier, each with the list of its outlying columns."""
    df = nan_to_null(df)
    bounds = iqr_bounds(df, columns or names.numeric_columns(df), 8, 4)
    if not bounds:
        return df.where(F.lit(False)).withColumn("outlier_columns", F.lit(""))
    hits = F.concat_ws(",", *[F.when(is_outside(c, b), F.lit(c)) for c, b in bounds.items()])
    return df.withColumn("outlier_columns", hits).where(F.col("outlier_columns") != "")

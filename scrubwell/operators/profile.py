"""Profile, missing and duplicate counts, quality score, before/after summary."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, text
from .tables import by_type, col, histogram, literal_table, nan_to_null, row_to_rows

_MISSING_WEIGHT, _DUPLICATE_WEIGHT, _INVALID_WEIGHT = 0.55, 0.25, 0.20  # fixed values


def round_half_up(x: Column, digits: int) -> Column:
    """Round doubles the same way on every engine (built-in ``round`` differs at ties)."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(round_half_up(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def column_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: position, dtype, rows, non_null, distinct, min, max, mean.

    Exact by default: a (column, value) count whose partial aggregation absorbs hot values,
    then a count per column. ``approximate=True`` uses one pass of HyperLogLog sketches and
    no shuffle of values."""
    df = nan_to_null(df)
    spark = df.sparkSession
    per_type = []
    for kind, cells in by_type(df).items():
        if approximate:
            grouped = cells.groupBy("column")
            distinct, weight = F.approx_count_distinct("value"), F.lit(1)
        else:
            cells = histogram(cells)
            grouped = cells.groupBy("column")
            distinct, weight = F.count("value"), F.col("n")
        value = F.col("value")
        if kind in ("bigint", "double") or kind.startswith("decimal"):
            number = value.cast("double")
            spread = [F.min(number), F.max(number),
                      F.try_divide(F.sum(number * weight), F.sum(F.when(value.isNotNull(), weight)))]
        else:
            spread = [F.lit(None).cast("double")] * 3
        per_type.append(grouped.agg(
            F.sum(weight).alias("rows"),
            F.coalesce(F.sum(F.when(value.isNotNull(), weight)), F.lit(0)).alias("non_null"),
            distinct.alias("distinct"),
            *[s.alias(n) for s, n in zip(spread, ("min", "max", "mean"))]))
    if not per_type:  # a table without columns
        per_type = [literal_table(spark, {"column": "string", "rows": "long", "non_null": "long", "distinct": "long",
                                          "min": "double", "max": "double", "mean": "double"}, [])]
    stats = reduce(DataFrame.unionByName, per_type)
    schema = literal_table(spark, {"position": "long", "column": "string", "dtype": "string"},
                           [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)])
    joined = schema.join(stats, "column", "left")  # the schema side keeps columns of an empty table
    zero = F.lit(0).cast("long")
    return joined.select(
        "position", "column", "dtype",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("rows", "non_null", "distinct")],
        "min", "max", "mean")


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: dtype, rows, non-null, missing, missing %, distinct."""
    missing = F.col("rows") - F.col("non_null")
    return column_stats(df, approximate).select(
        "column", "dtype", "rows", "non_null", missing.alias("missing"),
        _percent(missing, F.col("rows")).alias("missing_pct"), "distinct")


def profile_snapshot(df: DataFrame, samples: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """Profile plus min, max and mean of numeric columns. Raw values stay out unless
    ``samples=True`` asks for the three smallest of each non-numeric column. ``stats`` are the
    column statistics where these are known."""
    stats = column_stats(df) if stats is None else stats
    missing = F.col("rows") - F.col("non_null")
    out = stats.select(
        "column", "dtype", missing.alias("missing"),
        _percent(missing, F.col("rows")).alias("missing_pct"),
        "distinct", "min", "max", round_half_up(F.col("mean"), 4).alias("mean"))
    if not samples:
        return out
    plain = [c for c in df.columns if c not in set(names.numeric_columns(df))]
    cells = df.select(*[col(c).cast("string").alias(c) for c in plain])
    smallest = _three_smallest(cells)
    return out.join(F.broadcast(smallest), "column", "left")


def _three_smallest(cells: DataFrame) -> DataFrame:
    """Three smallest distinct values per column by repeated minimum, never a full sort."""
    aggs = {c: F.min(col(c)) for c in cells.columns}
    found: dict[str, list[str]] = {c: [] for c in cells.columns}
    for _ in range(3):
        row = cells.agg(*[a.alias(c) for c, a in aggs.items()]).first() if aggs else {}
        for c in cells.columns:
            if row[c] is not None:
                found[c].append(row[c])
                aggs[c] = F.min(F.when(col(c) > row[c], col(c)))
    return literal_table(cells.sparkSession, {"column": "string", "sample_values": "string"},
                         [(c, ", ".join(x[:80] for x in v)) for c, v in found.items()])  # cut for display only


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing cells per column, most first. One aggregate, no shuffle of data."""
    df = nan_to_null(df)
    row = df.agg(*[F.count_if(col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    return row_to_rows(row, {"column": "string", "missing": "long"},
                       [(F.lit(c), F.col(f"_{i}")) for i, c in enumerate(df.columns)]
                       ).orderBy(F.desc("missing"), "column")


def _row_groups(df: DataFrame, *extra: Column) -> DataFrame:
    """Distinct rows with their number of copies (column ``_n``) and extra values that the row
    decides. Copies collapse before the shuffle; long texts travel as digests."""
    keys = [(text.digest_long(col(f.name)) if isinstance(f.dataType, T.StringType) else col(f.name))
            .alias(f"_k{i}") for i, f in enumerate(df.schema)]
    rows = df.select(*keys, *extra)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, rows that repeat an earlier row, and their percentage. NULLs compare equal."""
    rows, copies = F.sum("_n"), F.sum(F.col("_n") - 1)
    return _row_groups(nan_to_null(df)).agg(
        F.coalesce(rows, F.lit(0)).alias("rows"),
        F.coalesce(copies, F.lit(0)).alias("duplicate_rows"),
        _percent(copies, rows).alias("duplicate_pct"))


def _count_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))


def invalid_contact_cells(df: DataFrame) -> list[Column]:
    """Flags for filled contact cells that fail the format check, by column name."""
    flags = []
    for c in df.columns:
        kind = names.score_contact(c)
        if kind:
            cell = col(c).cast("string")
            valid = text.is_valid_email(cell) if kind == "email" else text.is_valid_phone(cell)
            flags.append(cell.isNotNull() & ~valid)
    return flags


def score(rows: Column, columns: int, missing: Column, duplicates: Column, invalid: Column) -> Column:
    """Completeness, repetition and contact validity on a scale of 0 to 100."""
    cells = rows * float(columns)
    raw = 100.0 * (1.0 - _MISSING_WEIGHT * missing / cells - _DUPLICATE_WEIGHT * duplicates / rows
                   - _INVALID_WEIGHT * F.least(invalid / cells, F.lit(1.0)))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    return F.when(rows > 0, round_half_up(bounded, 1)).otherwise(0.0) if columns else F.lit(0.0)


def status(score_: Column) -> Column:
    return (F.when(score_ >= 90, "Excellent").when(score_ >= 75, "Good")
            .when(score_ >= 50, "Needs Attention").otherwise("Poor"))


def quality(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, invalid contact cells, score, status.

    Missing and invalid cells are counted on the distinct rows and weighted by copies, so one
    pass and one shuffle yield all of it."""
    df = nan_to_null(df)
    missing = _count_true([col(c).isNull() for c in df.columns]).alias("_missing")
    invalid = _count_true(invalid_contact_cells(df)).alias("_invalid")
    n = F.col("_n")
    totals = _row_groups(df, missing, invalid).agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(a) for v, a in (
            (n, "rows"), (n * F.col("_missing"), "missing_cells"),
            (n - 1, "duplicate_rows"), (n * F.col("_invalid"), "invalid_contacts"))])
    scored = totals.withColumn("quality_score", score(
        F.col("rows").cast("double"), len(df.columns), F.col("missing_cells"),
        F.col("duplicate_rows"), F.col("invalid_contacts")))
    return scored.select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing_cells",
        "duplicate_rows", "invalid_contacts", "quality_score",
        status(F.col("quality_score")).alias("quality_status"))


@dataclass(frozen=True)
class Measures:
    """What several reports read of one table: its column statistics and its ``quality`` row."""
    columns: DataFrame
    quality: DataFrame


def measure(df: DataFrame) -> Measures:
    """Both are computed once and kept as literal tables of one row a column and one row."""
    return Measures(_kept(column_stats(df)), _kept(quality(df)))


def _kept(small: DataFrame) -> DataFrame:
    kinds = {f.name: {"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in small.schema}
    return literal_table(small.sparkSession, kinds, [tuple(r) for r in small.collect()])


def quality_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two ``quality`` rows as one before/after record."""
    both = (before.withColumn("_when", F.lit("before"))
            .unionByName(after.withColumn("_when", F.lit("after"))))
    pick = lambda c, when: F.max(F.when(F.col("_when") == when, F.col(c))).alias(f"{c}_{when}")
    return both.agg(*[pick(c, when) for c in (
        "rows", "columns", "missing_cells", "duplicate_rows", "quality_score")
        for when in ("before", "after")])


def quality_delta(summary: DataFrame) -> DataFrame:
    """Change from before to after for every measure of a summary."""
    delta = lambda c: F.col(f"{c}_after") - F.col(f"{c}_before")
    return summary.select(
        delta("rows").alias("rows_delta"), delta("missing_cells").alias("missing_delta"),
        delta("duplicate_rows").alias("duplicates_delta"),
        round_half_up(delta("quality_score"), 1).alias("score_delta"))

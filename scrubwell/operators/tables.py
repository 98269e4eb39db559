"""Helpers shared by the operators: small literal tables, the long (column, value) form of a
table, and staged copies in the cluster's shared folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest_long

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def literal_table(spark: SparkSession, schema: dict[str, str], rows) -> DataFrame:
    """A table of plan-time constants (one row per column, rule or vocabulary entry)."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(list(v), type=_ARROW[t]) for v, t in zip(columns, schema.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(schema)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of "missing": NaN in float columns becomes NULL. A no-op plan without any."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns])


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _comparable(field: T.StructField) -> tuple[str, Column]:
    """Type class and value of a field, widened losslessly so that few classes remain."""
    c, t = col(field.name), field.dataType
    if isinstance(t, _INTEGRAL):
        return "bigint", c.cast("bigint")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double", c.cast("double")
    if isinstance(t, T.StringType):
        return "string", digest_long(c)
    return t.simpleString(), c


def by_type(df: DataFrame, columns=None) -> dict[str, DataFrame]:
    """One long (column, value) table per type class.

    Unpivoting by class keeps values in their own type (no text form of numbers), and with a
    columnar source every column is still read once in total."""
    groups: dict[str, list[Column]] = {}
    for field in df.schema:
        if columns is None or field.name in columns:
            kind, value = _comparable(field)
            groups.setdefault(kind, []).append(value.alias(field.name))
    return {kind: long_form(df.select(*values)) for kind, values in groups.items()}


def long_form(df: DataFrame) -> DataFrame:
    """(column, value) rows of a table whose columns share one type."""
    return df.unpivot([], [col(c) for c in df.columns], "column", "value")


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, T.StructType) and any(_has_map(f.dataType) for f in t.fields)


def _entries(c: Column, t: T.DataType) -> Column:
    """A value in which every map is the array of its entries, in a canonical order."""
    if not _has_map(t):
        return c
    if isinstance(t, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(
            _entries(e["key"], t.keyType).alias("key"), _entries(e["value"], t.valueType).alias("value")))
        return F.array_sort(pairs)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _entries(x, t.elementType))
    return F.when(c.isNotNull(), F.struct(*[_entries(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))


def _maps(c: Column, t: T.DataType) -> Column:
    """The way back from ``_entries``."""
    if not _has_map(t):
        return c
    if isinstance(t, T.MapType):
        return F.map_from_entries(F.transform(c, lambda e: F.struct(
            _maps(e["key"], t.keyType).alias("key"), _maps(e["value"], t.valueType).alias("value"))))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _maps(x, t.elementType))
    return F.when(c.isNotNull(), F.struct(*[_maps(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))


def groupable(df: DataFrame) -> DataFrame:
    """The table with maps, which Spark cannot group, as arrays of entries."""
    if not any(_has_map(f.dataType) for f in df.schema):
        return df
    return df.select(*[_entries(col(f.name), f.dataType).alias(f.name) for f in df.schema])


def from_groupable(rows: DataFrame, like: DataFrame, *extra: str) -> DataFrame:
    """Rows of a groupable table with the types of ``like`` again, and extra columns."""
    if not any(_has_map(f.dataType) for f in like.schema):
        return rows
    return rows.select(*[_maps(col(f.name), f.dataType).alias(f.name) for f in like.schema], *map(col, extra))


def histogram(cells: DataFrame) -> DataFrame:
    """(column, value, n). Partial aggregation collapses hot values before the shuffle."""
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def row_to_rows(row: DataFrame, schema: dict[str, str], entries) -> DataFrame:
    """Turn a one-row aggregate into one row per entry; an entry is a tuple of columns."""
    names = list(schema)
    flat = [v.cast(t) for entry in entries for v, t in zip(entry, schema.values())]
    return row.select(F.stack(F.lit(len(entries)), *flat).alias(*names))


_local_folder: str | None = None
_holders: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables: the one the cluster names in ``spark.checkpoint.dir``.
    Only where that is unset and Spark runs on one machine is a temporary folder made."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="scrubwell-")
    return _local_folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: later passes read only the columns they need, and
    a lost executor costs no recomputation of the steps before."""
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stage``, with the folder, so that it can be discarded."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for held in _holders:
        held.append(path)
    with freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside the block remove their shuffle files as they end. Else these stay until the
    driver happens to collect its garbage, and a job of many writes holds them all at once."""
    was = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, was)


@contextmanager
def holding() -> Iterator[list[str]]:
    """The folders of all copies staged inside the block, for whoever releases them later."""
    held: list[str] = []
    _holders.append(held)
    try:
        yield held
    finally:
        _holders[:] = [h for h in _holders if h is not held]


def release(spark: SparkSession, held: list[str], keep: DataFrame | None = None) -> None:
    """Discard held copies, but for those that ``keep`` still reads."""
    if not held:
        return
    read = "\n".join(keep.inputFiles()) if keep is not None else ""
    for path in [p for p in held if p.rsplit("/", 1)[-1] not in read]:
        discard(spark, path)
        if path in held:
            held.remove(path)


def discard(spark: SparkSession, path: str) -> None:
    """Replace the files of a folder by an empty table, through the public writer, which works
    on every file system that Spark writes to."""
    spark.range(0).write.mode("overwrite").parquet(path)
    for held in _holders:
        if path in held:
            held.remove(path)

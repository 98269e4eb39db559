"""Readers. Text files load as text, so identifiers keep their leading zeros; typed sources load
as they are."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import col
from .records import read_records


MALFORMED = "_malformed"


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool | str = False, malformed: str = "fail",
             headers: str = "same") -> DataFrame:
    """All-text CSV with ``""`` quoting; empty fields stay empty strings, and rows with too few
    cells are filled up with them.

    Large files are read in ranges. ``multi_line=True`` is for cells with line breaks: a first pass
    counts the quotes of every range, so that each range finds the records that begin in it (see
    ``sources/records.py``); that takes balanced quotes, while ``multi_line="whole"`` reads each
    file in one piece, whatever its quotes. All files must have the header of the first, in its
    order; another one stops the read (only headers with repeated or empty names are not compared),
    unless ``headers="own"``: then every file is read by its own header, columns are those of all
    headers in the order they first occur, and a column that a file does not have is NULL there. A
    row with more cells than its header stops the read too, unless ``malformed="keep"``: then the
    rows come with the column ``_malformed``, the whole line of such a row, else NULL.
    """
    if malformed not in ("fail", "keep"):
        raise ValueError("malformed is 'fail' or 'keep'")
    if headers not in ("same", "own"):
        raise ValueError("headers is 'same' or 'own'")
    if multi_line not in (True, False, "whole") or headers == "own" and multi_line == "whole":
        raise ValueError("multi_line is False, True or 'whole', the last only with headers='same'")
    if multi_line is True or headers == "own":
        return _by_records(spark, path, malformed, headers)
    multi_line = multi_line == "whole"
    options = {"quote": '"', "escape": '"', "multiLine": multi_line, "encoding": "UTF-8"}
    names = spark.read.csv(path, header=True, **options).columns
    first = spark.read.csv(path, header=False, **options).first()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names]).add(MALFORMED, T.StringType())
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=first is None or list(first) != names, mode="PERMISSIVE",
                          columnNameOfCorruptRecord=MALFORMED, **options)
    # a record that does not fit has too few cells or too many
    separators = _separators(F.col(MALFORMED))
    # naming every column keeps the parser from skipping cells, which would hide a long row
    whole = F.octet_length(F.concat_ws("", *[col(n) for n in names])) >= 0
    line = F.when((separators >= len(names)) & whole, F.col(MALFORMED))
    if malformed == "fail":
        # a condition, so that it holds whichever columns are read
        rows = rows.where(_refused(line))
        return rows.select(*[col(n) for n in names]).na.fill("")
    return rows.select(*[F.coalesce(col(n), F.lit("")).alias(n) for n in names], line.alias(MALFORMED))


def _separators(record: Column) -> Column:
    """Separators outside quotes."""
    return F.length(F.regexp_replace(F.regexp_replace(record, r'"(?:[^"]|"")*+"', ""), "[^,]", ""))


def _refused(line: Column) -> Column:
    return F.when(line.isNotNull(), F.raise_error(F.concat(F.lit("too many cells: "), line))).otherwise(F.lit(True))


def _by_records(spark: SparkSession, path, malformed: str, headers: str) -> DataFrame:
    """Records parsed once, into as many cells as the widest header has; each column then takes the
    cell that the header of the record's file gives it."""
    records, columns = read_records(spark, path)
    if headers == "same" and len(columns) > 1:
        raise ValueError(f"a file has another header: {columns[1]} instead of {columns[0]}; see headers='own'")
    wide = max(map(len, columns), default=0)
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(wide)]).add(MALFORMED, T.StringType())
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    rows = records.select("header", "record", F.from_csv("record", cells.toDDL(), options).alias("cells"))
    names = list(dict.fromkeys(n for c in columns for n in c))

    def cell(name: str) -> Column:
        value = F.lit(None).cast("string")
        for number in reversed([i for i, c in enumerate(columns) if name in c]):
            own = F.coalesce(F.col(f"cells.c{columns[number].index(name)}"), F.lit(""))
            value = F.when(F.col("header") == number, own).otherwise(value)
        return value
    # only a record that does not fit the widest header, or one of another header, needs its cells counted
    width = F.get(F.array(*(F.lit(len(c)) for c in columns)), F.col("header")) if columns else F.lit(0)
    doubtful = F.col(f"cells.{MALFORMED}").isNotNull() | (width < wide)
    every = F.octet_length(F.concat_ws("", *(F.col(f"cells.c{i}") for i in range(wide)))) >= 0
    line = F.when(F.when(doubtful, _separators(F.col("record")) >= width).otherwise(F.lit(False)) & every, F.col("record"))
    if malformed == "fail":
        return rows.where(_refused(line)).select(*[cell(n).alias(n) for n in names])
    return rows.select(*[cell(n).alias(n) for n in names], line.alias(MALFORMED))


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Typed source (parquet, orc, json, avro …) or, with ``format="table"``, a catalog table."""
    if format == "csv":
        return read_csv(spark, path, **options)
    return spark.table(path) if format == "table" else spark.read.format(format).options(**options).load(path)


#: rows in one task from which dealing them out is worth a shuffle
FULL_TASK = 20_000


def balanced(df: DataFrame, full_task: int = FULL_TASK) -> DataFrame:
    """A source whose rows keep every core busy. A task reads whole row groups (or whole files), so a
    compact table of millions of rows may lie in one task. The rows of each task are counted, without
    reading a column; where one has over twice its share, all rows are dealt out over the cores, copies
    of a row as well. The operators' rules cost far more a row than this shuffle of source columns."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not tasks or max(tasks) < full_task or max(tasks) * cores <= 2 * sum(tasks):
        return df
    return df.repartition(2 * cores)

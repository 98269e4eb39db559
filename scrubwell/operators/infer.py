"""Semantic kind per column: evidence in one pass, decision on the evidence."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, parse, text, vocab
from .tables import col, literal_table, long_form, row_to_rows

# fixed values: evidence thresholds
MIN_CELLS = 3
NUMERIC_SHARE = 0.95
DATE_SHARE = 0.90
DATE_SHAPE_SHARE = 0.60
NAMED_DATE_SHARE = 0.80

NUMERIC_KINDS = ("numeric", "currency", "percentage")

EVIDENCE = ("filled", "non_blank", "numbers", "percent_signs", "currency_signs", "dates", "date_shapes", "not_boolean")


@dataclass(frozen=True)
class Evidence:
    filled: int = 0
    non_blank: int = 0
    numbers: int = 0
    percent_signs: int = 0
    currency_signs: int = 0
    dates: int = 0
    date_shapes: int = 0
    not_boolean: int = 0


def evidence_columns(t: Column, parsed: Column) -> dict[str, Column]:
    """Aggregates over trimmed cells and the numbers read from them. A cell that is a number
    is a date only in compact form, so most numbers skip the date patterns."""
    may_be_date = parsed.isNull() | F.length(t).isin(4, 8)
    return {
        "filled": F.count(t),
        "non_blank": F.count_if(t != ""),
        "numbers": F.count(parsed),
        "percent_signs": F.count_if(parse.has_percent(t)),
        "currency_signs": F.count_if(parse.has_currency(t)),
        "dates": F.count(F.when(may_be_date, parse.date_in(t))),
        "not_boolean": F.count_if(~parse.is_boolean_word(t)),
    }


def needs_date_shapes(name: str, e: Evidence) -> bool:
    """Whether the kind hangs on the share of date-shaped cells, which costs a scan of its own."""
    return (names.name_role(name) is None and not names.is_date_hint(name)
            and not (e.filled >= MIN_CELLS and e.numbers >= NUMERIC_SHARE * e.filled)
            and e.non_blank >= MIN_CELLS and e.dates >= DATE_SHARE * e.non_blank)


def date_shape_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Date-shaped cells, for the few columns whose kind hangs on them."""
    if not columns:
        return {}
    row = df.agg(*[F.count_if(parse.has_date_shape(col(c))).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def column_evidence(df: DataFrame, columns=None) -> DataFrame:
    """One row per text column with the counts a decision needs. A single pass: the long form
    is aggregated by column name map-side, so only a few rows per task are shuffled."""
    columns = names.text_columns(df) if columns is None else columns
    if not columns:
        return literal_table(df.sparkSession, {"column": "string", **{e: "long" for e in EVIDENCE}}, [])
    cells = long_form(df.select(*[text.trim(col(c)).alias(c) for c in columns]))
    cells = cells.withColumn("parsed", parse.number_in(F.col("value")))
    evidence = evidence_columns(F.col("value"), F.col("parsed"))
    evidence["date_shapes"] = F.count_if(parse.has_date_shape(F.col("value")))
    return cells.groupBy("column").agg(*[evidence[e].alias(e) for e in EVIDENCE])


def is_date_confident(e: Evidence, hinted: bool) -> bool:
    if e.non_blank < MIN_CELLS or e.dates < DATE_SHARE * e.non_blank:
        return False
    return hinted or e.date_shapes >= DATE_SHAPE_SHARE * e.non_blank


def decide_kind(name: str, dtype: T.DataType, e: Evidence = Evidence()) -> str:
    """Name first, then type, then values. Complex types have no kind of their own."""
    role = names.name_role(name)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return "other"
    if role:
        return role
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if names.is_date_hint(name) and is_date_confident(e, hinted=True):
        return "date"
    if e.filled >= MIN_CELLS and e.numbers >= NUMERIC_SHARE * e.filled:
        if e.percent_signs:
            return "percentage"
        return "currency" if e.currency_signs else "numeric"
    if is_date_confident(e, hinted=False):
        return "date"
    if e.filled >= MIN_CELLS and e.not_boolean == 0:
        return "boolean"
    return "text"


def infer_kinds(df: DataFrame) -> dict[str, str]:
    """Kind of every column; one job, and none when names and types decide everything."""
    undecided = [c for c in names.text_columns(df) if names.name_role(c) is None]
    found = {r["column"]: Evidence(*[r[e] for e in EVIDENCE])
             for r in column_evidence(df, undecided).collect()} if undecided else {}
    return {f.name: decide_kind(f.name, f.dataType, found.get(f.name, Evidence())) for f in df.schema}


def kind_table(df: DataFrame) -> DataFrame:
    kinds = infer_kinds(df)
    return literal_table(df.sparkSession, {"column": "string", "kind": "string"}, list(kinds.items()))


def scale_percentages(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage columns as fractions: cells with ``%`` are divided by 100; without any ``%`` in
    the column, all cells are if the largest lies above 1 and up to 100."""
    cells = {c: (text.trim(col(c)), parse.number(col(c).cast("string"))) for c in columns}
    row = df.agg(*[a for t, n in cells.values() for a in (F.count_if(parse.has_percent(t)), F.max(n))]).first()
    def scaled(i, c):
        t, n = cells[c]
        signs, largest = row[2 * i], row[2 * i + 1]
        if signs:
            return n / F.when(parse.has_percent(t), 100.0).otherwise(1.0)
        return n / 100.0 if largest is not None and 1 < largest <= 100 else n
    fractions = {c: scaled(i, c) for i, c in enumerate(columns)}
    return df.select(*[fractions[c].alias(c) if c in fractions else col(c) for c in df.columns])


# --- acceptance rules of the explicit-column converters -------------------------------------
def generic_number(c: Column) -> Column:
    """Number text with ``, ₹ $ €`` removed (no ``£``, no ``%``, no number words). Every number has a
    digit or the f of ``inf``, so most other cells cost one pattern."""
    return F.when(c.rlike("[0-9fF]"), parse.plain_number(text.trim(F.regexp_replace(c, "[,₹$€]", ""))))


def numeric_acceptance(df: DataFrame) -> DataFrame:
    """(column, filled, numbers, accepted): which text columns convert to numbers."""
    columns = [c for c in names.text_columns(df) if c.lower() not in vocab.RETAIL_NEVER_NUMERIC]
    return _acceptance(df, columns, _numeric_reader, "numbers",
                       lambda c: 0.0 if c in vocab.RETAIL_NUMERIC_COLUMNS else NUMERIC_SHARE)


def date_acceptance(df: DataFrame) -> DataFrame:
    """(column, filled, dates, accepted): which date- or time-named text columns convert."""
    columns = [c for c in names.text_columns(df) if "date" in c.lower() or "time" in c.lower()]
    return _acceptance(df, columns, lambda c: parse.date(col(c)), "dates", lambda c: NAMED_DATE_SHARE)


def _numeric_reader(c: str) -> Column:
    from .retail import discount, number_anywhere

    if c == "Discount":
        return discount(col(c))
    return number_anywhere(col(c)) if c in vocab.RETAIL_NUMERIC_COLUMNS else generic_number(col(c))


def convert_numbers(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The table with every accepted text column as double, and two counters: converted columns,
    and cells that became missing."""
    return _converted(df, numeric_acceptance(df), "numbers", _numeric_reader,
                      "Columns converted to numeric", "Invalid numeric values converted to missing")


def convert_dates(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The same for accepted date- or time-named text columns, as timestamps."""
    return _converted(df, date_acceptance(df), "dates", lambda c: parse.date(col(c)),
                      "Columns converted to dates", "Invalid date values converted to missing")


def _converted(df, acceptance, label, reader, columns_key, cells_key):
    accepted = {r["column"]: r["filled"] - r[label] for r in acceptance.where("accepted").collect()}
    out = df.select(*[reader(c).alias(c) if c in accepted else col(c) for c in df.columns])
    return out, {columns_key: len(accepted), cells_key: sum(accepted.values())}


def _acceptance(df, columns, reader, label, share) -> DataFrame:
    schema = {"column": "string", "filled": "long", label: "long", "share": "double"}
    if not columns:
        return (literal_table(df.sparkSession, schema, []).withColumn("accepted", F.lit(False)).drop("share"))
    row = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(col(c)).alias(f"f{i}"), F.count(reader(c)).alias(f"r{i}"))])
    rows = row_to_rows(row, schema, [
        (F.lit(c), F.col(f"f{i}"), F.col(f"r{i}"), F.lit(share(c))) for i, c in enumerate(columns)])
    return rows.select("column", "filled", label, (
        (F.col("filled") > 0) & (F.col(label) >= F.col("share") * F.col("filled"))).alias("accepted"))

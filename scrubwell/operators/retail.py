"""Opt-in rule pack for retail order tables. Nothing here runs unless it is called."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..functions.parse import number_word
from .profile import round_half_up
from .tables import col, literal_table, row_to_rows

# fixed values: allowed ranges; quantity must exceed 0, the others may equal their bounds
_RULES = {
    "Age": lambda x: (x < 18) | (x > 100),
    "Quantity": lambda x: x <= 0,
    "Unit_Price": lambda x: x < 0,
    "Sales": lambda x: x < 0,
    "Rating": lambda x: (x < 1) | (x > 5),
    "Discount": lambda x: (x < 0) | (x > 1),
}
_CONTACTS = {
    "Customer_Name": lambda c: text.title_case(text.collapse(c)),
    "Email": text.email,
    "Phone": lambda c: text.phone_ten(text.strip_decimal_zero(c)),
}
_SALES_TOLERANCE = 0.01
_SALES_COLUMNS = {"Quantity", "Unit_Price", "Discount", "Sales"}


def known_label(c: Column, column: str) -> Column:
    """Label from the column's vocabulary; unknown labels in title case."""
    plain = F.lower(text.collapse(c))
    return F.coalesce(text.lookup(plain, vocab.RETAIL_LABELS[column]), text.title_case(plain))


def standardize_known_labels(df: DataFrame) -> DataFrame:
    return df.select(*[
        known_label(col(c), c).alias(c) if c in vocab.RETAIL_LABELS else col(c) for c in df.columns])


def standardize_contacts(df: DataFrame) -> DataFrame:
    """Customer_Name in title case, Email in lower case, Phone as ten digits."""
    return df.select(*[_CONTACTS[c](col(c)).alias(c) if c in _CONTACTS else col(c) for c in df.columns])


_DECIMAL = r"-?[0-9]+(?:\.[0-9]+)?"


def number_anywhere(c: Column) -> Column:
    """First number found in a cell after number words, signs and commas are resolved. A cell that is
    nothing but a number costs one pattern."""
    t = F.lower(text.trim(c))
    bare = F.regexp_replace(t, f"[{vocab.CURRENCY_SIGNS},]", "")
    found = F.regexp_extract(bare, _DECIMAL, 0)
    return F.when(c.rlike(rf"\A{_DECIMAL}\z"), c.try_cast("double")).otherwise(
        F.coalesce(number_word(t), F.nullif(found, F.lit("")).try_cast("double")))


def discount(c: Column) -> Column:
    """Discount as a fraction: ``%`` or a bare number above 1 is divided by 100."""
    n = number_anywhere(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("%"), F.lit("")))
    return F.when(c.contains("%") | (n > 1), n / 100.0).otherwise(n)


def range_violations(df: DataFrame) -> dict[str, Column]:
    return {c: F.coalesce(rule(col(c).cast("double")), F.lit(False)) for c, rule in _RULES.items() if c in df.columns}


def apply_ranges(df: DataFrame) -> DataFrame:
    bad = range_violations(df)
    return df.select(*[F.when(~bad[c], col(c)).alias(c) if c in bad else col(c) for c in df.columns])


def fix_city_state(df: DataFrame) -> DataFrame:
    """State of a known city, filled in or corrected. A table without these columns stays as it is."""
    if not {"City", "State"} <= set(df.columns):
        return df
    expected = text.lookup(col("City"), vocab.CITY_STATE)
    return df.withColumn("State", F.coalesce(expected, col("State")))


def expected_sales() -> Column:
    q, p, d = (col(c).cast("double") for c in ("Quantity", "Unit_Price", "Discount"))
    return round_half_up(q * p * (1.0 - d), 2)


def is_sales_mismatch() -> Column:
    return F.coalesce(F.abs(col("Sales").cast("double") - expected_sales()) > _SALES_TOLERANCE, F.lit(False))


def reconcile_sales(df: DataFrame, fix: bool = False) -> DataFrame:
    """Flag rows whose Sales differ from quantity, price and discount; with ``fix`` rewrite them.
    A table without these columns stays as it is."""
    if not _SALES_COLUMNS <= set(df.columns):
        return df
    flagged = df.withColumn("sales_mismatch", is_sales_mismatch())
    if not fix:
        return flagged
    return flagged.withColumn("Sales", F.when(F.col("sales_mismatch"), expected_sales())
                              .otherwise(col("Sales").cast("double")))


def business_counters(df: DataFrame, fix_sales: bool = False) -> DataFrame:
    """(seq, action, count): what the ranges, the city rule and the sales rule find in a table, in
    one aggregate. Sales are compared after the range rules, as they are applied; rules whose
    columns are absent count nothing and, but for the totals, are left out."""
    bad = range_violations(df)
    actions = [(f"Invalid {c.replace('_', ' ')} values converted to missing", flag) for c, flag in bad.items()]
    kept = {c: F.when(~bad[c], col(c).cast("double")) if c in bad else col(c).cast("double") for c in _SALES_COLUMNS & set(df.columns)}
    if {"City", "State"} <= set(df.columns):
        expected = text.lookup(col("City").cast("string"), vocab.CITY_STATE)
        actions.append(("City/State consistency fixes", expected.isNotNull() & ~col("State").cast("string").eqNullSafe(expected)))
    mismatch = F.lit(False)
    if len(kept) == len(_SALES_COLUMNS):
        wanted = round_half_up(kept["Quantity"] * kept["Unit_Price"] * (1.0 - kept["Discount"]), 2)
        mismatch = F.coalesce(F.abs(kept["Sales"] - wanted) > _SALES_TOLERANCE, F.lit(False))
    row = df.agg(*[F.count_if(flag).alias(f"_{i}") for i, (_, flag) in enumerate(actions)], F.count_if(mismatch).alias("mismatch"))
    violations = sum((F.col(f"_{i}") for i in range(len(bad))), F.lit(0))
    entries = [(name, F.col(f"_{i}")) for i, (name, _) in enumerate(actions)]
    entries += [("Sales calculation mismatches", F.col("mismatch")),
                ("Sales values recalculated from business rule", F.col("mismatch") if fix_sales else F.lit(0)),
                ("Total business-rule violations", violations)]
    return row_to_rows(row, {"seq": "int", "action": "string", "count": "long"},
                       [(F.lit(i), F.lit(name), n) for i, (name, n) in enumerate(entries, 1)])


def label_counters(df: DataFrame) -> DataFrame:
    """(column, changed): cells that the known labels and the contact rules change, in one aggregate."""
    rules = {c: known_label(col(c), c) for c in df.columns if c in vocab.RETAIL_LABELS}
    rules |= {c: rule(col(c)) for c, rule in _CONTACTS.items() if c in df.columns}
    schema = {"column": "string", "changed": "long"}
    if not rules:
        return literal_table(df.sparkSession, schema, [])
    row = df.agg(*[F.count_if(text.changed_null_safe(col(c), new)).alias(f"_{i}") for i, (c, new) in enumerate(rules.items())])
    return row_to_rows(row, schema, [(F.lit(c), F.col(f"_{i}")) for i, c in enumerate(rules)])

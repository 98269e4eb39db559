"""Queries and oracles on unusual input: numeric identifiers, map columns, CSV files, counters."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import findings, infer, missing, retail
from ..operators.tables import shared_folder
from ..plans.clean import clean
from ..sources import tables as readers
from . import fixtures as fx
from . import sqltext as q
from .rows import MC_COLUMNS, RETAIL_TYPED, _EXPECTED, _anywhere, _discount, mc, retail_orders, retail_typed

CHECKS = {}


def check(name: str, sql: str):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn
    return add


@check("ids_mixed_types", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS customer_id, CAST(c_custkey AS VARCHAR) || '.25' AS tax_code,
  CAST(c_custkey * 10000000 AS VARCHAR) || '.5' AS sku_code, CAST(c_custkey % 3 + 1 AS VARCHAR) || '.0E39' AS ledger_code,
  CAST(c_custkey AS VARCHAR) || '.1250' AS postal_code FROM customer""")
def ids_mixed_types(spark, folder):
    return clean(fx.from_sql(spark, folder, fx.MI), analyze_outliers=False).data


def _with_maps(spark, folder):
    """Every vector twice: once with the map's entries in the other order."""
    rows = fx.table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    one = F.create_map(F.lit("label"), F.col("label").cast("long"), F.lit("half"), F.floor(F.col("vec_id") / 2))
    other = F.create_map(F.lit("half"), F.floor(F.col("vec_id") / 2), F.lit("label"), F.col("label").cast("long"))
    return rows.select("vec_id", "embedding", one.alias("notes")).union(rows.select("vec_id", "embedding", other.alias("notes")))


_MAPS = "SELECT DISTINCT vec_id, label::BIGINT AS label, floor(vec_id / 2)::BIGINT AS half, len(embedding)::BIGINT AS size FROM embeddings"


def _flat(df):
    return df.select("vec_id", F.col("notes")["label"].alias("label"), F.col("notes")["half"].alias("half"),
                     F.size("embedding").cast("long").alias("size"))


@check("dedupe_complex", _MAPS)
def dedupe_complex(spark, folder):
    return _flat(missing.dedupe(_with_maps(spark, folder)))


@check("clean_complex", f"SELECT CAST(vec_id AS VARCHAR) AS vec_id, label, half, size FROM ({_MAPS})")
def clean_complex(spark, folder):
    return _flat(clean(_with_maps(spark, folder), analyze_outliers=False).data)


@check("scan_csv", f"SELECT customer_id, coalesce(name, '') AS name, coalesce(email, '') AS email, coalesce(phone, '') AS phone, "
                   f"coalesce(amount, '') AS amount, coalesce(notes, '') AS notes FROM {q.MC}")
def scan_csv(spark, folder):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = mc(spark, folder)
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_csv(spark, path).select("customer_id", "name", "email", "phone", "amount", "notes")


def _csv_folder(spark) -> str:
    return f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"


def _write_csv(rows, path: str, mode: str = "error") -> None:
    """Cells keep their spaces; all are quoted, so that line breaks may stand in them."""
    rows.coalesce(1).write.csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="", mode=mode,
                               ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


_LINES = "'first line' || chr(10) || '\"second\", line' || chr(10) || chr(10) || name || chr(10)"


@check("scan_csv_ranges", "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in MC_COLUMNS if c != "notes")
       + f", coalesce({_LINES}, '') AS notes FROM {q.MC}")
def scan_csv_ranges(spark, folder):
    """Every column of one file whose cells hold line breaks, read in ranges."""
    path = _csv_folder(spark)
    _write_csv(mc(spark, folder).withColumn("notes", F.expr(_LINES)), path)
    return readers.read_csv(spark, path, multi_line=True)


_HALVES = ((0, ("customer_id", "name", "status")), (1, ("notes", "customer_id", "name")))


@check("scan_csv_headers", " UNION ALL ".join("SELECT " + ", ".join(
    f"coalesce({c}, '') AS {c}" if c in columns else f"NULL::VARCHAR AS {c}" for c in ("customer_id", "name", "status", "notes"))
    + f" FROM {q.MC} WHERE coalesce(length(name), 0) % 2 = {half}" for half, columns in _HALVES))
def scan_csv_headers(spark, folder):
    """Two files with other columns in another order, read as one table."""
    path = _csv_folder(spark)
    for half, columns in _HALVES:
        rows = mc(spark, folder).where(F.coalesce(F.length("name"), F.lit(0)) % 2 == half)
        _write_csv(rows.select(*columns), path, mode="append")
    return readers.read_csv(spark, path, headers="own")


_BAD = {"Quantity": "Quantity <= 0", "Unit_Price": "Unit_Price < 0", "Discount": "NOT Discount BETWEEN 0 AND 1",
        "Rating": "NOT Rating BETWEEN 1 AND 5", "Sales": "Sales < 0"}
_WITHIN = "(SELECT city, state, " + ", ".join(f"CASE WHEN NOT ({b}) THEN {c} END AS {c}" for c, b in _BAD.items()) + f" FROM {RETAIL_TYPED})"
_RETAIL_COUNTS = {
    **{f"Invalid {c.replace('_', ' ')} values converted to missing": f"SELECT count(*) FROM {RETAIL_TYPED} WHERE {b}" for c, b in _BAD.items()},
    "City/State consistency fixes": f"SELECT count(*) FROM (SELECT {q.case_map('city', retail.vocab.CITY_STATE)} AS e, state FROM {q.MO}) WHERE e IS NOT NULL AND e IS DISTINCT FROM state",
    "Sales calculation mismatches": f"SELECT count(*) FROM {_WITHIN} WHERE abs(Sales - {_EXPECTED}) > 0.01::DOUBLE",
    "Sales values recalculated from business rule": "SELECT 0",
    "Total business-rule violations": f"SELECT count(*) FILTER ({') + count(*) FILTER ('.join(_BAD.values())}) FROM {RETAIL_TYPED}",
}


@check("retail_counters", q.union(f"SELECT {q.quote(a)} AS action, CAST(({sql}) AS BIGINT) AS count" for a, sql in _RETAIL_COUNTS.items()))
def retail_counters(spark, folder):
    return retail.business_counters(retail_typed(spark, folder)).select("action", "count")


@check("retail_label_counters", f"SELECT 'City' AS \"column\", count(*) FILTER (city IS DISTINCT FROM "
       f"{q.case_map('lower(' + q.collapse('city') + ')', retail.vocab.RETAIL_LABELS['City'], q.title('lower(' + q.collapse('city') + ')'))})::BIGINT AS changed FROM {q.MO}")
def retail_label_counters(spark, folder):
    return retail.label_counters(retail_orders(spark, folder)).where(F.col("column") == "City")


_QUANTITY, _SALE, _OFF = _anywhere("quantity"), _anywhere("sales"), _discount("discount")


@check("retail_convert", f"SELECT order_id, {_QUANTITY} AS Quantity, {_SALE} AS Sales, {_OFF} AS Discount, category AS Category, "
       f"(SELECT count(quantity) - count({_QUANTITY}) + count(sales) - count({_SALE}) + count(discount) - count({_OFF}) FROM {q.MO})::BIGINT AS invalid, "
       f"3::BIGINT AS columns FROM {q.MO}")
def retail_convert(spark, folder):
    orders = retail_orders(spark, folder).select("order_id", "Quantity", "Sales", "Discount", "Category")
    out, counters = infer.convert_numbers(orders)
    columns, invalid = counters.values()
    return out.withColumns({"columns": F.lit(columns).cast("long"), "invalid": F.lit(invalid).cast("long")})


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@check("date_convert", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 40 <> 0 THEN CAST({_DAY} AS TIMESTAMP) END AS order_date, o_orderpriority,
  (SELECT count(*) FROM orders WHERE o_orderkey % 40 = 0)::BIGINT AS invalid FROM orders""")
def date_convert(spark, folder):
    orders = fx.table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 40 == 0, "not known").otherwise(day)
    out, counters = infer.convert_dates(orders.select("o_orderkey", text.alias("order_date"), "o_orderpriority"))
    return out.withColumn("order_date", F.col("order_date").cast("timestamp_ntz")).withColumn(
        "invalid", F.lit(counters["Invalid date values converted to missing"]).cast("long"))


@check("report_summary", f"SELECT count(*)::BIGINT AS rows, {len(fx.MT_KINDS)}::BIGINT AS columns, "
       f"sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in fx.MT_KINDS)})::BIGINT AS missing_cells, 0::BIGINT AS duplicate_rows FROM {fx.oracle('(' + fx.MT.replace('STRING', 'VARCHAR') + ')')} t")
def report_summary(spark, folder):
    summary = findings.report(fx.from_sql(spark, folder, fx.MT)).summary
    return summary.select("rows", "columns", "missing_cells", "duplicate_rows")


# every written form of a date, one for each remainder of the key: (pattern, what it keeps)
_FORMS = [
    ("yyyy-MM-dd", "day"), ("yyyy/M/d", "day"), ("yyyy.MM.dd", "day"), ("yyyy-MM-dd '13:05'", "clock"), ("yyyy-MM-dd'T13:05:00'", "clock"),
    ("yyyy-MM-dd'T13:05:00Z'", "clock"), ("yyyy-MM-dd'T18:35:00+05:30'", "clock"), ("yyyy-MM-dd '1:05 PM'", "clock"), ("MM/dd/yyyy", "day"),
    ("M-d-yyyy", "day"), ("MM.dd.yyyy", "day"), ("M/d/yy", "day"), ("MM/dd/yyyy '13:05'", "clock"), ("d MMM yyyy", "day"), ("d-MMM-yyyy", "day"),
    ("d MMMM yyyy", "day"), ("MMM d, yyyy", "day"), ("MMMM d yyyy", "day"), ("MMM yyyy", "month"), ("MMMM-yyyy", "month"),
    ("yyyyMMdd", "day"), ("yyyy", "year"), ("yyyy-MM", "month"), ("d/M/yyyy", "late")]
_KEPT = {"day": "o_orderdate", "clock": "o_orderdate + INTERVAL 785 MINUTE", "month": "date_trunc('month', o_orderdate)",
         "year": "date_trunc('year', o_orderdate)",
         # the first number is the month unless it cannot be one
         "late": "CASE WHEN day(o_orderdate) > 12 THEN o_orderdate ELSE make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END"}


@check("parse_date_forms", "SELECT o_orderkey, CASE o_orderkey % 24 " + " ".join(
    f"WHEN {i} THEN CAST({_KEPT[kept]} AS TIMESTAMP)" for i, (_, kept) in enumerate(_FORMS)) + " END AS ordered FROM orders")
def parse_date_forms(spark, folder):
    orders = fx.table(spark, folder, "orders")
    written = F.lit(None).cast("string")
    for i, (pattern, _) in enumerate(_FORMS):
        written = F.when(F.col("o_orderkey") % len(_FORMS) == i, F.date_format("o_orderdate", pattern)).otherwise(written)
    return orders.select("o_orderkey", parse.date(written).alias("ordered"))

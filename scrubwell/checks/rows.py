"""Queries and oracles: sources, names, text, parsing, validation and the retail rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, parse, text, vocab
from ..operators import infer, missing, retail, validate
from ..operators.tables import literal_table
from ..sources import sinks, tables as readers
from . import fixtures as fx
from . import sqltext as q

CHECKS = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn
    return add


def mc(spark, folder):
    return fx.from_sql(spark, folder, fx.MC)


def mo(spark, folder):
    return fx.from_sql(spark, folder, fx.MO)


RETAIL_NAMES = {
    "city": "City", "state": "State", "quantity": "Quantity", "unit_price": "Unit_Price", "discount": "Discount",
    "sales": "Sales", "rating": "Rating", "order_status": "Order_Status", "payment_method": "Payment_Method",
    "sales_channel": "Sales_Channel", "category": "Category",
}


def retail_orders(spark, folder):
    return mo(spark, folder).withColumnsRenamed(RETAIL_NAMES)


def pick(**columns: str) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


# --- sources and sinks ----------------------------------------------------------------------
EVENT_KINDS = {"event_id": "id", "ts": "date", "user_id": "id", "event_type": "text", "value": "numeric", "props": "text"}


@check("scan_typed", q.union(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS filled FROM events" for c, k in EVENT_KINDS.items()))
def scan_typed(spark, folder):
    events = readers.read_table(spark, f"{folder}/events.parquet")
    filled = missing.filled_counts(events)
    return infer.kind_table(events).join(F.broadcast(literal_table(
        spark, {"column": "string", "filled": "long"}, list(filled.items()))), "column")


@check("export_prepare", f"SELECT customer_id, regexp_replace({q.trim('phone')}, '\\.0\\z', '') AS phone, email FROM {q.MC}")
def export_prepare(spark, folder):
    return sinks.prepare_export(mc(spark, folder)).select("customer_id", "phone", "email")


@check("preview_topn", f"SELECT customer_id, name, segment FROM {q.MC} ORDER BY customer_id LIMIT 100")
def preview_topn(spark, folder):
    return sinks.preview(mc(spark, folder), order_by=["customer_id"]).select("customer_id", "name", "segment")


# --- names ----------------------------------------------------------------------------------
@check("names_standardized", f"SELECT {pick(Customer_ID='customer_id', Full_Name='name', Name='segment', name_1='status', E_mail='email', Unnamed_Column='age')} FROM {q.MC}")
def names_standardized(spark, folder):
    raw = mc(spark, folder).select("customer_id", "name", "segment", "status", "email", "age")
    return names.standardize_names(raw.toDF(" Customer  ID ", "Full/Name", "_Name_", "name", "E-mail!", " -- "))


ROLES = ("is_id", "is_email", "is_phone", "is_percent", "is_currency", "is_date_hint", "is_name")
MC_ROLES = {"customer_id": "is_id", "name": "is_name", "email": "is_email", "phone": "is_phone", "amount": "is_currency",
            "conversion_rate": "is_percent", "joined": "is_date_hint"}
MC_COLUMNS = ("customer_id", "name", "email", "phone", "age", "amount", "conversion_rate", "status", "department",
              "gender", "is_active", "joined", "segment", "notes", "blank_col", "const_col")


@check("column_roles", q.union(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, " + ", ".join(
        f"{str(MC_ROLES.get(c) == r).upper()} AS {r}" for r in ROLES) + f" FROM {q.MC}" for c in MC_COLUMNS))
def column_roles(spark, folder):
    df = mc(spark, folder)
    rows = [(c, n, *[getattr(names, r)(c) for r in ROLES]) for c, n in missing.filled_counts(df).items()]
    return literal_table(spark, {"column": "string", "filled": "long", **{r: "boolean" for r in ROLES}}, rows)


# --- text -----------------------------------------------------------------------------------
@check("missing_tokens", f"SELECT customer_id, {pick(**{c: q.tokens(c) for c in ('age', 'amount', 'gender', 'status')})} FROM {q.MC}")
def missing_tokens(spark, folder):
    return mc(spark, folder).select("customer_id", *[
        text.missing_tokens(F.col(c)).alias(c) for c in ("age", "amount", "gender", "status")])


@check("missing_tokens_basic", "SELECT customer_id, " + pick(**{
    c: f"CASE WHEN lower({q.trim(c)}) IN {q.in_list(vocab.BASIC_MISSING_TOKENS)} THEN NULL ELSE {c} END"
    for c in ("age", "amount", "status")}) + f" FROM {q.MC}")
def missing_tokens_basic(spark, folder):
    return mc(spark, folder).select("customer_id", *[
        text.basic_missing_tokens(F.col(c)).alias(c) for c in ("age", "amount", "status")])


@check("basic_token_counts", q.union(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (lower({q.trim(c)}) IN {q.in_list(vocab.BASIC_MISSING_TOKENS)}) AS emptied FROM {q.MC}" for c in MC_COLUMNS))
def basic_token_counts(spark, folder):
    return missing.basic_token_counts(mc(spark, folder))


@check("text_whitespace", f"SELECT doc_id, {q.collapse('text')} AS clean_text FROM documents")
def text_whitespace(spark, folder):
    return fx.table(spark, folder, "documents").select("doc_id", text.collapse(F.col("text")).alias("clean_text"))


@check("name_title_case", f"SELECT customer_id, {q.title(q.collapse('name'))} AS name FROM {q.MC}")
def name_title_case(spark, folder):
    return mc(spark, folder).select("customer_id", text.title_case(text.collapse(F.col("name"))).alias("name"))


@check("email_normalize", f"SELECT customer_id, lower({q.trim('email')}) AS email FROM {q.MC}")
def email_normalize(spark, folder):
    return mc(spark, folder).select("customer_id", text.email(F.col("email")).alias("email"))


@check("phone_normalize", f"SELECT customer_id, {q.phone('phone')} AS phone FROM {q.MC}")
def phone_normalize(spark, folder):
    return mc(spark, folder).select("customer_id", text.phone(F.col("phone")).alias("phone"))


@check("cell_change_counts", q.union(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} <> {q.tokens(c)}) AS changed, "
    f"count(*) FILTER ({c} IS DISTINCT FROM {q.tokens(c)}) AS changed_null_safe FROM {q.MC}" for c in MC_COLUMNS))
def cell_change_counts(spark, folder):
    return missing.token_changes(mc(spark, folder))


# --- numbers, truth values, dates -----------------------------------------------------------
@check("parse_numeric", "SELECT order_id, " + ", ".join(
    f"{q.number(c)} AS {c}, contains({c}, '%') AS {c}_percent, regexp_matches({c}, '[₹$€£]') AS {c}_currency"
    for c in ("quantity", "unit_price", "discount", "sales")) + f" FROM {q.MO}")
def parse_numeric(spark, folder):
    return mo(spark, folder).select("order_id", *[x for c in ("quantity", "unit_price", "discount", "sales") for x in (
        parse.number(F.col(c)).alias(c), parse.has_percent(F.col(c)).alias(f"{c}_percent"),
        parse.has_currency(F.col(c)).alias(f"{c}_currency"))])


_CELL_SCALE = lambda c: f"CASE WHEN contains({c}, '%') THEN {q.number(c)} / 100.0::DOUBLE ELSE {q.number(c)} END"


@check("percent_scale", f"SELECT order_id, {_CELL_SCALE('discount')} AS discount, "
       f"{q.number('quantity')} / 100.0::DOUBLE AS quantity, {q.number('sales')} AS sales FROM {q.MO}")
def percent_scale(spark, folder):
    scaled = infer.scale_percentages(mo(spark, folder), ["discount", "quantity", "sales"])
    return scaled.select("order_id", "discount", "quantity", "sales")


@check("parse_boolean", f"SELECT customer_id, CASE WHEN lower({q.trim('is_active')}) IN {q.in_list(vocab.TRUE_WORDS)} THEN TRUE "
       f"WHEN lower({q.trim('is_active')}) IN {q.in_list(vocab.FALSE_WORDS)} THEN FALSE END AS is_active FROM {q.MC}")
def parse_boolean(spark, folder):
    return mc(spark, folder).select("customer_id", parse.boolean(F.col("is_active")).alias("is_active"))


@check("parse_date_mixed", f"SELECT customer_id, {q.date('joined')} AS joined, NULL::TIMESTAMP AS not_a_date FROM {q.MC}")
def parse_date_mixed(spark, folder):
    return mc(spark, folder).select("customer_id", parse.date(F.col("joined")).alias("joined"),
                                    parse.date(F.col("notes")).alias("not_a_date"))


@check("id_as_text", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, l_linenumber FROM lineitem")
def id_as_text(spark, folder):
    ids = lambda c: text.trim(F.col(c).cast("string")).alias(c)
    return fx.table(spark, folder, "lineitem").select(ids("l_orderkey"), ids("l_partkey"), "l_linenumber")


# --- validation -----------------------------------------------------------------------------
_VALID_EMAIL = f"CASE WHEN {q.is_email('lower(' + q.trim('email') + ')')} THEN lower({q.trim('email')}) END"
_VALID_PHONE = f"CASE WHEN {q.is_phone(q.phone('phone'))} THEN {q.phone('phone')} END"


@check("validate_email", f"SELECT customer_id, {_VALID_EMAIL} AS email FROM {q.MC}")
def validate_email(spark, folder):
    return validate.validate_email(mc(spark, folder), "email").select("customer_id", "email")


@check("validate_phone", f"SELECT customer_id, {_VALID_PHONE} AS phone FROM {q.MC}")
def validate_phone(spark, folder):
    return validate.validate_phone(mc(spark, folder), "phone").select("customer_id", "phone")


@check("validate_phone_in", f"SELECT customer_id, {q.phone_ten('phone')} AS phone FROM {q.MC}")
def validate_phone_in(spark, folder):
    return validate.validate_phone_ten(mc(spark, folder), "phone").select("customer_id", "phone")


@check("contact_counts", q.union(
    f"SELECT 'Invalid {what} values {ending}' AS action, count({c}) - count({valid}) AS count FROM {q.MC}"
    for what, c, valid in (("email", "email", _VALID_EMAIL), ("phone", "phone", q.phone_ten("phone")))
    for ending in ("detected", "converted to missing")))
def contact_counts(spark, folder):
    return validate.contact_counts(mc(spark, folder), email="email", phone="phone")


@check("semantic_ranges", f"SELECT order_id, CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS rating, "
       f"CASE WHEN qty >= 0 THEN qty END AS quantity FROM (SELECT order_id, rating, {q.number('quantity')} AS qty FROM {q.MO})")
def semantic_ranges(spark, folder):
    typed = mo(spark, folder).select("order_id", "rating", parse.number(F.col("quantity")).alias("quantity"))
    return validate.apply_semantic_ranges(typed)


# --- retail rules ---------------------------------------------------------------------------
def _known(c: str) -> str:
    plain = f"lower({q.collapse(c)})"
    return q.case_map(plain, vocab.RETAIL_LABELS[RETAIL_NAMES[c]], q.title(plain))


_RETAIL_LABELS = ("city", "state", "order_status", "payment_method", "sales_channel", "category")


@check("retail_categories", "SELECT order_id, " + ", ".join(f"{_known(c)} AS {RETAIL_NAMES[c]}" for c in _RETAIL_LABELS) + f" FROM {q.MO}")
def retail_categories(spark, folder):
    return retail.standardize_known_labels(retail_orders(spark, folder)).select(
        "order_id", *[RETAIL_NAMES[c] for c in _RETAIL_LABELS])


_NO_TAIL = "regexp_replace(" + q.trim("phone") + ", '\\.0\\z', '')"


@check("retail_contacts", f"SELECT customer_id, {q.title(q.collapse('name'))} AS Customer_Name, "
       f"lower({q.trim('email')}) AS Email, {q.phone_ten(_NO_TAIL)} AS Phone FROM {q.MC}")
def retail_contacts(spark, folder):
    named = mc(spark, folder).select("customer_id", F.col("name").alias("Customer_Name"),
                                     F.col("email").alias("Email"), F.col("phone").alias("Phone"))
    return retail.standardize_contacts(named)


def _anywhere(x: str) -> str:
    t = f"lower({q.trim(x)})"
    found = f"regexp_extract(regexp_replace({t}, '[₹$€£,]', '', 'g'), '-?[0-9]+(\\.[0-9]+)?')"
    words = " ".join(f"WHEN {q.quote(w)} THEN CAST({n} AS DOUBLE)" for w, n in vocab.NUMBER_WORDS.items())
    return f"CASE {t} {words} ELSE TRY_CAST(nullif({found}, '') AS DOUBLE) END"


def _discount(x: str) -> str:
    n = _anywhere(f"replace(replace({x}, ' ', ''), '%', '')")
    return f"CASE WHEN contains({x}, '%') OR {n} > 1 THEN {n} / 100.0::DOUBLE ELSE {n} END"


RETAIL_TYPED = (f"(SELECT order_id, city, state, {_anywhere('quantity')} AS Quantity, {_anywhere('unit_price')} AS Unit_Price, "
                f"{_discount('discount')} AS Discount, {_anywhere('sales')} AS Sales, CAST(rating AS DOUBLE) AS Rating FROM {q.MO})")


def retail_typed(spark, folder):
    number = lambda c: retail.number_anywhere(F.col(c)).alias(c)
    return retail_orders(spark, folder).select(
        "order_id", "City", "State", number("Quantity"), number("Unit_Price"),
        retail.discount(F.col("Discount")).alias("Discount"), number("Sales"), F.col("Rating").cast("double").alias("Rating"))


@check("retail_parse_number", f"SELECT order_id, Quantity, Unit_Price, Sales FROM {RETAIL_TYPED}")
def retail_parse_number(spark, folder):
    return retail_typed(spark, folder).select("order_id", "Quantity", "Unit_Price", "Sales")


@check("retail_parse_discount", f"SELECT order_id, Discount FROM {RETAIL_TYPED}")
def retail_parse_discount(spark, folder):
    return retail_typed(spark, folder).select("order_id", "Discount")


@check("retail_ranges", "SELECT order_id, CASE WHEN Quantity > 0 THEN Quantity END AS Quantity, "
       "CASE WHEN Unit_Price >= 0 THEN Unit_Price END AS Unit_Price, CASE WHEN Sales >= 0 THEN Sales END AS Sales, "
       f"CASE WHEN Rating BETWEEN 1 AND 5 THEN Rating END AS Rating, CASE WHEN Discount BETWEEN 0 AND 1 THEN Discount END AS Discount FROM {RETAIL_TYPED}")
def retail_ranges(spark, folder):
    return retail.apply_ranges(retail_typed(spark, folder)).select(
        "order_id", "Quantity", "Unit_Price", "Sales", "Rating", "Discount")


@check("retail_city_state", f"SELECT order_id, {_known('city')} AS City, coalesce({q.case_map(_known('city'), vocab.CITY_STATE)}, state) AS State FROM {q.MO}")
def retail_city_state(spark, folder):
    orders = retail_orders(spark, folder).withColumn("City", retail.known_label(F.col("City"), "City"))
    return retail.fix_city_state(orders).select("order_id", "City", "State")


_EXPECTED = q.half_up("Quantity * Unit_Price * (1.0::DOUBLE - Discount)", 2)


@check("retail_sales_check", f"SELECT order_id, coalesce(abs(Sales - {_EXPECTED}) > 0.01::DOUBLE, FALSE) AS sales_mismatch, "
       f"CASE WHEN abs(Sales - {_EXPECTED}) > 0.01::DOUBLE THEN {_EXPECTED} ELSE Sales END AS Sales FROM {RETAIL_TYPED}")
def retail_sales_check(spark, folder):
    return retail.reconcile_sales(retail_typed(spark, folder), fix=True).select("order_id", "sales_mismatch", "Sales")

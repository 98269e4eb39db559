"""Queries and oracles: kind inference and category labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text, vocab
from ..operators import infer, labels
from . import fixtures as fx
from . import sqltext as q
from .rows import MC_COLUMNS, RETAIL_NAMES, mc, mo, retail_orders

CHECKS = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn
    return add


def ml(spark, folder):
    return fx.from_sql(spark, folder, fx.ML)


# --- inference ------------------------------------------------------------------------------
_SHAPE = (r"(?i)[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}"
          r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b")
_NAME_ROLE = {"customer_id": "id", "email": "email", "phone": "phone", "amount": "currency", "conversion_rate": "percentage"}


def _evidence(c: str) -> str:
    words = q.in_list(vocab.TRUE_WORDS + vocab.FALSE_WORDS)
    return (f"SELECT '{c}' AS \"column\", {q.quote(_NAME_ROLE.get(c, ''))} AS role, {str(c == 'joined').upper()} AS hinted, "
            f"count({c}) AS filled, count(*) FILTER ({q.trim(c)} <> '') AS non_blank, count({q.number(c)}) AS numbers, "
            f"count(*) FILTER (contains({c}, '%')) AS percent_signs, "
            f"count(*) FILTER (regexp_matches({c}, '[₹$€£]')) AS currency_signs, count({q.date(c)}) AS dates, "
            f"count(*) FILTER (regexp_matches({c}, '{_SHAPE}')) AS date_shapes, "
            f"count(*) FILTER (lower({q.trim(c)}) NOT IN {words}) AS not_boolean FROM {q.MC}")


_EVIDENCE = f"({q.union(map(_evidence, MC_COLUMNS))})"


@check("infer_kinds", f"""
SELECT "column", filled, numbers, CASE WHEN role <> '' THEN role
  WHEN hinted AND non_blank >= 3 AND dates >= 0.9 * non_blank THEN 'date'
  WHEN filled >= 3 AND numbers >= 0.95 * filled AND percent_signs > 0 THEN 'percentage'
  WHEN filled >= 3 AND numbers >= 0.95 * filled AND currency_signs > 0 THEN 'currency'
  WHEN filled >= 3 AND numbers >= 0.95 * filled THEN 'numeric'
  WHEN non_blank >= 3 AND dates >= 0.9 * non_blank AND date_shapes >= 0.6 * non_blank THEN 'date'
  WHEN filled >= 3 AND not_boolean = 0 THEN 'boolean' ELSE 'text' END AS kind FROM {_EVIDENCE}""")
def infer_kinds(spark, folder):
    df = mc(spark, folder)
    return infer.column_evidence(df).select("column", "filled", "numbers").join(
        F.broadcast(infer.kind_table(df)), "column")


@check("date_confidence", f"""
SELECT "column", non_blank, dates, date_shapes, non_blank >= 3 AND dates >= 0.9 * non_blank AS confident_hinted,
  non_blank >= 3 AND dates >= 0.9 * non_blank AND date_shapes >= 0.6 * non_blank AS confident FROM {_EVIDENCE}""")
def date_confidence(spark, folder):
    parsed = (F.col("non_blank") >= infer.MIN_CELLS) & (F.col("dates") >= infer.DATE_SHARE * F.col("non_blank"))
    return infer.column_evidence(mc(spark, folder)).select(
        "column", "non_blank", "dates", "date_shapes", parsed.alias("confident_hinted"),
        (parsed & (F.col("date_shapes") >= infer.DATE_SHAPE_SHARE * F.col("non_blank"))).alias("confident"))


def _generic(x: str) -> str:
    bare = q.trim(f"regexp_replace({x}, '[,₹$€]', '', 'g')")
    return f"CASE WHEN regexp_matches({bare}, '(?i)\\A[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?\\z') THEN 1 END"


def _accept_numeric(c: str) -> str:
    from .rows import _anywhere, _discount
    name = RETAIL_NAMES.get(c, c)
    explicit = name in vocab.RETAIL_NUMERIC_COLUMNS
    number = _discount(c) if name == "Discount" else _anywhere(c) if explicit else _generic(c)
    rule = "count({0}) > 0" if explicit else "count({0}) > 0 AND count({1}) >= 0.95 * count({0})"
    return (f"SELECT '{name}' AS \"column\", count({c}) AS filled, count({number}) AS numbers, "
            f"{rule.format(c, number)} AS accepted FROM {q.MO}")


_MO_TEXT = ("city", "state", "quantity", "unit_price", "discount", "sales", "order_status", "payment_method",
            "sales_channel", "category")


@check("numeric_acceptance", q.union(map(_accept_numeric, _MO_TEXT)))
def numeric_acceptance(spark, folder):
    return infer.numeric_acceptance(retail_orders(spark, folder))


@check("date_acceptance", q.union(
    f"SELECT '{alias}' AS \"column\", count({c}) AS filled, count({q.date(c)}) AS dates, "
    f"count({c}) > 0 AND count({q.date(c)}) >= 0.8 * count({c}) AS accepted FROM {q.MC}"
    for c, alias in (("joined", "joined_date"), ("notes", "note_time"))))
def date_acceptance(spark, folder):
    named = mc(spark, folder).withColumnsRenamed({"joined": "joined_date", "notes": "note_time"})
    return infer.date_acceptance(named)


# --- labels ---------------------------------------------------------------------------------
_HIST = q.union(f"SELECT '{c}' AS \"column\", {q.collapse(c)} AS value FROM {q.ML} WHERE {c} IS NOT NULL"
                for c, *_ in q.ML_TRAITS)


@check("value_counts", f'SELECT "column", value, count(*) AS cnt FROM ({_HIST}) GROUP BY ALL')
def value_counts(spark, folder):
    return labels.value_counts(ml(spark, folder))


_LIMITS = q.values([(c, hinted) for c, hinted, *_ in q.ML_TRAITS])


@check("category_candidates", f"""
SELECT "column", hinted, count(DISTINCT value) AS "distinct", count(value) AS filled,
  count(DISTINCT value) BETWEEN 1 AND CASE WHEN hinted THEN 200 ELSE 50 END AS eligible
FROM ({_HIST}) h JOIN {_LIMITS} t(name, hinted) ON t.name = h."column" GROUP BY "column", hinted""")
def category_candidates(spark, folder):
    return labels.label_sizes(ml(spark, folder))


_ML_DICT = q.dictionary(q.ML, q.ML_TRAITS)


def _rule(name: str, column: str, key: str | None = None):
    extra = f", {key[0]} AS {key[1]}" if key else ""
    sql = f'WITH {_ML_DICT} SELECT "column", value, cnt{extra}, {column} FROM rules'

    def query(spark, folder):
        keys = [key[1]] if key else []
        return labels.label_groups(ml(spark, folder)).select("column", "value", "cnt", *keys, column)
    CHECKS[name] = (query, sql)


_rule("category_format_variants", "k3", ("fk", "format_key"))
_rule("category_compact_variants", "k4", ("ck", "compact_key"))
_rule("category_gender", "k5")
_rule("category_generic_alias", "k5b")
_rule("category_semantic", "k6")
_rule("category_boolean", "k7")
_rule("category_plural", "k8", ("pk", "plural_key"))


#: label of the column division -> the label it takes after where that is twice as frequent, as found by hand
_MISSPELLED = {"enginering": "engineering", "Finnance": "finance", "Engineering": "engineering"}


def _repaired(take: str, otherwise: str) -> str:
    """What a misspelled label takes from its model, where the model is frequent enough."""
    cases = " ".join(
        f"WHEN d.\"column\" = 'division' AND d.value = '{wrong}' AND EXISTS (SELECT 1 FROM dict m WHERE m.\"column\" = 'division' "
        f"AND m.value = '{right}' AND m.cnt >= greatest(2, 2 * d.cnt)) THEN (SELECT {take} FROM dict m WHERE m.\"column\" = 'division' AND m.value = '{right}')"
        for wrong, right in _MISSPELLED.items())
    return f"CASE {cases} ELSE {otherwise} END"


@check("category_spelling", f"WITH {_ML_DICT} SELECT d.\"column\", value, cnt, label AS resolved, {_repaired('m.label', 'NULL')} AS k9 FROM dict d")
def category_spelling(spark, folder):
    return labels.label_dictionary(ml(spark, folder)).select("column", "value", "cnt", "resolved", "k9")


@check("category_title", f"WITH {_ML_DICT} SELECT d.\"column\", value, cnt, {_repaired('m.canonical', 'canonical')} AS canonical FROM dict d")
def category_title(spark, folder):
    return labels.label_dictionary(ml(spark, folder)).select("column", "value", "cnt", "canonical")


_APPLIED = ", ".join(
    f"coalesce((SELECT canonical FROM dict WHERE dict.\"column\" = '{c}' AND dict.value = {q.collapse('s.' + c)}), "
    f"{q.collapse('s.' + c)}) AS {c}" for c, *_ in q.MO_TRAITS)


@check("category_apply", f"WITH {q.dictionary(q.MO, q.MO_TRAITS)} SELECT order_id, {_APPLIED} FROM {q.MO} s")
def category_apply(spark, folder):
    wanted = [c for c, *_ in q.MO_TRAITS]
    return labels.normalize_labels(mo(spark, folder).select("order_id", *wanted))


def _alias(c: str) -> str:
    return q.case_map(f"lower({q.trim(c)})", vocab.SEMANTIC_LABELS[c], c)


@check("semantic_aliases", f"SELECT {', '.join(f'{_alias(c)} AS {c}' for c in ('employment_type', 'education'))}, skill FROM {q.ML}")
def semantic_aliases(spark, folder):
    return labels.apply_semantic_aliases(ml(spark, folder).select("employment_type", "education", "skill"))

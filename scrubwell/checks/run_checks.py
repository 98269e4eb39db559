"""Queries and oracles: the whole cleaning run, its audit log, and the run history."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import missing
from ..operators.tables import shared_folder
from ..plans.clean import clean
from ..sources import history
from . import sqltext as q
from .aggregate_checks import _quality_sql, mc_dup
from .rows import MC_COLUMNS

CHECKS = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn
    return add


# --- the cleaned table in SQL, stage by stage -------------------------------------------------
_LABELLED = [("status", True, False, False, "status"), ("department", True, False, False, "department"),
             ("gender", False, True, False, "gender"), ("segment", True, False, False, "segment")]
_TOKEN_FREE = "SELECT " + ", ".join(f"{q.tokens(c)} AS {c}" for c in MC_COLUMNS) + f" FROM {q.MC_DUP}"
_SPELLED = ("SELECT * REPLACE (" + ", ".join(
    f"{rule} AS {c}" for c, rule in {**{c: q.collapse(c) for c in MC_COLUMNS}, "email": "lower(email)",
                                     "phone": q.phone("phone"), "name": q.title(q.collapse("name"))}.items()) + ") FROM free")
_LABEL = lambda c: (f"coalesce((SELECT canonical FROM dict WHERE dict.\"column\" = '{c}' AND dict.value = s.{c}), s.{c})")
_RATE = f"CASE WHEN contains(conversion_rate, '%') THEN {q.number('conversion_rate')} / 100.0::DOUBLE ELSE {q.number('conversion_rate')} END"
_TYPED = f"""
SELECT DISTINCT customer_id, name, email, phone, CASE WHEN {q.number('age')} BETWEEN 1 AND 120 THEN {q.number('age')} END AS age,
  {q.number('amount')} AS amount, {_RATE} AS conversion_rate, {_LABEL('status')} AS status, {_LABEL('department')} AS department,
  {_LABEL('gender')} AS gender, lower(is_active) IN ('yes', 'y') AS is_active, {q.date('joined')} AS joined,
  {_LABEL('segment')} AS segment, notes, const_col FROM spelled s WHERE customer_id IS NOT NULL"""
_CLEAN = (f"free AS ({_TOKEN_FREE}), spelled AS ({_SPELLED}), {q.dictionary('spelled', _LABELLED)}, typed AS ({_TYPED}), "
          f"cleaned AS (SELECT * REPLACE (CASE WHEN {q.is_email('email')} THEN email END AS email, "
          f"CASE WHEN {q.is_phone('phone')} THEN phone END AS phone) FROM typed)")


@check("clean_table", f"WITH {_CLEAN} SELECT * FROM cleaned")
def clean_table(spark, folder):
    return clean(mc_dup(spark, folder), analyze_outliers=False).data


@check("clean_table_drop_rows", f"WITH {_CLEAN} SELECT c.* FROM cleaned c JOIN typed t USING (customer_id) WHERE "
       + " AND ".join(f"t.{c} IS NOT NULL" for c in MC_COLUMNS if c != "blank_col"))
def clean_table_drop_rows(spark, folder):
    return clean(mc_dup(spark, folder), strategy="drop_rows", analyze_outliers=False).data


def _mode(c: str, unique: bool) -> str:
    """The smallest mode, or the mode only if it is the only one."""
    pick = "CASE WHEN count(*) = 1 THEN min(v) END" if unique else "min(v)"
    return (f"(SELECT {pick} FROM (SELECT v, n, max(n) OVER () AS m FROM "
            f"(SELECT {c} AS v, count(*) AS n FROM typed WHERE {c} IS NOT NULL GROUP BY {c})) WHERE n = m)")


_NUMBERS, _TEXTS = ("age", "amount", "conversion_rate"), ("name", "status", "department", "gender", "segment", "notes", "const_col")


def _filled(fills: dict[str, str]) -> str:
    """The cleaned table with gaps filled before the contacts are validated."""
    return "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, {v}) AS {c}" for c, v in fills.items()) + ") FROM cleaned"


@check("clean_table_median_mode", f"WITH {_CLEAN} " + _filled({
    **{c: f"(SELECT quantile_cont({c}, 0.5) FROM typed)" for c in _NUMBERS}, **{c: _mode(c, True) for c in _TEXTS}, "is_active": _mode("is_active", False)}))
def clean_table_median_mode(spark, folder):
    return clean(mc_dup(spark, folder), strategy="median_mode").data


@check("clean_table_constant", f"WITH {_CLEAN} " + _filled({**{c: "0.0" for c in _NUMBERS}, **{c: "'Unknown'" for c in _TEXTS}}))
def clean_table_constant(spark, folder):
    return clean(mc_dup(spark, folder), strategy="constant").data


def _count(sql: str, what: str) -> str:
    return f"SELECT '{what}' AS action, CAST(({sql}) AS VARCHAR) AS result"


def _cells(table: str, condition: str) -> str:
    return f"SELECT CAST(sum({' + '.join(f'CAST({condition.format(c=c)} AS INT)' for c in MC_COLUMNS if c != 'blank_col')}) AS BIGINT) FROM {table}"


_SIDE = f"(SELECT {', '.join(f'{c} AS {c}_raw, {q.tokens(c)} AS {c}_free' for c in MC_COLUMNS)} FROM {q.MC_DUP})"
_NORMAL = {**{c: q.collapse(f"{c}") for c in MC_COLUMNS}, "email": "lower(email)", "phone": q.phone("phone"),
           "name": q.title(q.collapse("name"))}
_PAIRS = "(SELECT " + ", ".join(f"{c} AS {c}_free, {n} AS {c}_norm" for c, n in _NORMAL.items()) + " FROM free)"
_AUDIT = {
    "Original rows": f"SELECT count(*) FROM {q.MC_DUP}",
    "Original columns": f"SELECT {len(MC_COLUMNS)}",
    "Blank rows removed": f"SELECT count(*) FROM {q.MC_DUP} WHERE customer_id IS NULL",
    "Blank columns removed": "SELECT 1",
    "Missing tokens normalized": _cells(_SIDE, "coalesce({c}_raw <> {c}_free, FALSE)"),
    "Missing tokens normalized (including new missing)": _cells(_SIDE, "({c}_raw IS DISTINCT FROM {c}_free)"),
    "Text cells whitespace/name-normalized": _cells(_PAIRS, "coalesce({c}_free <> {c}_norm, FALSE)"),
    "Formatting-only categorical variants standardized": "SELECT CAST(sum(cnt) AS BIGINT) FROM dict WHERE value <> canonical",
    "Invalid age values set to missing": f"SELECT count(*) FROM spelled WHERE {q.number('age')} NOT BETWEEN 1 AND 120",
    "Columns type-converted": "SELECT 5",
    "Invalid date values converted to missing": f"SELECT count(joined) - count({q.date('joined')}) FROM spelled",
    "Duplicate rows removed": "SELECT (SELECT count(*) FROM spelled WHERE customer_id IS NOT NULL) - (SELECT count(*) FROM typed)",
    "Missing cells before strategy": _cells("typed", "({c} IS NULL)"),
    "Invalid emails converted to missing": f"SELECT count(*) FROM typed WHERE NOT {q.is_email('email')}",
    "Invalid phones converted to missing": f"SELECT count(*) FROM typed WHERE NOT {q.is_phone('phone')}",
    "Cleaned rows": "SELECT count(*) FROM cleaned",
    "Cleaned columns": f"SELECT {len(MC_COLUMNS) - 1}",
    "Final missing cells": _cells("cleaned", "({c} IS NULL)"),
    "Final duplicate rows": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) FROM cleaned",
}


@check("audit_log", f"WITH {_CLEAN} " + q.union(_count(sql, action) for action, sql in _AUDIT.items()))
def audit_log(spark, folder):
    audit = clean(mc_dup(spark, folder), analyze_outliers=False).audit()
    return audit.where(F.col("action").isin(*_AUDIT)).select("action", "result")


@check("audit_log_full")
def audit_log_full(spark, folder):
    return clean(mc_dup(spark, folder), strategy="median_mode").audit()


# --- history ----------------------------------------------------------------------------------
def _new_base(spark) -> str:
    return f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"


def _two_runs(spark, folder) -> tuple[str, str, str]:
    """A history with one run per cleaning step of the messy customers."""
    base, df = _new_base(spark), mc_dup(spark, folder)
    filled = missing.drop_blank_rows(df)
    first = history.save_run(base, "customers raw.csv", df, filled)
    second = history.save_run(base, "customers raw.csv", df, missing.dedupe(filled))
    return base, first, second


_FILLED_ROWS = f"(SELECT * FROM {q.MC_DUP} WHERE customer_id IS NOT NULL)"
_DISTINCT_ROWS = f"(SELECT DISTINCT * FROM {_FILLED_ROWS})"
_MEASURES = {"rows": "rows", "columns": "columns", "quality_score": "quality", "missing_cells": "missing", "duplicate_rows": "duplicates"}
_PUBLIC = ["source_name"] + [f"{m}_{w}" for m in _MEASURES.values() for w in ("before", "after")]


def _run_sql(after: str) -> str:
    return ("SELECT 'customers raw.csv' AS source_name, " + ", ".join(
        f'{w[0]}."{m}" AS {a}_{w}' for m, a in _MEASURES.items() for w in ("before", "after"))
        + f" FROM ({_quality_sql(q.MC_DUP)}) b, ({_quality_sql(after)}) a")


@check("history_append", _run_sql(_DISTINCT_ROWS))
def history_append(spark, folder):
    base, df = _new_base(spark), mc_dup(spark, folder)
    history.save_run(base, "customers raw.csv", df, missing.dedupe(missing.drop_blank_rows(df)))
    return history.list_runs(spark, base).select(*_PUBLIC)


@check("history_list", _run_sql(_DISTINCT_ROWS) + " UNION ALL " + _run_sql(_FILLED_ROWS))
def history_list(spark, folder):
    base, _, _ = _two_runs(spark, folder)
    return history.list_runs(spark, base).select(*_PUBLIC)


@check("history_get", f"SELECT rows_after, quality_after - quality_before AS improvement FROM ({_run_sql(_DISTINCT_ROWS)})")
def history_get(spark, folder):
    base, _, second = _two_runs(spark, folder)
    return history.get_run(spark, base, second).select("rows_after", "improvement")


@check("history_delete", _run_sql(_DISTINCT_ROWS))
def history_delete(spark, folder):
    base, first, _ = _two_runs(spark, folder)
    history.delete_run(spark, base, first)
    history.vacuum(spark, base)
    return history.list_runs(spark, base).select(*_PUBLIC)


@check("history_summary", f"SELECT 2::BIGINT AS runs, quality_after AS latest_score, 1::BIGINT AS datasets FROM ({_run_sql(_DISTINCT_ROWS)})")
def history_summary(spark, folder):
    base, _, _ = _two_runs(spark, folder)
    return history.summarize_runs(spark, base)

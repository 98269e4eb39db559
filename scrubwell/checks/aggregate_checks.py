"""Queries and oracles: profile, score, outliers, duplicates, missing values, findings."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import findings, missing, outliers, profile
from ..operators.labels import alias_groups
from ..operators.profile import round_half_up
from ..operators.tables import literal_table
from . import fixtures as fx
from . import sqltext as q
from .rows import MC_COLUMNS, mc

CHECKS = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn
    return add


def mc_dup(spark, folder):
    return fx.from_sql(spark, folder, fx.MC_DUP)


def mt(spark, folder):
    return fx.from_sql(spark, folder, fx.MT)


def sk(spark, folder):
    return fx.from_sql(spark, folder, fx.SK)


MT, SK = f"({fx.oracle(fx.MT)})", f"({fx.oracle(fx.SK)})"
_PCT = lambda part, whole: q.half_up(f"({part}) * 100.0::DOUBLE / ({whole})", 2)


# --- profile --------------------------------------------------------------------------------
LINEITEM = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
            "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return q.union(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS \"rows\", count({c}) AS non_null, count(*) - count({c}) AS missing, "
        f"{_PCT(f'count(*) - count({c})', 'count(*)')} AS missing_pct, count(DISTINCT {c}) AS \"distinct\" FROM {table}"
        for c, t in columns.items())


@check("column_profile", _profile_sql("lineitem", LINEITEM))
def column_profile(spark, folder):
    return profile.profile(fx.table(spark, folder, "lineitem"))


@check("column_profile_text", _profile_sql("documents", DOCUMENTS))
def column_profile_text(spark, folder):
    return profile.profile(fx.table(spark, folder, "documents"))


@check("column_profile_messy", _profile_sql(q.MC_DUP, dict.fromkeys(MC_COLUMNS, "string")))
def column_profile_messy(spark, folder):
    return profile.profile(mc_dup(spark, folder))


@check("missing_by_column", q.union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM {q.MC_DUP}" for c in MC_COLUMNS))
def missing_by_column(spark, folder):
    return profile.missing_by_column(mc_dup(spark, folder))


def _duplicates(table: str) -> str:
    return (f"(SELECT (SELECT count(*) FROM {table}) AS n, "
            f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS kept)")


@check("duplicate_count", f"SELECT n AS \"rows\", n - kept AS duplicate_rows, {_PCT('n - kept', 'n')} AS duplicate_pct FROM {_duplicates(q.MC_DUP)}")
def duplicate_count(spark, folder):
    return profile.duplicate_count(mc_dup(spark, folder))


_REPEATED = "(SELECT text, lang, source, n_chars FROM documents)"


@check("duplicate_count_text", f"SELECT n AS \"rows\", n - kept AS duplicate_rows, {_PCT('n - kept', 'n')} AS duplicate_pct FROM {_duplicates(_REPEATED)}")
def duplicate_count_text(spark, folder):
    return profile.duplicate_count(fx.table(spark, folder, "documents").drop("doc_id"))


def _quality_sql(table: str) -> str:
    gaps = " + ".join(f"CAST({c} IS NULL AS INT)" for c in MC_COLUMNS)
    bad = (f"CAST(coalesce(NOT {q.is_email('email')}, FALSE) AS INT) + "
           f"CAST(coalesce(NOT {q.is_phone('phone')}, FALSE) AS INT)")
    cells = f"CAST(n * {len(MC_COLUMNS)} AS DOUBLE)"
    raw = (f"100.0::DOUBLE * (1.0::DOUBLE - 0.55::DOUBLE * gaps / {cells} - 0.25::DOUBLE * (n - kept) / n "
           f"- 0.20::DOUBLE * least(bad / {cells}, 1.0::DOUBLE))")
    return f"""
SELECT *, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 75 THEN 'Good'
               WHEN quality_score >= 50 THEN 'Needs Attention' ELSE 'Poor' END AS quality_status
FROM (SELECT n AS "rows", {len(MC_COLUMNS)}::BIGINT AS "columns", gaps AS missing_cells, n - kept AS duplicate_rows,
             bad AS invalid_contacts, {q.half_up(f'greatest(0.0::DOUBLE, least(100.0::DOUBLE, {raw}))', 1)} AS quality_score
      FROM (SELECT CAST(sum({gaps}) AS BIGINT) AS gaps, CAST(sum({bad}) AS BIGINT) AS bad FROM {table}), {_duplicates(table)})"""


@check("quality_score", f"SELECT * EXCLUDE (quality_status) FROM ({_quality_sql(q.MC_DUP)})")
def quality_score(spark, folder):
    return profile.quality(mc_dup(spark, folder)).drop("quality_status")


@check("quality_status", f"SELECT quality_score, quality_status FROM ({_quality_sql(q.MC_DUP)})")
def quality_status(spark, folder):
    return profile.quality(mc_dup(spark, folder)).select("quality_score", "quality_status")


_FILLED = " OR ".join(f"{c} IS NOT NULL" for c in MC_COLUMNS)
_AFTER = f"(SELECT DISTINCT * FROM {q.MC_DUP} WHERE {_FILLED})"
_MEASURES = ("rows", "columns", "missing_cells", "duplicate_rows", "quality_score")
_SUMMARY = ("SELECT " + ", ".join(f'{w[0]}."{m}" AS {m}_{w}' for m in _MEASURES for w in ("before", "after"))
            + f" FROM ({_quality_sql(q.MC_DUP)}) b, ({_quality_sql(_AFTER)}) a")


def _summary(spark, folder):
    before = mc_dup(spark, folder)
    after = missing.dedupe(missing.drop_blank_rows(before))
    return profile.quality_summary(profile.quality(before), profile.quality(after))


@check("quality_summary", _SUMMARY)
def quality_summary(spark, folder):
    return _summary(spark, folder)


@check("quality_delta", f"SELECT rows_after - rows_before AS rows_delta, missing_cells_after - missing_cells_before AS missing_delta, "
       f"duplicate_rows_after - duplicate_rows_before AS duplicates_delta, "
       f"{q.half_up('quality_score_after - quality_score_before', 1)} AS score_delta FROM ({_SUMMARY})")
def quality_delta(spark, folder):
    return profile.quality_delta(_summary(spark, folder))


def _snapshot_sql(table: str, columns: dict[str, str]) -> str:
    def spread(c, t):
        if t not in ("bigint", "int", "double"):
            return "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean"
        x = f"CAST({c} AS DOUBLE)"
        return f"min({x}) AS min, max({x}) AS max, {q.half_up(f'avg({x})', 4)} AS mean"
    return q.union(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS missing, "
        f"{_PCT(f'count(*) - count({c})', 'count(*)')} AS missing_pct, count(DISTINCT {c}) AS \"distinct\", {spread(c, t)} FROM {table}"
        for c, t in columns.items())


ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
          "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@check("profile_snapshot", _snapshot_sql("orders", ORDERS))
def profile_snapshot(spark, folder):
    return profile.profile_snapshot(fx.table(spark, folder, "orders"))


# --- outliers -------------------------------------------------------------------------------
_SK_COLUMNS = ("l_orderkey", "l_linenumber", "load", "unit_price", "l_tax")
_QUARTILES = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {c}_q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {c}_q3"
                       for c in _SK_COLUMNS)
_BOUNDS = ", ".join(f"{c}_q1, {c}_q3, {c}_q3 - {c}_q1 AS {c}_iqr, {c}_q1 - 1.5::DOUBLE * ({c}_q3 - {c}_q1) AS {c}_lo, "
                    f"{c}_q3 + 1.5::DOUBLE * ({c}_q3 - {c}_q1) AS {c}_hi" for c in _SK_COLUMNS)
_SKB = f"sk AS {SK}, b AS (SELECT {_BOUNDS} FROM (SELECT {_QUARTILES} FROM sk))"
_OUT = lambda c: f"(sk.{c} < b.{c}_lo OR sk.{c} > b.{c}_hi)"


@check("outliers_iqr", f"WITH {_SKB} " + q.union(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({_OUT(c)}) AS outliers, {q.half_up(f'any_value({c}_lo)', 6)} AS lower, "
    f"{q.half_up(f'any_value({c}_hi)', 6)} AS upper FROM sk, b" for c in _SK_COLUMNS))
def outliers_iqr(spark, folder):
    return outliers.outliers(sk(spark, folder)).select(
        "column", "outliers", round_half_up(F.col("lower"), 6).alias("lower"), round_half_up(F.col("upper"), 6).alias("upper"))


@check("outlier_report", f"WITH {_SKB} " + q.union(
    f"SELECT '{c}' AS \"column\", " + ", ".join(f"{q.half_up(f'any_value({c}_{k})', 2)} AS {a}" for k, a in (
        ("q1", "q1"), ("q3", "q3"), ("iqr", "iqr"), ("lo", "lower_bound"), ("hi", "upper_bound")))
    + f", count(*) FILTER ({_OUT(c)}) AS outliers FROM sk, b" for c in _SK_COLUMNS))
def outlier_report(spark, folder):
    return outliers.outlier_report(sk(spark, folder))


_CLIP = lambda c: q.half_up(f"least(greatest(CAST({c} AS DOUBLE), {c}_lo), {c}_hi)", 4)


@check("outlier_cap", f"WITH {_SKB} SELECT l_orderkey, l_linenumber, {_CLIP('load')} AS load, unit_price, {_CLIP('l_tax')} AS l_tax FROM sk, b")
def outlier_cap(spark, folder):
    capped = outliers.cap_outliers(sk(spark, folder))
    key = lambda c: F.col(c).cast("long").alias(c)
    return capped.select(key("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"),
                         round_half_up(F.col("load"), 4).alias("load"), "unit_price",
                         round_half_up(F.col("l_tax"), 4).alias("l_tax"))


@check("outlier_cap_counts", f"WITH {_SKB} " + q.union(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({_OUT(c)}) AS outliers, {q.half_up(f'any_value({c}_lo)', 6)} AS lower, "
    f"{q.half_up(f'any_value({c}_hi)', 6)} AS upper FROM sk, b" for c in ("l_orderkey", "l_linenumber", "load", "l_tax")))
def outlier_cap_counts(spark, folder):
    return outliers.cap_counts(sk(spark, folder)).select(
        "column", "outliers", round_half_up(F.col("lower"), 6).alias("lower"), round_half_up(F.col("upper"), 6).alias("upper"))


@check("outlier_rows", f"WITH {_SKB} SELECT sk.l_orderkey, sk.l_linenumber, concat_ws(',', "
       + ", ".join(f"CASE WHEN {_OUT(c)} THEN '{c}' END" for c in _SK_COLUMNS)
       + f") AS outlier_columns FROM sk, b WHERE {' OR '.join(map(_OUT, _SK_COLUMNS))}")
def outlier_rows(spark, folder):
    return outliers.outlier_rows(sk(spark, folder)).select("l_orderkey", "l_linenumber", "outlier_columns")


# --- duplicates, blanks, missing values -----------------------------------------------------
@check("drop_blank_rows", f"SELECT * FROM {q.MC_DUP} WHERE {_FILLED}")
def drop_blank_rows(spark, folder):
    return missing.drop_blank_rows(mc_dup(spark, folder))


@check("drop_blank_columns", f"SELECT * EXCLUDE (blank_col) FROM {q.MC_DUP}")
def drop_blank_columns(spark, folder):
    return missing.drop_blank_columns(mc_dup(spark, folder))


@check("dedupe_exact", f"SELECT DISTINCT * FROM {q.MC_DUP}")
def dedupe_exact(spark, folder):
    return missing.dedupe(mc_dup(spark, folder))


@check("duplicate_groups", f"SELECT *, count(*) AS copies FROM {q.MC_DUP} GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, folder):
    return missing.duplicate_groups(mc_dup(spark, folder))


@check("impute_stats", q.union([
    *[f"SELECT '{c}' AS \"column\", {q.half_up(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 4)} AS number, NULL AS label FROM {MT}"
      for c in ("points", "visits")],
    f"SELECT 'member', NULL, CAST(mode(member) AS VARCHAR) FROM {MT}", f"SELECT 'grade', NULL, mode(grade) FROM {MT}"]))
def impute_stats(spark, folder):
    values = missing.impute_stats(mt(spark, folder), fx.MT_KINDS)
    rows = [(c, v if isinstance(v, float) else None, None if isinstance(v, float) else str(v).lower()) for c, v in values.items()]
    table = literal_table(spark, {"column": "string", "number": "double", "label": "string"}, rows)
    return table.select("column", round_half_up(F.col("number"), 4).alias("number"), "label")


def _imputed(fills: dict[str, str]) -> str:
    cell = lambda c: (f"coalesce({c}, {fills[c]})" if c in fills else c)
    number = lambda c: q.half_up(f"coalesce(CAST({c} AS DOUBLE), {fills[c]})", 4)
    return "SELECT " + ", ".join(f"{number(c) if c in ('points', 'visits') else cell(c)} AS {c}" for c in fx.MT_KINDS) + f" FROM {MT}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[round_half_up(F.col(c), 4).alias(c) if c in ("points", "visits") else c for c in df.columns])


@check("impute_median_mode", _imputed({
    "points": f"(SELECT quantile_cont(points, 0.5) FROM {MT})", "visits": f"(SELECT quantile_cont(CAST(visits AS DOUBLE), 0.5) FROM {MT})",
    "member": f"(SELECT mode(member) FROM {MT})", "grade": f"(SELECT mode(grade) FROM {MT})"}))
def impute_median_mode(spark, folder):
    return _rounded(missing.impute_median_mode(mt(spark, folder), fx.MT_KINDS))


@check("impute_constant", _imputed({"points": "0.0", "visits": "0.0", "grade": "'Unknown'", "remark": "'Unknown'"}))
def impute_constant(spark, folder):
    return _rounded(missing.impute_constant(mt(spark, folder), fx.MT_KINDS))


@check("drop_missing_rows", f"SELECT * FROM {MT} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in fx.MT_KINDS))
def drop_missing_rows(spark, folder):
    return missing.drop_missing_rows(mt(spark, folder))


# --- findings -------------------------------------------------------------------------------
def mf(spark, folder):
    """The messy customers with a typed age and a skewed amount."""
    return fx.from_sql(spark, folder, MF_SQL)


MF_SQL = ("SELECT *, CASE WHEN age = '150' THEN 150 ELSE 30 END AS customer_age, "
          "CASE WHEN CAST(right(customer_id, 3) AS INT) > 970 THEN 100000 ELSE CAST(right(customer_id, 3) AS INT) END AS visit_length "
          f"FROM ({fx.MC_DUP}) messy")
MF = f"({fx.oracle(MF_SQL)})"
MF_COLUMNS = MC_COLUMNS + ("customer_age", "visit_length")
_HEAD = lambda rule, severity, column, n, text: (
    f"'{rule}' AS rule, {severity} AS severity, {column} AS \"column\", CAST({n} AS BIGINT) AS n, {text} AS finding")
_COUNTED = lambda n, tail: f"format('{{:,}}', {n}) || {q.quote(tail)}"
_STATS = q.union(f"SELECT '{c}' AS c, count(*) AS total, count({c}) AS filled, count(DISTINCT {c}) AS kinds FROM mf" for c in MF_COLUMNS)
_WITH = f"WITH mf AS {MF}, stats AS ({_STATS})"
_SHARE = "(total - filled) * 100.0::DOUBLE / total"
_MISSING = (f"SELECT CASE WHEN c IN ('customer_id', 'email', 'phone') THEN 'missing_contact' ELSE 'missing_data' END AS rule, "
            f"CASE WHEN {_SHARE} >= 30 THEN 'High' WHEN {_SHARE} >= 10 THEN 'Medium' ELSE 'Low' END AS severity, "
            f"c AS \"column\", total - filled AS n, format('{{:,}}', total - filled) || ' missing cells (' || "
            f"printf('%.1f', {q.half_up(_SHARE, 1)}) || '% of rows).' AS finding FROM stats WHERE total > filled")
HIGH, MEDIUM, LOW = "'High'", "'Medium'", "'Low'"
_DUPS_TEXT = _COUNTED("n - kept", " exact duplicate rows detected.")
_DUPS = f"SELECT {_HEAD('duplicates', MEDIUM, q.quote('Dataset'), 'n - kept', _DUPS_TEXT)} FROM {_duplicates('mf')} WHERE n > kept"
_CONSTANT_TEXT = "'The column contains one distinct non-null value or no usable values.'"
_CONSTANT = f"SELECT {_HEAD('constant', LOW, 'c', 'kinds', _CONSTANT_TEXT)} FROM stats WHERE kinds <= 1"
_UNIQUE = "CAST(kinds AS DOUBLE) / greatest(filled, 1)"
_UNIQUE_PCT = q.half_up(_UNIQUE + " * 100.0::DOUBLE", 0)
_UNIQUE_TEXT = f"printf('%.0f', {_UNIQUE_PCT}) || '% of non-null values are unique.'"
_CARDINALITY = (f"SELECT {_HEAD('cardinality', LOW, 'c', 'kinds', _UNIQUE_TEXT)} FROM stats WHERE total >= 20 AND {_UNIQUE} >= 0.98 "
                f"AND c NOT IN ('customer_id', 'email', 'phone', 'customer_age', 'visit_length')")


def _cells(rule: str, column: str, bad: str, tail: str) -> str:
    return (f"SELECT {_HEAD(rule, HIGH, q.quote(column), 'n', _COUNTED('n', tail))} FROM "
            f"(SELECT count(*) FILTER ({bad}) AS n FROM mf) WHERE n > 0")


_EMAIL = _cells("email", "email", f"NOT {q.is_email(q.trim('email'))}", " non-null values do not match the basic email format check.")
_PHONE = _cells("phone", "phone", f"phone IS NOT NULL AND NOT coalesce({q.is_phone(q.phone('phone'))}, FALSE)",
                " non-null values fail the normalized 10–15 digit phone check.")
_AGE = _cells("age_range", "customer_age", "customer_age < 1 OR customer_age > 120",
              " values fall outside the conservative 1–120 age range.")


def _outlier_finding(c: str) -> str:
    text = _COUNTED("n", " observations fall outside the 1.5×IQR bounds.")
    return (f"SELECT {_HEAD('outliers', MEDIUM, q.quote(c), 'n', text)} FROM (SELECT count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) "
            f"OR {c} > q3 + 1.5 * (q3 - q1)) AS n, any_value(q3 - q1) AS iqr, count(DISTINCT {c}) AS kinds FROM mf, "
            f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM mf)) "
            f"WHERE n > 0 AND iqr > 0 AND kinds >= 4")


_OUTLIERS = q.union(map(_outlier_finding, ("customer_age", "visit_length")))


def _alias_finding(c: str) -> str:
    text = _COUNTED("n", " normalized value groups contain multiple raw spellings.")
    norm = f"regexp_replace(lower({q.trim(c)}), '[^a-z0-9]+', '', 'g')"
    return (f"SELECT {_HEAD('aliases', MEDIUM, q.quote(c), 'n', text)} FROM (SELECT count(*) FILTER (raws > 1 AND norm <> '') AS n, "
            f"sum(cells) AS cells FROM (SELECT {norm} AS norm, count(DISTINCT {q.trim(c)}) AS raws, count(*) AS cells "
            f"FROM mf WHERE {c} IS NOT NULL GROUP BY 1)) WHERE n > 0 AND cells >= 10")


_ALIASES = q.union(map(_alias_finding, MC_COLUMNS))
_ALL = q.union([_MISSING, _DUPS, _CONSTANT, _CARDINALITY, _EMAIL, _PHONE, _AGE, _OUTLIERS, _ALIASES])


@check("finding_missing", f"{_WITH} {_MISSING}")
def finding_missing(spark, folder):
    df = mf(spark, folder)
    return findings.missing_findings(profile.column_stats(df), df.columns)


@check("finding_duplicates", f"{_WITH} {_DUPS}")
def finding_duplicates(spark, folder):
    return findings.duplicate_findings(profile.duplicate_count(mf(spark, folder)))


@check("finding_constant", f"{_WITH} {_CONSTANT}")
def finding_constant(spark, folder):
    return findings.constant_findings(profile.column_stats(mf(spark, folder)))


@check("finding_cardinality", "WITH stats AS (" + q.union(
    f"SELECT '{c}' AS c, count(*) AS total, count({c}) AS filled, count(DISTINCT {c}) AS kinds FROM {q.MC}"
    for c in MC_COLUMNS) + f") {_CARDINALITY}")
def finding_cardinality(spark, folder):
    df = mc(spark, folder)
    return findings.cardinality_findings(profile.column_stats(df), df.columns)


def _cell_rule(name: str, sql: str):
    CHECKS[f"finding_{name}"] = (
        lambda spark, folder: findings.cell_findings(mf(spark, folder)).where(F.col("rule") == name), f"{_WITH} {sql}")


_cell_rule("email", _EMAIL)
_cell_rule("phone", _PHONE)
_cell_rule("age_range", _AGE)


@check("finding_outliers", f"{_WITH} {_OUTLIERS}")
def finding_outliers(spark, folder):
    return findings.outlier_findings(outliers.outliers(mf(spark, folder)))


@check("finding_aliases", f"{_WITH} {_ALIASES}")
def finding_aliases(spark, folder):
    return findings.alias_findings(alias_groups(mf(spark, folder)))


@check("finding_summary", f"{_WITH}, found AS ({_ALL}) SELECT count(*) AS issue_count, " + ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in findings.SEVERITIES) + " FROM found")
def finding_summary(spark, folder):
    return findings.summarize(findings.findings(mf(spark, folder)))


_TEXTS = q.values([(r, *t) for r, t in vocab.FINDING_TEXTS.items()])
_STEPS = q.values([(c, *t) for c, t in vocab.GUIDANCE.items()])


@check("finding_guidance", f"{_WITH}, found AS ({_ALL}) SELECT severity, t.category, found.\"column\", finding, why_it_matters, "
       f"recommendation, recommended_action, workflow, guardrail, n FROM found LEFT JOIN {_TEXTS} t(rule, category, why_it_matters, recommendation) "
       f"ON t.rule = found.rule LEFT JOIN {_STEPS} s(category, recommended_action, workflow, guardrail) ON s.category = t.category")
def finding_guidance(spark, folder):
    return findings.report(mf(spark, folder)).findings.drop("seq")

"""Findings report: rules over the aggregate tables, each finding with its severity, reason
and safe next step. Nothing here changes data."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text, vocab
from .labels import alias_groups
from .outliers import outliers
from .profile import Measures, column_stats, duplicate_count, measure, profile_snapshot, round_half_up
from .tables import col, literal_table, nan_to_null

_COUNT = "%,d"
SEVERITIES = ("High", "Medium", "Low")
# fixed values: message formats
_MESSAGES = {
    "missing": _COUNT + " missing cells (%.1f%% of rows).",
    "duplicates": _COUNT + " exact duplicate rows detected.",
    "constant": "The column contains one distinct non-null value or no usable values.",
    "cardinality": "%.0f%% of non-null values are unique.",
    "email": _COUNT + " non-null values do not match the basic email format check.",
    "phone": _COUNT + " non-null values fail the normalized 10–15 digit phone check.",
    "outliers": _COUNT + " observations fall outside the 1.5×IQR bounds.",
    "age_range": _COUNT + " values fall outside the conservative 1–120 age range.",
    "aliases": _COUNT + " normalized value groups contain multiple raw spellings.",
}
_FINDING = {"rule": "string", "severity": "string", "column": "string", "n": "long", "finding": "string"}
_MIN_CARDINALITY_ROWS, _CARDINALITY_SHARE = 20, 0.98  # fixed values


def _rule(hit: Column, rule: Column | str, severity: Column | str, column: Column, n: Column,
          message: str, *values: Column) -> tuple[Column, ...]:
    """Whether a row gives rise to a finding, and the finding."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return (hit, as_column(rule), as_column(severity), column, n.cast("long"),
            F.format_string(_MESSAGES[message], *values))


def _emit(rows: DataFrame, *rules: tuple[Column, ...]) -> DataFrame:
    """All findings of a table of aggregates, which is computed once for all its rules."""
    fields = [x for rule in rules for x in rule]
    return rows.select(F.stack(F.lit(len(rules)), *fields).alias("hit", *_FINDING)).where("hit").drop("hit")


def _missing(columns: list[str]) -> tuple[Column, ...]:
    n = F.col("rows") - F.col("non_null")
    share = F.try_divide(n * 100.0, F.col("rows"))
    severity = F.when(share >= 30, "High").when(share >= 10, "Medium").otherwise("Low")
    contact = [c for c in columns if names.is_contact_or_id(c)]
    rule = F.when(F.col("column").isin(contact), "missing_contact").otherwise("missing_data")
    return _rule(n > 0, rule, severity, F.col("column"), n, "missing", n, round_half_up(share, 1))


def _constant() -> tuple[Column, ...]:
    hit = (F.col("rows") > 0) & (F.col("distinct") <= 1)
    return _rule(hit, "constant", "Low", F.col("column"), F.col("distinct"), "constant")


def _cardinality(columns: list[str]) -> tuple[Column, ...]:
    skip = [c for c in columns if names.is_contact_or_id(c)]
    share = F.col("distinct") / F.greatest(F.col("non_null"), F.lit(1))
    hit = ((F.col("dtype") == "string") & (F.col("rows") >= _MIN_CARDINALITY_ROWS)
           & (share >= _CARDINALITY_SHARE) & ~F.col("column").isin(skip))
    return _rule(hit, "cardinality", "Low", F.col("column"), F.col("distinct"), "cardinality",
                 round_half_up(share * 100.0, 0))


def missing_findings(stats: DataFrame, columns: list[str]) -> DataFrame:
    return _emit(stats, _missing(columns))


def constant_findings(stats: DataFrame) -> DataFrame:
    return _emit(stats, _constant())


def cardinality_findings(stats: DataFrame, columns: list[str]) -> DataFrame:
    return _emit(stats, _cardinality(columns))


def column_findings(stats: DataFrame, columns: list[str]) -> DataFrame:
    """The three rules above over one computation of the column statistics."""
    return _emit(stats, _missing(columns), _constant(), _cardinality(columns))


def duplicate_findings(duplicates: DataFrame) -> DataFrame:
    n = F.col("duplicate_rows")
    return _emit(duplicates, _rule(n > 0, "duplicates", "Medium", F.lit("Dataset"), n, "duplicates", n))


def cell_findings(df: DataFrame) -> DataFrame:
    """E-mail, phone and age checks of all their columns in one aggregate."""
    numeric = set(names.numeric_columns(df))
    checks = []
    for c in df.columns:
        cell = col(c).cast("string")
        if names.is_email(c):
            checks.append(("email", c, cell.isNotNull() & ~text.is_valid_email(text.trim(cell))))
        if names.is_phone(c):
            valid = F.coalesce(text.is_valid_phone(text.phone(cell)), F.lit(False))
            checks.append(("phone", c, cell.isNotNull() & ~valid))
        if names.column_key(c) in vocab.AGE_KEYS and c in numeric:
            checks.append(("age_range", c, (col(c) < 1) | (col(c) > 120)))
    if not checks:
        return literal_table(df.sparkSession, _FINDING, [])
    row = df.agg(*[F.count_if(bad).alias(f"_{i}") for i, (_, _, bad) in enumerate(checks)])
    return _emit(row, *[
        _rule(F.col(f"_{i}") > 0, rule, "High", F.lit(c), F.col(f"_{i}"), rule, F.col(f"_{i}"))
        for i, (rule, c, _) in enumerate(checks)])


def outlier_findings(found: DataFrame) -> DataFrame:
    n = F.col("outliers")
    return _emit(found, _rule(n > 0, "outliers", "Medium", F.col("column"), n, "outliers", n))


def alias_findings(groups: DataFrame) -> DataFrame:
    n = F.col("groups")
    return _emit(groups, _rule(n > 0, "aliases", "Medium", F.col("column"), n, "aliases", n))


def with_guidance(findings: DataFrame) -> DataFrame:
    """Attach category, reason, recommendation and the category's next step to each finding."""
    spark = findings.sparkSession
    texts = literal_table(spark, {c: "string" for c in (
        "rule", "category", "why_it_matters", "recommendation")},
        [(rule, *t) for rule, t in vocab.FINDING_TEXTS.items()])
    place = ["seq"] if "seq" in findings.columns else []
    return guidance(findings.join(F.broadcast(texts), "rule", "left")).select(
        *place, "severity", "category", "column", "finding", "why_it_matters", "recommendation",
        "recommended_action", "workflow", "guardrail", "n")


def guidance(rows: DataFrame) -> DataFrame:
    """Action, workflow and guardrail by ``category``; a default where it has none of its own."""
    steps = ("recommended_action", "workflow", "guardrail")
    table = literal_table(rows.sparkSession, {"category": "string", **{s: "string" for s in steps}},
                          [(category, *t) for category, t in vocab.GUIDANCE.items()])
    joined = rows.join(F.broadcast(table), "category", "left")
    return joined.select(*rows.columns, *[
        F.coalesce(F.col(s), F.lit(default)).alias(s) for s, default in zip(steps, vocab.DEFAULT_GUIDANCE)])


@dataclass(frozen=True)
class Report:
    findings: DataFrame
    summary: DataFrame
    recommendations: tuple[str, ...]
    snapshot: DataFrame


def findings(df: DataFrame, measured: Measures | None = None) -> DataFrame:
    """All findings of a table, without the guidance texts. What is measured already is not
    computed again."""
    df = nan_to_null(df)
    stats, duplicates = (column_stats(df), duplicate_count(df)) if measured is None else (measured.columns, measured.quality)
    return reduce(DataFrame.unionByName, [
        column_findings(stats, df.columns), duplicate_findings(duplicates), cell_findings(df),
        outlier_findings(outliers(df)), alias_findings(alias_groups(df))])


def summarize(found: DataFrame) -> DataFrame:
    """Findings per severity."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    return found.agg(F.count(F.lit(1)).alias("issue_count"), *counts)


def report(df: DataFrame) -> Report:
    """Findings with guidance in order (``seq``; missing values first, most first), one summary row
    (size, missing cells, duplicate rows, findings per severity), general advice and the profile
    snapshot. Column statistics and row groups are computed once for all of these; the findings are
    a few rows per column, kept as a small literal table."""
    measured = measure(df)
    rows = [tuple(r) for r in findings(df, measured).select(*_FINDING).collect()]
    order = list(_MESSAGES)
    place = {"missing_contact": 0, "missing_data": 0, **{rule: i for i, rule in enumerate(order)}}
    rows.sort(key=lambda r: (place[r[0]], -r[3] if place[r[0]] == 0 else 0, df.columns.index(r[2]) if r[2] in df.columns else -1))
    found = literal_table(df.sparkSession, {"seq": "long", **_FINDING}, [(i, *r) for i, r in enumerate(rows, 1)])
    advice = vocab.REVIEW_ADVICE if rows else (vocab.NO_FINDINGS_ADVICE,)
    counts = {s.lower(): sum(r[1] == s for r in rows) for s in SEVERITIES}
    totals = {"issue_count": len(rows), **counts}
    summary = measured.quality.select("rows", "columns", "missing_cells", "duplicate_rows",
                                 *[F.lit(n).cast("long").alias(c) for c, n in totals.items()])
    return Report(with_guidance(found), summary, advice, profile_snapshot(df, stats=measured.columns))

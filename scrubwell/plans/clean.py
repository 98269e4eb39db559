"""One-call cleaning of a table of unknown schema.

``fit`` reads the table once for everything the data has to decide (blank columns, kinds, label
spellings, percentage scale) and returns a ``CleaningPlan``, a set of plan-time constants.
``CleaningPlan.apply`` is then a plain projection that works on any table with those columns.
``clean`` adds the steps that look across rows: de-duplication, the missing-value strategy,
outlier counts, contact validation and the audit log.

All counters come from aggregates over the data, not from task-side accumulators, so a retried
task cannot count twice.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, parse, text, vocab
from ..operators import labels, missing, validate
from ..operators.infer import (EVIDENCE, NUMERIC_KINDS, Evidence, date_shape_counts, decide_kind,
                               evidence_columns, needs_date_shapes)
from ..operators.outliers import outliers
from ..operators.profile import invalid_contact_cells, quality
from ..operators.tables import col, discard, literal_table, nan_to_null, stage_at

CONVERTED_KINDS = (*NUMERIC_KINDS, "date", "boolean")
STRATEGY_ALIASES = {  # fixed values: the long names of the strategies
    "Leave missing values unchanged": "leave",
    "Fill numeric with median; safe text with mode": "median_mode",
    "Fill numeric with 0; text with 'Unknown'": "constant",
    "Drop rows containing missing values": "drop_rows",
}


def _as_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a contact or identifier cell, with every digit it has. A double that would be
    written with an exponent is written out where a decimal holds it exactly (with at least one
    decimal place, as other doubles have), else its own text stays."""
    plain = c.cast("string")
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return plain
    exact = [F.when(d.cast("double") == c.cast("double"), d.cast("string"))
             for d in (plain.try_cast(f"decimal({kind})") for kind in ("38,10", "38,1", "38,30"))]
    full = F.regexp_replace(F.coalesce(*exact), r"(\.[0-9]+?)0+$", "$1")
    return F.when(plain.contains("E"), F.coalesce(full, plain)).otherwise(plain)


def _spelled(name: str, cell: Column) -> Column:
    """Stage 3 for a token-free cell of one text column: whitespace, contact and name spelling."""
    if names.is_email(name):
        return F.lower(cell)
    if names.is_phone(name):
        return text.phone(cell)
    cell = text.collapse_inner(cell)
    return text.title_case(cell) if names.is_name(name) else cell


def _is_text(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def _normalized(df: DataFrame) -> DataFrame:
    """Text columns without missing tokens, in their normal spelling."""
    trimmed = df.select(*[
        text.missing_tokens(col(f.name)).alias(f.name) if _is_text(f) else col(f.name) for f in df.schema])
    return trimmed.select(*[
        _spelled(f.name, col(f.name)).alias(f.name) if _is_text(f) else col(f.name) for f in df.schema])


def _has_value(df: DataFrame) -> Column:
    """True for rows with at least one cell that is not missing. The test reads the raw cells: a
    filter on normalised ones would be pushed below and evaluate every rule a second time. It
    stops at the first filled cell."""
    texts = [col(f.name) for f in df.schema if _is_text(f)]
    others = [col(f.name).isNotNull() for f in df.schema if not _is_text(f)]
    filled = [F.exists(F.array(*texts), lambda cell: text.missing_tokens(cell).isNotNull())] if texts else []
    return _any([F.coalesce(test, F.lit(False)) for test in others + filled])


@dataclass(frozen=True)
class CleaningPlan:
    """What the data decided, ready to be applied to it or to later rows of the same shape."""
    columns: tuple[tuple[str, str], ...]            # (source name, standard name) of kept columns
    kinds: dict[str, str]                           # standard name -> kind
    scale: dict[str, str] = field(default_factory=dict)   # percentage columns: "cell" or "whole"
    label_map: dict[str, dict[str, str]] = field(default_factory=dict)

    def normalize(self, df: DataFrame) -> DataFrame:
        """Kept columns under standard names, text normalised, blank rows gone."""
        # renamed by position, since names that differ in case only cannot be told apart by name
        renamed = nan_to_null(names.standardize_names(df)).select(*[col(new) for _, new in self.columns])
        return _normalized(renamed.where(_has_value(renamed)))

    def convert(self, df: DataFrame) -> DataFrame:
        """Kinds become types; then values outside an implied range become NULL."""
        typed = df.select(*[self._converted(f.name, f.dataType).alias(f.name) for f in df.schema])
        def bounded(c):
            bounds = validate.range_of(c) if self.kinds[c] in NUMERIC_KINDS else None
            return col(c) if bounds is None else F.when(~validate.is_out_of_range(col(c), bounds), col(c)).alias(c)
        return typed.select(*[bounded(c) for c in typed.columns])

    def _converted(self, name: str, dtype: T.DataType) -> Column:
        kind, c, is_text = self.kinds[name], col(name), isinstance(dtype, T.StringType)
        if kind in NUMERIC_KINDS:
            value = c.cast("double") if isinstance(dtype, T.NumericType) else parse.number_in(c.cast("string"))
            if self.scale.get(name) == "whole":
                return value / 100.0
            return value / F.when(parse.has_percent(c), 100.0).otherwise(1.0) if self.scale.get(name) else value
        if kind == "date" and is_text:
            return parse.date_in(c)
        if kind == "boolean" and is_text:
            return parse.boolean_in(c)
        if kind in ("email", "phone", "id") and not is_text:
            cell = _as_text(c, dtype)
            return {"email": text.email, "phone": text.phone, "id": text.trim}[kind](cell)
        return c

    def apply(self, df: DataFrame) -> DataFrame:
        """Stages 1 to 5 as one projection, without any step that looks across rows."""
        done = labels.apply_mapping(self.normalize(df), self.label_map)
        aliased = {c for c, k in self.kinds.items() if k == "text" and labels.has_vocabulary(c)}
        if aliased:
            done = done.select(*[labels.semantic_alias(col(c), c).alias(c) if c in aliased else col(c)
                                 for c in done.columns])
        return self.convert(done)


# --- fit ------------------------------------------------------------------------------------
def _scan(df: DataFrame) -> dict[str, dict]:
    """Per column: fill counts, change counters and inference evidence, in one pass whose shuffle
    carries one row per column and task."""
    fields = list(df.schema)
    null = {t: F.lit(None).cast(t) for t in ("string", "double")}
    raw = df.select(
        *[(col(f.name) if _is_text(f) else null["string"]).alias(f"raw{i}") for i, f in enumerate(fields)],
        *[(col(f.name).cast("double") if isinstance(f.dataType, T.NumericType) else null["double"]).alias(f"num{i}")
          for i, f in enumerate(fields)],
        *[col(f.name).isNotNull().alias(f"has{i}") for i, f in enumerate(fields)])
    keep = [F.col(c) for c in raw.columns]
    texts = [i for i, f in enumerate(fields) if _is_text(f)]
    free = raw.select(*keep, *[text.missing_tokens(F.col(f"raw{i}")).alias(f"free{i}") for i in texts])
    keep += [F.col(f"free{i}") for i in texts]
    spelled = free.select(*keep, *[_spelled(fields[i].name, F.col(f"free{i}")).alias(f"norm{i}") for i in texts])

    def entry(i: int, f: T.StructField):
        role, bounds = names.name_role(f.name), validate.range_of(f.name) or (None, None)
        of = lambda kind: F.col(f"{kind}{i}") if _is_text(f) else null["string"]
        return (F.lit(i), F.col(f"raw{i}"), of("free"), of("norm"), labels.semantic_alias(of("norm"), f.name),
                F.col(f"num{i}"), F.col(f"has{i}"),
                *[F.lit(b if b is None else float(b)).cast("double") for b in bounds],
                F.lit(role not in ("email", "phone", "id")), F.lit(_is_text(f) and role is None))

    any_raw = _any([F.col(f"has{i}") for i in range(len(fields))])
    any_free = _any([F.col(f"free{i}").isNotNull() if i in texts else F.col(f"has{i}") for i in range(len(fields))])
    cells = spelled.select(
        any_raw.alias("any_raw"), any_free.alias("any_free"),
        F.stack(F.lit(len(fields)), *[x for i, f in enumerate(fields) for x in entry(i, f)]).alias(
            "i", "raw", "free", "norm", "alias", "num", "has", "low", "high", "measure", "open"))
    cells = cells.select("*", F.when(F.col("measure"), F.coalesce("num", parse.number_in(F.col("norm")))).alias("parsed"),
                         F.when(F.col("open"), F.col("norm")).alias("open_text"))
    evidence = evidence_columns(F.col("open_text"), F.col("parsed"))
    evidence["filled"] = F.count_if(F.col("norm").isNotNull() | F.col("num").isNotNull())
    evidence["percent_signs"] = F.count_if(F.col("measure") & parse.has_percent(F.col("norm")))
    value = F.col("parsed") / F.when(parse.has_percent(F.col("norm")), 100.0).otherwise(1.0)
    outside = F.col("low").isNotNull() & ((value < F.col("low")) | (value > F.col("high")))
    found = cells.groupBy("i").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("has").alias("has"),
        F.count_if(~F.col("any_raw")).alias("blank_rows"), F.count_if(~F.col("any_free")).alias("empty_rows"),
        F.count_if(text.changed(F.col("raw"), F.col("free"))).alias("trimmed"),
        F.count_if(text.changed_null_safe(F.col("raw"), F.col("free"))).alias("tokens"),
        F.count_if(text.changed(F.col("free"), F.col("norm"))).alias("respelled"),
        F.count_if(text.changed(F.col("norm"), F.col("alias"))).alias("aliased"),
        F.count_if(outside).alias("outside"), F.max("parsed").alias("largest"),
        F.approx_count_distinct("open_text").alias("labels"),
        *[e.alias(n) for n, e in evidence.items()]).collect()
    return {fields[r["i"]].name: {**r.asDict(), "date_shapes": 0} for r in found}


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def fit(df: DataFrame, limits: labels.LabelLimits = labels.DEFAULT_LIMITS) -> tuple[CleaningPlan, dict]:
    """The plan for a table and the counters of the passes that produced it. Text columns with
    more labels than ``limits`` allows get no label rules; the counters name them."""
    old_names = df.columns
    df = nan_to_null(names.standardize_names(df))
    renamed = list(zip(old_names, df.columns))
    stats = _scan(df)
    if not stats:  # a table without rows keeps its columns; names and types decide the kinds
        kinds = {f.name: decide_kind(f.name, f.dataType) for f in df.schema}
        return CleaningPlan(tuple(renamed), kinds), {"stats": {}, "dictionary": [], "over_limit": []}

    def is_alive(f: T.StructField) -> bool:
        return stats[f.name]["filled" if _is_text(f) else "has"] > 0

    fields = [f for f in df.schema if is_alive(f)]
    evidence = lambda f: Evidence(*[stats[f.name][e] for e in EVIDENCE])
    unsure = [f.name for f in fields if _is_text(f) and needs_date_shapes(f.name, evidence(f))]
    for c, n in date_shape_counts(_normalized(df.select(*[col(c) for c in unsure])), unsure).items():
        stats[c]["date_shapes"] = n
    kinds = {f.name: decide_kind(f.name, f.dataType, evidence(f)) for f in fields}
    scale = {}
    for c in (c for c, k in kinds.items() if k == "percentage"):
        if stats[c]["percent_signs"]:
            scale[c] = "cell"
        elif stats[c]["largest"] is not None and 1 < stats[c]["largest"] <= 100:
            scale[c] = "whole"

    inputs = labels.label_inputs(df, [f.name for f in fields if _is_text(f) and kinds[f.name] == "text"])
    holders = [c for c in inputs if stats[c]["labels"] <= limits.gate]
    dictionary = []
    if holders:
        # only label columns reach this pass; the blank-row filter cannot change their counts
        counts = labels.value_counts(df, holders, lambda c: _spelled("", text.missing_tokens(c)))
        table = labels.finish_dictionary(labels.rule_verdicts(counts, holders, limits), limits)
        dictionary = [r.asDict() for r in table.select("column", "value", "cnt", "canonical").collect()]
    label_map: dict[str, dict[str, str]] = {}
    for r in dictionary:
        if r["value"] != r["canonical"]:
            label_map.setdefault(r["column"], {})[r["value"]] = r["canonical"]
    kept = tuple((old, new) for old, new in renamed if new in kinds)
    listed = {r["column"] for r in dictionary}
    first = next(iter(stats.values()))
    return CleaningPlan(kept, kinds, scale, label_map), {
        "stats": stats, "dictionary": dictionary, "over_limit": [c for c in inputs if c not in listed], "rows": first["rows"],
        "blank_rows": first["blank_rows"], "empty_rows": first["empty_rows"]}


# --- clean ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class CleanResult:
    data: DataFrame
    plan: CleaningPlan
    log: dict[str, object]
    outliers: dict[str, dict]
    staged: str  # folder of the staged copy that ``data`` reads

    def release(self) -> None:
        """Drop the staged copy, once ``data`` has been written or is no longer wanted."""
        discard(self.data.sparkSession, self.staged)

    def audit(self) -> DataFrame:
        """The log as a table (seq, action, result)."""
        return literal_table(self.data.sparkSession, {"seq": "long", "action": "string", "result": "string"},
                             [(i, k, str(v)) for i, (k, v) in enumerate(self.log.items(), 1)])


def _alias_changes(plan: CleaningPlan, fitted: dict) -> int:
    """Cells that the vocabulary lookup changes after the label rules, from the dictionary where
    a column has one and from the scan otherwise."""
    total, listed = 0, {r["column"] for r in fitted["dictionary"]}
    for r in fitted["dictionary"]:
        table = vocab.SEMANTIC_LABELS.get(names.column_key(r["column"]), {})
        label = r["canonical"]
        total += r["cnt"] * (table.get(label.strip().lower(), label) != label)
    return total + sum(fitted["stats"][c]["aliased"] for c, k in plan.kinds.items()
                       if k == "text" and c not in listed)


def python_score(rows: int, columns: int, missing_cells: int, duplicates: int, invalid: int) -> float:
    if not rows or not columns:
        return 0.0
    cells = float(rows * columns)
    raw = 100.0 * (1.0 - 0.55 * missing_cells / cells - 0.25 * duplicates / rows - 0.20 * min(invalid / cells, 1.0))
    return math.floor(max(0.0, min(100.0, raw)) * 10 + 0.5) / 10


def _staged_counts(df: DataFrame, contacts: dict[str, str]) -> dict:
    """Rows, gaps and failing contact cells of the staged table, in one aggregate."""
    whole = F.lit(True)
    for c in df.columns:
        whole = whole & col(c).isNotNull()
    bad = {c: col(c).isNotNull() & ~(text.is_valid_email(col(c)) if k == "email" else text.is_valid_phone(col(c)))
           for c, k in contacts.items()}
    row = df.agg(
        F.count(F.lit(1)), F.count_if(whole),
        *[F.count_if(col(c).isNull()) for c in df.columns],
        *[F.count_if(b) for b in bad.values()], *[F.count_if(b & whole) for b in bad.values()]).first()
    gaps = dict(zip(df.columns, row[2:]))
    first = 2 + len(df.columns)
    return {"rows": row[0], "whole_rows": row[1], "gaps": gaps,
            "bad": dict(zip(bad, row[first:])), "bad_whole": dict(zip(bad, row[first + len(bad):]))}


def clean(df: DataFrame, strategy: str = "leave", analyze_outliers: bool = True,
          limits: labels.LabelLimits = labels.DEFAULT_LIMITS) -> CleanResult:
    """Clean a table of unknown schema; see the module text for the steps.

    Few passes read the source: evidence, label counts, and the de-duplicated copy. The copy is
    staged in the shared folder, and all later counts read only the columns they need from it."""
    strategy = STRATEGY_ALIASES.get(strategy, strategy)
    if strategy not in missing.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from {missing.STRATEGIES}")
    plan, fitted = fit(df, limits)
    stats, kinds = fitted["stats"], plan.kinds
    kept = [new for _, new in plan.columns]
    log: dict[str, object] = {
        "Original rows": fitted.get("rows", 0), "Original columns": len(df.columns),
        "Blank rows removed": fitted.get("blank_rows", 0),
        "Rows blank after token normalization": fitted.get("empty_rows", 0) - fitted.get("blank_rows", 0),
        "Blank columns removed": len(df.columns) - len(kept),
        "Column names standardized": sum(old != new for old, new in plan.columns),
        "Missing tokens normalized": sum(stats[c]["trimmed"] for c in stats),
        "Missing tokens normalized (including new missing)": sum(stats[c]["tokens"] for c in stats),
        "Text cells whitespace/name-normalized": sum(stats[c]["respelled"] for c in stats),
        "Formatting-only categorical variants standardized": sum(
            r["cnt"] for r in fitted["dictionary"] if r["value"] != r["canonical"]),
        "Semantic categorical aliases standardized": _alias_changes(plan, fitted) if stats else 0,
    }
    log["Text columns with too many labels for category rules"] = ", ".join(fitted["over_limit"]) or "None"
    range_hits = {c: stats[c]["outside"] for c in kept
                  if stats and kinds[c] in NUMERIC_KINDS and validate.range_of(c) and stats[c]["outside"]}
    for c, n in range_hits.items():
        log[f"Invalid {c} values set to missing"] = n
    log["Columns type-converted"] = sum(k in CONVERTED_KINDS for k in kinds.values())
    log["Invalid numeric values converted to missing"] = sum(range_hits.values()) + sum(
        stats[c]["filled"] - stats[c]["numbers"] for c in kept if stats and kinds[c] in NUMERIC_KINDS)
    log["Invalid date values converted to missing"] = sum(
        stats[c]["filled"] - stats[c]["dates"] for c in kept if stats and kinds[c] == "date")
    log["Inferred column types"] = ", ".join(f"{c}: {k}" for c, k in kinds.items())

    # converted once and written; without repeated rows this copy is also the de-duplicated one
    converted, staged = stage_at(plan.apply(df), "deduped")
    deduped, suspects = converted, missing.suspects(converted) if converted.columns else (None, 0)
    if suspects[1]:
        first = staged
        deduped, staged = stage_at(missing.dedupe(converted, suspects), "deduped")
        discard(df.sparkSession, first)
    contacts = {c: k for c, k in kinds.items() if k in ("email", "phone")}
    counts = _staged_counts(deduped, contacts)
    rows, gaps = counts["rows"], counts["gaps"]
    log["Duplicate rows removed"] = fitted.get("rows", 0) - fitted.get("empty_rows", 0) - rows

    missing_before = missing_after = sum(gaps.values())
    imputed, out = 0, deduped
    if strategy == "drop_rows":
        out, missing_after = missing.drop_missing_rows(deduped), 0
        log["Rows dropped for missing values"] = rows - counts["whole_rows"]
        log["Rows dropped for missing values (including duplicates)"] = (
            log["Duplicate rows removed"] + rows - counts["whole_rows"])
        rows = counts["whole_rows"]
    elif strategy != "leave":
        open_gaps = [c for c, n in gaps.items() if n and kinds[c] not in missing.PROTECTED_KINDS]
        if strategy == "median_mode":
            values = missing.fill_values(deduped, kinds, open_gaps)
        else:
            values = {c: v for c, v in missing.constant_fills(kinds).items()
                      if c in open_gaps and (gaps[c] < rows or v == "Unknown")}
        out = missing.fill(deduped, values)
        imputed = sum(gaps[c] for c in values)
        missing_after -= imputed
        log["Missing cells imputed"] = imputed
    log["Missing cells before strategy"] = missing_before
    log["Missing cells after strategy"] = missing_after

    found = {}
    if analyze_outliers:
        found = {r["column"]: {"count": r["outliers"], "lower": r["lower"], "upper": r["upper"]}
                 for r in outliers(out).collect()}
    log["Outlier cells capped"] = 0
    log["Outlier columns detected"] = len(found)
    log["Outlier observations detected"] = sum(o["count"] for o in found.values())

    bad = counts["bad_whole" if strategy == "drop_rows" else "bad"]
    invalid = {k: sum(n for c, n in bad.items() if contacts[c] == k) for k in ("email", "phone")}
    log["Invalid emails converted to missing"] = invalid["email"]
    log["Invalid phones converted to missing"] = invalid["phone"]
    valid = {"email": text.is_valid_email, "phone": text.is_valid_phone}
    out = out.select(*[F.when(valid[contacts[c]](col(c)), col(c)).alias(c) if bad.get(c) else col(c)
                       for c in out.columns])
    missing_after += sum(invalid.values())

    # Rows were distinct after de-duplication; only changed cells can make two of them equal.
    if imputed or sum(invalid.values()):
        final = quality(out).first()
        duplicates, score = final["duplicate_rows"], final["quality_score"]
    else:
        odd = invalid_contact_cells(out.select(*[col(c) for c in out.columns if c not in contacts]))
        failing = sum(out.agg(*[F.count_if(o) for o in odd]).first()) if odd else 0
        duplicates, score = 0, python_score(rows, len(out.columns), missing_after, 0, failing)
    log["Final invalid emails"] = 0
    log["Final invalid phones"] = 0
    log["Cleaned rows"] = rows
    log["Cleaned columns"] = len(out.columns)
    log["Final missing cells"] = missing_after
    log["Final duplicate rows"] = duplicates
    log["Final quality score"] = score
    log["Domain-specific rules applied"] = "None — universal mode"
    return CleanResult(out, plan, log, found, staged)

"""Audit rows of a stream: the cleaning plan's counters as observed metrics, one row an action and batch.

The counters are taken in the same pass that cleans the rows. Each step adds the cells that it
changes to per-row tallies; one set of sums is observed before blank rows go, so a retried task
counts once. A listener hands the sums of every finished batch on.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import names, text
from ..operators import labels, validate
from ..operators.infer import NUMERIC_KINDS
from ..operators.tables import col, literal_table, nan_to_null
from ..plans.clean import CleaningPlan, _has_value, _is_text, _spelled

_AUDIT = {"query": "string", "batch": "long", "seq": "long", "action": "string", "result": "long"}


def _total(flags: list[Column]) -> Column:
    return reduce(add, [F.coalesce(f, F.lit(False)).cast("long") for f in flags], F.lit(0).cast("long"))


class _Steps:
    """Rows with tallies beside them, whose names begin as no column of the table does."""

    def __init__(self, df: DataFrame):
        self.prefix = "_"
        while any(c.lower().startswith(self.prefix) for c in df.columns):
            self.prefix += "_"
        self.rows, self.columns, self.actions = df, df.columns, []

    def step(self, new: dict[str, Column], counts: dict[str, Column], keep: list[str] | None = None) -> None:
        """Replace columns, and add counts that may read both old columns and the given expressions."""
        tallies = [F.col(f"{self.prefix}{i}") for i in range(len(self.actions))]
        tallies += [c.alias(f"{self.prefix}{i}") for i, c in enumerate(counts.values(), len(self.actions))]
        self.columns = self.columns if keep is None else keep
        self.rows = self.rows.select(*[new.get(c, col(c)).alias(c) for c in self.columns], *tallies)
        self.actions += counts

    def tally(self, action: str) -> Column:
        return F.col(f"{self.prefix}{self.actions.index(action)}")


def _lost(old: Column, new: Column) -> Column:
    return old.isNotNull() & new.isNull()


def observed_clean(df: DataFrame, plan: CleaningPlan, name: str = "cleaning") -> DataFrame:
    """Normalised, converted and validated rows, as :func:`clean_stream` gives them, of a stream or a
    batch, whose counters are observed under ``name``.

    The counters are those of the batch log that need one row at a time; there is no
    de-duplication, so copies count each time. An empty batch counts zeros, or nothing where
    Spark does not run it. Columns that the plan dropped take part in the counts of missing tokens alone.
    """
    df = nan_to_null(names.standardize_names(df))
    kept, texts = [new for _, new in plan.columns], [f.name for f in df.schema if _is_text(f)]
    steps = _Steps(df)
    free = {c: text.missing_tokens(col(c)) for c in texts}
    any_raw = _total([col(c).isNotNull() for c in df.columns]) > 0
    filled = _has_value(df.select(*[col(c) for c in kept])) if kept else F.lit(False)
    steps.step(free, {
        "Original rows": F.lit(1).cast("long"),
        "Blank rows removed": _total([~any_raw]),
        "Rows blank after token normalization": _total([any_raw & ~filled]),
        "Missing tokens normalized": _total([text.changed(col(c), free[c]) for c in texts]),
        "Missing tokens normalized (including new missing)": _total([text.changed_null_safe(col(c), free[c]) for c in texts])})
    spelled = {c: _spelled(c, col(c)) for c in texts}
    steps.step(spelled, {"Text cells whitespace/name-normalized": _total([text.changed(col(c), spelled[c]) for c in texts])}, kept)
    for action, new in (
            ("Formatting-only categorical variants standardized",
             {c: F.coalesce(text.lookup(col(c), dict(sorted(m.items()))), col(c)) for c, m in plan.label_map.items() if m}),
            ("Semantic categorical aliases standardized",
             {c: labels.semantic_alias(col(c), c) for c, k in plan.kinds.items() if k == "text" and labels.has_vocabulary(c)})):
        steps.step(new, {action: _total([text.changed(col(c), value) for c, value in new.items()])})
    types = {f.name: f.dataType for f in steps.rows.schema}
    typed = {c: plan._converted(c, types[c]) for c in kept}
    of = lambda *kinds: [c for c in kept if plan.kinds[c] in kinds]
    steps.step(typed, {
        "unreadable numbers": _total([_lost(col(c), typed[c]) for c in of(*NUMERIC_KINDS)]),
        "Invalid date values converted to missing": _total([_lost(col(c), typed[c]) for c in of("date")])})
    bounds = {c: validate.range_of(c) for c in of(*NUMERIC_KINDS) if validate.range_of(c)}
    outside = {c: validate.is_out_of_range(col(c), b) for c, b in bounds.items()}
    steps.step({c: F.when(~out, col(c)) for c, out in outside.items()},
               {f"Invalid {c} values set to missing": _total([out]) for c, out in outside.items()})
    valid = {c: (validate.valid_email if plan.kinds[c] == "email" else validate.valid_phone)(col(c)) for c in of("email", "phone")}
    steps.step(valid, {f"Invalid {kind}s converted to missing": _total([_lost(col(c), valid[c]) for c in of(kind)])
                       for kind in ("email", "phone")})
    sums = {a: steps.tally(a) for a in steps.actions if a != "unreadable numbers"}
    sums["Invalid numeric values converted to missing"] = reduce(
        add, [steps.tally(f"Invalid {c} values set to missing") for c in bounds], steps.tally("unreadable numbers"))
    blank = steps.tally("Blank rows removed") + steps.tally("Rows blank after token normalization")
    seen = steps.rows.observe(name, *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in sums.items()])
    return seen.where(blank == 0).select(*[col(c) for c in kept])


class AuditListener(StreamingQueryListener):
    """Hands the counters of every finished batch on as (query, batch, seq, action, result) rows.
    ``deliver`` gets one list a batch; nothing is held here."""

    def __init__(self, deliver: Callable[[list[tuple]], None], name: str = "cleaning"):
        self.deliver, self.name = deliver, name

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is not None and progress.numInputRows:
            self.deliver([(str(progress.id), progress.batchId, i, action, int(n))
                          for i, (action, n) in enumerate(row.asDict().items(), 1)])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def to_folder(spark: SparkSession, folder: str) -> Callable[[list[tuple]], None]:
    """A receiver that appends every batch's rows to a Parquet folder."""
    def deliver(rows: list[tuple]) -> None:
        literal_table(spark, _AUDIT, rows).coalesce(1).write.mode("append").parquet(folder)
    return deliver


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit rows, each batch once, also where a batch was run again after a restart."""
    rows = spark.read.schema(", ".join(f"{c} {t}" for c, t in _AUDIT.items())).parquet(folder)
    place = F.row_number().over(Window.partitionBy("query", "batch", "action").orderBy("seq", "result"))
    return rows.withColumn("place", place).where("place = 1").drop("place")

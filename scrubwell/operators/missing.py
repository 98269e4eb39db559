"""Blank rows and columns, duplicates, and missing-value strategies."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from .infer import NUMERIC_KINDS
from .quantiles import exact_quantiles
from .tables import col, from_groupable, groupable, literal_table, nan_to_null, row_to_rows, stage

STRATEGIES = ("leave", "median_mode", "constant", "drop_rows")
PROTECTED_KINDS = ("id", "email", "phone", "date", "other")


def token_changes(df: DataFrame) -> DataFrame:
    """Per text column, the cells that token normalisation changes: value to value, and with
    values that became missing. One aggregate."""
    columns = names.text_columns(df)
    pairs = [(col(c), text.missing_tokens(col(c))) for c in columns]
    row = df.agg(*[x for i, (old, new) in enumerate(pairs) for x in (
        F.count_if(text.changed(old, new)).alias(f"a{i}"), F.count_if(text.changed_null_safe(old, new)).alias(f"b{i}"))])
    return row_to_rows(row, {"column": "string", "changed": "long", "changed_null_safe": "long"},
                       [(F.lit(c), F.col(f"a{i}"), F.col(f"b{i}")) for i, c in enumerate(columns)])


def basic_token_counts(df: DataFrame) -> DataFrame:
    """Per text column, the cells that the basic missing tokens empty. One aggregate."""
    columns = names.text_columns(df)
    row = df.agg(F.count(F.lit(1)), *[F.count_if(col(c).isNotNull() & text.basic_missing_tokens(col(c)).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    return row_to_rows(row, {"column": "string", "emptied": "long"}, [(F.lit(c), F.col(f"n{i}")) for i, c in enumerate(columns)])


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return nan_to_null(df).na.drop(how="all")


def filled_counts(df: DataFrame) -> dict[str, int]:
    df = nan_to_null(df)
    row = df.agg(*[F.count(col(c)).alias(f"_{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[i] for i, c in enumerate(df.columns)}


def drop_blank_columns(df: DataFrame) -> DataFrame:
    filled = filled_counts(df)
    return df.select(*[col(c) for c in df.columns if filled[c]])


#: digests that are broadcast (32 MB); where more occur twice, whole rows are shuffled instead
MOST_DIGESTS = 1_000_000
_DIGEST = ("_digest_a", "_digest_b")


def _digested(rows: DataFrame) -> DataFrame:
    """Rows with 128 bits of hashes. Equal rows have equal digests; the second also tells where
    NULLs stand, which hashes pass over."""
    values = [col(c) for c in rows.columns]
    gaps = F.concat(*[c.isNull().cast("int").cast("string") for c in values])
    return rows.withColumns({_DIGEST[0]: F.xxhash64(F.lit("a"), *values), _DIGEST[1]: F.xxhash64(gaps, *reversed(values))})


def suspects(df: DataFrame) -> tuple[DataFrame, int]:
    """Digests of more than one row, and how many there are. Only digests are shuffled."""
    counted = _digested(groupable(nan_to_null(df))).groupBy(*_DIGEST).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = stage(counted.select(*_DIGEST), "repeated-digests")
    return found, found.count()


def dedupe(df: DataFrame, found: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Exact duplicates only, never by identifier. NULLs compare equal, and so do maps with the
    same entries.

    A first pass, run at once, groups digests of the rows. A row whose digest is its own is
    distinct and stays where it is; only rows that share a digest are shuffled and compared whole.
    Without any, the table itself comes back. Where over MOST_DIGESTS digests occur twice, all rows
    are shuffled; copies on the same executor collapse before either shuffle. ``found`` are the
    :func:`suspects` of the same table, if known."""
    rows = groupable(nan_to_null(df))
    if not rows.columns:
        return df
    if df.isStreaming:
        return from_groupable(rows.dropDuplicates(), df)
    repeated, n = found or suspects(df)
    if not n:
        return nan_to_null(df)
    if n > MOST_DIGESTS:
        return from_groupable(rows.dropDuplicates(), df)
    marked = _digested(rows)
    apart = marked.join(F.broadcast(repeated), list(_DIGEST), "left_anti").select(*[col(c) for c in rows.columns])
    again = marked.join(F.broadcast(repeated), list(_DIGEST), "left_semi").select(*[col(c) for c in rows.columns]).dropDuplicates()
    return from_groupable(apart.union(again), df)


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every repeated row once, with its number of copies. As in :func:`dedupe`, only rows that share
    a digest with another are shuffled."""
    rows = groupable(nan_to_null(df))
    found, n = suspects(df)
    if n <= MOST_DIGESTS:
        rows = _digested(rows).join(F.broadcast(found), list(_DIGEST), "left_semi").select(*[col(c) for c in rows.columns])
    counted = rows.groupBy(*[col(c) for c in rows.columns]).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return from_groupable(counted, nan_to_null(df), "copies")


def drop_missing_rows(df: DataFrame) -> DataFrame:
    return nan_to_null(df).na.drop(how="any")


#: counters a column in the summary of frequent values
COUNTERS = 1 << 14


def modes(df: DataFrame, columns: list[str], settle: list[str] | None = None) -> DataFrame:
    """(column, mode, ties): the most frequent value as text (smallest on a tie) and how many
    values share that frequency. Where ``settle`` names columns, only these settle ties; the mode
    of others is NULL if it is not the only one, and none of their texts is moved.

    A summary of COUNTERS counters a column comes first: every value adds to the counter of its
    hash, so no value occurs more often than its counter says. The values of each column's fullest
    counter are counted exactly; whatever lies under counters that fall short of the best of them
    cannot win. Only what remains is counted, by digest, and only winners travel as text.
    """
    spark = df.sparkSession
    schema = {"column": "string", "mode": "string", "ties": "long"}
    if not columns:
        return literal_table(spark, schema, [])
    cells = df.select(*[col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], [col(c) for c in columns], "column", "value").where(F.col("value").isNotNull())
    cells = cells.withColumn("digest", F.xxhash64("value")).withColumn("counter", F.pmod("digest", F.lit(COUNTERS)).cast("int"))
    summary = stage(cells.groupBy("column", "counter").agg(F.count(F.lit(1)).alias("n")), "mode-summary")  # COUNTERS rows a column
    fullest = summary.groupBy("column").agg(F.max_by("counter", F.struct("n", "counter")).alias("counter"))

    def counted(some: DataFrame) -> DataFrame:
        of = cells.join(F.broadcast(some.select("column", "counter")), ["column", "counter"], "left_semi")
        return of.groupBy("column", "counter", "digest", F.xxhash64(F.lit("b"), "value").alias("other")).agg(F.count(F.lit(1)).alias("n"))

    least = {r["column"]: r["n"] for r in counted(fullest).groupBy("column").agg(F.max("n").alias("n")).collect()}
    if not least:
        return literal_table(spark, schema, [])
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("column")]
    possible = stage(counted(summary.where(F.col("n") >= bound)).where(F.col("n") >= bound), "mode-counts")
    most = possible.groupBy("column").agg(F.max("n").alias("most"))
    winners = possible.join(F.broadcast(most), "column").where("n = most").select("column", "digest", "other")
    tied = stage(winners.groupBy("column").agg(F.count(F.lit(1)).alias("ties")), "mode-ties")
    settled = tied if settle is None else tied.where((F.col("ties") == 1) | F.col("column").isin(settle))
    winners = winners.join(F.broadcast(settled), "column")
    # the smallest text of each task travels, not every winner
    texts = (cells.withColumn("other", F.xxhash64(F.lit("b"), "value")).join(winners, ["column", "digest", "other"], "left_semi")
             .groupBy("column").agg(F.min("value").alias("mode")))
    return tied.join(texts, "column", "left").select("column", "mode", "ties")


def impute_stats(df: DataFrame, kinds: dict[str, str]) -> dict[str, object]:
    """Fill value per column under ``median_mode``: the median of numeric kinds, the smallest
    mode of booleans, the mode of text only where it is unique."""
    df = nan_to_null(df)
    filled = filled_counts(df)
    rows = df.agg(F.count(F.lit(1))).first()[0]
    gaps = [c for c in df.columns if 0 < filled[c] < rows and kinds.get(c) not in PROTECTED_KINDS]
    return fill_values(df, kinds, gaps)


def fill_values(df: DataFrame, kinds: dict[str, str], gaps: list[str]) -> dict[str, object]:
    numeric = [c for c in gaps if kinds.get(c) in NUMERIC_KINDS]
    values: dict[str, object] = {
        c: q["values"][0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
    labelled = [c for c in gaps if kinds.get(c) in ("boolean", "text")]
    for r in modes(df, labelled, settle=[c for c in labelled if kinds[c] == "boolean"]).collect():
        if kinds[r["column"]] == "boolean":
            values[r["column"]] = r["mode"] == "true"
        elif r["ties"] == 1:
            values[r["column"]] = r["mode"]
    return values


def constant_fills(kinds: dict[str, str]) -> dict[str, object]:
    """Fill value per column under ``constant``: 0 for numeric kinds, ``Unknown`` for text. A
    boolean column has no third value, so its gaps stay."""
    return {c: 0.0 if k in NUMERIC_KINDS else "Unknown" for c, k in kinds.items()
            if k in NUMERIC_KINDS or k == "text"}


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Put plan-time constants into the gaps; numeric columns become double."""
    def filled(c):
        v = values[c]
        x = col(c).cast("double") if isinstance(v, float) else col(c)
        return F.coalesce(x, F.lit(v)).alias(c)
    return df.select(*[filled(c) if c in values else col(c) for c in df.columns])


def impute_median_mode(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return fill(nan_to_null(df), impute_stats(df, kinds))


def impute_constant(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Numeric gaps become 0 and text gaps ``Unknown``; an all-empty numeric column stays empty."""
    df = nan_to_null(df)
    filled = filled_counts(df)
    return fill(df, {c: v for c, v in constant_fills(kinds).items() if filled.get(c) or v == "Unknown"})

"""Category labels: histogram, variant rules, dictionary and its application.

The only pass over the data is a (column, value) count of low-cardinality text columns. Every
rule then works on that bounded dictionary (at most 200 labels per column unless ``LabelLimits``
says otherwise; thousands are fine).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import names, text, vocab
from .tables import col, histogram, literal_table, long_form

@dataclass(frozen=True)
class LabelLimits:
    """How many labels a column may have to be a category: without and with a telling name, and
    for spelling repair, which compares labels with each other. Columns above are left alone."""
    plain: int = vocab.LABEL_LIMIT
    hinted: int = vocab.HINTED_LABEL_LIMIT
    spelling: int = vocab.SPELLING_LIMIT

    @property
    def gate(self) -> int:
        """Estimate up to which labels are counted exactly, far above the sketch's error."""
        return 4 * max(self.plain, self.hinted)


DEFAULT_LIMITS = LabelLimits()
_RAW_GATE = 20_000       # raw spellings counted exactly without a second sketch


# --- keys ---------------------------------------------------------------------------------
def format_key(c: Column, keep_code_signs: bool = True) -> Column:
    """Label without case, separators and punctuation. A ``+``, ``-`` or ``#`` that ends a
    label is part of the name (``A+``, ``C#``) and stays unless told otherwise."""
    x = F.lower(text.trim(c))
    drop, gaps = r"(?U)[^\w ]+", r"(?U)[\s_\-/]+"
    if keep_code_signs:
        tail = F.regexp_extract(x, r"(?U)\w([+#\-]+)\z", 1)
        body = F.regexp_replace(x, r"(?<=(?U:\w))[+#\-]+\z", "")
        return F.concat(text.trim(F.regexp_replace(F.regexp_replace(body, gaps, " "), drop, "")), tail)
    return text.trim(F.regexp_replace(F.regexp_replace(x, gaps, " "), drop, ""))


def compact_key(format_key_: Column) -> Column:
    """Format key without spaces, so joined and split spellings meet; NULL when nothing is left.
    Code signs stay."""
    x = F.regexp_replace(format_key_, r"[^a-z0-9+#\-]+", "")
    x = F.when(x.rlike("[a-z0-9]"), x)
    return F.coalesce(text.lookup(x, vocab.COMPACT_ALIASES), x)


def singular_key(key: Column) -> Column:
    n = F.length(key)
    cut = lambda k: F.left(key, n - k)
    return (F.when(key.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
            .when(key.endswith("ses") & (n > 5), cut(2))
            .when(key.endswith("s") & ~key.endswith("ss") & (n > 3), cut(1))
            .otherwise(key))


# --- histogram and gate -------------------------------------------------------------------
def label_inputs(df: DataFrame, columns=None) -> list[str]:
    """Text columns that may hold labels, judged by name."""
    chosen = names.text_columns(df) if columns is None else columns
    return [c for c in chosen if not names.is_contact_or_id(c) and not names.is_name(c)]


def value_counts(df: DataFrame, columns=None, clean=text.collapse) -> DataFrame:
    """(column, value, cnt) of cleaned, filled cells. Raw cells are counted first, so hot values
    collapse map-side and the cleaning rule runs once per distinct cell instead of once per row."""
    columns = names.text_columns(df) if columns is None else columns
    if not columns:
        return literal_table(df.sparkSession, {"column": "string", "value": "string", "cnt": "long"}, [])
    cells = long_form(df.select(*[col(c) for c in columns])).where(F.col("value").isNotNull())
    # bound to the count, else the filter on cleaned values would be pushed below it and clean every cell
    return (histogram(cells).select("column", F.when(F.col("n") > 0, clean(F.col("value"))).alias("value"), "n")
            .where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.sum("n").alias("cnt")))


def _distinct_estimates(df: DataFrame, columns: list[str], rule) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(rule(col(c))).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def few_valued(df: DataFrame, columns: list[str], limits: LabelLimits = DEFAULT_LIMITS) -> list[str]:
    """Columns whose distinct count is possibly within the label limits, so that free text is
    spared the exact count. Raw cells are sketched first; only columns with many raw spellings are
    sketched again in cleaned form. The gate is far above the sketch's error at the true limit."""
    raw = _distinct_estimates(df, columns, lambda c: c)
    many = [c for c in columns if raw[c] > _RAW_GATE]
    cleaned = _distinct_estimates(df, many, text.collapse)
    return [c for c in columns if cleaned.get(c, 0) <= limits.gate]


def label_sizes(df: DataFrame, columns=None, limits: LabelLimits = DEFAULT_LIMITS) -> DataFrame:
    """(column, distinct, filled, hinted, eligible) for every text column that may hold labels.
    Cells are counted by digest, so the content of free text does not travel."""
    columns = label_inputs(df, columns)
    spark = df.sparkSession
    if columns:
        cells = long_form(df.select(*[text.digest_long(text.collapse(col(c))).alias(c) for c in columns]))
        counts = histogram(cells.where(F.col("value").isNotNull()))
    else:
        counts = literal_table(spark, {"column": "string", "value": "string", "n": "long"}, [])
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("filled"))
    hints = literal_table(spark, {"column": "string", "hinted": "boolean"},
                          [(c, names.is_label_hint(c)) for c in columns])
    limit = F.when(F.col("hinted"), limits.hinted).otherwise(limits.plain)
    return (hints.join(sizes, "column", "left").na.fill(0, ["distinct", "filled"])
            .withColumn("eligible", F.col("distinct").between(1, limit)))


# --- dictionary ---------------------------------------------------------------------------
def label_groups(df: DataFrame, columns=None, limits: LabelLimits = DEFAULT_LIMITS) -> DataFrame:
    """Dictionary before spelling and title rules: one row per label of the eligible columns
    with each rule's verdict (NULL where it has none) in its own column."""
    candidates = few_valued(df, label_inputs(df, columns), limits)
    return rule_verdicts(value_counts(df, candidates), candidates, limits)


def rule_verdicts(counts: DataFrame, columns: list[str], limits: LabelLimits = DEFAULT_LIMITS) -> DataFrame:
    spark = counts.sparkSession
    traits = literal_table(
        spark, {"column": "string", "column_key": "string", "hinted": "boolean", "gender": "boolean",
                "bool_like": "boolean", "semantic": "boolean"},
        [(c, k, names.is_label_hint(c), names.is_gender(c), names.is_boolean_label(c),
          k in vocab.SEMANTIC_LABELS) for c in columns for k in [names.column_key(c)]])
    # from here on all rows of a column share a partition, so the windows add no shuffle
    labels = counts.join(F.broadcast(traits), "column").repartition("column")
    labels = (labels.withColumn("distinct", F.count(F.lit(1)).over(W.partitionBy("column")))
              .where(F.col("distinct") <= F.when(F.col("hinted"), limits.hinted).otherwise(limits.plain)))
    labels = labels.withColumn("format_key", format_key(F.col("value")))
    labels = labels.withColumn("compact_key", compact_key(F.col("format_key")))
    labels = labels.withColumn("plural_key", singular_key(F.col("format_key")))

    def merged(key: str, *order: Column) -> Column:
        """Best label of a group of two or more that share a key."""
        same = W.partitionBy("column", key)
        best = F.first("value").over(same.orderBy(*order, "value")
                                     .rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        shared = (F.count(F.lit(1)).over(same) > 1) & (F.coalesce(F.col(key), F.lit("")) != "")
        return F.when(shared, best)

    by_count, by_length = F.desc("cnt"), F.desc(F.length("value"))
    vocabulary = literal_table(
        spark, {"column_key": "string", "format_key": "string", "k6": "string"},
        [(k, raw, label) for k, table in vocab.SEMANTIC_LABELS.items() for raw, label in table.items()])
    truth = F.when(F.col("format_key").isin(*vocab.TRUE_WORDS), "True").when(
        F.col("format_key").isin(*vocab.FALSE_WORDS), "False")
    return (labels
            .withColumn("k3", merged("format_key", by_count))
            .withColumn("k4", merged("compact_key", by_count, by_length))
            .withColumn("k5", F.when(F.col("gender"), text.lookup(F.col("format_key"), vocab.GENDER)))
            .withColumn("k5b", F.when(F.col("hinted"), text.lookup(F.col("compact_key"), vocab.GENERIC_ALIASES)))
            .join(F.broadcast(vocabulary), ["column_key", "format_key"], "left")
            .withColumn("k7", F.when(F.col("bool_like"), truth))
            .withColumn("k8", merged("plural_key", by_count, by_length))
            .withColumn("resolved", F.when(F.col("gender"), F.coalesce("k5", "k4", "k3", "value"))
                        .otherwise(F.coalesce("k8", "k7", "k6", "k5b", "k4", "k3", "value"))))


def _spelling_repairer(limit: int, min_length: int, min_ratio: float):
    """Spelling verdicts for the labels of one column that share their first letter. A rare label
    takes the resolved form of a similar label with at least twice the count; going from frequent
    to rare, the model label is always settled first. Columns above the limit have no verdicts.

    The characters that two labels share, in whatever order, bound their ratio from above. Models
    are compared from the highest bound down, until no bound reaches the best ratio found, so
    that few ratios are worked out and the verdicts are those of all pairs.
    The function carries its constants along, so executors need no copy of this package."""
    def repair(labels):
        from difflib import SequenceMatcher

        import numpy as np

        labels = labels.sort_values(["cnt", "value"], ascending=[False, True])
        if not labels["plain"].iloc[0] or labels["distinct"].iloc[0] > limit:
            return labels.assign(k9=None)
        keys, counts, resolved = labels["format_key"].tolist(), labels["cnt"].to_numpy(), labels["resolved"].tolist()
        lengths = np.array([len(k) for k in keys])
        letters = {c: i for i, c in enumerate(sorted(set("".join(keys))))}
        held = np.zeros((len(keys), len(letters)), np.int32)
        for i, key in enumerate(keys):
            np.add.at(held[i], [letters[c] for c in key], 1)
        settled, verdicts = [], []
        for i, key in enumerate(keys):
            best, best_ratio = None, 0.0
            if len(key) >= min_length:
                models = np.searchsorted(-counts, -max(2, 2 * counts[i]), "right")
                most = 2.0 * np.minimum(held[:models], held[i]).sum(1) / (lengths[:models] + lengths[i])
                for j in np.argsort(-most, kind="stable"):
                    if most[j] < max(min_ratio, best_ratio) - 1e-9:
                        break
                    ratio = SequenceMatcher(None, key, keys[j]).ratio()
                    if ratio > best_ratio or best is not None and ratio == best_ratio and j < best:
                        best, best_ratio = j, ratio
            verdicts.append(settled[best] if best is not None and best_ratio >= min_ratio else None)
            settled.append(resolved[i] if verdicts[i] is None else verdicts[i])
        return labels.assign(k9=verdicts)
    return repair


def label_dictionary(df: DataFrame, columns=None, limits: LabelLimits = DEFAULT_LIMITS) -> DataFrame:
    """(column, value, cnt, …, canonical) for every label of the eligible columns."""
    return finish_dictionary(label_groups(df, columns, limits), limits)


def finish_dictionary(groups: DataFrame, limits: LabelLimits = DEFAULT_LIMITS) -> DataFrame:
    """Spelling repair and final title case. The rows of a column already share a partition, so
    the grouped step adds no shuffle; a group is one column's labels of one first letter, whose
    number is limited."""
    marked = groups.withColumn("plain", ~F.col("semantic") & ~F.col("gender") & F.col("hinted"))
    repaired = marked.groupBy("column", F.left("format_key", F.lit(1))).applyInPandas(
        _spelling_repairer(limits.spelling, vocab.SPELLING_MIN_LENGTH, vocab.SPELLING_RATIO),
        T.StructType(marked.schema.fields + [T.StructField("k9", T.StringType())]))
    label = F.coalesce("k9", "resolved")
    lower_case = (F.lower(label) == label) & (F.length(label) > 1)
    return repaired.withColumn("canonical", F.when(
        F.col("plain") & lower_case, text.title_case(text.collapse(label))).otherwise(label))


def as_mapping(dictionary: DataFrame) -> dict[str, dict[str, str]]:
    """The labels that change, per column; bounded by the limits."""
    mapping: dict[str, dict[str, str]] = {}
    changes = dictionary.where(F.col("value") != F.col("canonical"))
    for r in changes.select("column", "value", "canonical").collect():
        mapping.setdefault(r["column"], {})[r["value"]] = r["canonical"]
    return mapping


# --- application --------------------------------------------------------------------------
def apply_mapping(df: DataFrame, mapping: dict[str, dict[str, str]]) -> DataFrame:
    """Replace labels by their canonical form. The dictionary is bounded, so it is one literal
    map a column; the table is not moved."""
    tables = {c: t for c, t in mapping.items() if t}
    if not tables:
        return df
    return df.select(*[
        F.coalesce(text.lookup(col(c), dict(sorted(tables[c].items()))), col(c)).alias(c) if c in tables else col(c)
        for c in df.columns])


def normalize_labels(df: DataFrame, columns=None, limits: LabelLimits = DEFAULT_LIMITS) -> DataFrame:
    """Whitespace-clean the text columns and bring the labels of eligible ones to one spelling."""
    inputs = label_inputs(df, columns)
    mapping = as_mapping(label_dictionary(df, columns, limits))
    cleaned = df.select(*[text.collapse(col(c)).alias(c) if c in inputs else col(c) for c in df.columns])
    return apply_mapping(cleaned, mapping)


def has_vocabulary(name: str) -> bool:
    return names.column_key(name) in vocab.SEMANTIC_LABELS


def semantic_alias(c: Column, name: str) -> Column:
    """Canonical label where the trimmed, lower-cased cell is in the vocabulary that the column
    name selects; otherwise the cell itself."""
    table = vocab.SEMANTIC_LABELS.get(names.column_key(name))
    return c if table is None else F.coalesce(text.lookup(F.lower(text.trim(c)), table), c)


def apply_semantic_aliases(df: DataFrame) -> DataFrame:
    labelled = set(names.text_columns(df))
    return df.select(*[
        semantic_alias(col(c), c).alias(c) if c in labelled else col(c) for c in df.columns])


# --- consistency report -------------------------------------------------------------------
def alias_groups(df: DataFrame) -> DataFrame:
    """(column, groups): per non-numeric column with 10 or more filled cells, how many
    normalised spellings stand for two or more raw spellings. A group is mixed when the smallest
    and largest fingerprint (128 bits) of its raw cells differ: number buffers keep the
    aggregation hash-based with one shuffle, and long texts travel as digests."""
    numeric = set(names.numeric_columns(df))
    plain = [f.name for f in df.schema
             if f.name not in numeric and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    schema = {"column": "string", "groups": "long"}
    if not plain:
        return literal_table(df.sparkSession, schema, [])
    cells = long_form(df.select(*[text.trim(col(c).cast("string")).alias(c) for c in plain]))
    keyed = cells.where(F.col("value").isNotNull()).select(
        "column", F.regexp_replace(F.lower("value"), "[^a-z0-9]+", "").alias("norm"),
        F.xxhash64("value").alias("a"), F.xxhash64(F.lit("raw"), "value").alias("b"))
    keyed = keyed.withColumn("empty", F.col("norm") == "").withColumn("norm", text.digest_long(F.col("norm")))
    groups = keyed.groupBy("column", "norm", "empty").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("a")).alias("a"), F.min(F.col("a")).alias("a_low"),
        F.max(F.col("b")).alias("b"), F.min(F.col("b")).alias("b_low"))
    mixed = ~F.col("empty") & ((F.col("a") != F.col("a_low")) | (F.col("b") != F.col("b_low")))
    return (groups.groupBy("column").agg(F.count_if(mixed).alias("groups"), F.sum("n").alias("filled"))
            .where((F.col("filled") >= 10) & (F.col("groups") > 0)).select("column", "groups"))

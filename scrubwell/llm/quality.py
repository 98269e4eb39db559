"""Quality rules whose cutoffs are set by labelled holdouts under a risk bound, with DataFrame
operations only.

For every stratum and rule, cutoffs are tested from the loosest to the strictest: an exact
binomial test on the good labelled texts must show that the rule rejects no more than its share
of the allowed risk. The first failure ends the sequence (fixed-sequence testing, so steps need no
correction); the error rate is divided by the number of strata and rules (Bonferroni). With
probability 1 - ``error``, no stratum then loses more than ``risk`` of its good texts to the rules.
Among the cutoffs that passed, the one is taken that rejects the most bad labelled texts less good
ones (of equal ones the loosest), and none if no cutoff rejects more bad texts than good ones.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.tables import stage

SYMBOLS = "#*$%&|<>"
SPACES = r"[\x20\x09-\x0D]+"
BROADCAST = 10_000  # strata with limits (a short row each) that are broadcast; more are joined

#: rule -> cutoffs from loose to strict; a text is rejected above the cutoff
RULES = {
    "symbols_per_word": (1.5, 1.0, 0.75, 0.5, 0.35, 0.25),
    "marks_per_word": (1.5, 1.0, 0.75, 0.5, 0.35, 0.25),
    "repeated_words": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "repeated_lines": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
    "word_length": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0),
}


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
             carry: Column | None = None) -> DataFrame:
    """(id, row, stratum, n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words); ``row`` is
    whatever ``carry`` names, else null.

    Words are runs of other characters than 0x20 and 0x09-0x0D; a null text has none. Repeated
    words stand in a three-word window that occurs twice or more in the text; windows are told
    apart by 64-bit hashes of their words, cut by the bits that number the positions.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carry = F.lit(None).cast("boolean") if carry is None else carry
    rows = docs.select(F.col(id_col).alias("id"), carry.alias("row"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))

    def occurrences(of: str) -> Column:
        rest = F.col("text")
        for c in of:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return (F.length("text") - F.length(rest)).cast("long")

    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("id", "row", "stratum", occurrences(SYMBOLS).alias("n_symbols"), occurrences("!?").alias("n_marks"),
                       lines.alias("lines"), F.array_remove(F.split("text", SPACES, -1), "").alias("words"))
    places = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size("words") + 1)).cast("int"))
    rows = rows.select("id", "row", "stratum", "n_symbols", "n_marks", F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                       "words", places.alias("places"))
    # window hashes with the position in the low bits, sorted: equal windows become neighbours
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    keyed = F.when(F.col("n_words") >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
        lambda i: window(i).bitwiseAND(-F.col("places")) + i))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("keys", keyed).drop("words")
    near = lambda x, other: F.coalesce(x.bitwiseXOR(other).bitwiseAND(-F.col("places")) == 0, F.lit(False))
    again = F.filter("keys", lambda x, j: near(x, F.get("keys", j - 1)) | near(x, F.get("keys", j + 1)))
    rows = rows.withColumn("found", again).drop("keys")
    rows = rows.withColumn("at", F.sort_array(F.transform("found", lambda x: x.bitwiseAND(F.col("places") - 1)))).drop("found", "places")
    covered = F.aggregate(F.transform("at", lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("at", j + 1) - x, F.lit(3).cast("long")))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", "row", "stratum", "n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def rule_values() -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbols_per_word": ratio("n_symbols", "n_words"), "marks_per_word": ratio("n_marks", "n_words"),
            "repeated_words": ratio("n_repeat_words", "n_words"), "repeated_lines": ratio("n_dup_lines", "n_lines"),
            "word_length": ratio("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series at n + 10, brought back by ten exact steps."""
    m = n + 10.0
    series = m * F.log(m) - m + 0.5 * F.log(2 * math.pi * m) + 1 / (12 * m) - 1 / (360 * m * m * m)
    for j in range(1, 11):
        series = series - F.log(n + float(j))
    return series


def binomial_tail(n: Column, k: Column, p: float, terms: int = 4000) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), or 1 where k >= n * p. Up to ``terms`` terms are summed
    downward from k, the rest is bounded above by a geometric series, so the value never errs low."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    odds = (1 - p) / p
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    def step(acc, i):
        term = acc["term"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))
    count = F.least(k, F.lit(float(terms))).cast("int")
    summed = F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), first, step)
    last = k - count
    ratio = last / (n - last + 1) * odds
    rest = F.when(last > 0, summed["term"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.when(k >= n * p, 1.0).otherwise(top * (summed["sum"] + rest))


def cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float = 0.02, error: float = 0.05,
            rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """(stratum, rule, cutoff) for every rule that passes its test in a stratum and is of use.

    ``labels`` has id and good; a text labelled twice is good only if every label says so. Only
    texts that the base rules pass are counted. No labels: no rows.
    """
    good = labels.groupBy("id").agg(F.min(F.col("good").cast("int")).alias("good")).where("good IS NOT NULL")
    held = measured.join(good, "id").where(~base_failed())
    values = rule_values()
    is_good = F.col("good") == 1
    counted = held.groupBy("stratum").agg(F.count_if(is_good).alias("n"), *(
        F.count_if((values[r] > c) & flag).alias(f"{kind}_{r}_{i}") for r, cs in rules.items() for i, c in enumerate(cs)
        for kind, flag in (("good", is_good), ("bad", ~is_good)))).where("n > 0")
    counted = stage(counted, "quality-counts")
    tests = counted.select("stratum", "n", F.inline(F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"good_{r}_{i}").alias("k"), F.col(f"bad_{r}_{i}").alias("bad"))
        for r, cs in rules.items() for i, c in enumerate(cs)))))
    level = error / max(1, counted.count() * len(rules))
    tests = tests.withColumn("passed", binomial_tail(F.col("n"), F.col("k"), risk / len(rules)) <= level)
    ended = F.coalesce(F.min(F.when(~F.col("passed"), F.col("step"))), F.lit(1 << 30))
    steps = tests.groupBy("stratum", "rule").agg(ended.alias("ended"), F.collect_list(F.struct(
        (F.col("bad") - F.col("k")).alias("gain"), (-F.col("step")).alias("back"), "cutoff")).alias("steps"))
    best = F.array_max(F.filter("steps", lambda x: -x["back"] < F.col("ended")))
    return steps.withColumn("best", best).where("best.gain > 0").select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def _limits(chosen: DataFrame) -> DataFrame:
    """One row a stratum, one column a rule."""
    return stage(chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"limit_{r}") for r in RULES)),
                 "quality-limits")


def _verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    values = rule_values()
    failed = F.array_compact(F.array(*(F.when(values[r] > F.col(f"limit_{r}"), F.lit(r)) for r in RULES)))
    out = measured.join(limits, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("rejected_by", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Measures, base_failed, rejected_by (names of the rules above their cutoffs) and kept for
    every row of ``docs``. A null stratum is its own; a stratum without enough labels has no
    cutoffs and only the base rules apply. A null or empty text fails the base rules. Rows with a
    null id are judged, not learnt from; repeated rows are judged alike; an empty table gives no rows.
    """
    measured = stage(measures(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col).drop("row"), "quality-measures")
    out = _verdicts(measured, _limits(cutoffs(measured, labels, risk=risk, error=error)))
    return out.select(F.col("id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines",
                      "n_repeat_words", "base_failed", "rejected_by", "kept")


def passing(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
            risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` would keep, with all their columns. Every text is
    measured once, where it is read, and written beside its measures; the labels meet the measures
    alone, and the few limits come to the rows, so no text is shuffled."""
    carry = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    measured = stage(measures(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col, carry=carry), "quality-rows")
    limits = _limits(cutoffs(measured.drop("row"), labels, risk=risk, error=error))
    if limits.count() <= BROADCAST:
        limits = F.broadcast(limits)
    return _verdicts(measured, limits).where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

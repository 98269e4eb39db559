"""Document rates whose expected domain totals meet target weights, with DataFrame operations only.

A naive Bayes classifier over the presence of telling words, learnt from a labelled table, gives
every document a posterior over domains (soft membership). Projected-gradient least squares then
finds nonnegative rates, as near to 1 as the start, so that the expected tokens of each domain,
summed over all documents by rate and posterior, meet their targets.
"""
from __future__ import annotations

import warnings
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.tables import stage

SPACES = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACES, -1), "")


def learn(texts: DataFrame, marks: DataFrame, *, words: int = 96, rows: int = 10_000, smoothing: float = 0.5) -> tuple[list[str], list[str], dict, dict]:
    """Domains, telling words, log odds and base scores of the classifier.

    ``texts`` has id and text, ``marks`` id and domain. At most ``rows`` marks are drawn, the first
    by hash of the id, and only these, a table of fixed size, meet the texts. For each domain the
    words with the largest gain over the others are taken, about ``words`` in all, so the model's
    size is fixed.
    """
    drawn = marks.where("id IS NOT NULL AND domain IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id", "domain").limit(rows)
    some = texts.join(stage(drawn, "mixing-drawn"), "id")
    some = stage(some.select("domain", F.array_distinct(_words(F.coalesce("text", F.lit("")))).alias("words")), "mixing-labelled")
    sizes = {r.domain: r.n for r in some.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()}
    domains = sorted(sizes)
    if not domains:
        return [], [], {}, {}
    counts = some.select("domain", F.explode("words").alias("word")).groupBy("word").agg(
        *(F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)))
    share = [(F.col(f"n{i}") + smoothing) / (sizes[d] + 2 * smoothing) for i, d in enumerate(domains)]
    every = sum(F.col(f"n{i}") for i in range(len(domains)))
    chosen = None
    for i in range(len(domains)):
        others = sum((s for j, s in enumerate(share) if j != i), F.lit(1e-6)) / max(len(domains) - 1, 1)
        gain = share[i] * F.log(share[i] / others)
        best = counts.where(every >= 5).orderBy(gain.desc(), "word").limit(-(-words // len(domains)))
        chosen = best if chosen is None else chosen.union(best)
    picked = chosen.distinct().orderBy("word").collect()
    total = sum(sizes.values())
    odds, base = {}, {d: 0.0 for d in domains}
    for i, d in enumerate(domains):
        base[d] = log(sizes[d] / total)
        for r in picked:
            p = (r[f"n{i}"] + smoothing) / (sizes[d] + 2 * smoothing)
            base[d] += log(1 - p)
            odds[d, r.word] = log(p) - log(1 - p)
    return domains, [r.word for r in picked], odds, base


def posteriors(docs: DataFrame, model, *, id_col: str, text_col: str, carry: Column | None = None) -> DataFrame:
    """(id, row, tokens, p): the number of words and one probability a domain, in sorted order;
    ``row`` is whatever ``carry`` names, else null."""
    domains, words, odds, base = model
    carry = F.lit(None).cast("boolean") if carry is None else carry
    rows = docs.select(F.col(id_col).alias("id"), carry.alias("row"), _words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    if words:
        known = F.array_intersect(F.col("words"), F.array(*map(F.lit, words)))
    else:
        known = F.array().cast("array<string>")
    rows = rows.select("id", "row", F.size("words").cast("long").alias("tokens"), known.alias("known"))
    has = {w: F.array_contains("known", w).cast("double") for w in words}
    scores = [sum((has[w] * odds[d, w] for w in words), F.lit(base[d])) for d in domains]
    rows = rows.select("id", "row", "tokens", F.array(*scores).alias("s"))
    raised = F.transform("s", lambda x: F.exp(x - F.array_max("s")))
    rows = rows.select("id", "row", "tokens", raised.alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", "row", "tokens", total.alias("total"), "e").select(
        "id", "row", "tokens", F.transform("e", lambda x: F.round(x / F.col("total"), 9)).alias("p"))


def _inverse(a: list[list[float]], least: float) -> list[list[float]]:
    """Gauss-Jordan with row pivots; a is one row a domain, so this is small. A pivot under
    ``least`` belongs to a domain that others already tell: it gets no step of its own."""
    n = len(a)
    m = [list(row) + [1.0 if i == j else 0.0 for j in range(n)] for i, row in enumerate(a)]
    free = []
    for i in range(n):
        k = max((r for r in range(n) if r not in free), key=lambda r: abs(m[r][i]))
        if abs(m[k][i]) < least:
            continue
        free.append(k)
        m[k] = [x / m[k][i] for x in m[k]]
        for r in range(n):
            if r != k:
                m[r] = [x - m[r][i] * y for x, y in zip(m[r], m[k])]
        m[i], m[k] = m[k], m[i]
        free[-1] = i
    return [m[i][n:] if i in free else [0.0] * n for i in range(n)]


def rate_of(p: Column, moves: list[list[float]], start: Column | None = None) -> Column:
    """A document's rate from its posterior: 1 (or ``start``), then every step, each projected on
    at least 0."""
    rate = F.lit(1.0) if start is None else start
    for move in moves:
        rate = F.greatest(F.lit(0.0), rate + sum((p[i] * x for i, x in enumerate(move[1:], 1)), p[0] * move[0]))
    return rate


class Unreached(UserWarning):
    """The steps ended before the targets were met."""


def steps(members: DataFrame, targets: dict[str, float], domains: list[str], *, tolerance: float = 1e-4,
          max_rounds: int = 60, rounds_a_pass: int = 6) -> tuple[list[list[float]], float]:
    """The moves that :func:`rate_of` follows, and the largest gap left, as a share of all tokens.

    ``members`` has id, tokens and p. The least-squares error, measured by the inverse of the domains'
    token-weighted products of posteriors (so that one step is exact as long as no rate meets
    zero), is lowered by steps along its gradient, each projected on rates of at least 0. Ends when
    every domain is within ``tolerance`` of the total, or after ``max_rounds`` steps, with a warning of
    the gap, for example when posteriors cannot give a domain its share. Every step is one
    aggregate over the members; the rates are written out after every ``rounds_a_pass`` steps.
    """
    n = len(domains)
    p = [F.col("p")[i] for i in range(n)]
    products = [F.sum(F.col("tokens") * p[i] * p[j]) for i in range(n) for j in range(i, n)]
    row = members.agg(F.sum("tokens").alias("tokens"), *(x.alias(f"g{k}") for k, x in enumerate(products))).first()
    total = float(row.tokens or 0)
    weight = sum(max(targets.get(d, 0.0), 0.0) for d in domains)
    if not total or not weight:
        return [], 0.0
    goal = [total * max(targets.get(d, 0.0), 0.0) / weight for d in domains]
    gram, k = [[0.0] * n for _ in range(n)], 0
    for i in range(n):
        for j in range(i, n):
            gram[i][j] = gram[j][i] = float(row[f"g{k}"] or 0.0)
            k += 1
    for i in range(n):
        gram[i][i] += 1e-9 * total
    inverse = _inverse(gram, 1e-8 * total)
    moves: list[list[float]] = []
    current, since = stage(members.select("id", "tokens", "p").withColumn("rate", F.lit(1.0)), "mixing-rates"), []
    while True:
        rate = rate_of(F.col("p"), since, F.col("rate"))
        sums = current.agg(*(F.sum(F.col("tokens") * rate * p[i]).alias(f"t{i}") for i in range(n))).first()
        missing = [goal[i] - float(sums[f"t{i}"] or 0.0) for i in range(n)]
        gap = max(map(abs, missing)) / total
        if gap <= tolerance:
            return moves, gap
        if len(moves) >= max_rounds:
            warnings.warn(f"after {len(moves)} steps a domain's tokens miss their target by {gap:.3g} of all tokens", Unreached, stacklevel=3)
            return moves, gap
        since.append([sum(inverse[i][j] * missing[j] for j in range(n)) for i in range(n)])
        moves.append(since[-1])
        if len(since) == rounds_a_pass:
            current, since = stage(current.withColumn("rate", rate_of(F.col("p"), since, F.col("rate"))), "mixing-rates"), []


def mixing_rates(docs: DataFrame, marks: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text",
                 tolerance: float = 1e-4) -> DataFrame:
    """(id_col, tokens, rate, p_<domain> ...) for every row of ``docs``.

    ``marks`` has id and domain of labelled rows; ``targets`` gives each domain's share of the expected
    tokens (rescaled over the domains that occur; a domain without target gets none). A null or
    empty text has no tokens, so its rate moves nothing; its posterior is that of no words. Words
    are lower-cased runs of other characters than 0x20 and 0x09-0x0D. Without labelled rows all
    rates are 1. Repeated rows get equal rates; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = learn(texts, marks)
    domains = model[0]
    members = stage(posteriors(docs, model, id_col=id_col, text_col=text_col).drop("row"), "mixing-members")
    moves, _ = steps(members, targets, domains, tolerance=tolerance)
    return members.select(F.col("id").alias(id_col), "tokens", F.round(rate_of(F.col("p"), moves), 6).alias("rate"),
                        *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)))


def copies(key: Column, rate: Column) -> Column:
    """How often a document is taken at its rate: the whole part, and one more with the chance of
    the rest, decided by a hash of the key, so the choice is the same in every run."""
    chance = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1_000_003)) / 1_000_003.0
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def mixed(docs: DataFrame, marks: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text",
          tolerance: float = 1e-4) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as its rate says (see :func:`copies`).
    A rate follows from the posterior and the steps, so it is worked out beside the text: no
    text meets a join. Rows with one id but other texts have rates of their own."""
    model = learn(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), marks)
    carry = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    members = stage(posteriors(docs, model, id_col=id_col, text_col=text_col, carry=carry), "mixing-rows")
    moves, _ = steps(members, targets, model[0], tolerance=tolerance)
    times = copies(F.col("id"), F.round(rate_of(F.col("p"), moves), 6))
    taken = members.select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times")).alias("time"))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

"""Toxicity by a convolutional classifier over hashed word embeddings, trained in numpy.

A word (a run of letters or digits, lower-cased) is the sum of embeddings of its hash and of the
hashes of its first bytes, so that unseen forms of a known stem are recognised. Filters of several
widths slide over the text, each keeps its maximum, and a logistic layer reads these maxima.
The threshold of a language is the one with the best F1 on those of its labelled texts, a fifth of all,
that the network was not trained on.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.tables import stage
from .memory import per_batch
from .words import words

STEMS = (None, 4, 5, 6)   # a word's hashed parts: the whole, then its first bytes
BUCKETS, DIMENSION, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
PAD = len(STEMS) * BUCKETS
_SLICE = 1 << 20


def _between() -> np.ndarray:
    table = np.ones(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[a:b] = False
    return table


def features(column):
    """(first row, ids [slots, parts], offsets) for slices of texts. Every text ends in empty
    slots, so that each of its words starts a window of every width."""
    for part in words(column, _SLICE, _between()):
        n = np.diff(part.offsets)
        ids = np.stack([(part.hashes(k) & np.uint64(BUCKETS - 1)).astype(np.int32) + j * BUCKETS for j, k in enumerate(STEMS)], 1)
        slots = np.maximum(n, 1) + max(WIDTHS) - 1
        offsets = np.concatenate(([0], np.cumsum(slots)))
        out = np.full((int(offsets[-1]), len(STEMS)), PAD, np.int32)
        out[np.arange(len(ids)) + np.repeat(offsets[:-1] - part.offsets[:-1], n)] = ids
        yield part.first, out, offsets


class Network:
    """Parameters are plain arrays, so a network travels to executors as it is."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = (rng.normal(size=(PAD + 1, DIMENSION)) * 0.1).astype(np.float32)
        self.embedding[PAD] = 0
        self.filters = [(rng.normal(size=(w, DIMENSION, FILTERS)) * 0.5 / np.sqrt(w)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.head = (rng.normal(size=len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.offset = 0.0

    def pooled(self, ids: np.ndarray, offsets: np.ndarray):
        """Embedded slots, all filter responses, and their maximum in every text."""
        x = self.embedding[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            x = x + self.embedding[ids[:, j]]
        n = len(x)
        responses = np.empty((n, len(self.bias)), np.float32)
        for k, (w, filters) in enumerate(zip(WIDTHS, self.filters)):
            total = x @ filters[0]
            for j in range(1, w):
                total[:n - j] += x[j:] @ filters[j]
            responses[:, k * FILTERS:(k + 1) * FILTERS] = total
        tail = max(WIDTHS) - 1  # windows that start in the empty slots do not count
        last = (offsets[1:, None] - 1 - np.arange(tail)).ravel()
        responses[last] = -np.inf
        return x, responses, np.maximum.reduceat(responses, offsets[:-1], axis=0)

    def logits(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + self.bias, 0) @ self.head + self.offset

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(self.pooled(ids, offsets)[2])
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[np.ndarray], labels: np.ndarray, prior: float, *, epochs: int = 14, batch: int = 64,
          rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Network:
    """Fit by Adagrad on texts given as slot ids. ``prior`` is the share of label 1 among all
    labelled training texts; the last offset is moved from the sample's share to it."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        net.head[:] = 0
        net.offset = float(np.log((prior * len(texts) + 0.5) / ((1 - prior) * len(texts) + 0.5))) if len(texts) else float(np.log(0.01))
        return net
    squares = {"embedding": np.full_like(net.embedding, 1e-4), "bias": np.full_like(net.bias, 1e-4), "head": np.full_like(net.head, 1e-4)}
    filter_squares, offset_square = [np.full_like(f, 1e-4) for f in net.filters], 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), batch):
            pick = order[start:start + batch]
            ids = np.concatenate([texts[i] for i in pick])
            offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in pick])))
            x, responses, top = net.pooled(ids, offsets)
            active = (top + net.bias > 0).astype(np.float32)
            error = (1 / (1 + np.exp(-np.clip(net.logits(top), -30, 30))) - labels[pick]).astype(np.float32) / len(pick)
            d_head = (np.maximum(top + net.bias, 0) * error[:, None]).sum(0) + decay * net.head
            d_top = error[:, None] * net.head * active
            text_of = np.repeat(np.arange(len(pick)), np.diff(offsets))
            at, unit = np.nonzero(responses == top[text_of])
            key, first = np.unique(text_of[at] * len(net.bias) + unit, return_index=True)
            at, unit, grad = at[first], unit[first], d_top.ravel()[key]
            live = grad != 0
            at, unit, grad = at[live], unit[live], grad[live]
            rows, steps = [], []
            for k, w in enumerate(WIDTHS):
                own = (unit // FILTERS) == k
                a, u, g = at[own], unit[own] % FILTERS, grad[own]
                d_filter = np.zeros_like(net.filters[k])
                for j in range(w):
                    np.add.at(d_filter[j].T, u, g[:, None] * x[a + j])
                    rows.append(a + j)
                    steps.append(g[:, None] * net.filters[k][j].T[u])
                d_filter += decay * net.filters[k]
                filter_squares[k] += d_filter ** 2
                net.filters[k] -= rate * d_filter / np.sqrt(filter_squares[k])
            rows, steps = np.concatenate(rows), np.concatenate(steps)
            touched, inverse = np.unique(ids[rows], return_inverse=True)
            d_embedding = np.zeros((len(touched), DIMENSION), np.float32)
            np.add.at(d_embedding, inverse.reshape(len(rows), -1), steps[:, None, :])
            d_embedding[touched == PAD] = 0
            squares["embedding"][touched] += d_embedding ** 2
            net.embedding[touched] -= rate * d_embedding / np.sqrt(squares["embedding"][touched])
            for name, d in (("bias", d_top.sum(0)), ("head", d_head)):
                squares[name] += d ** 2
                getattr(net, name)[:] -= rate * d / np.sqrt(squares[name])
            offset_square += float(error.sum()) ** 2
            net.offset -= rate * float(error.sum()) / np.sqrt(offset_square)
    share = labels.mean()
    net.offset += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def _encode(batches):
    for batch in batches:
        texts = [ids[offsets[i]:offsets[i + 1]] for _, ids, offsets in features(batch.column(0)) for i in range(len(offsets) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary()), batch.column(1)], names=["slots", "label"])


def _scores(net: Network):
    def run(batches):
        for batch in batches:
            out = [net.scores(ids, offsets) for _, ids, offsets in features(batch.column(1))]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["row", "score"])
    return run


def longest(lengths: list[tuple[int, int]], slots: int) -> int:
    """The length in characters to which texts (length, number of such) are cut to hold ``slots`` words; six characters
    count as a word, and three words are added to a text."""
    left, texts = 6 * (slots - 3 * sum(n for _, n in lengths)), sum(n for _, n in lengths)
    for length, n in sorted(lengths):
        if length * texts > left:
            return max(left // texts, 1)
        left, texts = left - length * n, texts - n
    return max((length for length, _ in lengths), default=0)


def fit(docs: DataFrame, marks: DataFrame, *, rows: int = 4000, slots: int = 6_000_000, **options) -> Network:
    """A network from ``docs`` (id, text) and ``marks`` (id, label; one row an id). Of each label at
    most ``rows`` / 2 ids are drawn, the first by hash. Their texts are whole as long as they hold
    about ``slots`` words together; else the longest are cut, all to one length, at which they do, and
    of each the window is taken that a hash says, so that every drawn id is learned from. Of ids
    with more than ``slots`` / 6 texts together the first texts of every id are taken. The share of
    label 1 is counted over all marked ids. Only the drawn ids, a table of fixed size, meet the texts."""
    known = stage(docs.select("id").distinct().join(marks.where("label IS NOT NULL"), "id"), "toxicity-known")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(rows // 2)
        drawn = some if drawn is None else drawn.union(some)
    texts = stage(docs.join(stage(drawn, "toxicity-drawn"), "id").select("id", "text", "label"), "toxicity-texts")
    order = [F.xxhash64("id"), "id", "text"]
    if texts.count() > slots // 6:  # ids with many texts: the first texts of all ids go before the second ones
        turn = F.row_number().over(Window.partitionBy("id").orderBy("text"))
        texts = stage(texts.withColumn("turn", turn).orderBy("turn", *order).limit(slots // 6).drop("turn"), "toxicity-texts")
    lengths = [(r.length, r.n) for r in texts.groupBy(F.length("text").alias("length")).agg(F.count("*").alias("n")).collect()]
    most = longest(lengths, slots)
    start = F.pmod(F.xxhash64("id", F.lit("window")), F.length("text") - most + 1).cast("int") + 1
    window = F.when(F.length("text") > most, F.substring("text", start, F.lit(most))).otherwise(F.col("text"))
    held = texts.orderBy(*order).select(window.alias("text"), "label")
    data = held.mapInArrow(_encode, "slots binary, label int").collect()
    ids = [np.frombuffer(r.slots, np.int32).reshape(-1, len(STEMS)) for r in data]
    labels = np.array([r.label for r in data], np.float32)
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    return train(ids, labels, prior, **options)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang",
                   held_out: Column | None = None, rows: int = 4000, slots: int = 6_000_000, floor: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted, threshold, flagged) for every row of ``docs``.

    ``labels`` has id and label (1: toxic); rows for which ``held_out`` is true teach nothing. The
    score uses the text alone. predicted compares it with ``floor``; flagged with the threshold of
    the row's language (null: its own), which is ``floor`` where a language has no labelled texts
    of both kinds. Null texts are empty and are scored like any text. A text with several labels
    counts as toxic if one says so. Without labels all scores are equal. Repeated rows are scored
    alike; an empty table gives no rows; other columns are ignored. ``rows`` and ``slots`` bound the
    sample that is learned from, in ids and in words. A fifth of the labelled ids, by hash, is kept
    from the network; all of their texts set the thresholds.
    """
    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(language_col).cast("string"), F.lit("")).alias("language"), flag.alias("held"))
    marks = labels.groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label"))
    kept = F.pmod(F.xxhash64("id", F.lit("threshold")), F.lit(5)) == 0
    net = fit(docs.where(~F.col("held")).select("id", "text"), marks.where(~kept), rows=rows, slots=slots)
    kinds = dict(docs.dtypes)
    packed = docs.select(F.struct("id", "language", "held").alias("row"), "text")
    scored = stage(packed.mapInArrow(per_batch(_scores(net)), f"row struct<id:{kinds['id']},language:string,held:boolean>, score double")
                   .select("row.*", "score"), "toxicity-scores")
    limits = thresholds(scored.where(~F.col("held")).join(marks.where(kept), "id"), floor)
    out = scored.join(limits, "language", "left").withColumn("threshold", F.coalesce("threshold", F.lit(floor)))
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "score",
                      (F.col("score") >= floor).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def thresholds(scored: DataFrame, floor: float, steps: int = 100) -> DataFrame:
    """(language, threshold) with the best F1 among ``steps`` cutoffs; of equal ones the nearest
    to ``floor``. Languages without both labels are left out."""
    bins = scored.groupBy("language", F.least(F.floor(F.col("score") * steps), F.lit(steps - 1)).alias("bin")).agg(
        F.sum("label").alias("toxic"), F.count("*").alias("n"))
    above = Window.partitionBy("language").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("language")
    bins = bins.select("language", "bin", F.sum("toxic").over(above).alias("hit"), F.sum("n").over(above).alias("taken"),
                       F.sum("toxic").over(every).alias("toxic"), F.sum("n").over(every).alias("n"))
    f1 = 2 * F.col("hit") / (F.col("taken") + F.col("toxic"))
    cut = F.col("bin") / steps
    return bins.where("toxic > 0 AND toxic < n").groupBy("language").agg(F.max_by(cut, F.struct(f1, -F.abs(cut - floor), -cut)).alias("threshold"))

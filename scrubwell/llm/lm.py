"""Scores of texts under a smoothed bigram model run as a weighted backoff automaton.

States are histories, arcs carry the smoothed log-probability of a seen pair and lead to the next
history, failure arcs carry the escape weight and lead to the state without history. One pass from
left to right follows arcs, or fails and retries, and adds up weights.

The model grows with the corpus and is never held whole. Documents are packed into blocks; a
block's distinct words and pairs ask for their counts (requests go by hash to buckets, counts are
summed over all blocks, answers go back), and the block walks the part of the automaton that its
own texts can reach. A pair goes to the bucket of its history, which so counts the history's
different next words; pairs of frequent histories are spread by their own hashes and these counts
summed.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..operators.tables import stage
from .ids import long_id
from .memory import per_batch, per_group
from .words import mix, words

_END, _BEGIN = 0x0123456789ABCDEF, 0x0FEDCBA987654321
_PAIR = 0xD6E8FEB86659FD93
_LEVELS = 48
_SPREAD = 1 << 16  # histories at most whose pairs are spread

_BLOCK = ("block string, payload binary, vocabulary binary, ids array<long>, lengths array<int>, held array<boolean>, "
          "tokens long, frequent array<long>, counts array<long>")
_REQUEST = "block string, bucket long, words binary, word_counts binary, next_words binary, pairs binary, pair_counts binary, spread binary"
_ANSWER = ("block string, bucket long, word_totals binary, pair_totals binary, types long, total double, "
           "levels array<struct<level:int,count:double,kinds:double>>, spread array<struct<history:int,count:double,kinds:double>>")


def _pack(tokens: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int32)


def _pair_table(tokens, lengths, held, size):
    """Distinct pairs (history * size + word) of a block, their training counts, and for each
    token the training flag. History ``size - 1`` is the begin of a text."""
    keys = np.empty(len(tokens), np.int64)
    keys[1:] = tokens[:-1]
    keys[np.cumsum(lengths) - lengths] = size - 1
    keys *= size
    keys += tokens
    trains = np.repeat(~held, lengths)
    keys <<= 1
    keys |= trains
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] >> 1 != keys[:-1] >> 1)))
    seen = np.add.reduceat(keys & 1, first)
    return keys[first] >> 1, seen, trains


def _encode(block_bytes: int):
    def block(ids, held, pieces, lengths):
        hashes = np.concatenate(pieces)
        vocabulary, tokens, count = np.unique(hashes, return_inverse=True, return_counts=True)
        rank = np.argsort(-count, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        vocabulary, tokens = vocabulary[rank], place[tokens]
        lengths, held = np.array(lengths), np.array(held)
        often = np.flatnonzero(count[rank] >= max(2, len(tokens) >> 16))
        return {"block": uuid.uuid4().hex, "payload": _pack(tokens), "vocabulary": vocabulary.tobytes(), "ids": ids,
                "lengths": lengths.tolist(), "held": held.tolist(), "tokens": len(tokens),
                "frequent": vocabulary[often].view(np.int64).tolist(), "counts": count[rank][often].tolist()}

    schema = pa.schema([("block", pa.string()), ("payload", pa.binary()), ("vocabulary", pa.binary()),
                        ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())),
                        ("tokens", pa.int64()), ("frequent", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        ids, held, pieces, lengths, size = [], [], [], [], 0
        for batch in batches:
            all_ids, all_held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part in words(batch.column(1)):
                n = len(part)
                h, at = part.hashes(), part.offsets
                pieces.append(np.insert(h, at[1:], np.uint64(_END)))
                lengths += (np.diff(at) + 1).tolist()
                ids += all_ids[part.first:part.first + n]
                held += all_held[part.first:part.first + n]
                size += len(part.data) + 16 * n
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([block(ids, held, pieces, lengths)], schema)
                    ids, held, pieces, lengths, size = [], [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([block(ids, held, pieces, lengths)], schema)
    return run


class _Block:
    """``spread`` holds the hashes, in order, of the histories whose pairs go to buckets by their own hashes."""

    def __init__(self, row: dict, buckets: int, spread: np.ndarray):
        self.tokens, self.hashes = _unpack(row["payload"]), np.frombuffer(row["vocabulary"], np.uint64)
        self.lengths, self.held = np.array(row["lengths"], np.int64), np.array(row["held"], bool)
        self.size = len(self.hashes) + 1
        self.keys, self.seen, trains = _pair_table(self.tokens, self.lengths, self.held, self.size)
        self.words = np.bincount(self.tokens[trains], minlength=self.size - 1)
        history = self.keys // self.size
        self.pair_hashes = mix(np.append(self.hashes, np.uint64(_BEGIN))[history] * np.uint64(_PAIR) + self.hashes[self.keys % self.size])
        # no word follows the end of a text, and as many texts begin as end: pairs of the begin go with the end mark
        history[history == self.size - 1] = np.flatnonzero(self.hashes == np.uint64(_END))[0]
        self.word_order = np.argsort(self.hashes)
        self.rank = np.empty(self.size - 1, np.int64)
        self.rank[self.word_order] = np.arange(self.size - 1)
        self.history = self.rank[history]
        # the histories of spread pairs count from the number of words on
        place = np.searchsorted(spread, self.hashes)
        far = spread[np.minimum(place, len(spread) - 1)] == self.hashes if len(spread) else np.zeros(self.size - 1, bool)
        self.history = np.where(far[history], self.size - 1 + place[history], self.history)
        self.pair_buckets = _bucket(np.where(far[history], self.pair_hashes, self.hashes[history]), buckets)
        self.pair_order = np.argsort(self.pair_buckets * (self.size - 1 + len(spread)) + self.history, kind="stable")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) * buckets >> 24


def _short(hashes: np.ndarray) -> bytes:
    """The low 48 bits; with the bucket these tell grams apart."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(payloads) -> np.ndarray:
    six = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


def _requests(buckets: int, spread: np.ndarray):
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int64())] + [
        (c, pa.binary()) for c in ("words", "word_counts", "next_words", "pairs", "pair_counts", "spread")])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b, out = _Block(row, buckets, spread), []
                wh, wc = b.hashes[b.word_order], b.words[b.word_order].astype("<u4")
                ph, pc, history = b.pair_hashes[b.pair_order], b.seen[b.pair_order].astype("<u4"), b.history[b.pair_order]
                near = np.bincount(history[history < len(wh)], minlength=len(wh)).astype("<u4")
                wa = np.searchsorted(_bucket(wh, buckets), np.arange(buckets + 1))
                pb = np.searchsorted(b.pair_buckets[b.pair_order], np.arange(buckets + 1))
                for k in range(buckets):
                    w, p = slice(wa[k], wa[k + 1]), slice(pb[k], pb[k + 1])
                    if wa[k + 1] > wa[k] or pb[k + 1] > pb[k]:
                        far = history[p][int(near[w].sum()):] - len(wh)
                        out.append({"block": row["block"], "bucket": k, "words": _short(wh[w]), "word_counts": wc[w].tobytes(),
                                    "next_words": near[w].tobytes(), "pairs": _short(ph[p]), "pair_counts": pc[p].tobytes(),
                                    "spread": far.astype("<u2").tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _totals(keys: list, counts: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The sum over all blocks for every requested key, block by block; each request's key by
    number, the keys and all sums."""
    every, inverse = np.unique(_long(keys), return_inverse=True)
    total = np.zeros(len(every), np.uint64)
    np.add.at(total, inverse, np.frombuffer(b"".join(counts), "<u4").astype(np.uint64))
    return np.split(total[inverse], np.cumsum([len(k) // 6 for k in keys])[:-1]), inverse, every, total


def _answer(buckets: int, spread: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_pylist() for c in table.column_names}
        by_word, word, words_, total = _totals(col["words"], col["word_counts"])
        by_pair, pair, pairs, pair_total = _totals(col["pairs"], col["pair_counts"])
        # the history of every request's pair: words of this bucket, then spread ones
        history, at = [], 0
        for near, far in zip(col["next_words"], col["spread"]):
            near = np.frombuffer(near, "<u4")
            history += [np.repeat(word[at:at + len(near)], near), len(words_) + np.frombuffer(far, "<u2").astype(np.int64)]
            at += len(near)
        of = np.zeros(len(pairs), np.int64)
        of[pair] = np.concatenate(history)
        kinds = np.bincount(of[pair_total > 0], minlength=len(words_) + len(spread))
        count = np.concatenate((total.astype(np.int64), np.zeros(len(spread), np.int64)))
        home = np.flatnonzero(_bucket(spread, buckets) == col["bucket"][0])
        place = np.searchsorted(words_, _long([_short(spread[home])]))
        held = place < len(words_)
        home, place = home[held], place[held]
        held = words_[place] == _long([_short(spread[home])])
        home, place = home[held], place[held]
        count[len(words_) + home], count[place] = count[place], 0
        own = count[:len(words_)]
        level = np.minimum(np.log2(np.maximum(own, 1)).astype(int), _LEVELS - 1)
        sums = np.bincount(level, own, _LEVELS), np.bincount(level, kinds[:len(words_)], _LEVELS)
        parts = count[len(words_):], kinds[len(words_):]
        n = table.num_rows
        listed = lambda name, a, b: [{name: int(i), "count": float(a[i]), "kinds": float(b[i])} for i in np.flatnonzero((a > 0) | (b > 0))]
        entry = lambda name: pa.list_(pa.struct([(name, pa.int32()), ("count", pa.float64()), ("kinds", pa.float64())]))
        return pa.table({"block": pa.array(col["block"] + [""]), "bucket": pa.array(col["bucket"] + [-1], pa.int64()),
                         "word_totals": pa.array([w.tobytes() for w in by_word] + [b""], pa.binary()),
                         "pair_totals": pa.array([p.tobytes() for p in by_pair] + [b""], pa.binary()),
                         "types": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
                         "total": pa.array([0.0] * n + [float(total.sum())], pa.float64()),
                         "levels": pa.array([None] * n + [listed("level", *sums)], entry("level")),
                         "spread": pa.array([None] * n + [listed("history", *parts)], entry("history"))})
    return run


def _answer_group(buckets: int, spread: np.ndarray):
    """The group function; its one argument must be visible as such."""
    answer = per_group(_answer(buckets, spread))

    def run(table: pa.Table) -> pa.Table:
        return answer(table)
    return run


class Automaton:
    """States: 0 has no history, 1 + w has seen word w, the last one is the begin of a text."""

    def __init__(self, size, unigram, arcs, arc_weights, escape):
        self.size, self.unigram, self.arcs, self.arc_weights, self.escape = size, unigram, arcs, arc_weights, escape

    def walk(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One score a text; all texts advance together, word by word, each carrying its state."""
        order = np.argsort(-lengths, kind="stable")
        start, score = (np.cumsum(lengths) - lengths)[order], np.zeros(len(lengths))
        state = np.full(len(lengths), self.size, np.int64)
        ends = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        last = max(len(self.arcs) - 1, 0)
        for t, live in enumerate(ends):
            token, at = tokens[start[:live] + t], state[:live]
            key = at * self.size + token  # states are 64-bit
            arc = np.minimum(np.searchsorted(self.arcs, key), last)
            found = self.arcs[arc] == key if len(self.arcs) else np.zeros(live, bool)
            # no arc: pay the escape weight, fall to the state without history, take its arc there
            score[:live] += np.where(found, self.arc_weights[arc] if len(self.arcs) else 0.0, self.escape[at] + self.unigram[token])
            state[:live] = 1 + token
        out = np.empty(len(lengths))
        out[order] = score
        return out


def _score(total: float, types: int, growth: float, buckets: int, spread: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        (row,) = left.to_pylist()
        b, answers = _Block(row, buckets, spread), right.sort_by("bucket").to_pydict()
        words_, pairs = np.empty(b.size - 1), np.empty(len(b.keys))
        words_[b.word_order] = np.frombuffer(b"".join(answers["word_totals"]), np.uint64)
        pairs[b.pair_order] = np.frombuffer(b"".join(answers["pair_totals"]), np.uint64)
        p = (words_ + 0.5) / (total + 0.5 * (types + 1))
        unigram = np.log10(p)
        (end,) = np.flatnonzero(b.hashes == np.uint64(_END))
        # counts of the states, and the number of different next words expected after so many
        seen = np.concatenate(([0.0], words_, [words_[end]]))
        kinds = np.where(seen > 0, np.maximum(seen, 1) ** growth, 1.0)
        escape = np.where(seen > 0, np.log10(kinds / (seen + kinds)), 0.0)
        known = pairs > 0
        history, word = b.keys[known] // b.size, b.keys[known] % b.size
        state = history + 1
        weights = np.log10((pairs[known] + kinds[state] * p[word]) / (seen[state] + kinds[state]))
        model = Automaton(b.size, np.append(unigram, 0.0), state * b.size + word, weights, escape)
        score = model.walk(b.tokens, b.lengths)
        first = np.cumsum(b.lengths) - b.lengths
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(b.held), pa.array(b.lengths),
                         pa.array(np.add.reduceat((words_ > 0)[b.tokens].astype(np.int64), first)),
                         pa.array(np.add.reduceat(unigram[b.tokens], first)), pa.array(score)], schema=schema)
    return run


def _score_group(*model):
    """The cogroup function; its two arguments must be visible as such."""
    score = per_group(_score(*model))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return score(left, right)
    return run


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None,
                block_bytes: int = 10 << 20, bucket_tokens: int = 2_000_000) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``held_out`` (a boolean column; null counts as false) marks rows that are scored but never
    counted. Probabilities of a word: (count + 0.5) / (N + 0.5 * (V + 1)); after a history h:
    (pair count + k * that) / (count of h + k), where k, the number of different next words after
    count(h) occurrences, is count ** growth and growth is fitted on the counts and the numbers of
    different next words that the histories have in all training rows together. Null texts
    are empty; an empty text is its end mark alone. Repeated rows count each time. With nothing to
    learn from, every word has probability 1. An empty table gives no rows; other columns are ignored.
    """
    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    docs = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"), flag.alias("held"))
    blocks = stage(docs.mapInArrow(per_batch(_encode(block_bytes)), _BLOCK), "lm-blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(1, int(tokens // bucket_tokens))
    frequent = (blocks.select(F.explode(F.arrays_zip("frequent", "counts"))).groupBy("col.frequent").agg(F.sum("col.counts").alias("n"))
                .where(F.col("n") >= bucket_tokens // 8).orderBy(F.desc("n"), "frequent").limit(_SPREAD).collect()) if buckets > 1 else []
    spread = np.sort(np.array([r.frequent for r in frequent], np.int64).view(np.uint64))
    answers = stage(blocks.select("block", "payload", "vocabulary", "lengths", "held").mapInArrow(per_batch(_requests(buckets, spread)), _REQUEST)
                    .groupBy("bucket").applyInArrow(_answer_group(buckets, spread), _ANSWER), "lm-counts")
    sums = answers.where("block = ''").agg(F.sum("total").alias("n"), F.sum("types").alias("v")).first()
    total, types = sums.n or 0.0, sums.v or 0
    growth = _growth(_histories(answers.where("block = ''")))
    scored = (blocks.select("block", "payload", "vocabulary", "ids", "lengths", "held").groupBy("block")
              .cogroup(answers.where("block <> ''").select("block", "bucket", "word_totals", "pair_totals").groupBy("block"))
              .applyInArrow(_score_group(total, types, growth, buckets, spread),
                            "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                         F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def _histories(sums: DataFrame) -> dict[int, tuple[float, float]]:
    """Total count and total of different next words of the histories of every log level."""
    summed = lambda rows: rows.agg(F.sum("col.count").alias("c"), F.sum("col.kinds").alias("k"))
    levels = {r.level: (r.c, r.k) for r in summed(sums.select(F.explode("levels")).groupBy("col.level")).collect()}
    for r in summed(sums.select(F.explode("spread")).groupBy("col.history")).where("c > 0").collect():
        level = min(int(np.log2(r.c)), _LEVELS - 1)
        count, kinds = levels.get(level, (0.0, 0.0))
        levels[level] = count + r.c, kinds + r.k
    return dict(sorted(levels.items()))


def _growth(levels: dict[int, tuple[float, float]]) -> float:
    """The exponent g of next words = count ** g, by least squares through log levels. A level
    holds histories with 2**level to 2**(level+1) occurrences: their total count and total of
    different next words."""
    top = bottom = 0.0
    for level, (count, kinds) in levels.items():
        if level >= 1 and kinds > 0:
            x = np.log(1.42 * 2.0 ** level)
            y = x + np.log(kinds / count)
            top, bottom = top + count * x * y, bottom + count * x * x
    return float(min(max(top / bottom, 0.05), 0.99)) if bottom else 0.5

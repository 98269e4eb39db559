"""Benchmark items in documents: SimHash of item-sized windows, multi-index Hamming search, exact check.

A window can only be similar to an item if it shares a shingle with it, so windows are laid around
shared shingles, of the length of the items that have these. A window has several independent
fingerprints, each cut into blocks. Of two fingerprints within the radius at least one block differs
in at most radius / blocks bits, so looking the near values of every block up in an index of the
items' blocks loses none. Item values are stored with half of that distance around them and looked
up with the other half. What lies within the radius in any fingerprint is compared exactly, by
weighted shingles.

A shingle that occurs c times and weighs w enters a fingerprint with the square root of w * c. The
cosine of two windows is then at least 2s / (1 + s) for a weighted similarity of s, whatever the weights.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.tables import stage
from .ids import long_id
from .memory import per_batch
from .words import mix, words

BITS, BLOCKS, PRINTS = 64, 4, 4
_STEP = 4096  # window starts looked at together
_ITEM = "item long, n_words int, size int, grams array<struct<gram:long,n:int>>"


def _item_shingles(size: int):
    def run(batches):
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for part in words(batch.column(1)):
                n = np.diff(part.offsets)
                for width in np.unique(np.minimum(n, size)):
                    if width:
                        grams, at = part.shingles(int(width))
                        for i in np.flatnonzero(np.minimum(n, size) == width):
                            g, c = np.unique(grams[at[i]:at[i + 1]], return_counts=True)
                            rows.append({"item": ids[part.first + i], "n_words": int(n[i]), "size": int(width),
                                         "grams": [{"gram": int(a), "n": int(b)} for a, b in zip(g.view(np.int64), c)]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("item", pa.int64()), ("n_words", pa.int32()), ("size", pa.int32()),
                ("grams", pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int32())])))]))
    return run


def weighted_similarity(a: dict[int, int], b: dict[int, int], weight: dict[int, float], other: float) -> float:
    """Sum of the smaller over sum of the larger counts, each shingle with its weight."""
    both = every = 0.0
    for g in a.keys() | b.keys():
        x, y, w = a.get(g, 0), b.get(g, 0), weight.get(g, other)
        both, every = both + w * min(x, y), every + w * max(x, y)
    return both / every if every else 0.0


def _components(grams: np.ndarray, number: int) -> np.ndarray:
    """A row of 64 symmetric components for every shingle; each fingerprint has its own."""
    keys = np.arange(8 * number + 1, 8 * number + 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(grams[:, None] ^ keys).view(np.int8).reshape(-1, BITS) + 0.5


def _pack(sums: np.ndarray) -> np.ndarray:
    """Four blocks of 16 bits a row."""
    return np.packbits(sums > 1e-9, axis=1).view(np.uint16)


def _ball(radius: int) -> np.ndarray:
    values = np.arange(1 << 16, dtype=np.uint16)
    return values[np.bitwise_count(values) <= radius].astype(np.int64)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (n[i] of them), one after another."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _around(hits: np.ndarray, span: int, total: int) -> np.ndarray:
    """Starts, in order, of the windows of ``span`` that hold one of the ordered hits."""
    low, high = np.maximum(hits - span + 1, 0), np.minimum(hits, total - span)
    low[1:] = np.maximum(low[1:], high[:-1] + 1)
    return _spread(low, np.maximum(high - low + 1, 0))


def _first_repeat(grams: np.ndarray) -> np.ndarray:
    """For each place: the first place at which a shingle comes again that came at or after it."""
    order = np.argsort(grams, kind="stable")
    again = np.full(len(grams), len(grams), np.int64)
    same = np.flatnonzero(grams[order][1:] == grams[order][:-1])
    again[order[same]] = order[same + 1]
    return np.minimum.accumulate(again[::-1])[::-1]


class Items:
    """Benchmark items of one shingle size, ready for search."""

    def __init__(self, rows, weight: dict[int, float], other: float, similarity: float, radius: int):
        self.weight, self.other, self.similarity, self.radius = weight, other, similarity, radius
        self.ids = [r["item"] for r in rows]
        self.length = np.array([r["n_words"] for r in rows])
        self.lengths, self.kind = np.unique(self.length, return_inverse=True)
        self.size = rows[0]["size"]
        self.counts = [{g["gram"] & (1 << 64) - 1: g["n"] for g in r["grams"]} for r in rows]
        pairs = sorted((g, k) for k, c in enumerate(self.counts) for g in c)
        every = np.array([g for g, _ in pairs], np.uint64)
        self.grams, self.first = np.unique(every, return_index=True)
        self.first = np.append(self.first, len(pairs))
        self.owner = np.array([k for _, k in pairs], np.int64)
        self.weights = np.array([weight.get(int(g), other) for g in self.grams])
        self.prints = np.stack([np.concatenate([self.print_of(np.array(list(c), np.uint64), np.array(list(c.values())), p) for c in self.counts])
                                for p in range(PRINTS)])
        self._index = None

    def _weight_of(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.weights[at], self.other)

    def print_of(self, grams: np.ndarray, counts: np.ndarray, number: int) -> np.ndarray:
        """The fingerprint of different shingles with their counts."""
        return _pack((_components(grams, number) * np.sqrt(self._weight_of(grams) * counts)[:, None]).sum(0)[None])

    @property
    def index(self) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each fingerprint and block: the keys (length, value near an item's block), in order, where
        each begins, and the items. Built where it is used: the items travel without it."""
        if self._index is None:
            ball = _ball(self.radius // BLOCKS // 2)
            self._index = []
            for prints in self.prints:
                tables = []
                for b in range(BLOCKS):
                    keys = (self.kind[:, None] << 16 | prints[:, b, None].astype(np.int64) ^ ball).ravel()
                    order = np.argsort(keys, kind="stable")
                    keys, first = np.unique(keys[order], return_index=True)
                    tables.append((keys, np.append(first, len(order)), (order // len(ball)).astype(np.int32)))
                self._index.append(tables)
        return self._index

    def candidates(self, prints: np.ndarray, length: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Different (print, item) pairs of this length with a block in the same bucket."""
        near = self.radius // BLOCKS
        ball = _ball(near - near // 2)
        kind, found = int(np.searchsorted(self.lengths, length)), []
        for b, (keys, first, items) in enumerate(self.index[number]):
            wanted = (kind << 16 | prints[:, b, None].astype(np.int64) ^ ball).ravel()
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == wanted)
            n = first[at[hit] + 1] - first[at[hit]]
            found.append(np.repeat(hit // len(ball), n) * len(self.ids) + items[_spread(first[at[hit]], n)])
        return np.divmod(np.unique(np.concatenate(found)), len(self.ids))

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has, and their places in the item index."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == grams)
        return hit, at[hit]

    def within(self, grams: np.ndarray, windows: dict[int, np.ndarray], low: int) -> np.ndarray:
        """(distance, start, item) of windows and items within the radius in some fingerprint,
        nearest first. ``windows`` holds the starts, from ``low`` on, for every item length."""
        spans = {length: min(length - self.size + 1, len(grams)) for length in windows}
        near = grams[low:max(int(starts[-1]) + spans[length] for length, starts in windows.items())]
        root, repeat, found = np.sqrt(self._weight_of(near)), _first_repeat(near), []
        # running sums count a shingle that comes twice as two; such windows are summed on their own
        twice = {length: np.flatnonzero(repeat[starts - low] < starts - low + spans[length]) for length, starts in windows.items()}
        for number in range(PRINTS):
            running = np.concatenate((np.zeros((1, BITS)), np.cumsum(_components(near, number) * root[:, None], axis=0)))
            for length, starts in windows.items():
                prints = _pack(running[starts + spans[length] - low] - running[starts - low])
                for w in twice[length]:
                    g, c = np.unique(grams[starts[w]:starts[w] + spans[length]], return_counts=True)
                    prints[w] = self.print_of(g, c, number)[0]
                w, k = self.candidates(prints, length, number)
                distance = np.bitwise_count(prints[w] ^ self.prints[number][k]).sum(1, dtype=np.int64)
                keep = distance <= self.radius
                found.append(np.stack([distance[keep], starts[w[keep]], k[keep]]))
        distance, start, item = np.concatenate(found, axis=1)
        order = np.lexsort((distance, item, start))
        distance, start, item = distance[order], start[order], item[order]
        new = np.ones(len(order), bool)
        new[1:] = (start[1:] != start[:-1]) | (item[1:] != item[:-1])
        order = np.flatnonzero(new)[np.lexsort((start[new], distance[new]))]
        return np.stack([distance[order], start[order], item[order]], axis=1)

    def search(self, grams: np.ndarray, hits: np.ndarray, where: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for every item found, the
        earliest of equal ones."""
        n_hit = self.first[where + 1] - self.first[where]
        of = self.length[self.owner[_spread(self.first[where], n_hit)]]
        at = np.repeat(hits, n_hit)
        windows = {int(length): _around(np.unique(at[of == length]), min(int(length) - self.size + 1, len(grams)), len(grams))
                   for length in np.unique(of)}
        best: dict[int, tuple[float, int, int]] = {}
        for low in range(min(s[0] for s in windows.values()), max(s[-1] for s in windows.values()) + 1, _STEP):
            some = {length: s[slice(*np.searchsorted(s, (low, low + _STEP)))] for length, s in windows.items()}
            some = {length: s for length, s in some.items() if len(s)}
            if not some:
                continue
            for _, start, item in self.within(grams, some, low).tolist():
                if item in best and best[item][0] >= 1.0:
                    continue
                span = min(int(self.length[item]) - self.size + 1, len(grams))
                g, c = np.unique(grams[start:start + span], return_counts=True)
                s = weighted_similarity(dict(zip(g.tolist(), c.tolist())), self.counts[item], self.weight, self.other)
                if s >= self.similarity and (item not in best or (s, -start) > (best[item][0], -best[item][1])):
                    best[item] = (s, start, span + self.size - 1)
        return [(item, *found) for item, found in sorted(best.items())]


def _search(groups: list[Items]):
    schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for part in words(batch.column(1)):
                for items in groups:
                    grams, offsets = part.shingles(items.size)
                    if not len(grams):
                        continue
                    hits, where = items.shared(grams)
                    text = np.searchsorted(offsets, hits, "right") - 1
                    cuts = np.searchsorted(text, np.unique(text))
                    for a, b in zip(cuts, [*cuts[1:], len(hits)]):
                        i = text[a]
                        for item, s, start, n in items.search(grams[offsets[i]:offsets[i + 1]], hits[a:b] - offsets[i], where[a:b]):
                            out.append((ids[part.first + i], items.ids[item], s, start, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 11, chunk: int = 400_000) -> DataFrame:
    """(id_col, item_id, similarity, first_word, n_words): the best window for every document and
    benchmark item whose weighted similarity is at least ``similarity``.

    Words are lower-cased (A-Z). A shingle weighs 1 + ln(items / items that have it); one that no
    item has weighs as one of a single item. Windows have the item's number of words, or are the
    whole text if that is shorter; an item under ``size`` words is one shingle. Null or empty
    texts and items match nothing; repeated items or documents match each time; an item without
    an id is left out; empty tables give no rows. A fingerprint of 64 bits differs in 9 to 10 bits
    on average at a similarity of 0.8; one of the four lies within ``radius`` 11 with a probability
    of 0.995 there and nearly 1 above 0.85, and what does is found for sure. Items go to the
    tasks in groups of about ``chunk`` shingles, one pass each; with more than one group each
    pass is written before the next group is read, so the driver holds one group.
    """
    items = benchmark.select(long_id(benchmark, item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL")
    items = stage(items.mapInArrow(_item_shingles(size), _ITEM), "benchmark-items")
    docs = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.count("*").alias("n"), F.sum(F.size("grams")).alias("grams")).first()
    chunks = max(1, -(-(total.grams or 0) // chunk))
    df = items.select("size", F.explode("grams.gram").alias("gram")).groupBy("size", "gram").agg(F.count("*").alias("df"))
    part = F.pmod(F.xxhash64("item", "n_words"), F.lit(chunks))
    found = None
    for k in range(chunks):
        some = items.where(part == k)
        # weights of this group's shingles, which are those of at most ``chunk`` places
        own = some.select("size", F.explode("grams.gram").alias("gram")).distinct().join(df.where("df > 1"), ["size", "gram"])
        common = own.collect()
        groups = []
        rows = [r.asDict(recursive=True) for r in some.collect()]
        other = 1 + float(np.log(max(total.n, 1)))
        for width in sorted({r["size"] for r in rows}):
            weight = {r.gram & (1 << 64) - 1: 1 + float(np.log(total.n / r.df)) for r in common if r.size == width}
            groups.append(Items([r for r in rows if r["size"] == width], weight, other, similarity, radius))
        step = docs.mapInArrow(per_batch(_search(groups)), "id long, item_id long, similarity double, first_word long, n_words long")
        step = stage(step, "benchmark-leaks") if chunks > 1 else step
        found = step if found is None else found.union(step)
    return found.withColumnRenamed("id", id_col)

"""Nearest vectors by cosine, with an inverted multi-index.

Unit vectors are cut in two halves, and each half is quantised by centroids of its own; a vector's
cell is its pair of centroids. A query walks the pairs by the sum of their two distances, with a
heap, until the cells it has met hold enough entries; these are compared exactly. Every row is
indexed; only centroids and the share of entries to meet are fitted on a bounded sample.

Cells lie in blocks of bounded size: small ones are packed, large ones are dealt out by a hash of
the id. Queries lie in bounded slices in the same way, so a task sees one block and one slice,
however often one vector occurs.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..operators.tables import literal_table, stage
from .memory import give_back, per_batch

SAMPLE, MOST_CENTROIDS, PER_CELL, BLOCK = 16_384, 256, 50, 4_096
TRIAL, RECALL, CLOSE = 256, 0.97, 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal rows give equal numbers."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True, initial=0) for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Means of at most ``k`` groups of rows (Lloyd's rounds from evenly spread distinct rows)."""
    distinct = np.unique(x, axis=0)
    found = distinct[np.unique(np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int))]
    for _ in range(rounds):
        own = _distances(x, found).argmin(1)
        n = np.bincount(own, minlength=len(found))
        sums = np.stack([np.bincount(own, x[:, j], len(found)) for j in range(x.shape[1])], axis=1) if x.shape[1] else found * 0
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


@dataclass
class Codebook:
    first: np.ndarray   # centroids of the first halves
    second: np.ndarray  # centroids of the second halves
    share: float = 1.0  # share of all entries that a query meets

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _distances(x[:, :cut], self.first), _distances(x[:, cut:], self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)


def walk(a: np.ndarray, b: np.ndarray):
    """Pairs (i, j) of two lists of distances, by rising sum; of equal sums the earlier ranks first."""
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, by_a, by_b = a[by_a].tolist(), b[by_b].tolist(), by_a.tolist(), by_b.tolist()
    heap, done = [(a[0] + b[0], 0, 0)], [0] * len(a)  # done[i]: pairs of row i already out
    while heap:
        _, i, j = heapq.heappop(heap)
        yield by_a[i], by_b[j]
        done[i] = j + 1
        # a pair enters once both pairs before it are out
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))


def fit(sample: np.ndarray, total: int, *, k: int = 5, recall: float = RECALL) -> Codebook:
    """Centroids, and the share of entries to meet: in the sample, queries held out find ``recall``
    of their ``k`` nearest within that share. The whole table is denser, so neighbours lie nearer."""
    x = unit(sample)
    wanted = int(np.clip(round((total / PER_CELL) ** 0.5), 1, MOST_CENTROIDS))
    half = x.shape[1] // 2
    book = Codebook(centroids(x[:, :half], wanted), centroids(x[:, half:], wanted))
    trial = max(1, min(TRIAL, len(x) // 10))
    asked, rest = x[:trial], x[trial:]
    if len(rest) <= 10 * k:
        return book
    cell = book.cell(rest)
    size = np.bincount(cell, minlength=book.cells)
    a, b = book.distances(asked)
    order = np.argsort((a[:, :, None] + b[:, None, :]).reshape(trial, -1), axis=1, kind="stable")
    met = np.empty_like(order)
    np.put_along_axis(met, order, np.cumsum(size[order], axis=1), axis=1)
    nearest = np.argpartition(-(asked @ rest.T), k, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(met, cell[nearest], axis=1).ravel())
    book.share = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] / len(rest))
    return book


def layout(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each cell: cells of over ``most`` rows have several blocks of their
    own, others share one in their order while it has room."""
    first, pieces, block, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, most
    for c, n in enumerate(counts.tolist()):
        if n > most:
            block += room < most
            first[c], pieces[c] = block, -(-n // most)
            block, room = block + int(pieces[c]), most
        else:
            if n > room:
                block, room = block + 1, most
            first[c], room = block, room - n
    return first, pieces


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def _assign(book: Codebook):
    def run(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            cell = book.cell(unit(_matrix(vectors, book.dim))) if len(ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cell, pa.int32()), vectors], names=["id", "cell", "vector"])
    return run


_VISITS = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("cells", pa.list_(pa.int32())), ("home", pa.int32()), ("vector", pa.list_(pa.float64()))])


def _visits(book: Codebook, counts: np.ndarray, first: np.ndarray, pieces: np.ndarray, wanted: int):
    """Blocks that each query must see, with the cells it met there."""
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), book.dim)
            a, b = book.distances(unit(x)) if len(x) else (x, x)
            ids, out = batch.column(0).to_pylist(), []
            for q, key in enumerate(ids):
                met, blocks, home = 0, {}, None
                for i, j in walk(a[q], b[q]):
                    c = i * len(book.second) + j
                    home = c if home is None else home
                    if counts[c]:
                        met += int(counts[c])
                        for block in range(first[c], first[c] + pieces[c]):
                            blocks.setdefault(block, []).append(c)
                    if met >= wanted:
                        break
                out.extend((key, block, cells, home, x[q]) for block, cells in blocks.items())
                if len(out) >= 20_000 or q == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_VISITS)], schema=_VISITS)
                    out = []
    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best_of(ids: np.ndarray, vectors: np.ndarray, allowed: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and scores of its ``k`` nearest allowed rows, ties to the smaller id. A
    matrix product picks the rows that can be among them, a sum in fixed order ranks these."""
    rough = np.where(allowed, unit(queries) @ unit(vectors).T, -np.inf)
    least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
    out = []
    for q in range(len(queries)):
        at = np.flatnonzero((rough[q] >= least[q] - CLOSE) & allowed[q])
        score = cosines(np.broadcast_to(queries[q], (len(at), queries.shape[1])), vectors[at]) if len(at) else np.zeros(0)
        order = np.lexsort((ids[at], -score))[:k]
        out.append((ids[at][order], score[order]))
    return out


def _search(dim: int, k: int, step: int = 512):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if len(entries) and len(queries):
            ids, cell, x = np.asarray(entries["id"]), np.asarray(entries["cell"]), _matrix(entries["vector"], dim)
            cells, local = np.unique(cell, return_inverse=True)
            keys, q, met = np.asarray(queries["id"]), _matrix(queries["vector"], dim), queries["cells"].to_pylist()
            for at in range(0, len(keys), step):
                own = slice(at, at + step)
                seen = np.stack([np.isin(cells, m) for m in met[own]])
                allowed = seen[:, local] & (ids[None, :] != keys[own, None])
                for key, (near, score) in zip(keys[own], best_of(ids, x, allowed, q[own], k)):
                    found.append((np.full(len(near), key), near, score))
        columns = [np.concatenate([f[i] for f in found]) if found else [] for i in range(3)]
        give_back()
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)
    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None, of: str = "double") -> DataFrame:
    """(id, vector, an array of ``of``) of rows with an id, a direction and only finite components."""
    x = F.col(vector_col).cast(f"array<{of}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
    rows = rows.where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
    return rows if dim is None else rows.where(F.size("vector") == dim)


def _once(rows: DataFrame, name: str) -> DataFrame:
    """One row an id, the smallest vector; nothing is shuffled but ids unless some repeat."""
    again = stage(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), name)
    if again.isEmpty():
        return rows
    once = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector"))
    return rows.join(again, "id", "left_anti").unionByName(once)


def _spread(cell: Column, key: Column, places: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Rows with the block (or slice) of their cell; several by a hash of the key. ``places`` has at
    most MOST_CENTROIDS squared rows."""
    return rows.join(F.broadcast(places), cell == F.col("place"), "inner").withColumn(
        name, F.col("start") + F.pmod(F.xxhash64(key), F.col("pieces"))).drop("place", "start", "pieces")


def _places(spark, counts: np.ndarray, most: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    first, pieces = layout(counts, most)
    kept = np.flatnonzero(counts).tolist()
    table = literal_table(spark, {"place": "long", "start": "long", "pieces": "long"}, [(c, int(first[c]), int(pieces[c])) for c in kept])
    return table, first, pieces


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the ``k`` rows of largest cosine found.

    ``queries`` has the same two columns; rows with a query's own id are no candidates of it. Scores
    are exact, in double precision, on the given vectors; ties go to the smaller id. A query meets
    a share of all entries, fitted so that ``recall`` of the true neighbours of held-out rows are
    found; if there are not that many candidates, it gets all of them.

    Vectors that are null, zero or empty, or hold null or non-finite components, and rows without an
    id take no part, as candidates or queries; nor do vectors that are not of the most frequent
    length (of several the longest). Of rows with one id the smallest vector counts. Other columns are
    ignored; an empty table gives no rows. The driver holds at most ``sample`` vectors, the centroids
    and MOST_CENTROIDS squared counts; a task holds ``block`` entries and as many queries, more or less.
    """
    spark = vectors.sparkSession
    sizes = usable(vectors, id_col, vector_col).groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return spark.createDataFrame([], schema)
    of = "float" if isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), T.FloatType) else "double"
    entries = _once(usable(vectors, id_col, vector_col, top.dim, of), "neighbours-repeats")
    drawn = entries.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    book = fit(_matrix(drawn["vector"], top.dim), top.n, k=k, recall=recall)
    coded = stage(entries.mapInArrow(per_batch(_assign(book)), f"id long, cell int, vector array<{of}>"), "neighbours-cells")
    counts = np.zeros(book.cells, np.int64)
    for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row a cell
        counts[r.cell] = r.n
    places, first, pieces = _places(spark, counts, block)
    wanted = max(int(np.ceil(book.share * counts.sum())), 0) + 4 * k + 1
    asked = _once(usable(queries, id_col, vector_col, top.dim), "neighbours-asked")
    visits = stage(asked.mapInArrow(per_batch(_visits(book, counts, first, pieces, wanted)),
                                    "id long, block long, cells array<int>, home int, vector array<double>"), "neighbours-visits")
    homes = np.zeros(book.cells, np.int64)
    for r in visits.groupBy("home").agg(F.count_distinct("id").alias("n")).collect():
        homes[r.home] = r.n
    visits = _spread(F.col("home"), F.col("id"), _places(spark, homes, block)[0], visits, "slice")
    pairs = visits.select(F.col("block").alias("at"), F.col("slice").alias("for")).distinct()
    blocks = _spread(F.col("cell"), F.col("id"), places, coded, "block").join(pairs, F.col("block") == F.col("at"))
    blocks = blocks.select("id", "cell", "vector", F.col("at").alias("block"), F.col("for").alias("slice"))
    found = blocks.groupBy("block", "slice").cogroup(visits.groupBy("block", "slice")).applyInArrow(
        _search(top.dim, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

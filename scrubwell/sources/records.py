"""CSV records of large files, read in ranges, where cells may hold line breaks.

Whether a line break ends a record depends on all quotes before it. Every range of a file counts
its quotes; the running sum over a file's ranges tells which of them start inside a cell. With that
each range finds its own records. A record that crosses ranges leaves one piece in each, and only
these pieces are brought together.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
_RANGES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("header", pa.string())])
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("first", pa.bool_()), ("header", pa.int32()), ("record", pa.string())])
RANGES = "file string, start long, quotes long, header string"
PIECES = "file string, start long, kind string, first boolean, header int, record string"
#: a record inside one range; its first piece; pieces of nothing else; its last piece
WHOLE, TAIL, MIDDLE, HEAD = "whole", "tail", "middle", "head"


def _lines(spark: SparkSession, path) -> DataFrame:
    rows = spark.read.text(path, lineSep="\n")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches) -> Iterator[tuple[str, int, pa.Array]]:
    """Neighbouring lines of one range. A range's lines come one after another, in their order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column(1).to_numpy()
        file = batch.column(0).dictionary_encode()
        of = file.indices.to_numpy()
        edges = np.flatnonzero((start[1:] != start[:-1]) | (of[1:] != of[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            yield file.dictionary[int(of[a])].as_py(), int(start[a]), batch.column(2).slice(a, b - a)


def _count(batches):
    """One row a range: its quotes, and the first record if the file begins here."""
    rows, now, quotes, header, complete = [], None, 0, [], False

    def ended():
        if now:
            rows.append((*now, quotes, "\n".join(header) if now[1] == 0 else None))
    for file, start, lines in _runs(batches):
        if (file, start) != now:
            ended()
            now, quotes, header, complete = (file, start), 0, [], start > 0
        if not complete:
            for line in lines.to_pylist():
                if not header and line in ("", "\r"):
                    continue
                header.append(line)
                complete = sum(h.count(QUOTE) for h in header) % 2 == 0
                if complete:
                    break
        quotes += pc.sum(pc.count_substring(lines, QUOTE)).as_py() or 0
    ended()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RANGES)], schema=_RANGES)


@dataclass
class Ranges:
    """What the tasks must know of the files: the ranges, which of them start inside a cell, and the header."""
    starts: dict[str, np.ndarray] = field(default_factory=dict)  # of files with several ranges
    inside: dict[str, np.ndarray] = field(default_factory=dict)
    header: dict[str, int] = field(default_factory=dict)         # of files whose header is not the first one's

    def starts_inside(self, file: str, start: int) -> bool:
        known = self.starts.get(file)
        at = 0 if known is None else int(np.searchsorted(known, start))
        if known is None and start or known is not None and (at == len(known) or known[at] != start):
            raise RuntimeError(f"{file} was cut in other ranges than when its quotes were counted; read it again")
        return known is not None and bool(self.inside[file][at])


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.array(["\n".join(line for part in parts for line in part.to_pylist())], pa.string())


class Splitter:
    """Records of one range, from its lines in order; ``put(records, kind)`` takes them."""

    def __init__(self, begins_inside: bool, put):
        self.put, self.odd, self.headless, self.held = put, begins_inside, begins_inside, []

    def take(self, lines: pa.Array) -> None:
        quotes = pc.count_substring(lines, QUOTE).to_numpy()
        before = (np.concatenate(([0], np.cumsum(quotes))) + self.odd) % 2
        self.odd = bool(before[-1])
        begins = np.flatnonzero(before[:-1] == 0)
        if not len(begins):
            self.held.append(lines)
            return
        first, last = int(begins[0]), int(begins[-1])
        if first:
            self.held.append(lines.slice(0, first))
        if self.held:
            self.put(_joined(self.held), HEAD if self.headless else WHOLE)
        if last > first:
            offsets = pa.array(np.append(begins[:-1], last) - first, pa.int32())
            self.put(pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(first, last - first)), "\n"), WHOLE)
        self.headless, self.held = False, [lines.slice(last)]

    def end(self) -> None:
        if self.held:
            self.put(_joined(self.held), (MIDDLE if self.odd else HEAD) if self.headless else TAIL if self.odd else WHOLE)


def _split(ranges: Ranges):
    def run(batches):
        out, now, splitter, headed = [], None, None, True

        def put(records: pa.Array, kind: str) -> None:
            nonlocal headed
            if kind in (WHOLE, TAIL):  # blank lines are no records
                records = records.filter(pc.invert(pc.is_in(records, pa.array(["", "\r"]))))
            n = len(records)
            if n:
                first = np.zeros(n, bool)
                first[0], headed = not headed, True
                file, start = now
                out.append(pa.RecordBatch.from_arrays([
                    pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([kind] * n, pa.string()),
                    pa.array(first), pa.array([ranges.header.get(file, 0)] * n, pa.int32()), records], schema=_PIECES))

        for file, start, lines in _runs(batches):
            if (file, start) != now:
                if splitter:
                    splitter.end()
                now, headed = (file, start), start > 0
                splitter = Splitter(ranges.starts_inside(file, start), put)
            splitter.take(lines)
            yield from out
            out.clear()
        if splitter:
            splitter.end()
        yield from out
    return run


_CELL = re.compile(r'\s*"((?:[^"]|"")*)"[^,]*|([^,]*)', re.S)


def names_of(header: str) -> list[str]:
    """Column names of a header record: empty ones are numbered, repeated ones get their number."""
    cells, at, header = [], 0, header.removesuffix("\r")
    while at <= len(header):
        found = _CELL.match(header, at)
        quoted, plain = found.groups()
        cells.append(plain if quoted is None else quoted.replace('""', QUOTE))
        at = found.end() + 1
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_records(spark: SparkSession, path) -> tuple[DataFrame, list[list[str]]]:
    """(header, record) rows of all files, without header records and blank lines, and the columns
    of each header. ``header`` numbers the columns' list; the first is that of the first file by name.

    Quotes must be balanced as RFC 4180 has them: a cell with a quote is quoted, the quote doubled.
    The driver holds one row for each range of a file (Spark's split size), no text but the headers.
    """
    lines = _lines(spark, path)
    counted = sorted(lines.mapInArrow(_count, RANGES).collect(), key=lambda r: (r.file, r.start))
    ranges, columns, by_file = Ranges(), [], {}
    for r in counted:
        by_file.setdefault(r.file, []).append(r)
    for file, rows in by_file.items():
        names = names_of(rows[0].header or "")
        if names not in columns:
            columns.append(names)
        if columns.index(names):
            ranges.header[file] = columns.index(names)
        if len(rows) > 1:
            ranges.starts[file] = np.array([r.start for r in rows])
            ranges.inside[file] = np.concatenate(([0], np.cumsum([r.quotes for r in rows])[:-1])) % 2 == 1
    pieces = lines.mapInArrow(_split(ranges), PIECES)
    whole = pieces.where(F.col("kind") == WHOLE)
    if any(x.any() for x in ranges.inside.values()):
        # a piece that begins a record starts a chain, which ends with the next piece of the kind HEAD
        order = Window.partitionBy("file").orderBy("start", F.col("kind") == TAIL)
        chain = F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        crossing = pieces.where(F.col("kind") != WHOLE).withColumn("chain", chain)
        parts = F.sort_array(F.collect_list(F.struct("start", (F.col("kind") == TAIL).alias("tail"), "record")))
        stitched = crossing.groupBy("file", "header", "chain").agg(F.array_join(parts["record"], "\n").alias("record"),
                                                                  F.max("first").alias("first"))
        whole = whole.select("header", "record", "first").unionByName(stitched.select("header", "record", "first"))
    record = F.regexp_replace("record", "\r\\z", "")
    return whole.where(~F.col("first")).select("header", record.alias("record")).where("record <> ''"), columns

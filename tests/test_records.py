"""CSV files read in ranges: line breaks in cells, and headers of their own."""
import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scrubwell.sources import records, tables


@pytest.fixture
def small_ranges(spark):
    """Files are cut every 400 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def text_of(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def odd_rows(n, seed=0):
    rng = random.Random(seed)
    cells = ["plain", "", "two\nlines", 'say "hi"', "a,b", "\n", '"', "é日", "x" * 90, "\n\n\n", 'end"\n"']
    return [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_quoted_file_in_many_ranges_equals_the_one_piece_read(spark, tmp_path, small_ranges, end):
    rows = odd_rows(400) + [["big", "one\ncell\n" * 700, "over, ranges"], ["last", 'a "', "no end"]]
    path = tmp_path / "in.csv"
    path.write_bytes(text_of([["key", "left", "right"], *rows], end).removesuffix(end).encode())
    read = tables.read_csv(spark, str(path), multi_line=True)
    lines, _ = records.read_records(spark, str(path))
    assert lines.rdd.getNumPartitions() > 20
    got = sorted(map(tuple, read.collect()))
    assert got == sorted(map(tuple, tables.read_csv(spark, str(path), multi_line="whole").collect()))
    assert got == sorted(map(tuple, rows))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a",\n\r', max_size=4), min_size=2, max_size=2), min_size=1, max_size=8), st.data())
def test_ranges_give_the_records_of_the_whole(rows, data):
    """Lines cut into ranges and batches at any place, without Spark."""
    lines = text_of(rows).split("\n")[:-1]
    cuts = sorted(data.draw(st.lists(st.integers(0, len(lines)), max_size=4)))
    parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)]) if a < b]
    found, open_, odd = [], [], False
    for part in parts:
        pieces = []
        splitter = records.Splitter(odd, lambda r, kind: pieces.extend((kind, x) for x in r.to_pylist()))
        step = data.draw(st.integers(1, 3))
        for i in range(0, len(part), step):
            splitter.take(pa.array(part[i:i + step], pa.string()))
        splitter.end()
        odd = sum(x.count('"') for x in part) % 2 != odd
        for kind, piece in pieces:
            if kind in (records.WHOLE, records.TAIL):
                assert not open_
            open_.append(piece)
            if kind in (records.WHOLE, records.HEAD):
                found.append("\n".join(open_))
                open_ = []
    assert not open_ and found == [text_of([row])[:-1] for row in rows]


def test_every_file_by_its_own_header(spark, tmp_path, small_ranges):
    folder = tmp_path / "x"
    folder.mkdir()
    (folder / "1.csv").write_text(text_of([["id", "name", "note"], *([str(i), f"n{i}", "two\nlines"] for i in range(60))]))
    (folder / "2.csv").write_text("\n\n" + text_of([["note", "id"], *(["", str(100 + i)] for i in range(60))], "\r\n"))
    (folder / "3.csv").write_text(text_of([["ID2", "id", "name", "id2"], ["1", "200", 'q"', "2"], ["3"]]))
    (folder / "4.csv").write_text("name,note,id\n")
    (folder / "5.csv").write_text("")
    read = tables.read_csv(spark, str(folder), headers="own")
    assert read.columns[:3] == ["id", "name", "note"] and len(read.columns) == 5
    expected = [(str(i), f"n{i}", "two\nlines", None, None) for i in range(60)] + [(str(100 + i), None, "", None, None) for i in range(60)]
    assert sorted(map(str, map(tuple, read.collect()))) == sorted(map(str, expected + [("200", 'q"', None, "1", "2"), ("", "", None, "3", "")]))
    with pytest.raises(ValueError, match="header"):
        tables.read_csv(spark, str(folder), multi_line=True)


@pytest.mark.parametrize("headers", ["same", "own"])
def test_long_rows_of_ranged_files(spark, tmp_path, headers):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text('a,b\n1,"2\n,",3\n4,"5\n"\n6\n,,\n,\n')
    if headers == "own":
        (tmp_path / "x" / "2.csv").write_text("b,a,c\n7,8,9\n7,8,9,\n")
        (tmp_path / "x" / "3.csv").write_text("b\n1\n2,\n")
    path = str(tmp_path / "x")
    with pytest.raises(Exception, match="too many cells"):
        tables.read_csv(spark, path, multi_line=True, headers=headers).select("a").collect()
    rows = tables.read_csv(spark, path, multi_line=True, headers=headers, malformed="keep")
    long = {r[tables.MALFORMED] for r in rows.where(F.col(tables.MALFORMED).isNotNull()).collect()}
    assert long == {'1,"2\n,",3', ",,"} | ({"7,8,9,", "2,"} if headers == "own" else set())


def test_options_and_empty_input(spark, tmp_path):
    for wrong in ({"headers": "other"}, {"multi_line": "some"}, {"multi_line": "whole", "headers": "own"}):
        with pytest.raises(ValueError):
            tables.read_csv(spark, str(tmp_path), **wrong)
    (tmp_path / "only.csv").write_text("a,b\n")
    assert tables.read_csv(spark, str(tmp_path / "only.csv"), multi_line=True).columns == ["a", "b"]
    assert tables.read_csv(spark, str(tmp_path / "only.csv"), multi_line=True).count() == 0


def test_other_ranges_than_counted_are_refused():
    known = records.Ranges({"f": np.array([0, 10])}, {"f": np.array([False, True])})
    assert not known.starts_inside("f", 0) and known.starts_inside("f", 10) and not known.starts_inside("g", 0)
    for file, start in (("f", 5), ("g", 5), ("f", 11)):
        with pytest.raises(RuntimeError, match="ranges"):
            known.starts_inside(file, start)

"""Fill-in-the-middle rows: a text is cut at two unit ends and its parts are put in another order.

Units are lines or code points. Their ends are found on the UTF-8 bytes, eight at a time: the
bytes of a slice of texts are viewed as 64-bit words, bytes that end a unit are marked in each
word by arithmetic, marks are counted by word, the running counts are searched for the word that
holds the wanted mark, and the mark is resolved inside that word.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .memory import give_back
from .words import SLICE_BYTES, raw

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "character")

_ONES, _HIGH, _LOW7 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
_EIGHT, _NEWLINE = np.uint64(8), 10


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, filled up with zeros, and one word of zeros more."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[:len(data)] = data
    return padded.view("<u8")


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of each byte that equals ``byte``; no carry crosses a byte."""
    x = words ^ (_ONES * np.uint64(byte))
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def continuations(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte 10xxxxxx, which goes on with a code point."""
    return words & ~(words << np.uint64(1)) & _HIGH


class Marks:
    """Marked bytes (the top bit of each), with counts before a byte and places of marks."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def count(self, at: np.ndarray) -> np.ndarray:
        """Marks in front of each byte offset."""
        word = at >> 3
        below = (np.uint64(1) << ((at & 7).astype(np.uint64) * _EIGHT)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def place(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of the k-th mark, from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        wanted = (k - self.before[word]).astype(np.uint64)
        # byte i of ``upto`` counts the marks of bytes 0 to i; those with at most ``wanted`` lie before the mark
        upto = (self.marks[word] >> np.uint64(7)) * _ONES
        return word * 8 + np.bitwise_count(((wanted * _ONES | _HIGH) - upto) & _HIGH)


def cuts(data: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """(n, prefix, middle, suffix) of each text: its units, and the code points of its parts.

    ``at`` has the byte offsets of the texts and their end; ``first`` and ``second`` are unsigned
    numbers whose remainders by n + 1 are the units before the two cuts.
    """
    words = words_of(data)
    inside = Marks(continuations(words))
    start, end = at[:-1], at[1:]
    if unit == "line":
        ends = Marks(equal_bytes(words, _NEWLINE))
        seen = ends.count(start)
        full = ends.count(end) - seen
        last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(end), np.uint8)
        n = full + ((end > start) & (last != _NEWLINE))
    else:  # a code point ends where the next one starts
        ends = Marks(~continuations(words) & _HIGH)
        seen = ends.count(start) + 1
        n = ends.count(end) - seen + 1
        full = n - 1
    a, b = (x % (n + 1) for x in (first, second))

    def byte(units: np.ndarray) -> np.ndarray:
        found = ends.place(np.minimum(seen + np.maximum(units, 1) - 1, ends.before[-1] - 1)) + (unit == "line") if ends.before[-1] else end
        return np.where(units == 0, start, np.where(units <= full, found, end))

    edges = [start, byte(np.minimum(a, b)), byte(np.maximum(a, b)), end]
    points = [e - inside.count(e) for e in edges]
    return n, *(points[i + 1] - points[i] for i in range(3))


_PARTS = pa.struct([(name, pa.int64()) for name in ("n", "prefix", "middle", "suffix")])


def _cut(unit: str):
    @F.arrow_udf("n long, prefix long, middle long, suffix long")
    def parts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        data, at = raw(text)
        numbers = [np.asarray(x.fill_null(0)).astype(np.int64) for x in (first, second)]
        out, i = [np.zeros((4, 0), np.int64)], 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
            out.append(np.stack(cuts(data[at[i]:at[j]], at[i:j + 1] - at[i], *(x[i:j] for x in numbers), unit)))
            i = j
        rows = np.concatenate(out, axis=1)
        give_back()
        return pa.StructArray.from_arrays([pa.array(r, pa.int64()) for r in rows], fields=list(_PARTS))
    return parts


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, unit: str = "line",
                   rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of every text.

    Four numbers come from the SHA-256 of ``seed:id``. The first two cut the text after as many
    units as their remainders by n + 1 say; the third (below ``rate`` of 100) says whether the
    text is cut at all, the fourth (below ``spm_rate``) whether the suffix stands in front.
    Empty or null texts, and those that contain a control string, stay as they are (``plain``; null
    texts become empty ones and the part sizes are null). A null id counts as an empty string.
    Repeated rows give equal rows, other columns are ignored, an empty table gives no rows.
    Whole texts are cut, of any length; texts never leave the JVM but for their bytes' marks.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), digest.alias("_digest"))
    rows = rows.select("_id", "_text", (number[2] % 100).alias("_third"), (number[3] % 100).alias("_fourth"),
                       _cut(unit)(F.col("_text"), number[0], number[1]).alias("_cut"))
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    form = F.when((F.col("_text") == "") | marked | (F.col("_third") >= rate), "plain").when(F.col("_fourth") < spm_rate, "spm").otherwise("psm")
    rows = rows.select("_id", "_text", "_cut", form.alias("_form"))
    size = {k: F.col(f"_cut.{k}").cast("int") for k in ("prefix", "middle", "suffix")}
    prefix = F.substring("_text", F.lit(1), size["prefix"])
    middle = F.substring("_text", size["prefix"] + 1, size["middle"])
    suffix = F.substring("_text", size["prefix"] + size["middle"] + 1, size["suffix"])
    output = (F.when(F.col("_form") == "plain", F.col("_text"))
              .when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    cut = F.col("_form") != "plain"
    return rows.select(F.col("_id").alias(id_col), F.col("_cut.n").alias("n"), F.col("_form").alias("form"),
                       F.when(cut, F.col("_cut.prefix")).alias("prefix_chars"), F.when(cut, F.col("_cut.middle")).alias("middle_chars"),
                       output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The exact text again, from an output and its form. Texts that were cut hold no control
    string, and none can arise where a part meets one, so the first of each is the mark."""
    body = F.substring(output, F.lit(4), F.length(output))
    parts = F.split(body, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 3)
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(parts[0], parts[2], parts[1]))
            .otherwise(F.concat(parts[1], parts[2], parts[0])))

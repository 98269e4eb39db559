"""Token-id shards compressed by Re-Pair grammars, written as files and read back.

Texts are encoded with a public byte-level BPE tokenizer, in id order, and cut into shards. In
each shard frequent neighbours are replaced by nonterminals, round after round; a round replaces
many pairs at once wherever their occurrences do not overlap. Pairs inside a word are counted on
the distinct words, weighted by how often these occur; later rounds work on the whole sequence.
A shard stores its rules, the expansion length of every rule and running lengths along the
sequence, so that any range of ids is decoded without the rest.
"""
from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.tables import shared_folder
from .ids import long_id
from .memory import per_batch
from .words import BASE, raw, span_hashes

MAGIC, STEP = b"RPAIR2\0\0", 1024  # STEP: symbols between running lengths
END = 0
OTHER_BASE, JOINED = 0xD1342543DE82EF95, 256
_SOLID = r"[^\s\x00-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SHARD = "part int, shard long, n_docs long, n_ids long, n_symbols long, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces:
    """Encodes texts through their distinct pieces. A text is cut before a space or at a line
    break that stands between two characters other than white space; the tokenizer never joins
    across these places, so encoding the pieces gives the ids of the whole text. Texts with other
    white space, or with the cut mark or a special token in them, are encoded as they are."""

    KEPT = 1_000_000  # pieces whose ids are remembered from shard to shard (some 50 bytes each)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.space_led = np.zeros(max(vocabulary.values()) + 1, bool)
        self.space_led[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # a space in byte-level form
        self.tails = {c: int(self._ids([c])[0][0]) for c in ".,"}
        self.keys, self.places = np.zeros((2, 0), np.uint64), np.zeros(0, np.int64)
        self.flat, self.lengths, self.again = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def _forget(self):
        """Forget the pieces that no shard has met again since the last time."""
        stay = self.again[self.places]
        self.keys, self.places = self.keys[:, stay], (np.cumsum(self.again) - 1)[self.places[stay]]
        self.flat, self.lengths = self.flat[np.repeat(self.again, self.lengths)], self.lengths[self.again]
        self.again = np.zeros(len(self.lengths), bool)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and offsets of the distinct pieces; piece numbers and offsets of the texts."""
        texts = column.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, r"[\s\x00\x{85}\x{A0}\p{Z}][\s\x00\x{85}\x{A0}\p{Z}]|^\s|\s$|[\t\v\f\r\x00\x1c-\x1f\x{85}]|[\x{A0}\p{Zl}\p{Zp}\x{2000}-\x{200A}\x{1680}\x{202F}\x{205F}\x{3000}]|<\|").to_numpy(zero_copy_only=False)
        whole = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        marked = pc.replace_substring(pc.replace_substring(whole, " ", "\0 "), "\n", "\0\n\0")
        split = pc.split_pattern(marked, "\0")
        pieces = split.flatten().dictionary_encode()
        words, numbers = pieces.dictionary, pieces.indices.to_numpy().astype(np.int64)
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        if odd.any():
            rows = np.flatnonzero(odd)
            numbers = np.insert(numbers, offsets[rows + 1] - 1, np.arange(len(words), len(words) + len(rows)))
            # the empty text of a whole piece has left one empty piece; both stay
            offsets = offsets + np.concatenate(([0], np.cumsum(odd)))
            words = pa.concat_arrays([words, texts.filter(pa.array(odd))])
        ids, at = self.distinct(words)
        return ids, at, numbers, offsets

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # a last full stop or comma after a letter is always a token of its own
        tailed = pc.match_substring_regex(words, r"\p{L}[.,]$")
        cores = pc.if_else(tailed, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        place = self._places(cores.dictionary)
        start = np.cumsum(self.lengths) - self.lengths
        where = place[cores.indices.to_numpy()]
        extra = tailed.to_numpy(zero_copy_only=False)
        n = self.lengths[where]
        at = np.concatenate(([0], np.cumsum(n + extra)))
        out = np.zeros(int(at[-1]), np.int64)
        to, run = np.arange(int(n.sum())), np.cumsum(n) - n
        out[to + np.repeat(at[:-1] - run, n)] = self.flat[to + np.repeat(start[where] - run, n)]
        stop = pc.ends_with(words, ".").to_numpy(zero_copy_only=False)[extra]
        out[at[1:][extra] - 1] = np.where(stop, self.tails["."], self.tails[","])
        return out, at

    def _places(self, texts: pa.Array) -> np.ndarray:
        """Where the ids of each text stand among those remembered; new texts are encoded first.
        Texts are known by 128 bits of hashes of their bytes."""
        if len(self.lengths) > self.KEPT:
            self._forget()
        data, offsets = raw(texts)
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        keys = np.stack([span_hashes(data, offsets[:-1], offsets[1:], base) for base in (BASE, OTHER_BASE)])
        at = np.minimum(np.searchsorted(self.keys[0], keys[0]), max(self.keys.shape[1] - 1, 0))
        found = (self.keys[:, at] == keys).all(0) if self.keys.shape[1] else np.zeros(len(texts), bool)
        new = np.flatnonzero(~found)
        flat, lengths = self._encoded(texts.take(pa.array(new)))
        place = np.empty(len(texts), np.int64)
        place[found] = self.places[at[found]]
        self.again[place[found]] = True
        place[new] = len(self.lengths) + np.arange(len(new))
        self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
        self.flat, self.lengths = np.concatenate((self.flat, flat)), np.concatenate((self.lengths, lengths))
        keys, places = np.concatenate((self.keys, keys[:, new]), 1), np.concatenate((self.places, place[new]))
        order = np.argsort(keys[0], kind="stable")
        self.keys, self.places = keys[:, order], places[order]
        return place

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text. Texts that begin with their only white
        space, a space, are encoded many as one: a token that begins with a space begins the next."""
        led = pc.and_(pc.match_substring_regex(texts, "^ " + _SOLID + "+$"), pc.invert(pc.match_substring(texts, "<|")))
        spaced = led.to_numpy(zero_copy_only=False)
        rest = self._ids(texts.filter(pc.invert(led)).to_pylist())
        some = texts.filter(led)
        data, offsets = raw(some)
        body = data.tobytes()
        flat, _ = self._ids([body[a:b].decode() for a, b in zip(offsets[:-1:JOINED], [*offsets[JOINED:-1:JOINED], offsets[-1]])] if len(some) else [], 64)
        begins = np.flatnonzero(self.space_led[flat])
        if len(begins) == len(some):
            joined = flat, np.diff(np.append(begins, len(flat)))
        else:
            joined = self._ids(some.to_pylist())
        lengths = np.empty(len(texts), np.int64)
        lengths[spaced], lengths[~spaced] = joined[1], rest[1]
        of_led = np.repeat(spaced, lengths)
        out = np.empty(len(of_led), np.int32)
        out[of_led], out[~of_led] = joined[0], rest[0]
        return out, lengths

    def _ids(self, texts: list[str], at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's own objects are large, so only a few are held at a time."""
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), at_once):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i:i + at_once], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(lengths[-1].sum())))
        return np.concatenate(flat), np.concatenate(lengths)


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One encoder a Python worker, so that its memory also serves the worker's later tasks."""
    return Pieces(path)


#: most bits of a pair's hash slot
BITS = 20
#: odd multipliers of the pair hash, another two each round
_STIR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _replace(seq: np.ndarray, active: np.ndarray, weight: np.ndarray | None, rules: list, next_symbol: int, least: int, turn: int):
    """One round: replace all frequent neighbours that no more frequent pair overlaps by new symbols.
    ``active`` holds the places of all pairs that may be frequent. A pair of old symbols only gets
    rarer, so what is rare once is left out for good, and a round costs what the last one changed.
    Pairs are counted by hash slots, each for the pair that wrote it last; others of its slot get
    their turn under the next round's hash. Where that finds no frequent pair, all pairs of full
    slots are counted by themselves. Returns the sequence, the active places, the mask of symbols
    that remain and the next free symbol; the mask is None if no pair occurs ``least`` times."""
    bits = min(BITS, len(active).bit_length() + 1)
    slots = 1 << bits
    left, right = seq[active].view(np.uint32), seq[active + 1].view(np.uint32)
    slot = (left * _STIR[turn % 5] + right * _STIR[(turn + 1 + turn // 5 % 4) % 5]) >> np.uint32(32 - bits)
    maybe = np.flatnonzero((np.bincount(slot, weights=weight, minlength=slots) >= least)[slot])
    if not len(maybe):
        return seq, active, None, next_symbol
    active, own, pairs = active[maybe], slot[maybe], left[maybe].astype(np.int64) << 32 | right[maybe]
    weight = None if weight is None else weight[maybe]
    holder = np.zeros(slots, np.int64)

    def hold(which):
        holder[own[which]] = pairs[which]
        held = np.flatnonzero(holder[own] == pairs)
        return held, np.bincount(own[held], weights=None if weight is None else weight[held], minlength=slots)

    held, exact = hold(slice(None))
    if not (exact >= least).any():
        _, where, inverse = np.unique(pairs, return_index=True, return_inverse=True)
        frequent = np.flatnonzero(np.bincount(inverse, weights=weight) >= least)
        if not len(frequent):
            return seq, active, None, next_symbol
        held, exact = hold(where[frequent])
    at, of = active[held], own[held]
    rank = np.where(exact >= least, exact.astype(np.int64) << bits | np.arange(slots), 0)[of]  # larger is more frequent
    beside = np.diff(at) == 1
    before, after = np.zeros_like(rank), np.zeros_like(rank)
    before[1:], after[:-1] = np.where(beside, rank[:-1], 0), np.where(beside, rank[1:], 0)
    best = np.flatnonzero((rank > 0) & (rank >= before) & (rank >= after))
    at, of, again = at[best], of[best], rank[best] == before[best]
    first = np.maximum.accumulate(np.where(again, -1, at))
    odd = (at - first) % 2 == 0  # every other one in a run of one pair
    take, of = at[odd], of[odd]
    apart = np.concatenate(([True], np.diff(take) > 1))
    take, of = take[apart], of[apart]
    number = np.zeros(slots, np.int32)
    number[of] = 1
    used = np.flatnonzero(number)
    number[used] = next_symbol + np.arange(len(used))
    rules.append(np.stack([holder[used] >> 32, holder[used] & 0xFFFFFFFF], 1))
    seq[take] = number[of]
    keep, mark = np.ones(len(seq), bool), np.zeros(len(seq), bool)
    keep[take + 1] = False
    mark[active], mark[take] = True, True
    seq, mark = seq[keep], mark[keep]
    changed = take - np.arange(len(take))
    mark[np.maximum(changed - 1, 0)], mark[-1] = True, False
    return seq, np.flatnonzero(mark), keep, next_symbol + len(used)


def compress(ids: np.ndarray, at: np.ndarray, numbers: np.ndarray, *, first_symbol: int, least: int = 16, rounds: int | None = None):
    """(rules, symbols) of the sequence of pieces ``numbers``; piece k is ids[at[k]:at[k + 1]].
    Goes on until no pair occurs ``least`` times, first inside the distinct pieces, then in the
    whole sequence, or after ``rounds`` rounds of each."""
    rules, symbol, ids = [], first_symbol, ids.astype(np.int32)
    sizes = np.diff(at)
    weight = np.bincount(numbers, minlength=len(sizes))
    piece, turn, active = np.repeat(np.arange(len(sizes)), sizes), 0, np.arange(max(len(ids) - 1, 0))
    while turn != rounds:
        active = active[piece[active] == piece[active + 1]]
        ids, active, keep, symbol = _replace(ids, active, weight[piece[active]], rules, symbol, least, turn)
        if keep is None:
            break
        piece, turn = piece[keep], turn + 1
    sizes = np.bincount(piece, minlength=len(sizes))
    start = np.cumsum(sizes) - sizes
    n = sizes[numbers]
    run = np.cumsum(n) - n
    seq = ids[np.arange(int(n.sum())) + np.repeat(start[numbers] - run, n)]
    turn, active = 0, np.arange(max(len(seq) - 1, 0))
    while turn != rounds:
        seq, active, keep, symbol = _replace(seq, active, None, rules, symbol, least, turn)
        if keep is None:
            break
        turn += 1
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), seq


def write_shard(doc_ids: np.ndarray, doc_sizes: np.ndarray, first_symbol: int, rules: np.ndarray, seq: np.ndarray,
                no_id: np.ndarray | None = None) -> bytes:
    """Header, document ids and offsets, rules, expansion lengths, running lengths, symbols, and a
    bit a document that has no id."""
    missing = np.packbits(np.zeros(len(doc_ids), bool) if no_id is None else no_id)
    lengths = _lengths(first_symbol, rules)
    total = np.concatenate(([0], np.cumsum(_expanded(seq, first_symbol, lengths))))
    head = np.array([len(doc_ids), first_symbol, len(rules), len(seq), total[-1]], "<i8")
    parts = (MAGIC, head, doc_ids.astype("<i8"), np.concatenate(([0], np.cumsum(doc_sizes))).astype("<i8"),
             rules.astype("<u4"), lengths.astype("<i8"), total[:-1:STEP].astype("<i8"), seq.astype("<u4"), missing)
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def _lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """Expansion length of every rule; a rule uses only earlier symbols."""
    lengths = np.zeros(len(rules), np.int64)
    while len(rules) and (lengths == 0).any():
        sides = np.where(rules < first, 1, lengths[np.maximum(rules - first, 0)])
        lengths = np.where((sides > 0).all(1), sides.sum(1), 0)
    return lengths


def _expanded(seq: np.ndarray, first: int, lengths: np.ndarray) -> np.ndarray:
    return np.where(seq < first, 1, lengths[np.maximum(seq - first, 0)]) if len(lengths) else np.ones(len(seq), np.int64)


class Shard:
    """A shard read from its bytes; ``ids(a, b)`` decodes only the symbols that cover the range."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, self.first, n_rules, n_symbols, self.size = np.frombuffer(payload, "<i8", 5, 8)
        at = 48
        def take(kind, count):
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out
        self.doc_ids, self.offsets = take("<i8", n), take("<i8", n + 1)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<i8", n_rules)
        self.running, self.seq = take("<i8", -(-n_symbols // STEP)), take("<u4", n_symbols)
        self.no_id = np.unpackbits(take("u1", -(-n // 8)), count=n).astype(bool)
        self.flat = None

    def _table(self):
        """Expansions of all rules in one array, shorter rules first."""
        start = np.cumsum(self.lengths) - self.lengths
        flat = np.zeros(int(self.lengths.sum()), np.int64)
        done = np.zeros(len(self.rules), bool)
        while not done.all():
            ready = np.flatnonzero(~done & ((self.rules < self.first) | done[np.maximum(self.rules - self.first, 0)]).all(1))
            to = start[ready].copy()
            for side in (0, 1):
                s = self.rules[ready, side]
                leaf = s < self.first
                flat[to[leaf]] = s[leaf]
                k = s[~leaf] - self.first
                n = self.lengths[k]
                run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(to[~leaf], n) + run] = flat[np.repeat(start[k], n) + run]
                step = np.ones(len(s), np.int64)
                step[~leaf] = n
                to += step
            done[ready] = True
        self.start, self.flat = start, flat

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = int(self.size) if b is None else b
        if b <= a:
            return np.zeros(0, "<u4")
        if self.flat is None:
            self._table()
        block = int(np.searchsorted(self.running, a, "right")) - 1
        stop = int(np.searchsorted(self.running, b, "left")) * STEP
        seq = self.seq[block * STEP:stop].astype(np.int64)
        n = _expanded(seq, self.first, self.lengths)
        end = np.cumsum(n)
        leaf = seq < self.first
        base = np.where(leaf, 0, self.start[np.maximum(seq - self.first, 0)]) if len(self.rules) else np.zeros(len(seq), np.int64)
        at = np.arange(int(end[-1])) + np.repeat(base - (end - n), n)
        out = self.flat[np.minimum(at, max(len(self.flat) - 1, 0))] if len(self.flat) else np.zeros(len(at), np.int64)
        out[(end - n)[leaf]] = seq[leaf]
        offset = int(self.running[block])
        return out[a - offset:b - offset].astype("<u4")


def _write(path: str, shard_bytes: int, least: int, rounds: int | None):
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                        ("n_symbols", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        pieces, shard = pieces_of(path), 0
        first_symbol = pieces.tokenizer.get_vocab_size(with_added_tokens=True)
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            doc_ids, no_id = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)
            _, text_at = raw(batch.column(1))
            i = 0
            while i < len(doc_ids):
                j = max(i + 1, int(np.searchsorted(text_at, text_at[i] + shard_bytes, "right")) - 1)
                ids, at, numbers, offsets = pieces.encode(batch.column(1).slice(i, j - i))
                ids, at = np.append(ids, END), np.append(at, at[-1] + 1)  # the last piece ends documents
                numbers = np.insert(numbers, offsets[1:], len(at) - 2)
                size = np.concatenate(([0], np.cumsum(np.diff(at)[numbers])))
                ends = offsets[1:] + np.arange(1, len(offsets))
                doc_sizes = np.diff(np.concatenate(([0], size[ends])))
                rules, seq = compress(ids, at, numbers, first_symbol=first_symbol, least=least, rounds=rounds)
                payload = write_shard(doc_ids[i:j], doc_sizes, first_symbol, rules, seq, no_id[i:j])
                yield pa.RecordBatch.from_pylist([{
                    "part": TaskContext.get().partitionId(), "shard": shard, "n_docs": j - i, "n_ids": int(doc_sizes.sum()),
                    "n_symbols": len(seq), "payload": payload}], schema)
                shard, i = shard + 1, j
    return run


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 part_bytes: int = 48 << 20, shard_bytes: int = 6 << 20, least: int = 16, rounds: int | None = None) -> None:
    """Encode every text (null: empty), add the end id, and write shards in ascending id order.

    Rows with one id stand together, ordered by text; a null id comes first. The tokenizer file
    must lie at the same place on every machine. An empty table writes an empty set of shards.
    Pairs are replaced until none occurs ``least`` times in its shard, or for ``rounds`` rounds inside
    distinct pieces and as many over the whole sequence.
    """
    docs = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    # rows of one id (or none) are cut between texts, by their beginnings, which sort as the texts do
    (docs.repartitionByRange(int(parts), F.col("id"), F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
     .mapInArrow(per_batch(_write(tokenizer or default_tokenizer(), shard_bytes, least, rounds)), SHARD)
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder))


def _read(batches):
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for part, number, payload in zip(*(batch.column(c).to_pylist() for c in range(3))):
            shard = Shard(payload)
            ids, at = shard.ids(), shard.offsets
            body = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(body[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(shard.doc_ids.astype(np.int64), mask=shard.no_id),
                 pa.array(at[:-1].astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document in the shards of ``folder``."""
    shards = spark.read.schema(SHARD).parquet(folder)
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    base = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    docs = shards.select("part", "shard", "payload").mapInArrow(
        per_batch(_read), "part int, shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as token shards in the shared folder and read their digests back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, **options)
    return read_digests(spark, folder)

"""Repair of conversations: the cheapest edits that make roles alternate, by a Viterbi search.

A conversation's turns are read in order. The states of the search are the last role put out
(none, system, user, assistant). Each turn is kept, given another role or deleted, after empty
turns that may be inserted; the roles put out must read ``(s?(ua)+)?``. Of equally cheap edits
the ASCII-least initials (D, I, K, R) win.

Each state has one survivor, a leaf of a tree of steps that point back. Steps count what refers
to them, so those no survivor came through go at once; as soon as all survivors share a first
step, its edits are settled, put out and forgotten. Memory so holds only turns still open.

Survivors have consumed the same turns and end in different states, and the edits of one entry
state fix the state they end in, so none of their initials is the beginning of another's: whatever
follows, two of them compare as they do now. Their order by complete unsettled edits therefore
carries over from turn to turn, as a rank, and no tied suffix is walked again.

The same holds between parts of a long conversation, which so becomes a four by four table of
costs and ranks for each part; the tables are chained, and each part is then searched on its own.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.tables import stage
from .memory import give_back, per_batch

NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (NONE, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: state after the role of another state is put out; a system turn only comes first
NEXT = {(NONE, SYSTEM): SYSTEM, (NONE, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
FOLLOWS = {s: [t for t in STATES if (s, t) in NEXT] for s in STATES}
#: MIMIC[s][t]: what it costs at most more to do from t what can be done from s, by turns inserted
#: first (2 each) and a deleted system turn (3). A survivor dearer than another by more is given up:
#: "all deleted so far" else always survives, and nothing is ever settled.
MIMIC = {NONE: {SYSTEM: 4, USER: 5, ASSISTANT: 3}, SYSTEM: {NONE: 0, USER: 2, ASSISTANT: 0},
         USER: {NONE: 2, SYSTEM: 2, ASSISTANT: 2}, ASSISTANT: {NONE: 0, SYSTEM: 4, USER: 2}}
SPACE = " \t\n\x0b\f\r"

Move = tuple[int, str]
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, edits) after up to two inserted turns; more would only come back to a state."""
    reached = [(state, 0, "")]
    for s, cost, edits in reached:
        yield s, cost, edits
        if len(edits) < 2:
            reached.extend((t, cost + INSERT, edits + "I") for t in FOLLOWS[s] if t in ROLES)


def _moves(initial: int | None, drop: bool, truncated: bool) -> list[list[Move | None]]:
    """The cheapest, then least edits for one turn, from each state to each state."""
    best: list[list[Move | None]] = [[None] * 4 for _ in STATES]
    for s in STATES:
        for mid, cost, edits in _inserted(s):
            options = [(mid, DELETE, "D")]
            if not drop:
                options += [(t, KEEP + truncated, "K") for t in FOLLOWS[mid] if t == initial]
                options += [(t, REROLE + truncated, "R") for t in FOLLOWS[mid] if t in ROLES]
            for t, more, edit in options:
                move = (cost + more, edits + edit)
                if best[s][t] is None or move < best[s][t]:
                    best[s][t] = move
    return best


_INSERTS: list[list[Move | None]] = [[None] * 4 for _ in STATES]
for _s in STATES:
    for _t, _cost, _edits in _inserted(_s):
        if _INSERTS[_s][_t] is None or (_cost, _edits) < _INSERTS[_s][_t]:
            _INSERTS[_s][_t] = (_cost, _edits)
_TABLES = {(initial, drop, truncated): _moves(initial, drop, truncated)
           for initial in (None, SYSTEM, USER, ASSISTANT) for drop in (False, True) for truncated in (False, True)}


class Step:
    """A turn's edits on the way to a state; ``refs`` counts the steps and survivors that came through it."""

    __slots__ = ("parent", "edits", "turn", "refs", "kids")

    def __init__(self, parent: Step | None, edits: str, turn):
        self.parent, self.edits, self.turn, self.refs, self.kids = parent, edits, turn, 0, []


class Search:
    """Survivors of one part of a conversation; ``emit(edits, turn)`` gets settled edits in order."""

    def __init__(self, emit: Callable[[str, object], None] | None = None, entry: int = NONE):
        self.emit, self.root = emit, Step(None, "", None) if emit else None
        self.held = {entry: (0, 0, self.root)}  # state -> (cost, rank, step)
        if self.root:
            self.root.refs = 1
        self.open = self.most_open = 0

    def take(self, turn, initial: int | None, drop: bool, truncated: bool) -> None:
        self._step(turn, _TABLES[initial, drop, truncated])

    def _step(self, turn, table) -> None:
        found = {}
        for s, (cost, rank, step) in self.held.items():
            for t in STATES:
                move = table[s][t]
                if move is not None:
                    way = (cost + move[0], rank, move[1])
                    if t not in found or way < found[t][0]:
                        found[t] = way, step
        order = {t: k for k, t in enumerate(sorted(found, key=lambda t: found[t][0][1:]))}
        held = {}
        for t, ((cost, _, edits), parent) in found.items():
            if any(cost > found[o][0][0] + more or not more and cost == found[o][0][0] and order[o] < order[t]
                   for o, more in MIMIC[t].items() if o in found):
                continue
            step = None
            if parent is not None:
                step = Step(parent, edits, turn)
                step.refs = 1
                parent.refs += 1
                parent.kids.append(step)
            held[t] = (cost, order[t], step)
        for _, _, step in self.held.values():
            self._let_go(step)
        self.held = held
        if self.emit:
            self.open += 1
            self.most_open = max(self.most_open, self.open)
            self._settle()

    def _let_go(self, step: Step | None) -> None:
        while step is not None:
            step.refs -= 1
            if step.refs:
                return
            parent, step.parent = step.parent, None
            if parent is not None:
                parent.kids.remove(step)
            step = parent

    def _settle(self) -> None:
        """Put out what all survivors share. A step with one reference that is a step is settled."""
        while self.root.refs == 1 and self.root.kids:
            step = self.root.kids[0]
            self.emit(step.edits, step.turn)
            step.parent = None
            self.root, self.open = step, self.open - 1

    def table(self) -> dict[int, tuple[int, int]]:
        """state -> (cost, rank)."""
        return {t: (cost, rank) for t, (cost, rank, _) in self.held.items()}

    def end(self, exit: int | None = None) -> int:
        """Finish in ``exit``, or with the cheapest turns inserted at the end; the cost."""
        if exit is None:
            table = [[m if t in ENDS else None for t, m in enumerate(row)] for row in _INSERTS]
            self._step(None, table)
            exit = min(self.held, key=lambda t: self.held[t][:2])
        cost = self.held[exit][0]
        for t in [t for t in self.held if t != exit]:
            self._let_go(self.held.pop(t)[2])
        if self.emit:
            self._settle()
        return cost


def apply(edits: str, state: int, role: str | None, text: str | None) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(edit, role, text, state) of one turn's settled edits; a deleted turn keeps what it was."""
    for edit in edits:
        if edit == "I":
            state = next(t for t in FOLLOWS[state] if t in ROLES)
            yield edit, ROLES[state], "", state
        elif edit == "R":
            state = next(t for t in FOLLOWS[state] if t in ROLES)
            yield edit, ROLES[state], text, state
        elif edit == "K":
            state = INITIALS[role[:1]]
            yield edit, role, text, state
        else:
            yield edit, role, text, state


_EDITS = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()),
                    ("fault", pa.string()), ("role", pa.string()), ("text", pa.string()), ("was", pa.string()), ("cost", pa.int64())])
EDITS = "conv string, part long, seq long, turn long, edit string, fault string, role string, text string, was string, cost long"
_PARTS = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())])
PARTS = "conv string, part long, entry int, exit int, cost long, rank int"
_ROW_BYTES, _ROWS = 4 << 20, 20_000


def _faults(batches) -> Iterator[tuple]:
    """Rows in order, with the first fault of each. A text repeats an earlier one if its digest was
    seen in the conversation, or, where ``first`` was looked up, if it comes after that turn."""
    last, seen = None, set()
    for batch in batches:
        for conv, part, turn, role, text, blank, truncated, known, first, entry, exit in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, part) != last:
                last, seen = (conv, part), set()
            digest = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            at = -(1 << 63) - 1 if turn is None else turn
            again = digest in seen or (known and at > (-(1 << 63) - 1 if first is None else first))
            seen.add(digest)
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            yield conv, part, turn, role, text, fault, entry, exit


def _tables(batches):
    """Costs and ranks of each part of a long conversation, from each state to each."""
    out, last, searches = [], None, []

    def ended():
        out.extend({"conv": last[0], "part": last[1], "entry": s, "exit": t, "cost": c, "rank": r}
                   for s, search in enumerate(searches) for t, (c, r) in search.table().items())
    for conv, part, _, role, _, fault, _, _ in _faults(batches):
        if (conv, part) != last:
            if last is not None:
                ended()
            last, searches = (conv, part), [Search(entry=s) for s in STATES]
        for search in searches:
            search.take(None, INITIALS.get(role[:1]), fault in ("blank", "duplicate"), fault == "truncated")
    if last is not None:
        ended()
    yield pa.RecordBatch.from_pylist(out, _PARTS)


def _repair(batches):
    """Settled edits of each part, in order."""
    rows, size, last, search, seq, state, paid = [], 0, None, None, 0, NONE, 0

    def settled(edits, turn):
        nonlocal seq, state, size, paid
        at, role, text, fault = turn or (None, None, None, None)
        for edit, now, said, state in apply(edits, state, role, text):
            own = edit != "I"
            cost = {"I": INSERT, "D": DELETE, "R": REROLE, "K": KEEP}[edit] + (own and edit != "D" and fault == "truncated")
            rows.append((*last, seq, at if own else None, edit, fault if own else None, now, said, role if own else None, cost))
            seq, size, paid = seq + 1, size + len(said or "") + 64, paid + cost

    def out():
        nonlocal rows, size
        columns = list(zip(*rows)) or [()] * len(_EDITS)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITS)], schema=_EDITS)
        rows, size = [], 0
        return batch

    ends = None
    for conv, part, turn, role, text, fault, entry, exit in _faults(batches):
        if (conv, part) != last:
            if search is not None:
                search.end(ends)
            last, seq, state, ends = (conv, part), 0, entry, exit
            search = Search(settled, entry)
        search.take((turn, role, text, fault), INITIALS.get(role[:1]), fault in ("blank", "duplicate"), fault == "truncated")
        if size > _ROW_BYTES or len(rows) > _ROWS:
            yield out()
    if search is not None:
        search.end(ends)
    yield out()


_ENTRIES = "conv string, part long, entry int, exit int"


def _chain(batches):
    """Entry and exit state of every part, from the parts' tables in order."""
    ways, last, survivors, back = [], None, {}, []

    def ended():
        final = [(c + move[0], r, move[1], s) for s, (c, r) in survivors.items() for t, move in enumerate(_INSERTS[s]) if move and t in ENDS]
        state = min(final)[3]
        for k in range(len(back) - 1, -1, -1):
            part, came = back[k]
            # the last part ends as its own search finds it, with turns inserted at the end
            ways.append({"conv": last, "part": part, "entry": came[state], "exit": None if k == len(back) - 1 else state})
            state = came[state]

    def joined(part, table):
        nonlocal survivors
        found = {}
        for s, t, cost, rank in table:
            if s in survivors:
                way = (survivors[s][0] + cost, survivors[s][1], rank, s)
                found[t] = min(found.get(t, way), way)
        order = {t: k for k, t in enumerate(sorted(found, key=lambda t: found[t][1:3]))}
        back.append((part, {t: way[3] for t, way in found.items()}))
        survivors = {t: (way[0], order[t]) for t, way in found.items()}

    part_of, table = None, []
    for batch in batches:
        for conv, part, entry, exit, cost, rank in zip(*(c.to_pylist() for c in batch.columns)):
            if part_of is not None and (conv, part) != part_of:
                joined(part_of[1], table)
                table = []
            if part_of is None or conv != part_of[0]:
                if part_of is not None:
                    ended()
                last, survivors, back = conv, {NONE: (0, 0)}, []
            part_of = (conv, part)
            table.append((entry, exit, cost, rank))
    if part_of is not None:
        joined(part_of[1], table)
        ended()
    yield pa.RecordBatch.from_pylist(ways, pa.schema([("conv", pa.string()), ("part", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())]))


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return rows.select("*", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))


_INPUT = ("conv", "part", "turn", "role", "text", "blank", "truncated", "known", "first", "entry", "exit")
_ORDER = ("conv", "part", "turn", "role", "text")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv", "part").sortWithinPartitions(*_ORDER).select(*_INPUT)


def edits(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
          long_rows: int = 65_536) -> DataFrame:
    """(conv, part, seq, turn, edit, fault, role, text, was, cost): every edit of the cheapest repair.

    Rows of one conversation lie together in one partition, in order of (part, seq). ``edit`` is K
    (kept), R (another role), D (deleted; role and text are what they were) or I (an empty turn,
    ``turn`` null); ``fault`` is the turn's first of blank, duplicate (role and text seen earlier),
    truncated; ``was`` is the role before; ``cost`` what the edit adds.

    Turns are taken by number, null first, then by role and text. A null text or role is one space, a
    null ``conv`` is a conversation too (ids are given back as text). A role fits by its first letter
    (s, u, a). Texts may have any length; repeated rows are duplicates; other columns are ignored;
    an empty table gives no rows. A conversation of over ``long_rows`` turns is searched in parts of
    about that many, cut at turn numbers, by different tasks; turns of one number stay together.
    """
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    none = {"known": F.lit(False), "first": F.lit(None).cast("long"), "entry": F.lit(NONE), "exit": F.lit(None).cast("int")}
    counts = rows.groupBy("conv").agg(F.count("*").alias("n"))
    long = stage(counts.where(F.col("n") > long_rows), "turns-long")
    if long.isEmpty():
        return _in_order(rows.withColumn("part", F.lit(0).cast("long")).withColumns(none)).mapInArrow(per_batch(_repair), EDITS)
    same = rows["conv"].eqNullSafe(long["conv"])
    short = _in_order(rows.join(long, same, "left_anti").withColumn("part", F.lit(0).cast("long")).withColumns(none))
    done = short.mapInArrow(per_batch(_repair), EDITS)

    # a turn of a long conversation repeats an earlier one if it comes after the first of its digest
    some = rows.join(long, same, "left_semi")
    digest = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    when = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("first"))
    firsts = some.groupBy(F.col("conv").alias("c"), digest.alias("d")).agg(F.min(when).alias("f"), F.count("*").alias("copies"))
    firsts = firsts.where("copies > 1").select("c", "d", "f.first", F.lit(True).alias("known"))
    known = some.withColumn("_digest", digest).join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("_digest") == F.col("d")), "left")
    # parts: ranges of (conv, turn) with about as many rows
    shares = -(-long.agg(F.sum("n")).first()[0] // long_rows)
    known = known.repartitionByRange(shares, "conv", "turn").withColumn("part", F.spark_partition_id().cast("long"))
    known = stage(known.select(*_ORDER, "blank", "truncated", F.coalesce("known", F.lit(False)).alias("known"), "first"), "turns-known")
    tables = stage(_in_order(known.withColumns({"entry": none["entry"], "exit": none["exit"]})).mapInArrow(per_batch(_tables), PARTS), "turns-tables")
    ways = stage(tables.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_chain, _ENTRIES), "turns-ways")
    w = ways.select(F.col("conv").alias("wc"), F.col("part").alias("wp"), "entry", "exit")
    entered = known.join(w, F.col("conv").eqNullSafe(F.col("wc")) & (F.col("part") == F.col("wp"))).drop("wc", "wp")
    found = stage(_in_order(entered).mapInArrow(per_batch(_repair), EDITS), "turns-edits")
    return done.union(found.repartition("conv").sortWithinPartitions("conv", "part", "seq"))


_DIGESTS = pa.schema([("conv", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                      ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
DIGESTS = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


class Digest:
    """What is reported of one conversation, from its edits in order; texts pass through a hash."""

    def __init__(self, conv: str | None):
        self.conv, self.low, self.high, self.distinct, self.turn = conv, None, None, 0, None
        self.faults, self.illegal, self.before, self.cost, self.audit, self.hash, self.any = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, 0, [], sha256(), False

    def take(self, turn, edit, fault, role, text, was, cost) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "D":
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True
        if edit == "I":
            return
        if turn is not None:
            if self.low is None or turn != self.turn:
                self.distinct += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + was[:1] not in LEGAL:
            self.illegal += 1
        self.before = was[:1]

    def row(self) -> dict:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        return {"conv": self.conv, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _digests(batches):
    now, out = None, []
    for batch in batches:
        for conv, _, _, turn, edit, fault, role, text, was, cost in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = Digest(conv)
            now.take(turn, edit, fault, role, text, was, cost)
        if len(out) >= _ROWS:
            yield pa.RecordBatch.from_pylist(out, _DIGESTS)
            out = []
            give_back()
    if now is not None:
        out.append(now.row())
    yield pa.RecordBatch.from_pylist(out, _DIGESTS)


def repair_report(edited: DataFrame, ids: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for every distinct id of ``ids``: gaps between turn numbers, turns by fault, illegal
    neighbours of roles, cost, the edits' initials, and the SHA-256 of the repaired ``role:text``
    lines. ``edited`` comes from :func:`edits`; a conversation without rows there has zeros, no
    edits and the hash of an empty text. ``gaps`` that no long can hold are the largest long."""
    digests = edited.mapInArrow(_digests, DIGESTS)
    every = ids.select(F.col(id_col)).distinct()
    found = every.join(digests, every[id_col].cast("string").eqNullSafe(digests["conv"]), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(id_col, *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           of: int = 20) -> DataFrame:
    """Turns with planted faults, by crc32 of ``conv:turn`` modulo ``of``: 0 drops the row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col, role_col, text_col)}
    kind = F.crc32(F.concat(filled[conv_col], F.lit(":"), filled[turn_col])) % of
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled[text_col], "[.!?]", "")).otherwise(filled[text_col])
    rows = turns.select(F.col(conv_col), F.col(turn_col), F.when(kind == 4, "user").otherwise(filled[role_col]).alias(role_col), text.alias(text_col),
                        F.when(kind == 3, 2).otherwise(1).alias("_times"), kind.alias("_kind")).where("_kind <> 0")
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_kind")

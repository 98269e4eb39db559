"""Fill-in-the-middle rows, repaired conversations and nearest vectors, against plain Python."""
import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm_tables import CLASHING
from scrubwell.llm import fim, neighbours, queries, turns

FOLDER = "/root/testdata/sf0.001"

# fill in the middle


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\n\r é日\U0001f600", max_size=30), max_size=6), st.randoms(), st.sampled_from(fim.UNITS))
def test_cuts_fall_on_unit_ends(texts, rng, unit):
    data = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(b) for b in data]))).astype(np.int64)
    a, b = np.array([[rng.randrange(1 << 32) for _ in texts] for _ in range(2)], np.int64).reshape(2, -1)
    got = np.stack(fim.cuts(np.frombuffer(b"".join(data), np.uint8), at, a, b, unit), axis=1)
    for i, text in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
        low, high = sorted((int(a[i]) % (len(units) + 1), int(b[i]) % (len(units) + 1)))
        parts = ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
        assert got[i].tolist() == [len(units), *map(len, parts)]


def plain_fim(key, text, unit, rate, spm):
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("character", 60, 0), ("line", 0, 50)])
def test_forms_and_round_trip(make, unit, rate, spm):
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "no end", "has <S> inside\nline", "a<\nP>\n<\nS", "é日\n" * 9, "x\n" * 400_000 + "é" * 500_000]
    texts += ["".join(rng.choices(["a", "é", "\n", "<", ">", "P", "S", "M", " "], k=rng.randrange(60))) for _ in range(150)]
    rows = [*enumerate(texts), (3, "\n\n\n"), (None, "no id\nsecond"), (-5, "x\ny")]
    out = fim.fill_in_middle(make(*rows, extra=["7 AS n", "'x' AS form", "1 AS _text", "2 AS _cut"]), unit=unit, rate=rate, spm_rate=spm)
    out = out.withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect())
    assert got == sorted((str(k), *plain_fim(k, t or "", unit, rate, spm), t or "") for k, t in rows)


def test_fim_of_nothing(make):
    assert fim.fill_in_middle(make()).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(make(), unit="word")


# conversations

LANGUAGE, OPEN = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"s?(ua)*u?\Z")


def cheapest(rows):
    """(cost, edits) by a uniform-cost search over whole edit strings."""
    heap, limit, found = [(0, "", 0, "")], None, []
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        if limit is not None and cost > limit:
            break
        if i == len(rows) and LANGUAGE.match(roles):
            limit = cost
            found.append(edits)
        ways = [(cost + 2, edits + "I", i, roles + x) for x in "ua" if not edits.endswith("II")]
        if i < len(rows):
            initial, drop, more = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, roles))
            if not drop:
                ways += [(cost + more, edits + "K", i + 1, roles + initial)] if initial in "sua" and initial else []
                ways += [(cost + 2 + more, edits + "R", i + 1, roles + x) for x in "ua"]
        for way in ways:
            if OPEN.match(way[3]):
                heapq.heappush(heap, way)
    return limit, min(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.booleans(), st.booleans()), max_size=5))
def test_search_finds_the_least_of_the_cheapest_edits(rows):
    rows = [(initial, drop, int(cut and not drop)) for initial, drop, cut in rows]
    got = []
    search = turns.Search(lambda edits, _: got.append(edits))
    for row in rows:
        search.take(row, turns.INITIALS.get(row[0]), row[1], bool(row[2]))
    assert (search.end(), "".join(got)) == cheapest(rows)


def whole_strings(rows):
    """(cost, edits) by a search that carries complete strings and never gives a state up."""
    best = {0: (0, "")}
    for initial, drop, cut in rows:
        table, now = turns._TABLES[turns.INITIALS.get(initial), drop, bool(cut)], {}
        for s, (cost, edits) in best.items():
            for t, move in enumerate(table[s]):
                if move is not None:
                    now[t] = min(now.get(t, (1 << 40, "")), (cost + move[0], edits + move[1]))
        best = now
    return min((cost + move[0], edits + move[1]) for s, (cost, edits) in best.items()
               for t, move in enumerate(turns._INSERTS[s]) if move is not None and t in turns.ENDS)


@pytest.mark.parametrize("seed", range(12))
def test_long_ties_equal_complete_strings(seed):
    rng = random.Random(seed)
    letters = ["suax", "u", "a", "uuaa", "s", "xu"][seed % 6]
    rows = [(rng.choice(letters), rng.random() < 0.1 * (seed % 3), 0) for _ in range(rng.randrange(200, 400))]
    rows = [(i, d, int(not d and rng.random() < 0.3)) for i, d, _ in rows]
    got = []
    search = turns.Search(lambda edits, _: got.append(edits))
    for i, d, c in rows:
        search.take(None, turns.INITIALS.get(i), d, bool(c))
    assert (search.end(), "".join(got)) == whole_strings(rows)


def test_settled_turns_are_let_go():
    rng = random.Random(5)
    search = turns.Search(lambda edits, turn: None)
    for k in range(20_000):
        search.take(k, turns.INITIALS.get(rng.choice("suaa")), rng.random() < 0.1, rng.random() < 0.1)
    assert search.most_open < 60


SPACE = " \t\n\x0b\f\r"


def plain_report(rows):
    """The report of one conversation's (turn, role, text), by the contract's words."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    numbers = [t for t, _, _ in rows if t is not None]
    cost, audit = whole_strings(marked)
    out, state, left = [], 0, list(rows)
    for edit in audit:
        if edit == "I":
            state = next(t for t in turns.FOLLOWS[state] if t in turns.ROLES)
            out.append(f"{turns.ROLES[state]}:")
            continue
        _, role, text = left.pop(0)
        if edit == "R":
            state = next(t for t in turns.FOLLOWS[state] if t in turns.ROLES)
            role = turns.ROLES[state]
        elif edit == "K":
            state = turns.INITIALS[role[:1]]
        if edit != "D":
            out.append(f"{role}:{text}")
    illegal = sum(a[1][:1] + b[1][:1] not in turns.LEGAL for a, b in zip(rows, rows[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


TURNS = "conv_id long, turn long, role string, text string"


def reports(df, ids, **options):
    return {r.conv_id: tuple(r)[1:] for r in turns.repair_report(turns.edits(df, **options), ids).collect()}


def test_query_equals_plain_reports(spark):
    rows = defaultdict(list)
    for r in pq.read_table("/root/testdata/sf0.01/conversations.parquet").to_pylist():
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r["text"]) if kind == 2 else r["text"]
        rows[r["conv_id"]] += [(r["turn"], "user" if kind == 4 else r["role"], text)] * ({0: 0, 3: 2}.get(kind, 1))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_turn_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: plain_report(v) for k, v in rows.items()}


def odd_turns():
    rng = random.Random(8)
    texts = ["Yes.", "No", " ", "", "a\nb?", "é日!", "tail. \t\n", "long " * 50_000 + "end."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([*texts, None]))
            for c in range(40) for _ in range(rng.randrange(1, 9))]
    return rows + [(None, 1, "user", "no id."), (None, 2, "assistant", "no id!"), (50, 7, "user", "x"), (50, 7, "user", "x"), (51, -(1 << 63), "user", "y."), (51, (1 << 63) - 1, "user", "z.")]


@pytest.mark.parametrize("long_rows", [65_536, 2])
def test_odd_conversations(spark, long_rows):
    """Nulls, ties, repeats, empty and long texts, clashing names; whole or in parts."""
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS conv", "2 AS part", "'x' AS fault", "3 AS seq")
    expected = defaultdict(list)
    for c, t, role, text in rows:
        expected[c].append((t, " " if role is None else role, " " if text is None else text))
    wanted = {k: plain_report(v) for k, v in expected.items()}
    wanted[51] = ((1 << 63) - 1, *wanted[51][1:])
    assert reports(df, df, long_rows=long_rows) == wanted


def test_one_long_conversation_in_parts(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "user", "assistant", "system"]), f"text {rng.randrange(900)}" + rng.choice([".", ""])) for t in range(1500)]
    rows += [(2, t, ["user", "assistant"][t % 2], f"t{t}.") for t in range(10)]
    df = spark.createDataFrame(rows, TURNS)
    expected = {k: plain_report([r[1:] for r in rows if r[0] == k]) for k in (1, 2)}
    assert reports(df, df, long_rows=100) == reports(df, df) == expected


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.")], TURNS)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert reports(df.limit(0), df) == {1: empty} and reports(df.limit(0), df.limit(0)) == {}


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b!") for c in range(30) for t in (None, 1, 2)] + [(None, 1, None, None)]
    got = defaultdict(list)
    for r in turns.damage(spark.createDataFrame(rows, TURNS)).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        assert got[c, t] == {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])


# nearest vectors

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, asked, k=5):
    """query -> [(vec_id, score)] over one row an id."""
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in asked:
        scores = [(-float(neighbours.cosines(x[q][None], v[None])[0]), i) for i, v in x.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=7), st.lists(st.integers(0, 4), min_size=1, max_size=7))
def test_walk_meets_every_pair_by_rising_sum(a, b):
    pairs = list(neighbours.walk(np.array(a, float), np.array(b, float)))
    sums = [a[i] + b[j] for i, j in pairs]
    assert len(set(pairs)) == len(pairs) == len(a) * len(b) and sums == sorted(sums)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{folder}/embeddings.parquet").to_pylist()]
    x = np.array([v for _, v in rows], np.float64)
    wanted = brute(rows, [i for i, _ in rows if i % 50 == 0])
    got, at = found(queries.op13_nearest_vectors(spark, folder)), {i: n for n, (i, _) in enumerate(rows)}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in wanted.items())
    assert got.keys() == wanted.keys() and all(len(v) == 5 for v in got.values()) and hits >= 0.9 * 5 * len(wanted)
    for q, near in got.items():
        for i, score in near:
            a, b = x[at[q]], x[at[i]]
            assert score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
        assert near == sorted(near, key=lambda r: (-r[1], r[0]))


def test_clustered_vectors_meet_few_cells():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(200, 16))[rng.integers(0, 200, 8000)] + rng.normal(scale=0.05, size=(8000, 16)))
    assert neighbours.fit(x, 100_000).share < 0.1


def test_odd_vectors(spark):
    """Nulls, zeros, odd lengths, not finite, copies in one cell, repeated ids, clashing names."""
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7 - 3), 1.0, float(i % 5)]) for i in range(1, 90)] + [(100 + i, [2.0, 1.0, 1.0]) for i in range(40)]
    bad = [(500, None), (501, []), (502, [0.0, 0.0, 0.0]), (503, [1.0, None, 2.0]), (504, [nan, 1.0, 1.0]), (505, [inf, 1.0, 1.0]), (506, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (550, None)]
    twice = [(600, [3.0, 3.0, 3.0]), (600, [1.0, 2.0, 3.0]), (600, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(good + bad + twice, VECTORS).selectExpr("*", "1 AS id", "2 AS cell", "3 AS block", "4 AS vector", "5 AS score")
    result = neighbours.nearest(df, df.where("vec_id % 50 = 0"), block=16)
    asked = [i for i, _ in good if i % 50 == 0] + [600]
    assert found(result) == brute([*good, (600, [1.0, 2.0, 3.0])], asked)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], VECTORS)
    assert found(neighbours.nearest(df, df.where("vec_id = 50"))) == brute([(50, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], [50])
    assert neighbours.nearest(df.limit(0), df).collect() == [] and neighbours.nearest(df, df.limit(0)).collect() == []
    one = spark.createDataFrame([(50, [3.0])], VECTORS)
    assert neighbours.nearest(one, one).collect() == []

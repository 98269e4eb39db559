"""Token shards, chat formats, URL rules and personal data on small tables."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from llm_tables import CLASHING
from scrubwell.llm import chat, pii, token_files
from scrubwell.llm.urls import filter_urls
from scrubwell.llm.words import words

# token shards


@pytest.fixture(scope="module")
def pieces():
    return token_files.Pieces(token_files.default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab.,' \n\t\r\x00\x1c\x85\xa0\u2003é日12<|>#", max_size=25)), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(pieces, texts):
    ids, at, numbers, offsets = pieces.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        got = [t for k in numbers[offsets[i]:offsets[i + 1]] for t in ids[at[k]:at[k + 1]]]
        assert got == pieces.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_shards_decode_whole_and_in_part():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(0, 6, rng.integers(1, 20))
        at, numbers = np.concatenate(([0], np.cumsum(sizes))), rng.integers(0, len(sizes), rng.integers(0, 3000))
        ids = rng.integers(0, 4, at[-1])
        full = np.concatenate([ids[at[k]:at[k + 1]] for k in numbers] + [np.zeros(0, int)])
        rules, seq = token_files.compress(ids, at, numbers, first_symbol=10, least=2)
        shard = token_files.Shard(token_files.write_shard(np.array([1]), np.array([len(full)]), 10, rules, seq))
        assert (shard.ids() == full).all() and len(seq) <= len(full)
        for _ in range(4):
            a, b = sorted(rng.integers(0, len(full) + 1, 2))
            assert (shard.ids(a, b) == full[a:b]).all()


def test_digests_follow_id_order(make, pieces):
    rows = [(i, " ".join(random.Random(i).choices(["alpha", "beta.", "Gamma,", "x\ny"], k=i * 7))) for i in (9, 3, 40, 12)]
    rows += [(5, None), (6, ""), (3, "again"), (7, "odd\t\t space ")]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(
        make(*rows, extra=CLASHING), part_bytes=200, shard_bytes=60).orderBy("start").collect()]
    start, expected = 0, []
    for key, text in sorted((k, t or "") for k, t in rows):
        ids = np.array([*pieces.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected


def test_every_long_is_an_id_and_null_is_none(make):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, "a b"), (None, "c"), (high, None), (None, "c"), (low, "a b")]
    got = token_files.token_digests(make(*rows), shard_bytes=3).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, low, low, high]


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    for least in (2, 5, 16):
        numbers = np.concatenate([np.tile(rng.integers(0, 40, 30), 20), rng.integers(0, 40, 4000)])
        ids, at = rng.integers(0, 9, 200), np.arange(0, 201, 5)
        _, seq = token_files.compress(ids, at, numbers, first_symbol=10, least=least)
        taken, last = {}, {}
        for i, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist())):  # of overlapping occurrences every other one
            if last.get(pair) != i - 1:
                taken[pair], last[pair] = taken.get(pair, 0) + 1, i
        assert max(taken.values()) < least


def test_pieces_that_come_again_are_remembered_and_others_forgotten(pieces, monkeypatch):
    small = token_files.Pieces(token_files.default_tokenizer())
    monkeypatch.setattr(small, "KEPT", 3)
    whole = lambda texts: [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for texts in (["a bird sang, low", "a bird"], ["a bird flew 12 miles."], ["the bird sang"], ["", "other words came up"], ["a bird sang, low"]):
        ids, at, numbers, offsets = small.encode(pa.array(texts))
        flat = [[i for k in numbers[a:b] for i in ids[at[k]:at[k + 1]]] for a, b in zip(offsets[:-1], offsets[1:])]
        assert flat == whole(texts)
        assert len(small.keys[0]) == len(small.places) == len(small.lengths) == len(small.again)
        assert small.lengths.sum() == len(small.flat)
    assert len(small.lengths) < 12


def test_rounds_leave_no_frequent_pair_and_decode_exactly():
    """Runs of one symbol, hot and rare pieces: all pairs of the result are rarer than ``least``, counted plainly."""
    rng = np.random.default_rng(5)
    for trial in range(20):
        sizes = rng.integers(1, 9, 40)
        at = np.concatenate(([0], np.cumsum(sizes)))
        ids, numbers = rng.integers(1, 4 if trial % 2 else 30, at[-1]), rng.zipf(1.5, 3000) % 40
        full = np.concatenate([ids[at[k]:at[k + 1]] for k in numbers])
        rules, seq = token_files.compress(ids, at, numbers, first_symbol=100)
        assert all(n < 16 for n in Counter(zip(seq[:-1].tolist(), seq[1:].tolist())).values())
        shard = token_files.Shard(token_files.write_shard(np.array([1]), np.array([len(full)]), 100, rules, seq))
        assert np.array_equal(shard.ids(), full)
        assert np.array_equal(shard.ids(100, 900), full[100:900])


def test_no_documents(make):
    assert token_files.token_digests(make()).collect() == []


# chat

TURNS = "conv_id long, turn long, role string, text string"


def test_formatted_texts_read_back(spark):
    hard = ["<|end|>", "</s>[INST]", "&lt;", "&amp;lt;", "a\nb", "", None, "<|start|>user<|text|>", "é日"]
    rows = [(c, t, ["user", "assistant"][t % 2], hard[(c + t) % len(hard)]) for c in range(9) for t in range(5)]
    rows += [(20, 0, None, "x"), (21, None, "user", "null turn"), (21, 1, "<|end|>", "odd role"), (None, 0, "user", "no conversation"),
             (22, 0, "user", "b"), (22, 0, "user", "a"), (22, 0, "assistant", "c")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS id", "2 AS conv", "3 AS score")
    formatted = chat.format_paths(chat.threads(df)).cache()
    back = {}
    for r in chat.read_turns(formatted).collect():
        back.setdefault(r.conv, []).append((r["at"], r.role, r.text, r.learnt))
    expected = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        held = expected.setdefault(c, [])
        held.append((len(held), role or "", text or "", (text or "") if role == "assistant" else ""))
    assert {c: sorted(v) for c, v in back.items()} == expected
    for r in formatted.collect():
        assert [r.formatted[s.start:s.start + s.length] for s in r.loss if s.length] == [
            x[2].replace("&", "&amp;").replace("<", "&lt;") for x in expected[r.conv] if x[3]]


def test_branches_are_ranked_and_deep_paths_enumerated(spark):
    tree = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", -1.0),
            (1, 4, 2, "user", "more", 0.5), (1, 5, 2, "user", "same", 0.5), (2, 1, 99, "user", "parent is missing", None), (1, 4, 2, "user", "more", 0.5)]
    deep = [(3, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(40)]
    df = spark.createDataFrame(tree + deep, "conv long, id long, parent long, role string, text string, score double")
    rows = {(r.conv, r["rank"]): r for r in chat.format_paths(df, branches=2).collect()}
    assert (rows[1, 1].leaf, rows[1, 2].leaf, (1, 3) in rows) == (4, 5, False)
    assert rows[3, 1].n_turns == 40 and rows[2, 1].n_turns == 1
    assert re.findall(r"<\|text\|>(\d+)<", rows[3, 1].formatted) == [str(i) for i in range(40)]


def test_cycles_raise_and_empty_tables_give_no_rows(spark):
    schema = "conv long, id long, parent long, role string, text string, score double"
    assert chat.format_paths(spark.createDataFrame([], schema)).collect() == []
    # the second conversation has a leaf whose way runs into a cycle
    for rows in ([(1, 1, 2), (1, 2, 1)], [(1, 1, None), (2, 3, 2), (2, 2, 1), (2, 1, 2), (3, 1, None), (3, 2, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            chat.paths(spark.createDataFrame([(*r, "u", "", 0.0) for r in rows], schema))


# urls

def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("options", [{}, {"range_rows": 7}])
def test_verdicts_equal_a_plain_loop(spark, options):
    rng = random.Random(0)
    labels, paths = ["a", "b", "com", "net", "www", "x-y"], ["", "/", "/en/", "/en", "/en/a", "/e", "/zz"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randrange(1, 4)))
    rules = sorted({(host(), rng.choice(paths)) for _ in range(40)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules] + [("a", "/both", "allow"), ("a", "/both", "block"), ("", "/", "block"), (None, "/", "block")]
    urls = [rng.choice(["http", "HTTPS"]) + "://" + host().upper() + rng.choice(paths) + rng.choice(["", "?q=/en/", "#/en/", "x"]) for _ in range(200)]
    urls += [None, "", "no scheme", "http://", "x://a/both/c", "http://a:80/en/", "http://.com/", "http://a..com/en/", urls[0], urls[0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'k' AS `key`", "1 AS page", "2 AS bucket")
    got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **options)
    assert got.columns == ["page_id", "url", "key", "page", "bucket", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r["rule"], r.verdict) == plain_verdict(r.url, rules), r.url
    assert got.count() == len(urls)


def test_no_pages_or_no_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [(r["rule"], r.verdict) for r in filter_urls(pages, rules).collect()] == [(None, "allow")]
    assert filter_urls(pages.limit(0), rules).collect() == []


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
digits = lambda m: re.sub("[^0-9]", "", m.group())


def plain_spans(text):
    return ([("email", *m.span()) for m in EMAIL.finditer(text)]
            + [("ip", *m.span()) for m in IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split("."))]
            + [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
            + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@-+ 2(é", max_size=30),
                 st.lists(st.sampled_from(["4111 1111 1111 1111", "a@b.c", "@", ".", " ", "+1 (456) 555-2186", "1.2.3.4", "0255.1.1.1", "-", "é"]), max_size=6).map("".join)))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_the_field_adds_spans_in_code_points(make):
    text = "éé password=b7db7aa4a5fcc78305, then ring 456-555-2186. or a@b.cd in 1999"
    rows = [(1, text), (2, None), (3, ""), (4, "plain words, all of them (so) 12 of 30!"), (5, "9" * 50_000 + "a" * 50_000 + "@"), (1, text)]
    got = {r.doc_id: r for r in pii.find_personal_data(make(*rows, extra=CLASHING)).collect()}
    spans = [s.split(":") for s in got[1].spans.split(",")]
    assert [(k, text[int(a):int(b)]) for k, a, b in spans] == [("email", "a@b.cd"), ("phone", "456-555-2186"), ("secret", "password=b7db7aa4a5fcc78305")]
    assert (got[1].n_email, got[1].n_phone) == (1, 0)
    assert [got[k].spans for k in (2, 3, 4, 5)] == [""] * 4
    assert pii.find_personal_data(make()).collect() == []


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.train())


@pytest.mark.parametrize("text, expected", [
    ("call 456-555-2186, 456-555-2187 today", ["456-555-2186", "456-555-2187"]),
    ("call (456) 555-2186 (456) 555-2187 today", ["(456) 555-2186", "(456) 555-2187"]),
    ("phone 4565552186, 4565552187, 4565552188 now", ["4565552186", "4565552187", "4565552188"]),
    ("card 4111 1111 1111 1111 5500 0000 0000 0004 expired", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
    ("paid with 5500-0000-0000-0004 4111-1111-1111-1111 today", ["5500-0000-0000-0004", "4111-1111-1111-1111"]),
    ("write kim@localhost bob@localhost today", ["kim@localhost", "bob@localhost"]),
    ("reply to kim99@localhost bob@site.org please", ["kim99@localhost", "bob@site.org"]),
    ("the password=hunter22x9 token=9f8e7d6c5b4a3f2e was lost", ["password=hunter22x9", "token=9f8e7d6c5b4a3f2e"]),
    ("key: sk-9a8b7c6d5e4f3a2b token: Zx81kq09Lm22 is", ["sk-9a8b7c6d5e4f3a2b", "Zx81kq09Lm22"]),
    ("é mail kim@localhost, call 456-555-2186, 456-555-2187 or +1 (456) 555-2188 now", ["kim@localhost", "456-555-2186", "456-555-2187", "+1 (456) 555-2188"]),
])
def test_neighbours_of_one_kind_are_spans_of_their_own(finder, text, expected):
    (out,) = finder.run([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["row", "text"])])
    spans = [s.split(":")[1:] for s in out.column("spans")[0].as_py().split(",")]
    assert sorted(text[int(a):int(b)] for a, b in spans) == sorted(expected)


def test_runs_are_parted_at_words():
    def found(kind, text):
        return [text[a:b] for _, a, b in pii.parted(text, kind, [m.span() for m in re.finditer(r"\S+", text)])]
    assert found("secret", "password=short token=9f8e7d6c5b4a3f2e") == ["token=9f8e7d6c5b4a3f2e"]
    assert found("secret", "token=9f8e7d6c5b4a3f2e password=short") == ["token=9f8e7d6c5b4a3f2e"]
    assert found("secret", "password: hunter22x9 secret:q8w7 e6r5t4y3") == ["password: hunter22x9", "secret:q8w7 e6r5t4y3"]
    assert found("phone", "12345, 4565552186") == ["4565552186"]
    assert found("phone", "030 5552186 030 5552187") == ["030 5552186", "030 5552187"]
    assert found("ip", "10.0.0.1 10.0.0.2") == [] == found("card", "4111 1111 1111 1112")


def whole_viterbi(field, shape):
    """The best labels of one text, word by word in double precision, and their score."""
    here = lambda t: (field.here[shape[t]].astype(float) + (field.before[shape[t - 1]] if t else 0)
                      + (field.after[shape[t + 1]] if t + 1 < len(shape) else 0))
    best, back = here(0), []
    for t in range(1, len(shape)):
        step = best[:, None] + field.pairs
        back.append(step.argmax(0))
        best = step.max(0) + here(t)
    out = [int(best.argmax())]
    for choice in reversed(back):
        out.append(int(choice[out[-1]]))
    return out[::-1], best.max()


@pytest.mark.parametrize("stretch", [1, 8])
def test_labels_are_the_best_of_whole_texts(stretch):
    """Random shapes and links of many strengths: every word takes part, and what is not decoded is O."""
    field, rng = pii.train(), np.random.default_rng(stretch)
    usual = pii.Field(field.here, field.before, field.after, field.pairs * stretch)
    for trial in range(40):
        sizes = rng.integers(0, 30, 5)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        shape = rng.choice(rng.choice(pii.SHAPES, 12), offsets[-1])
        at, labels = usual.labels(shape, offsets)
        got = np.zeros(len(shape), int)
        got[at] = labels
        for a, b in zip(offsets[:-1], offsets[1:]):
            if a < b:
                path, best = whole_viterbi(usual, shape[a:b])
                mine = got[a:b]
                score = (usual.here[shape[a:b], mine].sum() + usual.before[shape[a:b - 1], mine[1:]].sum()
                         + usual.after[shape[a + 1:b], mine[:-1]].sum() + usual.pairs[mine[:-1], mine[1:]].sum())
                assert score == pytest.approx(best, abs=1e-2)


def test_plain_words_are_labelled_too_where_the_field_says_so(finder):
    """With a field that likes plain words as secrets no word is O by rule; few words of the usual one are decoded."""
    likes = pii.Field(finder.field.here.copy(), finder.field.before, finder.field.after, finder.field.pairs)
    likes.here[:, pii.LABELS.index("secret")] += 50
    (part,) = words(pa.array(["plain words only here"]), 1 << 20)
    at, labels = likes.labels(pii.shapes(part), part.offsets)
    assert at.tolist() == [0, 1, 2, 3] and set(labels) == {pii.LABELS.index("secret")}
    (part,) = words(pa.array(["a long and plain text of words, " * 500 + "call 456-555-2186 today"]), 1 << 20)
    score = finder.field.scores(pii.shapes(part), part.offsets)
    assert len(finder.field.undecided(score, part.offsets)) < 20


def test_thousands_of_zeros_in_an_address():
    text = "0" * 5000 + "1.1.1." + "0" * 5000 + " " + "0" * 5000 + "1.1.1.256 " + "9" * 5000 + ".1.1.1"
    assert pii.base_spans(text) == [("ip", 0, 10_006)]

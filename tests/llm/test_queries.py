"""The registered queries on the small tables, against SQL or plain Python over whole tables."""
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from scrubwell.llm import pii, queries
from scrubwell.llm.token_files import Pieces, default_tokenizer

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run(spark, name):
    return {r.doc_id: r for r in queries.CHECKS[name][0](spark, FOLDER).collect()}


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.CHECKS.items() if sql])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    query, sql = queries.CHECKS[name]
    df, expected = query(spark, FOLDER), con.sql(sql)
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    at = [expected.columns.index(c) for c in order]
    assert sorted(str([str(r[c]) for c in order]) for r in df.collect()) == sorted(str([str(r[i]) for i in at]) for r in expected.fetchall())


def test_lm_base_scores(spark, docs):
    got = run(spark, "op3_lm_score")
    tokens = {d["doc_id"]: [*WORD.findall((d["text"] or "").translate(LOWER)), None] for d in docs}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    counts = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    for k, t in tokens.items():
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (held[k], len(t), sum(w in counts for w in t), n)
        assert got[k].base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    fresh = [got[k] for k in tokens if held[k]]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_token_digests(spark, docs):
    got, start = run(spark, "op5_token_files"), 0
    tokenizer = Pieces(default_tokenizer()).tokenizer
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_link_components(spark, docs):
    got, sets = run(spark, "op6_ngram_join"), {}
    for d in docs:
        w = WORD.findall((d["text"] or "").translate(LOWER))
        sets[d["doc_id"]] = {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    least = {k: k for k in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(s), find(k)) for k, s in sets.items()}


def test_leaked_items_are_found(spark, docs):
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontaminate(spark, FOLDER).collect()}
    items = {r["item_id"]: WORD.findall(r["text"].translate(LOWER)) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()}
    for d in docs:
        w = WORD.findall((d["text"] or "").translate(LOWER))
        seen = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        for k, item in items.items():
            own = {tuple(item[i:i + 5]) for i in range(len(item) - 4)}
            if own and own <= seen:
                assert (d["doc_id"], k) in found
            elif not own & seen:
                assert (d["doc_id"], k) not in found


def test_personal_data(spark, docs):
    got = run(spark, "op8_personal_data")
    for d in docs:
        base, r = pii.base_spans(d["text"] or ""), got[d["doc_id"]]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {s for s in joined.split(",") if s} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS[:4]]


def test_mixing_and_toxicity_cover_every_document(spark, docs):
    rates, scores = run(spark, "op7_mixing"), run(spark, "op1_toxicity")
    assert rates.keys() == scores.keys() == {d["doc_id"] for d in docs}
    total = sum(r.tokens for r in rates.values())
    for lang, share in queries.MIX.items():
        assert sum(r.tokens * r.rate * r[f"p_{lang}"] for r in rates.values()) / total == pytest.approx(share, abs=1e-3)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for k, r in scores.items())


def test_pipeline_stages(spark, docs):
    """Every stage against what it must do to its own input; the last against the tokenizer."""
    df, by_id = queries.read(spark, FOLDER, "documents"), {d["doc_id"]: d for d in docs}
    for name, step in corpus_pipeline.STAGES:
        before = [r.asDict() for r in df.collect()]
        df = corpus_pipeline.stage(step(spark, df, FOLDER), f"test-{name}")
        ids = sorted(r.doc_id for r in df.collect())
        if name != "tokens":
            assert df.columns == list(docs[0]) and all(r.asDict() == by_id[r.doc_id] for r in df.collect())
        if name == "quality":
            assert ids == sorted(k for k, r in run(spark, "op2_quality_rules").items() if r.kept)
        elif name == "near_duplicates":
            groups = corpus_pipeline.jaccard_components(spark.createDataFrame(before, "doc_id long, lang string, n_chars long, source string, text string"), size=5, percent=80)
            assert ids == sorted({r.component_id for r in groups.collect()})
        elif name == "decontaminate":
            leaked = {r.doc_id for r in queries.op4_decontaminate(spark, FOLDER).collect()}
            assert ids == sorted(d["doc_id"] for d in before if d["doc_id"] not in leaked)
        elif name == "mix":
            times = Counter(ids)
            assert set(times) <= {d["doc_id"] for d in before} and max(times.values()) <= 9
        else:
            tokenizer = Pieces(default_tokenizer()).tokenizer
            expected = Counter()
            for d in before:
                ids_ = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, 0], "<u4")
                expected[d["doc_id"], len(ids_), zlib.crc32(ids_.tobytes())] += 1
            assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect()) == expected


def test_pipeline_stages_on_an_empty_table(spark):
    empty = queries.read(spark, FOLDER, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, FOLDER).count() == 0

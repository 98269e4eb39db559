"""Quality rules, model scores, decontamination, mixing and toxicity on small tables."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_tables import CLASHING, words
from scrubwell.llm import mixing, token_files, toxicity
from scrubwell.llm.decontaminate import PRINTS, Items, leaks, weighted_similarity
from scrubwell.llm.lm import Automaton, score_texts
from scrubwell.llm.mixing import mixing_rates
from scrubwell.llm.ngram_join import jaccard_components
from scrubwell.llm.quality import binomial_tail, judge, passing


# quality rules

def test_measures_and_base_rules(make, spark):
    text = "a b c\na b c\n\n \t\nx# y* é|\na b c"
    rows = {r.doc_id: r for r in judge(make((1, text), (2, None), (3, ""), (4, " ".join(words(1, 60))), extra=CLASHING),
                                       spark.createDataFrame([], "id long, good boolean")).collect()}
    r = rows[1]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (12, 15, 3, 2, 9, True, False)
    assert [(rows[k].n_words, rows[k].kept) for k in (2, 3)] == [(0, False), (0, False)]
    assert (rows[4].base_failed, rows[4].kept, rows[4].rejected_by) == (False, True, [])


def test_repeated_words_equal_brute_force(make, spark):
    rng, rows = random.Random(3), []
    for i in range(60):
        rows.append((i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40)))))
    rows.append((100, "th " * 30_000))
    got = {r.doc_id: r.n_repeat_words for r in judge(make(*rows), spark.createDataFrame([], "id long, good boolean")).collect()}
    for key, text in rows:
        w = text.split()
        seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        assert got[key] == len({i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)})


def test_binomial_tail_is_exact_or_above(spark):
    cases = [(10, 0, 0.1), (300, 2, 0.02), (5000, 80, 0.02), (100_000, 300, 0.004), (7, 7, 0.5), (100_000, 380, 0.004)]
    for n, k, p in cases:
        exact = 1.0 if k >= n * p else math.fsum(
            math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got, short = spark.range(1).select(binomial_tail(F.lit(n), F.lit(k), p), binomial_tail(F.lit(n), F.lit(k), p, terms=20)).first()
        assert got == pytest.approx(exact, rel=1e-6) and short >= exact * (1 - 1e-6)


def test_cutoffs_reject_junk_and_bound_the_risk(make, spark):
    good = [(i, " ".join(words(i, 60))) for i in range(2500)]
    junk = [(10_000 + i, " ".join(w + "##" for w in words(i, 60))) for i in range(50)]
    strange = [(20_000 + i, " ".join(w + "##" for w in words(i, 60)), "xx") for i in range(5)]  # a stratum without labels
    labels = spark.createDataFrame([(i, True) for i, _ in good] + [(i, False) for i, *_ in junk] + [(3, False)], "id long, good boolean")
    docs = make(*good, *junk, *strange, (None, None), (None, " ".join(words(5, 60))))
    rows = judge(docs, labels).collect()
    assert {r.doc_id for r in rows if not r.kept and r.doc_id is not None} == {i for i, *_ in junk}
    assert all(r.rejected_by == ["symbols_per_word"] for r in rows if 10_000 <= (r.doc_id or 0) < 20_000)
    kept = passing(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in rows if r.kept)


# language model

def bigram_scores(train, texts, growth):
    """The same model by plain dictionaries."""
    one, two = Counter(), Counter()
    for t in train:
        for h, w in zip(["<s>", *t], [*t, "</s>"]):
            one[w] += 1
            two[h, w] += 1
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    seen = lambda h: len(train) if h == "<s>" else one[h]
    out = []
    for t in texts:
        total = 0.0
        for h, w in zip(["<s>", *t], [*t, "</s>"]):
            k = seen(h) ** growth if seen(h) else 1.0
            total += math.log10((two[h, w] + k * p(w)) / (seen(h) + k) if seen(h) else p(w))
        out.append(total)
    return out


def test_scores_equal_plain_dictionaries(make, monkeypatch):
    from scrubwell.llm import lm
    monkeypatch.setattr(lm, "_growth", lambda levels: 0.6)
    texts = [words(i, n, 30) for i, n in enumerate((5, 0, 40, 3, 17, 200, 1))] + [["only", "once"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, "Only  ONCE\n")]
    texts += [[], ["only", "once"]]
    held = F.col("doc_id").isin(3, 5)
    small = {r.doc_id: r for r in score_texts(make(*rows, extra=CLASHING), held_out=held, block_bytes=200, bucket_tokens=20).collect()}
    whole = {r.doc_id: r for r in score_texts(make(*rows), held_out=held).collect()}
    expected = bigram_scores([t for (i, _), t in zip(rows, texts) if i not in (3, 5)], texts, 0.6)
    for (i, _), t, score in zip(rows, texts, expected):
        assert small[i].score == pytest.approx(score, abs=1e-9) and whole[i].score == pytest.approx(score, abs=1e-9)
        assert small[i].n_tokens == len(t) + 1 and small[i].held_out == (i in (3, 5))


def test_scores_depend_on_rows_not_on_their_packing(make, monkeypatch):
    from scrubwell.llm import lm
    seen = []
    fit = lm._growth
    monkeypatch.setattr(lm, "_growth", lambda levels: seen.append(levels) or fit(levels))
    texts = [words(i, n, 30) for i, n in enumerate([5, 0, 40, 3, 17, 200, 1] * 6)]
    docs, held = make(*((i, " ".join(t)) for i, t in enumerate(texts))), F.col("doc_id").isin(3, 5)
    whole, *others = [{r.doc_id: r.score for r in score_texts(d, held_out=held, **sizes).collect()} for d, sizes in (
        (docs.coalesce(1), {}), (docs.coalesce(1), {"block_bytes": 200}), (docs.repartition(7), {"block_bytes": 500, "bucket_tokens": 100}),
        (docs.repartition(3), {"block_bytes": 3000, "bucket_tokens": 20}))]
    after = {}
    for i, t in enumerate(texts):
        if i not in (3, 5):
            for h, w in zip(["<s>", *t], [*t, "</s>"]):
                after.setdefault(h, []).append(w)
    expected = {}
    for w in after.values():
        count, kinds = expected.get(len(w).bit_length() - 1, (0, 0))
        expected[len(w).bit_length() - 1] = count + len(w), kinds + len(set(w))
    assert seen == [expected] * 4
    for other in others:
        assert other == pytest.approx(whole, abs=1e-9)


def test_probabilities_of_a_state_sum_to_one():
    counts, unigram = {0: 3, 1: 1}, np.array([0.5, 0.3, 0.15, 0.05])
    seen, kinds = 4, 2.0
    arcs = np.array([1 * 5 + w for w in counts])
    weights = np.log10([(c + kinds * unigram[w]) / (seen + kinds) for w, c in counts.items()])
    escape = np.array([0, np.log10(kinds / (seen + kinds)), 0, 0, 0, 0.0])
    model = Automaton(5, np.append(np.log10(unigram), 0), arcs, weights, escape)
    after = [10 ** (model.walk(np.array([0, w]), np.array([2]))[0] - model.walk(np.array([0]), np.array([1]))[0]) for w in range(4)]
    assert sum(after) == pytest.approx(1.0)


def test_nothing_to_learn_from_and_no_rows(make):
    assert score_texts(make()).collect() == []
    (row,) = score_texts(make((1, "a b")), held_out=F.lit(True)).collect()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)


# decontamination

def test_leaks_equal_brute_force(make, spark):
    items = [(i, " ".join(words(i, 12 + i, 400))) for i in range(12)] + [(50, "one two"), (51, None), (52, ""), (None, "x y z"), (53, " ".join(words(3, 15, 400)))]
    rng, rows = random.Random(1), []
    for i in range(60):
        w, leaked = words(1000 + i, 80, 400), (items[i % 12][1] or "").upper().split()
        for _ in range(i % 4):
            leaked[rng.randrange(len(leaked))] = "changed"
        rows.append((i, " ".join(w[:40] + leaked + w[40:])))
    rows += [(100, "say one TWO three"), (101, None), (102, ""), (103, items[5][1]), (104, " ".join(items[11][1].split()[:-2])), (105, items[4][1] + " " + items[4][1])]
    df = make(*rows, extra=CLASHING)
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    shingle = lambda w, n: Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    split = {k: t.lower().split() for k, t in items if k is not None and t}
    held = {k: shingle(w, min(5, len(w))) for k, w in split.items()}
    every = Counter((len(w) if len(w) < 5 else 5, g) for w, s in ((split[k], s) for k, s in held.items()) for g in s)
    expected = {}
    for key, text in rows:
        w = (text or "").lower().split()
        for k, own in held.items():
            n, size = min(len(split[k]), len(w)), min(5, len(split[k]))
            weight = {g: 1 + math.log(len(held) / every[size, g]) for g in own}
            found = [weighted_similarity(dict(shingle(w[a:a + n], size)), dict(own), weight, 1 + math.log(len(held)))
                     for a in range(len(w) - n + 1)] if n >= size else []
            if found and max(found) >= 0.8:
                expected[key, k] = max(found)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    chunked = {(r.doc_id, r.item_id) for r in leaks(df, spark.createDataFrame(items, "item_id long, text string"), chunk=60).collect()}
    assert chunked == got.keys()


def _items(rng, n, length=60, radius=11):
    rows = [{"item": k, "n_words": length, "size": 5, "grams": [{"gram": int(g), "n": int(rng.integers(1, 4)) if i < 3 else 1}
             for i, g in enumerate(rng.integers(-2 ** 62, 2 ** 62, length - 4))]} for k in range(n)]
    weight = {g["gram"] & (1 << 64) - 1: float(rng.uniform(1, 8)) for r in rows for g in r["grams"]}
    return Items(rows, weight, 8.0, 0.8, radius)


def test_hamming_blocks_find_all_within_the_radius_and_little_else():
    rng = np.random.default_rng(5)
    items = _items(rng, 400)
    prints = rng.integers(0, 1 << 16, (300, 4), dtype=np.uint16)
    for w in range(200):  # half of them lie around an item, at distances up to 20
        flips = np.packbits(rng.permutation(64) < w // 10).view(np.uint16)
        prints[w] = items.prints[0][w] ^ flips
    w, k = items.candidates(prints, 60, 0)
    distance = np.bitwise_count(prints[:, None] ^ items.prints[0][None]).sum(2)
    got = set(zip(w.tolist(), k.tolist()))
    assert set(zip(*(x.tolist() for x in np.nonzero(distance <= 11)))) <= got
    assert len(got) < 0.02 * distance.size  # four blocks of 137 in 65,536 values: 0.8 %
    assert items.candidates(prints, 61, 0)[0].size == 0


def test_fingerprints_recall_similar_windows():
    """Windows just above the similarity, found by their fingerprints alone."""
    rng = np.random.default_rng(6)
    items, found, near = _items(rng, 300), 0, 0
    for k, own in enumerate(items.counts):
        other = dict(own)
        while True:
            less = dict(other)
            less.pop(list(less)[int(rng.integers(len(less)))])
            less[int(rng.integers(1, 2 ** 62))] = 1
            if weighted_similarity(less, own, items.weight, items.other) < 0.8:
                break
            other = less
        near += 1
        grams, counts = np.array(list(other), np.uint64), np.array(list(other.values()))
        found += any(np.bitwise_count(items.print_of(grams, counts, p)[0] ^ items.prints[p][k]).sum() <= 11 for p in range(PRINTS))
    assert found >= 0.97 * near


def test_leaks_in_a_very_long_repeating_text(make, spark):
    item = " ".join(words(7, 40, 300))
    long = " ".join(words(8, 30_000, 300)) + " " + "over and " * 3_000 + item + " " + "over and " * 3_000
    twice = " ".join([item] + ["tail of it"] * 4)
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words)
           for r in leaks(make((1, long), (2, twice + " x " + twice), (3, "over and " * 50)),
                          spark.createDataFrame([(1, item), (2, twice), (3, "over and over and over and over")], "item_id long, text string")).collect()}
    assert got[1, 1] == (1.0, 36_000, 40) and got[1, 3][1:] == (30_000, 7)
    assert got[2, 2] == (1.0, 0, 52) and got[3, 3] == (1.0, 0, 7) and (3, 1) not in got


def test_leaks_of_empty_tables(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(make((1, "a b c")), none).collect() == []
    assert leaks(make(), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


# mixing

def test_rates_meet_targets_and_equal_numpy(make, spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        lang = "aabc"[i % 4]
        rows.append((i, " ".join(rng.choice([lang + str(k) for k in range(6)] + ["x", "y"]) for _ in range(rng.randrange(5, 40))), lang))
    docs = make(*rows, (900, None, "a"), (901, "", "b"), extra=CLASHING)
    labelled = docs.where("doc_id % 3 = 0 AND doc_id < 300").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    targets = {"a": 0.2, "b": 0.5, "c": 0.3, "absent": 0.0}
    got = {r.doc_id: r for r in mixing_rates(docs, labelled, targets).collect()}
    p = np.array([[got[i].p_a, got[i].p_b, got[i].p_c] for i in range(300)])
    n, rate = np.array([got[i].tokens for i in range(300)]), np.array([got[i].rate for i in range(300)])
    assert np.array(["abc"[k] for k in p.argmax(1)] == np.array([r[2] for r in rows])).mean() > 0.98
    goal = n.sum() * np.array([0.2, 0.5, 0.3])
    assert np.allclose((rate * n) @ p, goal, atol=2e-4 * n.sum()) and (rate >= 0).all()
    plain, inverse = np.ones(300), np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(60):
        plain = np.maximum(0, plain + p @ (inverse @ (goal - (plain * n) @ p)))
    assert np.allclose(rate, plain, atol=5e-3)
    assert got[900].tokens == 0 and got[901].tokens == 0


def test_targets_that_cannot_be_met_are_told(make, spark):
    """Two domains with the same words cannot be told apart, so one cannot get all."""
    docs = make(*[(i, "same words in all of them", "ab"[i % 2]) for i in range(60)])
    marks = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    with pytest.warns(mixing.Unreached):
        rates = [r.rate for r in mixing_rates(docs, marks, {"a": 1.0, "b": 0.0}).collect()]
    assert all(np.isfinite(rates)) and min(rates) >= 0


def test_many_rates_at_zero(make, spark):
    docs = make(*[(i, " ".join([("a", "b", "c")[i % 3]] * 20), "abc"[i % 3]) for i in range(90)])
    marks = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    got = mixing_rates(docs, marks, {"a": 1.0, "b": 0.0, "c": 0.0}).collect()
    assert sum(r.rate * 20 * r.p_a for r in got) == pytest.approx(1800, rel=1e-3)


def test_mixed_rows_follow_their_rates(make, spark):
    docs = make(*[(i, " ".join(f"{'ab'[i % 2]}{(i + k) % 7}" for k in range(20)), "ab"[i % 2]) for i in range(200)], (3, "another text of one id"), (None, None),
                extra=["1 AS _times", "2 AS row", "3 AS times", "4 AS p", "5 AS rate"])
    marks = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    targets = {"a": 0.8, "b": 0.2}
    rates = mixing_rates(docs, marks, targets)
    wanted = Counter()
    for r in rates.select("doc_id", "tokens", mixing.copies(F.col("doc_id"), F.col("rate")).alias("times")).collect():
        wanted[r.doc_id, r.tokens] += r.times
    taken = mixing.mixed(docs, marks, targets)
    assert taken.columns == docs.columns
    assert Counter((r.doc_id, len((r.text or "").split())) for r in taken.collect()) == +wanted


def test_ids_must_be_integers(make):
    docs = make((1, "a b c")).withColumn("doc_id", F.lit("x"))
    for run in (lambda: score_texts(docs, held_out=F.lit(False)), lambda: jaccard_components(docs), lambda: token_files.token_digests(docs)):
        with pytest.raises(TypeError, match="integer"):
            run()


def test_mixing_without_labels_or_rows(make, spark):
    none = spark.createDataFrame([], "id long, domain string")
    assert [r.rate for r in mixing_rates(make((1, "a"), (2, None)), none, {"a": 1.0}).collect()] == [1.0, 1.0]
    assert mixing_rates(make(), none, {"a": 1.0}).collect() == []


# toxicity

def test_toxic_words_and_stems_are_found_on_held_out_rows(make, spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        w, toxic = words(i, 30, 500), i % 3 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(["Vileword!", "badstem" + format(rng.randrange(999), "x")])
        rows.append((i, " ".join(w), "en" if i % 2 else "fr"))
        labels.append((i, int(toxic)))
    docs = make(*rows, (900, None), (901, ""), (902, "vileword " * 50_000), extra=CLASHING)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "id long, label int"), held_out=F.col("doc_id") % 5 == 0).collect()}
    held = [i for i in range(0, 600, 5)]
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[902].predicted == 1
    assert got[900].score == got[901].score and got[0].held_out and not got[1].held_out


@pytest.mark.parametrize("huge", [range(1), range(40)])
def test_huge_labelled_texts_leave_the_others_in_the_sample(make, spark, huge):
    rng, rows, labels = random.Random(5), [], []
    for i in range(400):
        w, toxic = words(i, 20, 200), i % 2 == 0
        if toxic:
            w[rng.randrange(20)] = "vileword"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    long = [(1000 + i, "calm and plain " * 5_000) for i in huge]
    labels += [(i, 0) for i, _ in long]
    got = {r.doc_id: r for r in toxicity.score_toxicity(make(*rows, *long), spark.createDataFrame(labels, "id long, label int"),
                                                         held_out=(F.col("doc_id") % 5 == 0) & (F.col("doc_id") < 1000), slots=12_000).collect()}
    held = range(0, 400, 5)
    assert sum(got[i].predicted == (i % 2 == 0) for i in held) / len(held) > 0.95


def test_only_the_longest_texts_are_cut():
    assert toxicity.longest([(10, 5), (600, 1)], 10_000) == 600
    assert toxicity.longest([(10, 5), (6000, 1)], 418) == 6 * (418 - 18) - 50
    assert toxicity.longest([(100, 3), (200, 1)], 12 + 50) == 75
    assert toxicity.longest([], 100) == 0


def test_toxicity_without_labels_or_rows(make, spark):
    none = spark.createDataFrame([], "id long, label int")
    a, b = toxicity.score_toxicity(make((1, "x"), (2, None)), none).collect()
    assert a.score == b.score < 0.3 and (a.threshold, a.predicted) == (0.3, 0)
    assert toxicity.score_toxicity(make(), none).collect() == []


def test_network_equals_plain_loops():
    """Every window that starts at a word (or at the one empty slot of a text without words), filter by filter."""
    rng, net = np.random.default_rng(3), toxicity.Network(5)
    net.bias[:], net.offset = rng.normal(size=len(net.bias)) * 0.1, 0.2
    (first, ids, offsets), = toxicity.features(pa.array(["One two, THREE four five", "", None, "a", "é ü " * 40, "!!"]))
    got, tail, at = net.scores(ids, offsets), max(toxicity.WIDTHS) - 1, 0
    assert first == 0 and [b - a - tail for a, b in zip(offsets, offsets[1:])] == [5, 1, 1, 1, 80, 1]
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        x = [sum(net.embedding[j].astype(float) for j in slot) for slot in ids[a:b]]
        z = net.offset
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                top = max(sum(float(x[t + j] @ net.filters[k][j][:, f]) for j in range(w)) for t in range(len(x) - tail))
                z += max(top + net.bias[k * toxicity.FILTERS + f], 0) * net.head[k * toxicity.FILTERS + f]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_thresholds_equal_plain_search(spark):
    rng = random.Random(9)
    rows = [(lang, round(rng.random(), 3), int(rng.random() < 0.4)) for lang in "ab" for _ in range(200)] + [("c", 0.5, 1)]
    got = {r.language: r.threshold for r in toxicity.thresholds(spark.createDataFrame(rows, "language string, score double, label int"), 0.3).collect()}
    def f1(lang, cut):
        taken = [y for l, s, y in rows if l == lang and math.floor(s * 100) >= cut]
        return 2 * sum(taken) / (len(taken) + sum(y for l, _, y in rows if l == lang))
    assert got.keys() == {"a", "b"}
    for lang, threshold in got.items():
        assert f1(lang, round(threshold * 100)) == pytest.approx(max(f1(lang, cut) for cut in range(100)))


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, (int(rng.integers(3, 9)), len(toxicity.STEMS))).astype(np.int32) for _ in range(40)]
    labels = np.array([float((t == 7).any()) for t in texts], np.float32)
    net = toxicity.train(texts, labels, float(labels.mean()), epochs=60, batch=8)
    scores = [net.scores(t, np.array([0, len(t)]))[0] for t in texts]
    assert np.mean((np.array(scores) >= 0.5) == (labels == 1)) > 0.95

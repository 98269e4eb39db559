"""Edge cases of names, text, numbers, dates and labels."""
import datetime as dt
import hashlib
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrubwell.functions import names, parse, text
from scrubwell.operators import labels, quantiles, retail
from scrubwell.operators.infer import Evidence, decide_kind, generic_number, infer_kinds, numeric_acceptance
from pyspark.sql import types as T


def apply(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_standard_names():
    assert [names.standard_name(n) for n in (" Customer  ID ", "a/b%c", "__x__", "--", "naïve col")] == [
        "Customer_ID", "a_b_c", "x", "Unnamed_Column", "naïve_col"]
    assert names.unique_names(["a", "a", "a_1", "A"]) == ["a", "a_2", "a_1", "A_3"]
    assert names.unique_names(["x", "x", "x"]) == ["x", "x_1", "x_2"]


def test_name_roles():
    role = names.name_role
    assert [role(n) for n in ("Work E-mail", "mobile", "Order No", "Tax_Rate", "Total Amount", "status", "width")] == [
        "email", "phone", "id", "percentage", "currency", None, None]
    assert names.score_contact("mailing_address") == "email"


def test_identifier_columns_by_word_and_by_substring(spark):
    df = spark.createDataFrame([(1, 2, 3)], "width long, zip long, size long")
    assert names.identifier_columns(df) == ["zip"]
    assert names.identifier_columns(df, substring=True) == ["width", "zip"]
    assert names.measure_columns(df) == ["width", "size"]


def test_whitespace_and_tokens(spark):
    assert apply(spark, text.collapse, [" a\t\nb ", "x  y", "　", None]) == ["a b", "x y", "", None]
    assert apply(spark, text.missing_tokens, [" N/A ", "—", "unknown", " x ", "", "not  available", None]) == [
        None, None, "unknown", "x", None, "not  available", None]


def test_title_case_matches_python(spark):
    values = ["o'brien", "usb-hub", "x2y", "ÉCOLE du nord", "mc donald's", "a", "3rd party", ""]
    assert apply(spark, text.title_case, values) == [v.title() for v in values]


def test_phone(spark):
    assert apply(spark, text.phone, ["+91 98765 43210", "9876543210.0", "0091-9876543210", "+910091987", "abc", "(020) 123"]) == [
        "9876543210", "9876543210", "9876543210", "987", None, "020123"]
    assert apply(spark, text.phone_ten, ["919876543210", "9876543210", "123", None]) == ["9876543210", "9876543210", None, None]


def test_email_has_no_trailing_newline(spark):
    assert apply(spark, text.is_valid_email, ["a@b.c", "a@b.c\n", "a@b", "a b@c.d", "@b.c"]) == [True, False, False, False, False]


def test_number(spark):
    values = ["1,200", "₹ 5", "$-3.5", "12%", "five", "1e3", ".5", "5.", "inf", "1_000", "0x10", "nan", "1d", "abc", "-", "1.2.3", None]
    assert apply(spark, parse.number, values) == [
        1200.0, 5.0, -3.5, 12.0, 5.0, 1000.0, 0.5, 5.0, float("inf"), None, None, None, None, None, None, None, None]


@pytest.mark.parametrize("cell,expected", [
    ("2024-01-15", dt.datetime(2024, 1, 15)), ("2024/1/5", dt.datetime(2024, 1, 5)), ("2024.01.05", dt.datetime(2024, 1, 5)),
    ("01/15/2023", dt.datetime(2023, 1, 15)), ("13/02/2023", dt.datetime(2023, 2, 13)), ("1/2/80", dt.datetime(1980, 1, 2)),
    ("1/2/23 4:05", dt.datetime(2023, 1, 2, 4, 5)), ("02/30/2023", None), ("5 January 2022", dt.datetime(2022, 1, 5)),
    ("Jan 5, 2022", dt.datetime(2022, 1, 5)), ("5-Jan-2022", dt.datetime(2022, 1, 5)), ("March 2021", dt.datetime(2021, 3, 1)),
    ("20240115", dt.datetime(2024, 1, 15)), ("2024", dt.datetime(2024, 1, 1)), ("10:30", None), ("now", None),
    ("2024-01-15T10:30:00+05:30", dt.datetime(2024, 1, 15, 5)), ("2024-01-15 02:30 PM", dt.datetime(2024, 1, 15, 14, 30)),
    ("2021-02-29", None), ("1234.56", None), ("may the 4th", None)])
def test_date(spark, cell, expected):
    assert apply(spark, parse.date, [cell]) == [expected]


def test_kinds(spark):
    df = spark.createDataFrame(
        [(str(i), f"{i}%", f"${i}", "2024-01-0%d" % (i + 1), ("yes", "no")[i % 2], f"w{i}", "1 Feb 2024") for i in range(5)],
        "a string, b string, c string, d string, e string, f string, g string")
    assert infer_kinds(df) == {"a": "numeric", "b": "percentage", "c": "currency", "d": "date", "e": "boolean",
                               "f": "text", "g": "date"}
    assert decide_kind("x", T.ArrayType(T.FloatType())) == "other"
    assert decide_kind("joined", T.StringType(), Evidence(filled=2, non_blank=2, dates=2)) == "text"


def dictionary(spark, column, counts):
    rows = [(v,) for v, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, f"`{column}` string")
    return {r["value"]: r["canonical"] for r in labels.label_dictionary(df).collect()}


def test_label_rules(spark):
    assert dictionary(spark, "status", {"Active": 5, "active": 2, "ACTIVE": 1}) == dict.fromkeys(
        ("Active", "active", "ACTIVE"), "Active")
    assert dictionary(spark, "skill", {"C": 3, "C++": 2, "C#": 2, "c": 1, "A+": 1, "A-": 1}) == {
        "C": "C", "c": "C", "C++": "C++", "C#": "C#", "A+": "A+", "A-": "A-"}
    assert dictionary(spark, "place", {"東京": 3, "大阪": 2}) == {"東京": "東京", "大阪": "大阪"}
    assert dictionary(spark, "is_active", {"Yes": 3, "YES": 1, "n": 2})["n"] == "False"


def test_spelling_repair_follows_the_frequent_label(spark):
    got = dictionary(spark, "division", {"engineering": 8, "enginering": 3, "enginerin": 1, "sales": 4})
    assert got == {"engineering": "Engineering", "enginering": "Engineering", "enginerin": "Engineering", "sales": "Sales"}


def all_pairs_verdicts(rows):
    """Spelling verdicts by comparing a label with every more frequent one; rows are (value, key, cnt, resolved)."""
    settled, verdicts, seen = {}, {}, []
    for value, key, cnt, resolved in sorted(rows, key=lambda r: (-r[2], r[0])):
        best, best_ratio = None, 0.0
        for other, other_key, other_cnt in seen if len(key) >= 4 else ():
            if other_cnt >= max(2, 2 * cnt) and other_key[:1] == key[0]:
                ratio = SequenceMatcher(None, key, other_key).ratio()
                if ratio > best_ratio:
                    best, best_ratio = other, ratio
        verdicts[value] = settled[best] if best is not None and best_ratio >= 0.84 else None
        settled[value] = resolved if verdicts[value] is None else verdicts[value]
        seen.append((value, key, cnt))
    return verdicts


def misspelled_labels(n, seed, letters="aeinrst", first="pq"):
    """n labels of which about half are others with a letter lost, doubled or changed."""
    rng = random.Random(seed)
    word = lambda: rng.choice(first) + "".join(rng.choices(letters, k=rng.randint(2, 12)))
    found = {word(): rng.randint(5, 40) for _ in range(n // 2)}
    roots = list(found)
    while len(found) < n:
        root, i = rng.choice(roots), 0
        i = rng.randrange(1, len(root))
        found.setdefault(rng.choice([root[:i] + root[i + 1:], root[:i] + root[i - 1:], root[:i] + rng.choice(letters) + root[i + 1:]]), rng.randint(1, 9))
    return found


@pytest.mark.parametrize("seed, letters", [(1, "aeinrst"), (2, "ab"), (3, "aeiou\u00e9\u4eac")])
def test_spelling_verdicts_are_those_of_all_pairs(spark, seed, letters):
    found = misspelled_labels(300, seed, letters)
    rows = [(label,) for label, n in found.items() for _ in range(n)]
    wide = labels.LabelLimits(plain=5_000, hinted=5_000, spelling=5_000)
    got = labels.label_dictionary(spark.createDataFrame(rows, "division string"), limits=wide).select(
        "value", "format_key", "cnt", "resolved", "k9").collect()
    assert len(got) == len(found)
    expected = all_pairs_verdicts([tuple(r)[:4] for r in got])
    assert {r.value: r.k9 for r in got} == expected
    assert sum(v is not None for v in expected.values()) > 20


def test_spelling_of_five_thousand_labels(spark):
    """All under one first letter; every planted misspelling goes to its model, and no other label changes."""
    roots = [f"p{hashlib.md5(str(i).encode()).hexdigest()[:16]}" for i in range(4_000)]  # far from each other
    table = pa.table({"division": [w for w in roots for _ in range(2)] + [w[:8] + w[9:] for w in roots[:1_000]]})
    wide = labels.LabelLimits(plain=5_000, hinted=5_000, spelling=5_000)
    got = labels.label_dictionary(spark.createDataFrame(table), limits=wide).where("k9 IS NOT NULL").select("value", "k9").collect()
    assert {r.value: r.k9 for r in got} == {w[:8] + w[9:]: w for w in roots[:1_000]}
    narrow = labels.LabelLimits(plain=5_000, hinted=5_000, spelling=4_999)
    assert labels.label_dictionary(spark.createDataFrame(table), limits=narrow).where("k9 IS NOT NULL").count() == 0


def test_free_text_is_left_alone(spark):
    df = spark.createDataFrame([(f"note {i}",) for i in range(1500)], "remark string")
    assert labels.label_dictionary(df).count() == 0


def test_many_changed_labels_use_the_join(spark):
    rows = [(f"Label {i}",) for i in range(60) for _ in range(2)] + [(f"label-{i}",) for i in range(60)]
    df = spark.createDataFrame(rows, "part_type string")
    got = {r[0]: r[1] for r in labels.normalize_labels(df).groupBy("part_type").count().collect()}
    assert got == {f"Label {i}": 3 for i in range(60)}


def test_semantic_aliases_keep_other_cells(spark):
    df = spark.createDataFrame([("bachelor's degree",), ("PHD ",), ("none of these",), (None,)], "education string")
    assert [r[0] for r in labels.apply_semantic_aliases(df).collect()] == ["Bachelor's", "PhD", "none of these", None]


def test_retail_discount(spark):
    assert apply(spark, retail.discount, ["10%", "15", "0.2", "five%", "none", None]) == [0.1, 0.15, 0.2, 0.05, None, None]


@pytest.mark.parametrize("shape", ["spread", "hot", "two", "ties"])
def test_exact_quantiles_by_brackets(spark, shape, monkeypatch):
    monkeypatch.setattr(quantiles, "INSIDE_LIMIT", 20)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 50)
    rng = np.random.default_rng(7)
    values = {"spread": rng.normal(size=5001), "hot": np.where(rng.random(6000) < 0.34, 3.0, rng.random(6000) * 10),
              "two": np.where(rng.random(4000) < 0.5, 0.0, 1.0), "ties": rng.integers(0, 40, 5000).astype(float)}[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    got = quantiles.exact_quantiles(df, ["v"], [0.25, 0.5, 0.75])["v"]["values"]
    assert np.allclose(got, np.quantile(values, [0.25, 0.5, 0.75]), rtol=0, atol=1e-12)


def test_quantiles_of_many_columns(spark):
    df = spark.range(200).select(*[((F.col("id") * (7 + i)) % 101 + i).cast("double").alias(f"c{i}") for i in range(300)])
    got = quantiles.exact_quantiles(df, df.columns, [0.25, 0.5])
    for i in (0, 150, 299):
        values = sorted((k * (7 + i)) % 101 + i for k in range(200))
        at = lambda p: values[int(p * 199)] + (p * 199 - int(p * 199)) * (values[int(p * 199) + 1] - values[int(p * 199)])
        assert got[f"c{i}"] == {"count": 200, "values": [at(0.25), at(0.5)]}


def test_number_readers_on_odd_cells(spark):
    cells = ["5", "-5", "+5", "5.", ".5", "007", "1e3", "12.50", " 12 ", "1,200", "₹ 9", "ten", " TEN ", "x7y8", "-", "", "٣", "inf", "i,nf",
             "-Infinity", "€f", "5%", "5 %", "0.5", "200", "5\n", "1.2.3", "nan", "1d", None]
    anywhere = [5.0, -5.0, 5.0, 5.0, 5.0, 7.0, 1.0, 12.5, 12.0, 1200.0, 9.0, 10.0, 10.0, 7.0, None, None, None, None, None,
                None, None, 5.0, 5.0, 0.5, 200.0, 5.0, 1.2, None, 1.0, None]
    generic = [5.0, -5.0, 5.0, 5.0, 0.5, 7.0, 1000.0, 12.5, 12.0, 1200.0, 9.0, None, None, None, None, None, None, float("inf"), float("inf"),
               float("-inf"), None, None, None, 0.5, 200.0, 5.0, None, None, None, None]
    assert apply(spark, retail.number_anywhere, cells) == anywhere
    assert apply(spark, generic_number, cells) == generic
    assert apply(spark, retail.discount, ["5 %", "% 5", "0.5", "5", " 1 ", "1", "-3%", "ten", "te n", "", None]) == [
        0.05, 0.05, 0.5, 0.05, 1.0, 1.0, -0.03, 0.1, 0.1, None, None]


def test_one_pattern_on_the_raw_cell_settles_most_numbers(spark):
    cells = spark.createDataFrame([("0", "x0"), ("1.5", "x1"), ("2", "x2")], "Quantity string, City string")
    found = numeric_acceptance(cells)
    assert {tuple(r) for r in found.collect()} == {("Quantity", 3, 3, True), ("City", 3, 0, False)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(re.search(rf"CASE WHEN RLIKE\({c}#[0-9]+, ", plan) for c in ("Quantity", "City")), plan


def test_cells_are_cleaned_once_a_value(spark):
    cells = spark.createDataFrame([(" a  b",), ("a b",), ("a b",), (None,), ("n/a",)], "label string")
    counts = labels.value_counts(cells)
    assert {tuple(r) for r in counts.collect()} == {("label", "a b", 3), ("label", "n/a", 1)}
    free = labels.value_counts(cells, ["label"], lambda c: text.collapse_inner(text.missing_tokens(c)))
    assert {tuple(r) for r in free.collect()} == {("label", "a b", 3)}
    for table in (counts, free):
        plan = table._jdf.queryExecution().optimizedPlan().toString().split("\n")
        first = max(i for i, line in enumerate(plan) if "Aggregate [" in line)
        assert "RLIKE" in "".join(plan[:first]) and "RLIKE" not in "".join(plan[first:])


def test_collapse_equals_plain_python(spark):
    rng = random.Random(5)
    cells = ["".join(rng.choice(["a", "B9", " ", " ", "\t", "\u3000", "é", "~", "!", "\x1c", "\x7f", "\n"]) for _ in range(rng.randrange(9))) for _ in range(800)]
    cells += ["ab " * 400_000, "ab " * 400_000 + "é", "x"]
    plain = [" ".join(c.split()) for c in cells]
    assert apply(spark, text.collapse, cells) == plain
    assert apply(spark, lambda c: text.collapse_inner(text.trim(c)), cells) == plain

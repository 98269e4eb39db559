"""Goldens of the whole cleaning run."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrubwell import clean, fit, report
from scrubwell.operators import findings, missing, profile


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def customers(spark):
    return table(spark, [
        ("001", " alice ", "alice@example.com", 25, "₹1,200"), ("002", "BOB", "bad-email", 150, "2500"),
        ("002", "BOB", "bob@example.com", 30, "3,000"), ("003", "Carol", "carol@example.com", 40, None),
        (None, "Dave", None, 35, "4,500")],
        "` Customer ID ` string, Name string, Email string, Age long, Amount string")


def test_messy_table(customers):
    result = clean(customers)
    rows = {r["Name"] + str(r["Age"]): r for r in result.data.collect()}
    assert result.log["Cleaned rows"] == len(rows) == 5
    assert dict(result.data.dtypes)["Customer_ID"] == "string"
    assert result.log["Domain-specific rules applied"] == "None — universal mode"
    assert 0 < result.log["Final quality score"] <= 100
    assert rows["Alice25.0"]["Amount"] == 1200.0 and rows["Alice25.0"]["Customer_ID"] == "001"
    assert rows["BobNone"]["Age"] is None and rows["BobNone"]["Email"] is None
    assert result.log["Invalid Age values set to missing"] == 1
    assert [r["action"] for r in result.audit().orderBy("seq").collect()] == list(result.log)


def test_contacts_are_not_invented(spark):
    result = clean(table(spark, [("valid@example.com", "+91 98765 43210"), ("not-an-email", "123"), (None, None)],
                         "email string, phone string"), analyze_outliers=False)
    assert {(r["email"], r["phone"]) for r in result.data.collect()} == {("valid@example.com", "9876543210"), (None, None)}
    assert result.log["Invalid emails converted to missing"] == 1
    assert result.log["Invalid phones converted to missing"] == 1
    assert result.log["Blank rows removed"] == 1


def test_percentages(spark):
    result = clean(table(spark, [("10%",), ("25%",), ("50%",)], "conversion_rate string"), analyze_outliers=False)
    assert sorted(r[0] for r in result.data.collect()) == [0.10, 0.25, 0.50]
    whole = clean(table(spark, [(10.0,), (25.0,), (100.0,)], "tax_rate double"), analyze_outliers=False)
    assert sorted(r[0] for r in whole.data.collect()) == [0.10, 0.25, 1.0]
    fraction = clean(table(spark, [(0.1,), (0.5,), (1.0,)], "tax_rate double"), analyze_outliers=False)
    assert sorted(r[0] for r in fraction.data.collect()) == [0.1, 0.5, 1.0]


def test_report_finds_core_issues(spark):
    found = report(table(spark, [("ok@example.com", 25, "Active"), ("bad", 150, "active"), (None, 30, "ACTIVE"),
                                 ("x@y.com", 31, "Active")], "Email string, Age long, Status string"))
    rows = found.findings.collect()
    assert {"Missing Values", "Invalid Contact Data", "Semantic Range"} <= {r["category"] for r in rows}
    assert found.summary.first()["issue_count"] == len(rows) >= 3
    assert all(r["why_it_matters"] and r["recommended_action"] and r["workflow"] and r["guardrail"] for r in rows)
    assert len(found.recommendations) == 4


def test_report_of_a_sound_table(spark):
    found = report(table(spark, [(1, "a"), (2, "b")], "n long, t string"))
    assert found.findings.count() == 0 and len(found.recommendations) == 1


def test_report_measures_once_and_equals_its_parts(spark, monkeypatch):
    rows = [(i % 50, float(i % 7) if i % 9 else None, f"user{i % 40}@example.com" if i % 5 else "bad") for i in range(120)]
    for given in (rows, [], [(None, float("nan"), None)] * 3):
        df = table(spark, given, "id long, price double, email string")
        calls = Counter()
        for name in ("column_stats", "_row_groups"):
            counted = getattr(profile, name)
            monkeypatch.setattr(profile, name, lambda *a, name=name, counted=counted, **k: calls.update([name]) or counted(*a, **k))
        monkeypatch.setattr(findings, "column_stats", profile.column_stats)
        found = report(df)
        monkeypatch.undo()
        assert calls == {"column_stats": 1, "_row_groups": 1}
        plain = lambda some: sorted(map(str, some.collect()))
        assert plain(found.snapshot) == plain(profile.profile_snapshot(df))
        assert plain(found.summary.select("rows", "columns", "missing_cells", "duplicate_rows")) == plain(
            profile.quality(df).select("rows", "columns", "missing_cells", "duplicate_rows"))
        alone = Counter((r["column"], r["n"], r["finding"]) for r in findings.findings(df).collect())
        assert Counter((r["column"], r["n"], r["finding"]) for r in found.findings.collect()) == alone


def test_summary_is_before_after(spark):
    before = profile.quality(table(spark, [(1.0,), (None,), (1.0,)], "a double"))
    after = profile.quality(table(spark, [(1.0,), (1.0,)], "a double"))
    row = profile.quality_summary(before, after).first()
    assert (row["rows_before"], row["rows_after"], row["missing_cells_before"]) == (3, 2, 1)
    assert row["quality_score_after"] == 87.5


def test_outlier_finding_and_bounds(spark):
    df = table(spark, [(v,) for v in (10, 11, 12, 13, 14, 15, 16, 1000)], "Unit_Price long")
    row = report(df).findings.where("category = 'Outliers'").first()
    assert "Outliers" in row["workflow"] and "delete or cap outliers automatically" in row["guardrail"]
    assert clean(df).outliers == {"Unit_Price": {"count": 1, "lower": 6.5, "upper": 20.5}}


def test_strategies(spark):
    rows = [("1", "a", "yes"), ("3", "a", "no"), ("5", "b", "yes"), (None, None, None), ("9", None, "yes")]
    df = table(spark, [(str(i), *r) for i, r in enumerate(rows)], "row_id string, size string, tag string, is_on string")
    by_id = lambda result: {r["row_id"]: tuple(r)[1:] for r in result.data.collect()}
    leave = clean(df, "leave")
    assert by_id(leave)["3"] == (None, None, None) and leave.plan.kinds["is_on"] == "boolean"
    filled = clean(df, "Fill numeric with median; safe text with mode")
    assert by_id(filled)["3"] == (4.0, "a", True) and filled.log["Missing cells imputed"] == 4
    zero = clean(df, "constant")
    assert by_id(zero)["3"] == (0.0, "Unknown", None)
    dropped = clean(df, "drop_rows")
    assert set(by_id(dropped)) == {"0", "1", "2"} and dropped.log["Rows dropped for missing values"] == 2
    with pytest.raises(ValueError):
        clean(df, "guess")


def test_protected_kinds_are_never_filled(spark):
    df = table(spark, [("1", "a@b.c", "2024-01-01"), ("2", None, None), ("3", "d@e.f", "2024-01-03"), (None, "g@h.i", "2024-01-04")],
               "user_id string, email string, joined string")
    for strategy in ("median_mode", "constant"):
        result = clean(df, strategy)
        assert result.log["Missing cells after strategy"] == 3
        assert result.plan.kinds == {"user_id": "id", "email": "email", "joined": "date"}


def test_tokens_that_empty_a_row_or_column(spark):
    df = table(spark, [("a", "N/A"), (" -- ", "null"), ("b", "None")], "x string, y string")
    result = clean(df, analyze_outliers=False)
    assert result.data.columns == ["x"] and result.log["Blank columns removed"] == 1
    assert result.log["Rows blank after token normalization"] == 1 and result.log["Cleaned rows"] == 2


def test_signs_and_dates_survive_label_rules(spark):
    df = table(spark, [("-5", "1.5", "12/1/2024"), ("5", "15", "1/21/2024"), ("5", "15", "1/21/2024"), ("7", "2", "3/4/2024")],
               "delta string, size string, seen string")
    got = {(r["delta"], r["size"], str(r["seen"])[:10]) for r in clean(df, analyze_outliers=False).data.collect()}
    assert got == {(-5.0, 1.5, "2024-12-01"), (5.0, 15.0, "2024-01-21"), (7.0, 2.0, "2024-03-04")}


def test_cleaning_is_idempotent(customers):
    once = clean(customers).data
    again = clean(once).data
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_empty_table(spark):
    result = clean(table(spark, [], "user_id string, size long"))
    assert result.data.count() == 0 and result.log["Final quality score"] == 0.0


def test_complex_columns_pass_through(spark):
    df = table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "size long, vector array<float>")
    result = clean(df)
    assert result.log["Duplicate rows removed"] == 1 and result.plan.kinds["vector"] == "other"
    assert result.log["Final missing cells"] == 1


def test_nan_is_missing(spark):
    df = table(spark, [(float("nan"),), (1.0,), (2.0,)], "v double")
    assert profile.missing_by_column(df).first()["missing"] == 1
    assert missing.drop_missing_rows(df).count() == 2


def test_plan_applies_to_a_stream(spark, customers, tmp_path):
    from scrubwell.streaming.rows import clean_stream
    plan, _ = fit(customers)
    customers.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(customers.schema).parquet(str(tmp_path / "in"))
    query = (clean_stream(stream, plan).writeStream.format("memory").queryName("cleaned_rows")
             .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("cleaned_rows")
    assert got.count() == 5 and got.where(F.col("Email").isNull()).count() == 2


def test_dedupe_counts_with_a_hot_row(spark):
    hot = spark.range(30000).select(F.lit("same").alias("a"), F.lit(1).alias("b"))
    rest = spark.range(60000).select(F.col("id").cast("string").alias("a"), F.lit(1).alias("b"))
    df = hot.unionByName(rest)
    assert profile.duplicate_count(df).first()["duplicate_rows"] == 29999
    assert missing.dedupe(df).count() == 60001


def test_awkward_column_names(spark):
    df = table(spark, [("1.5", " A ", "x", 1.0), ("2.5", "b", None, 2.0), ("3", "c", "x", 3.0)],
               "`a.b` string, `Name` string, `name` string, `c``d e` double")
    result = clean(df)
    assert result.data.columns == ["a_b", "Name", "name_1", "c_d_e"]
    assert result.log["Final missing cells"] == 1 and result.plan.kinds["a_b"] == "numeric"
    plain = df.select("`a.b`", "`c``d e`")
    assert {r["column"]: r["distinct"] for r in profile.profile(plain).collect()} == {"a.b": 3, "c`d e": 3}
    assert profile.quality(plain).first()["rows"] == 3
    assert report(plain).findings.count() == 0


def test_alias_groups_count_mixed_spellings(spark):
    rows = [("New York",)] * 5 + [("new-york",)] * 5 + [("Paris",)] * 4 + [("東京",), ("大阪",)]
    found = report(table(spark, rows, "place string")).findings.where("category = 'Category Consistency'").collect()
    assert [r["n"] for r in found] == [1]


def exchanges(df):
    """The text of every exchange of the executed plan, with what it carries."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [block for block in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", block.strip())]


def test_distinct_rows_are_not_shuffled(spark):
    rows = [(i, f"text {i}", None if i % 3 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, note string, x double")
    assert exchanges(missing.dedupe(df)) == [] and missing.dedupe(df).count() == 300
    odd = df.union(spark.createDataFrame([(5, "text 5", None), (6, "text 6", 6.0), (7, None, None), (7, None, None), (None, "7", None), (None, None, float("nan")), (None, None, None),
                                          (8, "zero", 0.0), (8, "zero", -0.0)], df.schema))
    got = missing.dedupe(odd)
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.selectExpr("id", "note", "nanvl(x, null) AS x").distinct().collect()))
    copies = {(r.id, r.note): r.copies for r in missing.duplicate_groups(odd).collect()}
    assert copies == {(5, "text 5"): 2, (6, "text 6"): 2, (7, None): 2, (None, None): 2, (8, "zero"): 2}


def test_many_repeats_take_the_other_way(spark, monkeypatch):
    df = spark.createDataFrame([(i % 20, "x" * (i % 20)) for i in range(100)], "id long, note string")
    expected = sorted(map(tuple, missing.dedupe(df).collect()))
    monkeypatch.setattr(missing, "MOST_DIGESTS", 3)
    assert sorted(map(tuple, missing.dedupe(df).collect())) == expected == sorted((i, "x" * i) for i in range(20))
    assert {r.copies for r in missing.duplicate_groups(df).collect()} == {5}


def test_digests_that_collide_do_not_merge_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "id long, note string")
    monkeypatch.setattr(missing, "_digested", lambda rows: rows.withColumns({c: F.lit(0) for c in missing._DIGEST}))
    assert sorted(map(str, map(tuple, missing.dedupe(df).collect()))) == sorted(map(str, [(1, "a"), (2, "b"), (3, None)]))
    assert [(r.id, r.copies) for r in missing.duplicate_groups(df).collect()] == [(2, 2)]


@pytest.mark.parametrize("counters", [1, 7, 1 << 14])
def test_modes_equal_plain_counts(spark, monkeypatch, counters):
    monkeypatch.setattr(missing, "COUNTERS", counters)
    rng = random.Random(counters)
    rows = [(rng.choice(["a", "b", "b", None]), f"free {i}", rng.choice("xy"), None, i % 2 == 0, rng.choice("pqrs") * 100) for i in range(120)]
    names = ["label", "free", "pair", "empty", "flag", "long"]
    df = spark.createDataFrame(rows, "label string, free string, pair string, empty string, flag boolean, long string")
    expected = {}
    for i, name in enumerate(names):
        counts = Counter(str(r[i]).lower() if isinstance(r[i], bool) else r[i] for r in rows if r[i] is not None)
        if counts:
            tied = [v for v, n in counts.items() if n == max(counts.values())]
            expected[name] = (min(tied), len(tied))
    assert {r["column"]: (r["mode"], r["ties"]) for r in missing.modes(df, names).collect()} == expected
    some = {r["column"]: (r["mode"], r["ties"]) for r in missing.modes(df, names, settle=["flag"]).collect()}
    assert some == {c: (v if n == 1 or c == "flag" else None, n) for c, (v, n) in expected.items()}


def test_no_losing_text_is_moved(spark):
    """Only counters, digests and the smallest winner of a task are exchanged."""
    df = spark.createDataFrame([("common",)] * 40 + [(f"rare {i}",) for i in range(200)], "note string")
    found = missing.modes(df, ["note"], settle=[])
    carried = [line for block in exchanges(found) for line in block.splitlines() if line.startswith("Input")]
    assert carried and not any(re.search(r"\bvalue#", line) for line in carried)
    assert [tuple(r) for r in found.collect()] == [("note", "common", 1)]

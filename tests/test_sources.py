"""Readers, writers and the run history."""
import pytest
from pyspark.sql import functions as F

from scrubwell import clean
from scrubwell.checks import fixtures
from scrubwell.sources import history, sinks, tables


def test_csv_keeps_text(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('zip,note,n\n00123,"say ""hi"", ok",1\n045,,2\n"7","two\nlines",\n', encoding="utf-8")
    rows = {r["zip"]: (r["note"], r["n"]) for r in tables.read_csv(spark, str(path), multi_line=True).collect()}
    assert rows == {"00123": ('say "hi", ok', "1"), "045": ("", "2"), "7": ("two\nlines", "")}


def test_short_rows_and_typed_formats(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a,b\n1\n2,3\n", encoding="utf-8")
    assert sorted(map(tuple, tables.read_csv(spark, str(path)).collect())) == [("1", ""), ("2", "3")]
    df = spark.range(3)
    for fmt in ("json", "orc", "parquet"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert tables.read_table(spark, str(tmp_path / fmt), fmt).count() == 3


def test_long_rows_stop_the_read_or_are_kept(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n1,2,3\n4,5\n6\n,,\n,\n", encoding="utf-8")
    with pytest.raises(Exception, match="too many cells"):
        tables.read_csv(spark, str(path)).select("a").collect()
    rows = {(r.a, r.b, r[tables.MALFORMED]) for r in tables.read_csv(spark, str(path), malformed="keep").collect()}
    assert rows == {("1", "2", "1,2,3"), ("4", "5", None), ("6", "", None), ("", "", ",,"), ("", "", None)}


def test_files_with_another_header_stop_the_read(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    (tmp_path / "x" / "2.csv").write_text("a,b\n3,4\n", encoding="utf-8")
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "x")).collect())) == [("1", "2"), ("3", "4")]
    (tmp_path / "x" / "3.csv").write_text("b,a\n6,5\n", encoding="utf-8")
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(tmp_path / "x")).collect()


def messy(spark):
    return spark.createDataFrame([("1", "9876543210.0", "5"), ("2", "+91 9876543211", "7"), ("2", "+91 9876543211", "7")],
                                 "user_id string, phone string, size string")


def test_bundle_and_export(spark, tmp_path):
    result = clean(messy(spark))
    sinks.write_bundle(result, str(tmp_path / "out"))
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    assert {r["phone"] for r in read("Cleaned_Data").collect()} == {"9876543210", "9876543211"}
    assert read("Cleaning_Log").count() == len(result.log)
    assert read("Data_Profile").count() == 3
    read("Outlier_Analysis")
    sinks.write_cleaned(result.data, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).count() == 2


def test_audit_summary(spark, tmp_path):
    from scrubwell.operators import profile
    before, after = profile.quality(messy(spark)), profile.quality(messy(spark).distinct())
    sinks.write_audit_summary(profile.quality_summary(before, after), str(tmp_path / "audit"))
    row = spark.read.csv(str(tmp_path / "audit"), header=True, inferSchema=True).first()
    assert (row["rows_before"], row["rows_after"]) == (3, 2)


def test_history(spark, tmp_path):
    base = str(tmp_path / "history")
    assert history.list_runs(spark, base).count() == 0 and not history.delete_run(spark, base, "x")
    result = clean(messy(spark))
    first = history.save_run(base, "a b.csv", messy(spark), result.data, result.log)
    second = history.save_run(base, "other.csv", messy(spark), messy(spark))
    assert [r["run_id"] for r in history.list_runs(spark, base).collect()] == [second, first]
    run = history.get_run(spark, base, first).first()
    assert (run["rows_before"], run["rows_after"], run["duplicates_after"]) == (3, 2, 0) and run["improvement"] > 0
    assert history.summarize_runs(spark, base).first()["runs"] == 2
    assert spark.read.parquet(run["cleaned_path"]).count() == 2
    assert history.delete_run(spark, base, first)
    assert [r["run_id"] for r in history.list_runs(spark, base).collect()] == [second]
    assert history.get_run(spark, base, first).isEmpty()
    assert history.vacuum(spark, base) == 1 and history.vacuum(spark, base) == 0
    assert not (tmp_path / "history").joinpath("snapshots", run["cleaned_path"].split("/")[-2]).exists()


def test_a_failed_run_is_found_and_a_staged_copy_released(spark, tmp_path):
    base, df = str(tmp_path / "history"), messy(spark)
    broken = df.withColumn("size", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        history.save_run(base, "x.csv", df, broken)
    assert history.list_runs(spark, base).isEmpty()
    assert history.vacuum(spark, base) == 0 and history.vacuum(spark, base, failed_after_hours=-1) == 1
    result = clean(df)
    assert result.data.count() == 2
    result.release()
    assert spark.read.parquet(result.staged).isEmpty()


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id % 1000 AS l_orderkey", "1 AS l_linenumber")
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    wide = fixtures.table(spark, str(tmp_path), "lineitem")
    tasks = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 60_000 and max(tasks) <= 2 * 60_000 / spark.sparkContext.defaultParallelism
    assert {(r["l_orderkey"], r["count"]) for r in wide.groupBy("l_orderkey").count().collect()} == {(k, 60) for k in range(1000)}
    narrow = fixtures.table(spark, str(tmp_path), "orders")
    assert narrow.groupBy(F.spark_partition_id()).count().count() == 1


def test_balanced_tables_are_not_shuffled(spark, tmp_path):
    spark.range(60_000).repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "even"))
    even = spark.read.parquet(str(tmp_path / "even"))
    assert tables.balanced(even, full_task=1) is even
    none = spark.range(0)
    assert tables.balanced(none) is none

"""Counters of a stream against the batch log."""
import pytest

from scrubwell.plans.clean import clean, fit
from scrubwell.streaming.audit import AuditListener, observed_clean, read_audit, to_folder
from scrubwell.streaming.rows import clean_stream


def _messy(spark, rows: int = 240):
    """Tokens, spellings, label variants, dates, ranges, contacts and blank rows; no two rows are equal."""
    return spark.range(rows).selectExpr(
        "CASE WHEN id % 40 = 7 THEN NULL ELSE cast(id AS string) END AS ` Order ID `",
        "CASE WHEN id % 40 = 7 THEN ' ' WHEN id % 9 = 0 THEN 'N/A' WHEN id % 5 = 0 THEN concat(' ann  lee', id) ELSE concat('Bo Ek', id) END AS Name",
        "CASE WHEN id % 40 = 7 THEN '' WHEN id % 6 = 0 THEN 'not-an-email' ELSE concat('U', id, '@Example.com') END AS Email",
        "CASE WHEN id % 40 = 7 THEN 'null' WHEN id % 8 = 0 THEN '12' ELSE concat('+91 98765 ', 10000 + id) END AS Phone",
        "CASE WHEN id % 40 = 7 THEN NULL ELSE element_at(array('Credit Card', 'credit card', 'Credit-Card', 'UPI', 'upi ', 'Cash'), cast(id % 6 AS int) + 1) END AS Payment",
        "CASE WHEN id % 40 = 7 THEN '-' WHEN id % 30 = 0 THEN 'soon' ELSE concat('2024-01-', lpad(cast(id % 28 + 1 AS string), 2, '0')) END AS order_date",
        "CASE WHEN id % 40 = 7 THEN NULL WHEN id % 50 = 0 THEN 900 ELSE 20 + id % 60 END AS Age",
        "CASE WHEN id % 40 = 7 THEN NULL WHEN id % 45 = 0 THEN 'many' ELSE concat('$', id, '.50') END AS Amount",
        "cast(NULL AS string) AS empty", "CASE WHEN id = 3 THEN 'n/a' END AS tokens_only")


def _run(spark, source, folder, plan, files):
    audit = AuditListener(to_folder(spark, f"{folder}/audit"))
    spark.streams.addListener(audit)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    query = observed_clean(stream, plan).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/ckpt").start()
    try:
        query.processAllAvailable()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        query.stop()
        spark.streams.removeListener(audit)
    return read_audit(spark, f"{folder}/audit").collect()


@pytest.mark.parametrize("files", [100, 1])
def test_counters_of_batches_equal_the_batch_log(spark, tmp_path, files):
    source, folder = _messy(spark), str(tmp_path)
    source.repartition(3).write.parquet(f"{folder}/in")
    result = clean(source, analyze_outliers=False)
    rows = _run(spark, source, folder, result.plan, files)
    total = {}
    for r in rows:
        total[r.action] = total.get(r.action, 0) + r.result
    assert len({r.batch for r in rows}) == (1 if files > 1 else 3)
    expected = {a: result.log.get(a, 0) for a in total}
    assert total == expected
    for action in ("Blank rows removed", "Rows blank after token normalization"):
        assert action in total
    assert total["Original rows"] == 240 and total["Rows blank after token normalization"] == 6
    for action in ("Missing tokens normalized (including new missing)", "Text cells whitespace/name-normalized", "Invalid Age values set to missing",
                   "Formatting-only categorical variants standardized", "Invalid emails converted to missing",
                   "Invalid numeric values converted to missing", "Invalid date values converted to missing"):
        assert total[action] > 0, action
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(map(str, out.collect())) == sorted(map(str, clean_stream(source, result.plan).collect()))


def test_observed_rows_with_awkward_names_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", " x ", 1.0), (None, "n/a", float("nan")), ("b", "y", 2.0)], "`_0` string, `__1` string, `c.d` double")
    plan, _ = fit(df)
    assert sorted(map(str, observed_clean(df, plan).collect())) == sorted(map(str, clean_stream(df, plan).collect()))
    assert observed_clean(df.limit(0), plan).collect() == []


def test_a_batch_run_again_counts_once(spark, tmp_path):
    deliver = to_folder(spark, str(tmp_path / "audit"))
    for _ in range(2):
        deliver([("q", 0, 1, "Original rows", 5)])
    deliver([("q", 1, 1, "Original rows", 7)])
    assert sorted((r.batch, r.result) for r in read_audit(spark, str(tmp_path / "audit")).collect()) == [(0, 5), (1, 7)]

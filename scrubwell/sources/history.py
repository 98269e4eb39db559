"""Run history: one appended row per run in a Parquet table, with snapshots of the original, the
cleaned data and the audit log. Deleting a run appends a tombstone; ``vacuum`` then removes the
files. Appending never rewrites, so concurrent runs do not disturb each other."""
from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta
from pathlib import PurePath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import quality
from ..operators.tables import literal_table

RUN_SCHEMA = {
    "run_id": "string", "saved_at": "string", "source_name": "string",
    "rows_before": "long", "rows_after": "long", "columns_before": "long", "columns_after": "long",
    "quality_before": "double", "quality_after": "double", "missing_before": "long", "missing_after": "long",
    "duplicates_before": "long", "duplicates_after": "long", "original_path": "string", "cleaned_path": "string",
}


BEGUN_SCHEMA = {"run_id": "string", "saved_at": "string", "folder": "string"}


def save_run(base: str, source_name: str, original: DataFrame, cleaned: DataFrame,
             log: dict[str, object] | None = None) -> str:
    """Write the snapshots, measure both tables on the snapshots, and append the run."""
    spark = original.sparkSession
    run_id, now = uuid.uuid4().hex[:12], datetime.now()
    stem = re.sub(r"[^A-Za-z0-9_-]+", "_", PurePath(source_name).stem).strip("_") or "dataset"
    folder = f"{base.rstrip('/')}/snapshots/{now:%Y-%m-%d_%H-%M-%S}_{stem}_{run_id}"
    paths = {"original": f"{folder}/original", "cleaned": f"{folder}/cleaned"}
    literal_table(spark, BEGUN_SCHEMA, [(run_id, f"{now:%Y-%m-%d %H:%M:%S.%f}", folder)]).write.mode("append").parquet(f"{base.rstrip('/')}/begun")
    original.write.parquet(paths["original"])
    cleaned.write.parquet(paths["cleaned"])
    actions = literal_table(spark, {"seq": "long", "action": "string", "result": "string"},
                            [(i, k, str(v)) for i, (k, v) in enumerate((log or {}).items(), 1)])
    actions.coalesce(1).write.parquet(f"{folder}/audit")
    before, after = (quality(spark.read.parquet(paths[p])).first() for p in ("original", "cleaned"))
    row = (run_id, f"{now:%Y-%m-%d %H:%M:%S.%f}", source_name,
           *[m[c] for c in ("rows", "columns", "quality_score", "missing_cells", "duplicate_rows")
             for m in (before, after)],
           paths["original"], paths["cleaned"])
    literal_table(spark, RUN_SCHEMA, [row]).write.mode("append").parquet(f"{base.rstrip('/')}/runs")
    return run_id


def _read(spark: SparkSession, base: str, name: str, schema: dict[str, str]) -> DataFrame:
    ddl = ", ".join(f"{c} {t}" for c, t in schema.items())
    try:
        return spark.read.schema(ddl).parquet(f"{base.rstrip('/')}/{name}")
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return literal_table(spark, schema, [])


def list_runs(spark: SparkSession, base: str) -> DataFrame:
    """Runs that are not deleted, newest first."""
    deleted = _read(spark, base, "deleted", {"run_id": "string"})
    return _read(spark, base, "runs", RUN_SCHEMA).join(deleted, "run_id", "left_anti").orderBy(
        F.desc("saved_at"), "run_id")


def summarize_runs(spark: SparkSession, base: str) -> DataFrame:
    """Number of runs, score of the latest, number of datasets."""
    return list_runs(spark, base).agg(
        F.count(F.lit(1)).alias("runs"), F.max_by("quality_after", "saved_at").alias("latest_score"),
        F.countDistinct("source_name").alias("datasets"))


def get_run(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """One run with its gain in score; no row when it is unknown or deleted."""
    return list_runs(spark, base).where(F.col("run_id") == run_id).withColumn(
        "improvement", F.col("quality_after") - F.col("quality_before"))


def delete_run(spark: SparkSession, base: str, run_id: str) -> bool:
    if get_run(spark, base, run_id).isEmpty():
        return False
    literal_table(spark, {"run_id": "string"}, [(run_id,)]).write.mode("append").parquet(f"{base.rstrip('/')}/deleted")
    return True


def vacuum(spark: SparkSession, base: str, failed_after_hours: float = 24.0) -> int:
    """Remove the snapshot folders of deleted runs, and of runs that began but were not recorded
    within some hours; returns how many were removed. Folders are removed through the driver's
    file systems, which a remote client does not have; all else here is reading and writing."""
    runs, deleted = _read(spark, base, "runs", RUN_SCHEMA), _read(spark, base, "deleted", {"run_id": "string"})
    old = f"{datetime.now() - timedelta(hours=failed_after_hours):%Y-%m-%d %H:%M:%S.%f}"
    begun = _read(spark, base, "begun", BEGUN_SCHEMA)
    failed = begun.where(F.col("saved_at") < old).join(runs, "run_id", "left_anti")
    removed = 0
    for r in begun.join(deleted, "run_id", "left_semi").union(failed).distinct().toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(r["folder"])
        removed += folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return removed

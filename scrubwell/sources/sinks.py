"""Writers for cleaned data, the report bundle and the audit record, and a row preview."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import names, text, vocab
from ..operators.outliers import outlier_report
from ..operators.profile import profile
from ..operators.tables import col
from ..plans.clean import CleanResult


def prepare_export(df: DataFrame) -> DataFrame:
    """Contact columns as text without an accidental ``.0`` tail."""
    def ready(f):
        if names.column_key(f.name) not in vocab.EXPORT_CONTACT_KEYS:
            return col(f.name)
        return text.strip_decimal_zero(col(f.name).cast("string")).alias(f.name)
    return df.select(*[ready(f) for f in df.schema])


def _write(df: DataFrame, path: str, format: str, mode: str) -> None:
    options = {"header": True, "escape": '"'} if format == "csv" else {}
    df.write.format(format).options(**options).mode(mode).save(path)


def write_cleaned(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Write in as many files as the data has partitions; nothing is gathered in one task."""
    _write(prepare_export(df), path, format, mode)


def write_bundle(result: CleanResult, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Cleaned_Data, Cleaning_Log, Data_Profile and Outlier_Analysis side by side under one path."""
    for name, table in (("Cleaned_Data", prepare_export(result.data)), ("Cleaning_Log", result.audit()),
                        ("Data_Profile", profile(result.data)), ("Outlier_Analysis", outlier_report(result.data))):
        _write(table, f"{path}/{name}", format, mode)


def write_audit_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The one-row before/after record as CSV."""
    _write(summary.coalesce(1), path, "csv", mode)


def preview(df: DataFrame, rows: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """The first rows; which ones is only promised with ``order_by``."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)

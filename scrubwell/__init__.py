"""Data quality and cleaning for tables of unknown schema, on Spark DataFrames."""
from .operators.findings import report
from .operators.outliers import outlier_report, outliers
from .operators.profile import duplicate_count, missing_by_column, profile, quality
from .plans.clean import CleaningPlan, CleanResult, clean, fit

__all__ = ["CleaningPlan", "CleanResult", "clean", "fit", "report", "outlier_report", "outliers",
           "duplicate_count", "missing_by_column", "profile", "quality"]
